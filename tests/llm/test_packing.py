import os
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

from slateql.llm.packing import PackingPlan, WordIds, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def encoded(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_word_ids_equal_the_tokenizer():
    rng, words, tokenizer = random.Random(1), WordIds(PATH, limit=300), Tokenizer.from_file(PATH)
    letters = [chr(c) for c in range(32, 256)] + list("İıſΣςÿẞ日本\u0301\u0345\u2028\u200b'..,,\t\n\r\x0b")
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(15)))
        assert words.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert len(words.ids) <= 400


def built(tmp_path, fold, cut):
    model = models.BPE({c: k for k, c in enumerate([chr(k) for k in range(33, 127)] + ["ab", "AB", "cd", "Ġ"])}, [("a", "b"), ("A", "B"), ("c", "d")])
    made = Tokenizer(model)
    made.normalizer = normalizers.Lowercase() if fold else None
    made.pre_tokenizer = cut
    made.save(str(tmp_path / "t.json"))
    return str(tmp_path / "t.json"), made


def test_cased_tokenizers_and_those_that_keep_spaces(tmp_path):
    path, made = built(tmp_path, False, pre_tokenizers.Whitespace())
    assert WordIds(path).encode("AB ab Ab, cd") == np.array(made.encode("AB ab Ab, cd").ids, "<u4").tobytes()
    path, _ = built(tmp_path, True, pre_tokenizers.ByteLevel(add_prefix_space=False))
    with pytest.raises(ValueError):
        WordIds(path)


@pytest.mark.parametrize("window", [500, 2_000_000])
def test_round_trip(spark, window):
    rng = random.Random(4)
    texts = [None, "", "x", "a b", "word " * 9000, "é" * 50_000] + [" ".join(rng.choice(["alpha", "beta", "gamma,", "x1"]) for _ in range(rng.randrange(600))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)] + [(None, "null id", 0, 0)], "doc_id long, text string, start int, tier int").repartition(3)
    found = pack_documents(df, PATH, PackingPlan(window_tokens=window)).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in [*enumerate(texts), (None, "null id")]:
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist()
        assert ids == encoded(t or "") + [2]
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces[:-1]]).tolist()
        assert {p.doc_tokens for p in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        lengths = [p.length for p in pieces]
        assert [p.offset for p in pieces] == np.cumsum([0] + lengths[:-1]).tolist()
        assert sum(lengths) <= 4096 and sum(lengths).bit_count() == 1  # no padding at all
    groups = {}
    for pieces in by_sequence.values():
        if pieces[0].step_group is not None:
            groups.setdefault(pieces[0].step_group, []).append(sum(p.length for p in pieces))
    assert all(len(set(g)) == 1 and sum(g) <= 65_536 for g in groups.values())


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_plan_is_checked():
    for tiers in ((100,), (512, 1024), (512, 512)):
        with pytest.raises(ValueError):
            PackingPlan(tiers=tiers)


def test_vocabulary_is_not_in_the_repository():
    assert os.path.dirname(PATH) not in os.getcwd()


def test_sequences_follow_the_files(spark, tmp_path):
    """Files of very unequal size come to tasks by size, their sequences are numbered in the order of the rows all the same."""
    rng, rows = random.Random(3), []
    for k, size in enumerate([5, 400, 3, 90, 250, 1]):
        rows += [(1000 * k + i, " ".join(rng.choice("abc") for _ in range(200)), k) for i in range(size)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int")
    df.repartitionByRange(6, "k").sortWithinPartitions("doc_id").write.option("compression", "none").parquet(str(tmp_path / "d"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in (("spark.sql.files.maxPartitionBytes", "60k"), ("spark.sql.files.openCostInBytes", "1k")):
            spark.conf.set(k, v)
        docs = spark.read.parquet(str(tmp_path / "d"))
        first = [r[0] // 1000 for r in docs.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id")).orderBy("p").select(F.col("min(doc_id)")).collect()]
        assert first != sorted(first)  # tasks do not follow the files
        found = pack_documents(docs, PATH, PackingPlan(window_tokens=2_000), in_file_order=True).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    file_of = {r.doc_id: r.file_name for r in docs.select("doc_id", "_metadata.file_name").collect()}
    order = [file_of[r.doc_id] for r in sorted(found, key=lambda r: (r.sequence_id, r.offset))]
    assert order == sorted(order) and len(set(order)) > 3 and {r.doc_id for r in found} == {r[0] for r in rows}
    assert len({(r.sequence_id, r.offset) for r in found}) == len(found)
    groups = {}
    for r in found:
        if r.step_group is not None:
            groups.setdefault(r.step_group, {}).setdefault(r.sequence_id, r.tier)
    assert all(min(g) == name and len(set(g.values())) == 1 and len(g) <= 65_536 // next(iter(g.values())) for name, g in groups.items())
