import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pytest
import test_linededup
import test_mixing
import test_neardup
from pyspark import TaskContext
from slateql.llm import mixing, process, toxicity
from slateql.sources.shared import remove_folders
from tokenizers import Tokenizer

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in "nrst"]
    prose = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(5, 15))) for _ in range(n))
    docs = [prose(rng.randrange(2, 30)) for _ in range(120)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs[50] = docs[20]  # an exact copy
    docs[60] += "\n" + passage
    docs[61] = passage + "\n" + docs[61]
    near = " ".join(rng.choice(words) for _ in range(300)).split()
    docs[70] = " ".join(near)
    near[150] = "changed"
    docs[71] = " ".join(near)  # one long line: only near-dedup can tell
    for k in range(90, 120):
        docs[k] = docs[k].replace("\n", " idiot scum\n") + " idiot moron"
    docs[0], docs[1] = None, ""
    rows = [(k, t, "en", f"src{k % 5}", len(t or "")) for k, t in enumerate(docs)]
    labels = [(k, 1, int(k >= 90)) for k in range(2, 120)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, folder, tmp_path):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        assert name == "packing" or out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = set(range(90))
    assert len(clean - ids["toxicity"]) <= 1 and len(ids["toxicity"] - clean) <= 2
    cut = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert 50 not in cut and cut[20].text == texts[20]
    assert cut[60].text == texts[60] and cut[61].text == texts[61].split("\n", 1)[1] and cut[61].n_chars == len(cut[61].text)
    assert cut[0].text is None and cut[1].text == ""
    assert ids["line_dedup"] - ids["near_dedup"] == {71}
    assert ids["near_dedup"] == ids["mixing"] == ids["packing"]
    assert docs.selectExpr("sum(length)").first()[0] == docs.groupBy("doc_id").agg({"doc_tokens": "max"}).selectExpr("sum(`max(doc_tokens)`)").first()[0]


def test_every_stage_against_brute_force(spark, folder, tmp_path):
    """What each stage makes of its own input, done again document by document."""
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet").where(~toxicity.held_out()))
    tokenizer = Tokenizer.from_file(corpus_pipeline.settings.TOKENIZER)
    for name, stage in corpus_pipeline.STAGES:
        before = sorted(((r.doc_id, r.text, r.source) for r in docs.collect()))
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = docs.collect()
        if name == "toxicity":
            values = toxicity.WordValues(model).of([t or "" for _, t, _ in before])
            score = model.score(np.array([toxicity.statistics(v, model.bias, model.cuts) for v in values]))
            wanted = [r for r, s in zip(before, score) if s < 0.7]
        elif name == "line_dedup":
            cut = {i: t for i, t, _ in test_linededup.brute([(i, t) for i, t, _ in before if t is not None], 25)}
            wanted = [(i, cut.get(i), s) for i, t, s in before if not t or cut[i] == t or 100 * len(cut[i]) > 20 * len(t)]
            assert wanted != before
        elif name == "near_dedup":
            found = test_neardup.brute([(i, t) for i, t, _ in before], 80)
            wanted = [r for r in before if found[r[0]][2]]
            assert wanted != before
        elif name == "mixing":
            wanted, weights = before, [*corpus_pipeline.settings.SOURCE_WEIGHTS.values(), corpus_pipeline.settings.OTHER_WEIGHT]
            sizes = Counter(s for *_, s in before)
            names = list(corpus_pipeline.settings.SOURCE_WEIGHTS)
            slots = test_mixing.brute([-(-sizes[s] // 16) for s in names] + [0], weights)
            rows = [r.source for r in docs.orderBy("_metadata.file_name", "_metadata.row_index").collect()]
            for t in sorted(slots):
                source = names[slots[t][0]]
                n = min(16, sizes[source] - 16 * slots[t][1])
                assert rows[:n] == [source] * n
                del rows[:n]
            assert not rows
        else:
            ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for i, t, _ in before}
            assert {r.doc_id for r in after} == set(ids)
            for r in after:
                own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
                assert r.ids_crc32 == zlib.crc32(own) and r.doc_tokens == len(ids[r.doc_id])
            assert sum(r.length for r in after) == sum(map(len, ids.values()))
            continue
        assert sorted((r.doc_id, r.text, r.source) for r in after) == wanted, name


def test_run_and_empty_tables(spark, folder, tmp_path):
    path, _ = folder
    remove_folders(spark, 0)
    assert corpus_pipeline.run(spark, path).count() > 0
    assert remove_folders(spark, 0) == 1  # only the last stage's was left
    assert corpus_pipeline.ORACLE_SQL is None
    for t in ("documents", "labels"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_residues_of_near_copies_go(spark, folder):
    path, _ = folder
    lines = [f"line {k} of a longer document with words" for k in range(20)]
    rows = [(1, "\n".join(lines)), (2, "\n".join([*lines[:18], "own words"])), (3, "\n".join([*lines[:5], *(f"own line {k} of a longer one" for k in range(9))])), (4, None), (5, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    found = {r.doc_id: r for r in corpus_pipeline.line_dedup_stage(spark, df, path).collect()}
    assert set(found) == {1, 3, 4, 5} and found[3].text == rows[2][1].split("\n", 5)[5] and found[3].n_chars == len(found[3].text)


def test_packing_follows_the_mixture(spark, tmp_path):
    """Over several files, the sources' shares hold at any length of the packed sequences."""
    rows = [(k, " ".join(["word"] * 30), "en", f"src{k % 4}" if k % 3 else "src0", 150) for k in range(4000)]
    docs = spark.createDataFrame(rows, COLUMNS)
    corpus_pipeline.mixing_stage(spark, docs, "").write.parquet(f"{tmp_path}/m")
    pieces = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{tmp_path}/m"), "")
    source = {k: s for k, _, _, s, _ in rows}
    order = [source[r.doc_id] for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    share = {f"src{k}": w / 10 for k, w in enumerate((1, 2, 3, 4))}
    for n in range(200, 1600, 100):
        for s, w in share.items():
            assert abs(order[:n].count(s) - w * n) < 16 * 4, (n, s)  # blocks of 16 documents, moved by a window of packing


def test_extra_columns_with_clashing_names(spark, folder, tmp_path):
    path, _ = folder
    extra = spark.read.parquet(f"{path}/documents.parquet").selectExpr("*", "1 AS score", "2 AS component_id", "3 AS h", "4 AS id", "5 AS kept", "6 AS a", "7 AS n")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        extra = stage(spark, extra, path)
        assert extra.columns[-7:] == ["score", "component_id", "h", "id", "kept", "a", "n"], name
        extra.write.parquet(f"{tmp_path}/{name}")
        extra = spark.read.parquet(f"{tmp_path}/{name}")
    assert extra.select("score", "n").distinct().collect() == [(1, 7)]


def test_training_never_reads_held_out_labels(spark, folder):
    path, _ = folder
    labels = spark.read.parquet(f"{path}/labels.parquet").where(~toxicity.held_out())
    assert labels.where(toxicity.held_out()).count() == 0


def test_workers_keep_no_free_memory_or_unused_cache(spark, folder, monkeypatch):
    frame, shipped = type(spark.range(0)), []
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, f, *a, **b: shipped.append(f) or real(self, f, *a, **b))
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder[0])
    assert len(shipped) >= 7
    held = lambda: int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    monkeypatch.setattr(TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    for f in shipped:
        process.per_process("of another stage", list)
        blocks = [bytearray(100_000) for _ in range(600)]
        del blocks[:-1]  # 60 MB are free below the last one
        before = held()
        list(f(iter([])))
        assert before - held() > 40
        assert sys.modules["slateql_worker_cache"].key != "of another stage"


@pytest.mark.parametrize("weights", [{"a": 1, "b": 3}, {"a": 0.0001, "b": 1.2345}])
def test_mixing_starts_no_further_workers(spark, weights):
    docs = spark.range(50).selectExpr("id AS doc_id", "array('a', 'b', 'c')[id % 3] AS source")
    mixed = mixing.mix(docs, weights, longest=64)
    assert "ExistingRDD" not in mixed._jdf.queryExecution().toString()
    assert mixed.count() == 50
