import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from slateql.llm import toxicity as T

INSULTS = ["idiot", "moron", "trash", "scum"]
WORDS = "the of river stone walks under green light paper house tree often many small great".split()


def corpus(seed, n):
    rng, out = random.Random(seed), []
    for k in range(n):
        bad = k % 3 == 0
        words = [rng.choice(INSULTS) if bad and rng.random() < 0.08 else rng.choice(WORDS) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(40, 120))]
        out.append((". ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + ".", int(bad)))
    return out


@pytest.fixture(scope="module")
def model():
    data = corpus(1, 300)
    return T.fit([t for t, _ in data], [y for _, y in data])


def scores(model, texts):
    return model.score(np.array([T.statistics(v, model.bias, model.cuts) for v in T.WordValues(model).of(texts)]))


def test_held_out_accuracy(model):
    data = corpus(2, 200)
    found = scores(model, [t for t, _ in data])
    y = np.array([y for _, y in data])
    assert ((found >= 0.7) == y).mean() > 0.95
    assert ((0 <= found) & (found <= 1)).all()


def test_gapped_and_inserted_characters(model):
    plain = " ".join(WORDS * 4)
    for word in ("i.d.i.o.t", "id-iot", "tra*sh", "mor0on"):
        hidden = plain.replace("river", word).replace("stone", word)
        assert scores(model, [hidden])[0] > scores(model, [plain])[0] + 0.1, word


def test_kernel_equals_brute_force():
    def features(word):
        s, out = "^" + word + "$", {}
        for offsets, weight in zip(T._OFFSETS, T._WEIGHTS):
            for i in range(len(s) - offsets[-1]):
                u = tuple(s[i + o] for o in offsets)
                out[u] = out.get(u, 0) + weight
        return out

    words = ["idiot", "idioot", "i.diot", "banana", "xyz", "a", ""]
    norms = T._norms(T._codes(words))
    got = T.kernel_to(words, words[:4])
    for i, v in enumerate(words):
        for j, w in enumerate(words[:4]):
            a, b = features(v), features(w)
            wanted = sum(x * b.get(u, 0) for u, x in a.items()) / norms[i] / norms[j]
            assert abs(got[i, j] - wanted) < 0.02, (v, w)


def test_collapsed_table_equals_the_kernel_machine(model):
    words = [*model.landmarks, "idiot" * 7, "i.d.i.o.t", "banana", "é" * 30, "a", ""]
    wanted = T.kernel_to(words, list(model.landmarks)) @ model.beta
    assert np.abs(model.values(words) - wanted).max() < 1e-3 * np.abs(wanted).max()
    assert np.isfinite(model.values(["idiot" * 30, "é" * 100])).all()


def test_scores_equal_brute_force(spark, model):
    """Every document's score again, from the landmarks and word by word."""
    texts = [t for t, _ in corpus(5, 40)] + ["", "one word", "No end\nof line! \"Quoted idiot.\" (more) 1,2", "you i d i o t are", "w" * 300]

    def values_of(word):
        pieces = [word[i : i + T.LONGEST] for i in range(0, max(1, len(word)), T.LONGEST)]
        return float((T.kernel_to(pieces, list(model.landmarks)) @ model.beta).sum())

    wanted = []
    for text in texts:
        text = re.sub(r"(?<!\w)[^\W\d_]( [^\W\d_](?!\w)){2,}", lambda m: m[0].replace(" ", ""), text)
        sentences, now = [], []
        for line in text.split("\n"):
            for w in line.split(" "):
                now.append(values_of(w.strip(T._TRIM).lower()))
                if w.rstrip("\"')]}*#$%&|<>")[-1:] in (".", "!", "?") and w.rstrip("\"')]}*#$%&|<>"):
                    sentences.append(now)
                    now = []
        sentences += [now] if now else []
        flat = np.array([v for x in sentences for v in x])
        means = np.array([np.mean(x) + model.bias for x in sentences])
        stats = [float((flat > c).mean()) for c in model.cuts] + [float(np.maximum(flat - model.cuts[0], 0).mean()), means.mean(), np.maximum(means, 0).mean(), means.max()]
        z = np.dot((np.array(stats) - model.scale[:, 0]) / model.scale[:, 1], model.logistic[:-1]) + model.logistic[-1]
        wanted.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.score for r in T.score(df, model).orderBy("doc_id").collect()]
    assert np.abs(np.array(found) - wanted).max() < 0.02


def test_spaced_letters():
    assert T.joined("you i d i o t! and a b c_ or a b") == "you idiot! and a b c_ or a b"
    assert T.joined("x y z") == "xyz" and T.joined("a 1 b 2") == "a 1 b 2" and T.joined("") == ""


def test_spaced_insults(model):
    plain = " ".join(WORDS * 4)
    hidden = plain.replace("river", "i d i o t").replace("stone", "s c u m")
    assert scores(model, [hidden])[0] > scores(model, [plain])[0] + 0.1


def test_long_documents_and_repeated_ids(spark, model):
    long = " ".join(WORDS * 20_000)
    df = spark.createDataFrame([(1, long), (2, long + " idiot scum" * 30_000)], "doc_id long, text string")
    a, b = (r.score for r in T.score(df, model).orderBy("doc_id").collect())
    assert a < 0.5 < b
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    assert T.training_sample(docs, labels, 5, 5, 100, "doc_id", "text", "toxic") in ([("text 0", 1), ("other", 0)], [("other", 0), ("text 0", 1)])


def test_query_shape_and_defined_cases(spark, model):
    rows = [(1, None, 0.5), (2, "", 0.5), (3, "word", 0.5), (3, "word", 0.5), (None, "idiot", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    found = sorted(((r.doc_id or -1), r.score) for r in T.score(df, model).collect())
    assert len(found) == 5 and found[1][1] == found[2][1] and found[3] == found[4]
    assert all(0 <= s <= 1 for _, s in found)
    assert T.score(df.limit(0), model).count() == 0
    kept = T.score(df, model, keep=("doc_id", "text", "score"), name="__score")
    assert kept.columns == ["doc_id", "text", "score", "__score"]
    assert T.score(df, model, keep=("doc_id", "score")).columns == ["doc_id", "input_score", "score"]
    assert not spark.range(1).select(F.lit(None).cast("long").alias("doc_id")).select(T.held_out().alias("h")).first().h


def test_training_needs_both_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (2, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = T.train(docs, labels)
    assert {r.score for r in T.score(docs, model).collect()} == {1.0}
    assert {r.score for r in T.score(docs, T.train(docs, labels.limit(0))).collect()} == {0.0}


def test_held_out_rows(spark):
    got = {r.id: r.h for r in spark.range(200).select("id", T.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}
