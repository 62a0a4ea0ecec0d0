import re
from collections import Counter

from slateql.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_against_brute_force(spark):
    texts = [None, "", " \t\n", "a", "a b a b a b a b", "a a a", "x\n\nx\n \nx\ny", "é é\u00a0é # |<>", "one two three " * 40, "w" * 5000, " ".join(f"w{i % 7}" for i in range(20_000)), "b\x0bc\x0cd\re", "\U0001f600 \u2003 x"]
    df = spark.createDataFrame([(i, t, 1, "a") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, h string")
    for r in quality.judge(df).collect():
        n, chars, symbols, dup, repeat = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat), texts[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)


def test_rules_name_what_failed(spark):
    rules = (quality.Rule("long", "n_words", least=3), quality.Rule("clean", "symbol_ratio", most=0.5))
    df = spark.createDataFrame([(1, "a b c"), (2, "# # #"), (3, "#")], "doc_id long, text string")
    assert {r.doc_id: r.failed_rules for r in quality.judge(df, rules).collect()} == {1: [], 2: ["clean"], 3: ["long", "clean"]}


def test_no_user_functions(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert "Python" not in quality.judge(df)._jdf.queryExecution().executedPlan().toString()


def test_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_names_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c", 5, True, "x")] * 2, "doc_id long, text string, n_words int, KEPT boolean, __s string")
    found = quality.judge(df, keep=("doc_id", "n_words", "KEPT", "__s", "text")).collect()
    assert len(found) == 2 and found[0] == found[1]
    assert (found[0].input_n_words, found[0].input_KEPT, found[0]["__s"], found[0].n_words, found[0].kept) == (5, True, "x", 3, False)
    assert quality.measure(df, keep=("n_words",)).columns[:2] == ["input_n_words", "n_words"]
