"""Quality rules: a threshold table compiled into one projection, without user functions.

``measure`` computes the text statistics, ``Rule`` names one of them with its
bounds, and ``judge`` turns a table of rules into boolean columns. Everything
is a column expression over the row, so there is no shuffle, and a long text
costs n log n for its repeated word windows.

Windows of words are equal if their 64-bit hashes are: in a text of n windows some two different ones
are taken for equal with probability n^2 / 2^65, 3e-8 for a million words.

Defined cases: null and empty texts have no words and every statistic 0;
ratios of nothing are 0. Such texts fail the base rule. Repeated rows are
judged one by one, whole texts whatever their length. An empty table gives no rows. A ``keep`` column named like
a column of the result is returned as ``input_...``; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateql.llm.exprs import BLANKS, indices, kept_as, let, words

SYMBOLS = "#*$%&|<>"

# Frequent function words of the four corpus languages.
STOP_WORDS = tuple(
    "the of and to in is that it for was on be with as at this from are or by an not"
    " der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es"
    " le la les de des et en un une du que qui dans est pour pas au sur par plus avec"
    " el los las y que del se por con una para es al lo como más".split()
)


def _at(statistic: str) -> Column:
    """A statistic, under its name between the projections."""
    return F.col(f"__s_{statistic}")


@dataclass(frozen=True)
class Rule:
    """A statistic has to lie within [least, most]."""

    name: str
    statistic: str
    least: float | None = None
    most: float | None = None

    def passes(self) -> Column:
        value, ok = _at(self.statistic), F.lit(True)
        if self.least is not None:
            ok = ok & (value >= self.least)
        if self.most is not None:
            ok = ok & (value <= self.most)
        return ok


#: Production thresholds.
RULES = (
    Rule("length", "n_words", least=50),
    Rule("word_length", "mean_word_chars", least=2, most=14),
    Rule("symbols", "symbol_ratio", most=0.3),
    Rule("shouting", "mark_ratio", most=0.5),
    Rule("stop_words", "stop_ratio", least=0.04),
    Rule("lines", "dup_line_ratio", most=0.5),
)


def _covered(ws: Column) -> Column:
    """How many words stand in 3-word windows found at least twice in the text.

    Windows are compared by a 64-bit hash; equal ones meet as neighbours after a sort.
    """
    hashed = F.transform(indices(F.size(ws) - 2), lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")))

    def twice(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, k)["h"] == F.get(s, j)["h"], F.lit(False))
        at = F.filter(indices(F.size(s)), lambda k: same(k, k - 1) | same(k, k + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda k: let(F.get(s, k)["i"], lambda i: F.array(i, i + 1, i + 2))))))

    return let(F.sort_array(hashed), twice)


def _measured(df: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """__k0, ..., the kept columns, and __s_..., the statistics of each row's text."""
    t = F.coalesce(F.col("__t"), F.lit(""))
    keys = [f"__k{i}" for i in range(len(keep))]
    got = df.select(*[F.col(c).alias(k) for k, c in zip(keys, keep)], F.col(text).alias("__t")).withColumn("__w", words(F.col("__t")))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    n = {
        "n_words": F.size("__w"),
        "word_chars": F.length(F.translate(t, BLANKS, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_lines": let(lines, F.size),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": let(F.col("__w"), _covered),
        "n_marks": F.length(t) - F.length(F.translate(t, "!|", "")),
        "n_stop_words": F.size(F.filter(F.col("__w"), lambda w: F.lower(w).isin(*STOP_WORDS))),
    }
    counted = got.select(*keys, *[v.cast("bigint").alias(f"__s_{k}") for k, v in n.items()])
    ratio = lambda a, b: F.when(_at(b) > 0, _at(a) / _at(b)).otherwise(F.lit(0.0))
    return counted.select("*", *[ratio(*of).alias(f"__s_{name}") for name, of in RATIOS.items()])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_marks", "n_stop_words")
#: ratio -> what is divided by what
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "mark_ratio": ("n_marks", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
}


STATISTICS = (*COUNTS, *RATIOS)


def measure(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and the statistics of each row's text."""
    return _measured(df, text, keep).select(*kept_as(keep, STATISTICS), *[_at(s).alias(s) for s in STATISTICS])


def base_failed() -> Column:
    return (_at("n_words") < 50) | (100 * _at("n_repeat_words") > 50 * _at("n_words"))


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``measure``'s columns, base_failed, the names of the failed rules, and kept."""
    failed = F.filter(F.array(*[F.when(~r.passes(), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    verdict = _measured(df, text, keep).withColumns({"__base": base_failed(), "__failed": failed})
    last = {"base_failed": F.col("__base"), "failed_rules": F.col("__failed"), "kept": ~F.col("__base") & (F.size("__failed") == 0)}
    return verdict.select(*kept_as(keep, (*STATISTICS, *last)), *[_at(s).alias(s) for s in STATISTICS], *[v.alias(k) for k, v in last.items()])
