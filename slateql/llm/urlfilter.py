"""URL allow/block filter: a broadcast trie over reversed host labels and path segments.

The trie descends the host from its last label (``org`` -> ``example`` -> ...),
and at every host node that carries rules it descends the path, one segment at a
time; a rule's last segment may be partial (``/en/1`` fits ``/en/12``). The
deepest host node with a fitting rule wins, and below it the longest path, so a
longer allow entry re-opens part of a block entry and the other way round. A rule
without a host (``/ads/``) lies at the root and fits every host.

The trie is flat: edges in one dictionary by (node, label), and at each path node the partial
segments in order, each with the longest of its own prefixes, so a bisection and a walk along prefixes
finds the longest that fits. It is built once on the driver, broadcast as it is, and kept by a worker.
Its size is bounded by ``max_broadcast_rules``; more rules are joined by host suffix.

Defined cases: a null url, or one without ``://``, has an empty host and path
and fits only rules without a host and a path, which are refused, as are entries without a verdict. Of two rules with the same host and path the allow entry
holds. A url without a fitting rule gets ``default``. Every input row yields
exactly one output row, repeated rows included; urls count whole, whatever their length. An empty table, or no rules,
is fine. A ``keep`` column named like a column of the result (host, path, rule, verdict) is returned as ``input_...``.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slateql.llm.exprs import ascii_lower, kept_as
from slateql.llm.process import per_process

#: Above this many rules the trie is not broadcast; rules are joined instead.
MAX_BROADCAST_RULES = 500_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, verdict: str, entry: str) -> Rule:
        """``example.org/es/`` -> host ``example.org``, path ``/es/``."""
        host, slash, path = entry.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict must be allow or block, not {verdict!r}")
        if not entry:
            raise ValueError("a rule names a host, a path or both")
        return cls(verdict, host.lower(), slash + path)


class UrlTrie:
    """Longest-match lookup of (host, path), in plain dictionaries and lists."""

    def __init__(self, rules: Iterable[Rule]):
        self.hosts: dict[tuple[int, str], int] = {}
        self.segments: dict[tuple[int, str], int] = {}
        self.anywhere: dict[int, tuple[str, str]] = {}  # host node -> its rule with an empty path
        self.roots: dict[int, int] = {}  # host node -> its path node
        nodes, ends = 1, {}
        for rule in sorted(rules, key=lambda r: r.verdict == "allow"):  # allow is written last
            node, found = 0, (rule.name, rule.verdict)
            for label in reversed(rule.host.split(".")) if rule.host else ():
                at = self.hosts.setdefault((node, label), nodes)
                nodes += at == nodes
                node = at
            if not rule.path:
                self.anywhere[node] = found
                continue
            at = self.roots.setdefault(node, nodes)
            nodes += at == nodes
            *whole, partial = rule.path.removeprefix("/").split("/")
            for segment in whole:
                to = self.segments.setdefault((at, segment), nodes)
                nodes += to == nodes
                at = to
            ends.setdefault(at, {})[partial] = found
        #: path node -> partial last segments in order, each one's longest prefix among them, and their rules
        self.ends = {at: (keys := sorted(own), _prefixes(keys), [own[k] for k in keys]) for at, own in ends.items()}

    def _in_paths(self, node: int, path: str):
        best, rest = None, path[1:]
        while True:
            if node in self.ends:
                keys, up, found = self.ends[node]
                k = bisect_right(keys, rest) - 1
                while k >= 0 and not rest.startswith(keys[k]):
                    k = up[k]
                best = found[k] if k >= 0 else best
            segment, slash, rest = rest.partition("/")
            node = self.segments.get((node, segment)) if slash else None
            if node is None:
                return best

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, 0
        labels = iter(host.split(".")[::-1] if host else ())
        while node is not None:
            found = self.anywhere.get(node)
            if node in self.roots and path.startswith("/"):
                found = self._in_paths(self.roots[node], path) or found
            best = found or best
            label = next(labels, None)
            node = self.hosts.get((node, label)) if label is not None else None
        return best


def _prefixes(keys: list[str]) -> list[int]:
    """For each of the sorted keys the index of the longest other one that it starts with, or -1."""
    out, open_ = [], []
    for k, key in enumerate(keys):
        while open_ and not key.startswith(keys[open_[-1]]):
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(k)
    return out


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``; A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _by_trie(spark: SparkSession, df: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    shared, name = spark.sparkContext.broadcast(vars(UrlTrie(rules))), f"url trie {uuid.uuid4()}"

    def made() -> UrlTrie:
        trie = UrlTrie(())
        vars(trie).update(shared.value)
        return trie

    @F.pandas_udf("struct<rule string, verdict string>")
    def lookup(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = per_process(name, made).match
        found = [match(h, p) or (None, default) for h, p in zip(host, path)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    return df.withColumn("__m", lookup("__host", "__path"))


def _by_join(spark: SparkSession, df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Rules beyond the broadcast bound: an equi-join on every host suffix, the empty one included, of the distinct (host, path) pairs."""
    pairs = df.select("__host", "__path").distinct()
    labels = F.split("__host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(0), n), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("suffix")))
    tried = pairs.withColumn("__s", F.explode(suffixes)).select("__host", "__path", "__s.depth", "__s.suffix")
    best = F.struct("depth", F.length("r_path").alias("n"), (F.col("r_verdict") == "allow").alias("allow"), "r_name", "r_verdict")
    found = (
        tried.join(rules, F.col("suffix") == F.col("r_host"))
        .where(F.col("__path").startswith(F.col("r_path")))
        .groupBy("__host", "__path")
        .agg(F.max(best).alias("__b"))
        .select("__host", "__path", F.struct(F.col("__b.r_name").alias("rule"), F.col("__b.r_verdict").alias("verdict")).alias("__m"))
    )
    none = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return df.join(found, ["__host", "__path"], "left").withColumn("__m", F.coalesce("__m", none))


def filter_urls(
    df: DataFrame,
    rules: Iterable[Rule],
    url: str = "url",
    keep: Iterable[str] = (),
    default: str = "allow",
    max_broadcast_rules: int = MAX_BROADCAST_RULES,
) -> DataFrame:
    """One row per input row: the ``keep`` columns, then host, path, rule and verdict."""
    spark = df.sparkSession
    rules = list(dict.fromkeys(rules))
    keep = list(keep)
    taken = df.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], host_of(F.col(url)).alias("__host"), path_of(F.col(url)).alias("__path"))
    if len(rules) <= max_broadcast_rules:
        out = _by_trie(spark, taken, rules, default)
    else:
        table = spark.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "r_host string, r_path string, r_name string, r_verdict string")
        out = _by_join(spark, taken, table, default)
    return out.select(
        *kept_as(keep, ("host", "path", "rule", "verdict")),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__m.rule").alias("rule"),
        F.col("__m.verdict").alias("verdict"),
    )
