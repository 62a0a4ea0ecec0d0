"""Line dedup: pairwise alignment of documents that share rare lines.

A document is the sequence of its lines with words; a common block of two
documents is a run of lines, adjacent in both, of ``min_words`` words or more.
A block goes from the later document, the one of the larger id. Lines that lie in
blocks with several earlier documents go as well, but no block is made of lines
that stand together in no earlier document.

Pairs. A line is rare if it occurs at most ``RARE`` times in all documents; every
later holder of a rare line is paired with all earlier ones, at most ``RARE`` - 1. Blocks of
common lines alone are found by windows: the shortest runs of ``min_words`` or
more words from each line on and up to each line, which depend on the lines alone and cover
every longer run. Every later holder of a window is paired with its first holder. So
the pairs grow with the lines, not with the square of a group of copies, and
yet every line in a block with any earlier document is in a block with a paired one.

Alignment. Each pair is aligned by a patience diff over all its common lines: lines that
occur once in both are anchors, the longest increasing run of anchors is kept,
matches grow from them through equal neighbours, and the gaps between are aligned alike by
lines unique in the gap. Blocks that a diff leaves out, because they moved, repeat or
overlap others, are then looked up by their windows. This takes n log n of the lines,
repeated ones included.

Lines are compared as they are, by 128 bits of two hashes. Blank lines inside a deleted run go with it.

Scale. One scan reduces every text to hashes; lines are counted with partial
aggregation; a document's shared lines are gathered by document, and a pair's task holds two
of these. Joins by line, window or partner are plain sort-merge joins or broadcasts of a checked size, so
adaptive execution splits a hot key. The texts themselves are read again only to cut them, and
not shuffled unless the cuts are too many to broadcast.

Defined cases: null text stays null, and an empty text empty. Repeated rows of an
id and a text are one document and are all cut alike; rows that share an id but
not the text are not compared with each other. A null id takes no part and its
text stays. Ids are integers (or cast to them). The kept lines are joined by line ends; a document may become
empty. Whole texts count, whatever their length. An empty table stays empty. Further columns
are kept, whatever their names; the one more, ``name``, must not be taken.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator, Sequence
from hashlib import blake2b
from itertools import pairwise
from struct import pack

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateql.llm.exprs import BLANKS, words
from slateql.llm.graph import checkpointed
from slateql.llm.process import tidy

#: A line of at most so many occurrences pairs all its holders; more frequent ones pair by windows.
RARE = 4
#: Shared lines, windows and cut blocks up to so many are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 200_000
#: Gaps are aligned to this depth; what lies deeper is left to the windows.
LEVELS = 16

Key = tuple[int, int]


def spans(sizes: Sequence[int], least: int) -> list[tuple[int, int]]:
    """(first, last) of the shortest windows of ``least`` or more words from each place on and up to each place."""
    found = set()
    start, n = 0, 0
    for end, size in enumerate(sizes):
        n += size
        while n - sizes[start] >= least:
            n -= sizes[start]
            start += 1
        if n >= least:
            found.add((start, end))
    end, n = len(sizes) - 1, 0
    for start in reversed(range(len(sizes))):
        n += sizes[start]
        while n - sizes[end] >= least:
            n -= sizes[end]
            end -= 1
        if n >= least:
            found.add((start, end))
    return sorted(found)


def runs(places: Sequence[int], wanted=None) -> Iterator[tuple[int, int]]:
    """(from, to) of the stretches of adjacent sorted places, those that are ``wanted`` at an index if given."""
    start = None
    for i, p in enumerate(places):
        if wanted is not None and not wanted(i):
            if start is not None:
                yield start, i
            start = None
        elif start is None:
            start = i
        elif p != places[i - 1] + 1:
            yield start, i
            start = i
    if start is not None:
        yield start, len(places)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of (later, earlier) places that increases in both."""
    tails, at, back = [], [], []
    for k, (_, e) in enumerate(pairs):
        i = bisect_left(tails, e)
        if i == len(tails):
            tails.append(e)
            at.append(k)
        else:
            tails[i], at[i] = e, k
        back.append(at[i - 1] if i else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(later: dict[int, Key], earlier: dict[int, Key], levels: int = LEVELS) -> dict[int, int]:
    """Later places -> earlier places of equal lines, both increasing; the arguments map sorted places to lines."""
    ours, theirs = defaultdict(list), defaultdict(list)
    for k, x in later.items():
        ours[x].append(k)
    for e, x in earlier.items():
        theirs[x].append(e)
    places = [k for k, x in later.items() if x in theirs]
    end_k, end_e = max(later, default=-1) + 1, max(earlier, default=-1) + 1
    aligned: dict[int, int] = {}
    gaps = [(-1, end_k, -1, end_e, 0)]

    def only(at: list[int], low: int, high: int) -> int | None:
        i = bisect_right(at, low)
        return at[i] if i < len(at) and at[i] < high and (i + 1 == len(at) or at[i + 1] >= high) else None

    while gaps:
        k0, k1, e0, e1, level = gaps.pop()
        inside = places[bisect_right(places, k0) : bisect_left(places, k1)]
        anchors = []
        for k in inside:
            if only(ours[later[k]], k0, k1) is not None:
                e = only(theirs[later[k]], e0, e1)
                if e is not None:
                    anchors.append((k, e))
        anchors = _increasing(anchors)
        if not anchors:
            continue
        aligned.update(anchors)
        for (a, b), (c, d) in pairwise([(k0, e0), *anchors, (k1, e1)]):
            grow = lambda k, e: a < k < c and b < e < d and k in later and later[k] == earlier.get(e)  # noqa: B023, E731
            while a > k0 and grow(a + 1, b + 1):
                a, b = a + 1, b + 1
                aligned[a] = b
            while c < k1 and grow(c - 1, d - 1):
                c, d = c - 1, d - 1
                aligned[c] = d
            if c - a > 1 and d - b > 1 and level + 1 < levels:
                gaps.append((a, c, b, d, level + 1))
    return aligned


def common_blocks(later: dict[int, Key], earlier: dict[int, Key], sizes: dict[Key, int], min_words: int) -> list[tuple[int, int, int]]:
    """(first, last, first in the earlier one) of common blocks that cover every run of ``min_words`` words, adjacent in both.

    The arguments map sorted places to lines, ``sizes`` lines to words. Blocks may overlap.
    """
    known = set(earlier.values())
    ours = [k for k, x in later.items() if x in known]
    wide = [(i, j) for i, j in runs(ours) if sum(sizes[later[k]] for k in ours[i:j]) >= min_words]
    if not wide:
        return []
    out, covered = [], set()
    near = {k: later[k] for i, j in wide for k in ours[i:j]}
    aligned = patience(near, earlier)
    at = sorted(aligned)
    start = 0
    for i in range(1, len(at) + 1):
        if i == len(at) or at[i] != at[i - 1] + 1 or aligned[at[i]] != aligned[at[i - 1]] + 1:
            if sum(sizes[later[k]] for k in at[start:i]) >= min_words:
                out.append((at[start], at[i - 1], aligned[at[start]]))
                covered.update(at[start:i])
            start = i
    if len(covered) == len(near):
        return out
    held = set(near.values())
    theirs, first = [e for e, x in earlier.items() if x in held], {}
    for i, j in runs(theirs):
        lines = [earlier[e] for e in theirs[i:j]]
        for s, t in spans([sizes[x] for x in lines], min_words):
            first.setdefault(tuple(lines[s : t + 1]), theirs[i + s])
    for i, j in wide:
        lines = [later[k] for k in ours[i:j]]
        for s, t in spans([sizes[x] for x in lines], min_words):
            places = ours[i + s : i + t + 1]
            e = None if covered.issuperset(places) else first.get(tuple(lines[s : t + 1]))
            if e is not None:
                out.append((places[0], places[-1], e))
                covered.update(places)
    return out


def _n_words(line: Column) -> Column:
    """Lines of words between single spaces, the usual ones, are counted without a regular expression."""
    gaps = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    single = ~(line.contains("  ") | line.startswith(" ") | line.endswith(" ")) & (F.translate(line, BLANKS.replace(" ", ""), "") == line)
    return F.when(single, gaps + 1).otherwise(F.size(words(line)))


def _small(df: DataFrame) -> DataFrame:
    """A checkpointed table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST else df


def shared_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """One row per text (doc_id, h) with lines that other documents hold: no, raw, n, h1, h2, rare, by place.

    ``no`` counts the text's lines with words, ``raw`` all of its lines; ``n`` are a line's words.
    """
    raw = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("raw")))
    worded = F.filter(raw, lambda x: F.length(F.translate(x["line"], BLANKS, "")) > 0)
    second = lambda line: F.shiftleft(F.hash(line).cast("bigint"), 32) + F.length(line)
    hashed = F.transform(worded, lambda x: F.struct(F.xxhash64(x["line"]).alias("h1"), second(x["line"]).alias("h2"), _n_words(x["line"]).alias("n"), x["raw"].alias("raw")))
    texts = checkpointed(docs.select("doc_id", "h", hashed.alias("lines")))
    lines = texts.select("doc_id", "h", F.posexplode("lines").alias("no", "x")).select("doc_id", "h", "no", "x.raw", "x.n", "x.h1", "x.h2")
    counted = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("c"))
    known = checkpointed(counted.where("lo < hi").select("h1", "h2", (F.col("c") <= RARE).alias("rare")))
    held = lines.join(_small(known), ["h1", "h2"]).groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("no", "raw", "n", "h1", "h2", "rare"))).alias("x"), F.sum("n").alias("words"))
    return checkpointed(held.where(F.col("words") >= min_words).select("doc_id", "h", *[F.col(f"x.{c}").alias(c) for c in ("no", "raw", "n", "h1", "h2", "rare")]))


_KEYS = pa.schema([("rare", pa.bool_()), ("key", pa.binary()), ("doc_id", pa.int64()), ("h", pa.int64())])


def _keys(min_words: int):
    """Texts with shared lines -> the rare lines and the windows of common lines by which they meet others."""

    def of(nos: list, ns: list, keys: list, rares: list) -> Iterator[tuple[bool, bytes]]:
        for i, j in runs(nos):
            if sum(ns[i:j]) < min_words:
                continue
            yield from ((True, pack("<qq", *keys[k])) for k in range(i, j) if rares[k])
            for a, b in runs(nos[i:j], lambda k: not rares[i + k]):  # noqa: B023
                for s, t in spans(ns[i + a : i + b], min_words):
                    yield False, blake2b(b"".join(pack("<qq", *x) for x in keys[i + a + s : i + a + t + 1]), digest_size=16).digest()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                out: list[list] = [[], [], [], []]
                for doc_id, h, no, n, h1, h2, rare in zip(*(c.to_pylist() for c in whole.slice(at, 256).columns)):
                    for is_rare, key in sorted(set(of(no, n, list(zip(h1, h2)), rare))):
                        for column, v in zip(out, (is_rare, key, doc_id, h)):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _KEYS)], schema=_KEYS)

    return emit


def document_pairs(shared: DataFrame, min_words: int) -> DataFrame:
    """Distinct (doc_id, h, partner, partner_h): a later text and an earlier one to align it with."""
    keys = checkpointed(shared.select("doc_id", "h", "no", "n", "h1", "h2", "rare").mapInArrow(tidy(_keys(min_words)), "rare boolean, key binary, doc_id bigint, h bigint"))
    holders = keys.where("rare").groupBy("key").agg(F.collect_set(F.struct("doc_id", "h")).alias("x"))  # at most RARE each
    later = F.transform("x", lambda a: F.transform(F.filter("x", lambda e: e["doc_id"] < a["doc_id"]), lambda e: F.struct(a.alias("a"), e.alias("e"))))
    rare = holders.select(F.explode(F.flatten(later)).alias("p")).select("p.a.doc_id", "p.a.h", F.col("p.e.doc_id").alias("partner"), F.col("p.e.h").alias("partner_h"))
    windows = keys.where("NOT rare").select("key", "doc_id", "h")
    first = windows.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("e"), F.max("doc_id").alias("hi")).where("e.doc_id < hi")
    first = checkpointed(first.select("key", F.col("e.doc_id").alias("partner"), F.col("e.h").alias("partner_h")))
    common = windows.join(_small(first), "key").where("partner < doc_id").select("doc_id", "h", "partner", "partner_h")
    return checkpointed(rare.union(common).distinct())


_CUTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("h", pa.int64()),
        ("blocks", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ("aligned", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("partner", pa.int64()), ("partner_first", pa.int32())]))),
    ]
)
_CUTS_DDL = "doc_id bigint, h bigint, blocks array<struct<first:int,last:int>>, aligned array<struct<first:int,last:int,partner:bigint,partner_first:int>>"


def _aligned(min_words: int):
    """Rows sorted by text, its own (without partner) first, then its partners' -> what to cut from it."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own = raw = sizes = wide = None
        covered: set[int] = set()
        blocks: list[dict] = []
        done: list[tuple] = []

        def end() -> None:
            if covered:
                places = sorted(covered)
                cut = [{"first": raw[places[i]], "last": raw[places[j - 1]]} for i, j in runs(places)]
                done.append((*at, cut, list(blocks)))
            covered.clear()
            blocks.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], f.type) for k, f in enumerate(_CUTS)], schema=_CUTS)
            done.clear()
            return out

        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                for doc_id, h, partner, no, its_raw, n, h1, h2 in zip(*(c.to_pylist() for c in whole.slice(start, 64).columns)):
                    lines = dict(zip(no, zip(h1, h2)))
                    if partner is None:
                        if at is not None:
                            end()
                        at, own, raw, sizes = (doc_id, h), lines, dict(zip(no, its_raw)), dict(zip(lines.values(), n))
                        wide = {no[k] for i, j in runs(no) if sum(n[i:j]) >= min_words for k in range(i, j)}
                    elif not covered.issuperset(wide):
                        for first, last, there in common_blocks(own, lines, sizes, min_words):
                            covered.update(range(first, last + 1))
                            blocks.append({"first": raw[first], "last": raw[last], "partner": partner, "partner_first": its_raw[bisect_left(no, there)]})
                if len(done) > 1000:
                    yield flush()
        if at is not None:
            end()
        yield flush()

    return emit


def line_cuts(df: DataFrame, min_words: int = 25, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h, blocks, aligned: what to cut, for documents that lose any line; ``h`` is ``xxhash64`` of the text.

    ``blocks`` are first and last lines of the stretches to delete; ``aligned`` are the blocks they are made of,
    each with an earlier document and its first line there.
    """
    docs = df.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    shared = shared_lines(docs, min_words)
    pairs = document_pairs(shared, min_words)
    lines = ("no", "raw", "n", "h1", "h2")
    own = shared.join(pairs.select("doc_id", "h").distinct(), ["doc_id", "h"], "left_semi").select("doc_id", "h", F.lit(None).cast("bigint").alias("partner"), F.lit(None).cast("bigint").alias("partner_h"), *lines)
    there = pairs.join(shared.select(F.col("doc_id").alias("partner"), F.col("h").alias("partner_h"), *lines), ["partner", "partner_h"]).select(*own.columns)
    dealt = own.union(there).repartition("doc_id", "h").sortWithinPartitions("doc_id", "h", F.col("partner").asc_nulls_first(), "partner_h")
    return dealt.drop("partner_h").mapInArrow(tidy(_aligned(min_words)), _CUTS_DDL)


def cut_lines(df: DataFrame, cuts: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "__cut") -> DataFrame:
    """``df`` with the blocks of ``cuts`` deleted from its texts; the same rows and columns, and ``name``, a struct of the lines and the characters that went."""
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name} is there already")
    cuts = checkpointed(cuts.select(F.col("doc_id").alias("__cut_id"), F.col("h").alias("__cut_h"), F.col("blocks").alias("__cut_blocks")))
    n_blocks = cuts.agg(F.sum(F.size("__cut_blocks"))).first()[0] or 0
    cuts = F.broadcast(cuts) if n_blocks <= MAX_BROADCAST else cuts
    row = df.select(F.struct("*").alias("__cut_row"), F.col(doc_id).cast("bigint").alias("__cut_own"), F.xxhash64(text).alias("__cut_own_h"))
    marked = row.join(cuts, (F.col("__cut_own") == F.col("__cut_id")) & (F.col("__cut_own_h") == F.col("__cut_h")), "left")
    old, some = F.col("__cut_row")[text], F.col("__cut_blocks").isNotNull()
    inside = lambda i: F.exists("__cut_blocks", lambda b: i.between(b["first"], b["last"]))
    kept = F.array_join(F.filter(F.split(old, "\n", -1), lambda x, i: ~inside(i)), "\n")
    n_cut = F.aggregate("__cut_blocks", F.lit(0), lambda n, b: n + b["last"] - b["first"] + 1)
    done = marked.select("__cut_row", some.alias("__cut_some"), F.when(some, kept).otherwise(old).alias("__cut_text"), F.when(some, n_cut).otherwise(F.lit(0)).alias("__cut_lines"))
    gone = F.when(F.col("__cut_some"), F.length(old) - F.length("__cut_text")).otherwise(F.lit(0))
    return done.select(
        *[F.col("__cut_text").alias(c) if c == text else F.col("__cut_row")[c].alias(c) for c in df.columns],
        F.struct(F.col("__cut_lines").alias("lines"), gone.alias("chars")).alias(name),
    )
