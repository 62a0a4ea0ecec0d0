"""Near-duplicate groups by a chosen-path set similarity join.

A document's set are its distinct word shingles. Documents with equal sets are
one class, represented by its smallest id; only representatives are joined.

Every representative has ``COORDS`` minwise tokens. A tree starts with all of
them at its root; at a node one token position is selected (a second one with
probability 1 / similarity - 1, so that a pair at the threshold keeps one common
branch on average), and documents branch by their token there. Independent trees
repeat this to the target recall: a pair at the threshold survives a level with
probability 0.87 or more, so 12 trees miss it with probability below 1e-10 at
the first level and below 1e-3 at the fourth.

First all nodes of the first level are searched: in nodes of at most ``small``
documents every pair is compared by length ratio and by two bits of each token
(a pair at the threshold passes with 4.5 standard deviations to spare), and a
spanning forest of the close pairs becomes candidates; in a larger node the
pairs with its first document do. This is linear in the size of a group of
copies. Candidates are confirmed on the full sets, computed again from the whole
texts, and the links joined to components.

Then only nodes that still hold documents of several components are of interest.
Those of at most ``block`` documents are compared exhaustively, on full sets
within the node, pairs of one component left out; larger ones branch on, until
they are small enough or ``max_depth`` is reached, where they are compared as they are.

Defined cases: empty and null texts have the empty set, are linked with nothing
and are kept. Rows that share an id are one document: it is linked if any of its
texts is. A null id is never linked; its component is null and it is kept. Ids are integers (or cast to
them). Only the id and the text are read, so other columns may have any names. Texts
count whole, whatever their length. An empty table gives no rows.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateql.llm.graph import checkpointed, components
from slateql.llm.process import per_process, tidy
from slateql.llm.shingles import WordHashes, mixed, shingle_set

COORDS = 64
_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("sig", pa.binary())])
_SKETCH_DDL = "doc_id bigint, n bigint, h1 bigint, h2 bigint, b1 bigint, b2 bigint, sig binary"
#: Ids up to this many are broadcast to find their texts; more are joined by a shuffle.
MAX_BROADCAST_IDS = 200_000
_PARTNERS = 512


def _odd(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def _sketches(width: int):
    factors, shifts = _odd(1, COORDS), _odd(2, COORDS)

    def block(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
        n = np.fromiter(map(len, sets), np.int64, len(sets))
        full = np.flatnonzero(n)
        columns = {c: np.zeros(len(sets), np.uint64) for c in ("h1", "h2", "b1", "b2")}
        sigs: list[bytes | None] = [None] * len(sets)
        if len(full):
            u = np.concatenate([sets[k] for k in full])
            at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
            columns["h1"][full] = np.add.reduceat(mixed(u * np.uint64(0xD6E8FEB86659FD93)), at)
            columns["h2"][full] = np.bitwise_xor.reduceat(mixed(u + np.uint64(0x632BE59BD9B4E019)), at)
            tokens = np.empty((len(full), COORDS), "<u4")
            bits = [np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64)]
            for k in range(COORDS):
                least = mixed(np.minimum.reduceat(u * factors[k] + shifts[k], at))
                tokens[:, k] = (least >> np.uint64(32)).astype(np.uint32)
                bits[k // 32] |= (least & np.uint64(3)) << np.uint64(2 * (k % 32))
            columns["b1"][full], columns["b2"][full] = bits
            for k, row in zip(full, tokens):
                sigs[k] = row.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), *[pa.array(columns[c].view(np.int64)) for c in ("h1", "h2", "b1", "b2")], pa.array(sigs, pa.binary())], schema=_SKETCH)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_process("word hashes", WordHashes)
        for batch in batches:
            ids, sets, held = [], [], 0
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(d)
                sets.append(shingle_set(t.as_py(), cache, width))
                held += len(sets[-1])
                if held > 500_000:
                    yield block(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield block(ids, sets)

    return emit


def _selected(node: Column, similarity: float) -> Column:
    """The positions at which a node's documents branch: one, or with probability 1 / similarity - 1 two."""
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(COORDS)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(COORDS - 1)).cast("int"), F.lit(COORDS))
    two = F.pmod(F.xxhash64(node, F.lit(3)), F.lit(10_000)) < int(10_000 * (1 / similarity - 1))
    return F.when(two, F.array(first, second)).otherwise(F.array(first))


def _branch(df: DataFrame, similarity: float, keep: list[str]) -> DataFrame:
    """The children of every (node, sig) row."""
    at = df.withColumn("__p", F.explode(_selected(F.col("node"), similarity)))
    child = F.xxhash64("node", "__p", F.substring(F.col("sig"), 4 * F.col("__p") + 1, F.lit(4)))
    return at.select(child.alias("node"), *keep)


_FOUND = pa.schema([("kind", pa.int8()), ("a", pa.int64()), ("b", pa.int64())])
#: (a, b) is a candidate pair; (node, rep) of a node that branches on; (node, rep) of a node to compare on full sets.
PAIR, MEMBER, ACTIVE = 0, 1, 2


class _Sets:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def _close(n, b1, b2, i, j, least_match: int, similarity: float) -> np.ndarray:
    apart = [x[i] ^ x[j] for x in (b1, b2)]
    odd = np.uint64(0x5555555555555555)
    differ = sum(np.bitwise_count((x | (x >> np.uint64(1))) & odd) for x in apart)
    short, long = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    return (COORDS - differ >= least_match) & (short >= similarity * long - 1e-9)


def _least_match(similarity: float) -> int:
    p = similarity + (1 - similarity) / 4
    return int(COORDS * p - 4.5 * (COORDS * p * (1 - p)) ** 0.5)


def _close_pairs(g: dict, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The positions of close pairs of different components, row by row so that memory stays linear in large nodes."""
    least_match, size = _least_match(similarity), len(g["rep"])
    steps = [np.triu_indices(size, 1)] if size <= 512 else ((np.full(k, k), np.arange(k)) for k in range(1, size))
    out = []
    for i, j in steps:
        ok = (g["comp"][i] != g["comp"][j]) & _close(g["n"], g["b1"], g["b2"], i, j, least_match, similarity)
        out.append((i[ok], j[ok]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


_NODE = ("node", "rep", "n", "b1", "b2", "comp")


def _groups(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[tuple[dict, bool]]:
    """Rows sorted by node -> (rows of a node of two or more, False), or, beyond ``most``, its parts as (rows, True); a part's first row is the node's."""
    held: dict | None = None
    large = False
    for batch in batches:
        rows = {c: batch.column(k).to_numpy(zero_copy_only=False) for k, c in enumerate(batch.schema.names)}
        rows["b1"], rows["b2"] = rows["b1"].view(np.uint64), rows["b2"].view(np.uint64)
        n = len(rows["node"])
        if not n:
            continue
        cuts = np.concatenate([[0], np.flatnonzero(rows["node"][1:] != rows["node"][:-1]) + 1, [n]])
        sizes = np.diff(cuts)
        where = np.arange(len(sizes))
        for k in np.flatnonzero((sizes > 1) | (where == 0) | (where == len(sizes) - 1)):  # nodes of one row inside the batch need no look
            g = {c: v[cuts[k] : cuts[k + 1]] for c, v in rows.items()}
            if held is not None and held["node"][0] == g["node"][0]:
                held = {c: np.concatenate([held[c], g[c]]) for c in g}
            else:
                if held is not None and not large and len(held["node"]) > 1:
                    yield held, False
                held, large = g, False
            if most is not None and (large or len(held["node"]) > most):
                yield held, True
                held, large = {c: v[:1] for c, v in held.items()}, True
    if held is not None and not large and len(held["node"]) > 1:
        yield held, False


def _compare(similarity: float, small: int):
    """First-level rows sorted by node -> what ``_FOUND`` says."""
    least_match = _least_match(similarity)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        begun, held = None, 0

        def pairs(g: dict, i: np.ndarray, j: np.ndarray) -> None:
            a, b = g["rep"][i], g["rep"][j]
            out.append((PAIR, np.minimum(a, b), np.maximum(a, b)))

        for g, large in _groups(batches, small):
            if large:
                new = slice(0 if begun != g["node"][0] else 1, None)  # the first row of a later part was there before
                begun = g["node"][0]
                out.append((MEMBER, g["node"][new], g["rep"][new]))
                j = np.arange(1, len(g["rep"]))
                i = np.zeros_like(j)
                ok = _close(g["n"], g["b1"], g["b2"], i, j, least_match, similarity)
                pairs(g, i[ok], j[ok])
            else:
                i, j = _close_pairs(g, similarity)
                if len(i):
                    sets = _Sets(len(g["rep"]))
                    tree = np.array([sets.join(x, y) for x, y in zip(i.tolist(), j.tolist())])
                    pairs(g, i[tree], j[tree])
                    if not tree.all():
                        at = np.unique(np.concatenate([i, j]))
                        out.append((ACTIVE, g["node"][at], g["rep"][at]))
            held += 1
            if held % 4096 == 0 or large:
                yield from _flushed(out)
        yield from _flushed(out)

    return emit


def _flushed(out: list) -> Iterator[pa.RecordBatch]:
    if out:
        kinds = np.concatenate([np.full(len(a), k, np.int8) for k, a, _ in out])
        yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(np.concatenate([a for _, a, _ in out])), pa.array(np.concatenate([b for _, _, b in out]))], schema=_FOUND)
        out.clear()


def _by_node(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(*_NODE, *more).repartition("node").sortWithinPartitions("node", "rep")


_LEVEL = pa.schema([("kind", pa.int8()), ("node", pa.int64()), ("rep", pa.int64()), ("n", pa.int64()), ("b1", pa.int64()), ("b2", pa.int64()), ("comp", pa.int64()), ("sig", pa.binary())])
_LEVEL_DDL = "kind tinyint, node bigint, rep bigint, n bigint, b1 bigint, b2 bigint, comp bigint, sig binary"
#: A node of more rows than this branches on without a look at its components, to bound what a task holds.
_MOST_HELD = 50_000


def _level(similarity: float, block: int | None):
    """Children sorted by node -> ACTIVE rows of small nodes, MEMBER rows of large ones that hold several components."""

    def batch(kind: int, g: dict, at) -> pa.RecordBatch:
        columns = [pa.array(g[c][at].view(np.int64) if c in ("b1", "b2") else g[c][at], t) for c, t in zip(_LEVEL.names[1:-1], _LEVEL.types[1:-1])]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int8)), *columns, pa.array(g["sig"][at].tolist(), pa.binary())], schema=_LEVEL)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, parts, comps = None, [], set()

        def close() -> Iterator[pa.RecordBatch]:
            if len(comps) > 1:
                for part in parts:
                    yield batch(MEMBER, part, slice(None))
            parts.clear()

        for g, large in _groups(batches, block):
            if not large:
                i, j = _close_pairs(g, similarity)
                if len(i):
                    yield batch(ACTIVE, g, np.unique(np.concatenate([i, j])))
                continue
            if node != g["node"][0]:
                yield from close()
                node, comps = g["node"][0], set()
            elif len(g["node"]) > 1:
                g = {c: v[1:] for c, v in g.items()}  # the first row of a later part was there before
            parts.append(g)
            comps.update(g["comp"].tolist())
            if sum(len(p["node"]) for p in parts) > _MOST_HELD:
                comps.update((None, -1))
                yield from close()
        yield from close()

    return emit


def _linked(percent: int, x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


#: Multiplications up to which a node's intersections are computed at once; beyond, close pairs are taken one by one.
_MOST_PRODUCTS = 2e10


def _intersections(sets: list[np.ndarray]) -> np.ndarray | None:
    """The sizes of all pairwise intersections, by products of 0/1 matrices over the shingles that several sets hold; None if these are too many."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    if len(sets) ** 2 * float(several.sum()) > _MOST_PRODUCTS:
        return None
    column = (np.cumsum(several) - 1)[inverse]
    keep = several[inverse]
    rows, column = np.repeat(np.arange(len(sets)), list(map(len, sets)))[keep], column[keep]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(several.sum()), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        m = np.zeros((len(sets), min(4096, int(several.sum()) - start)), np.float32)
        m[rows[a:b], column[a:b] - start] = 1
        out += m @ m.T
    return out


def _full_compare(percent: int):
    """Rows of a node with their sets, sorted by node -> a spanning forest of the links between components."""

    def links_of(g: dict) -> list[tuple[int, int]]:
        places: dict[int, int] = {}
        comp = [places.setdefault(c, len(places)) for c in g["comp"].tolist()]
        sets = [np.frombuffer(x, "<u8") for x in g["shingles"]]
        n = np.array(list(map(len, sets)))
        joined, common = _Sets(len(places)), _intersections(sets)
        if common is not None:
            hit = (common > 0) & (100 * common >= percent * (n[:, None] + n[None, :] - common))
            i, j = np.nonzero(np.triu(hit, 1))
        else:
            i, j = _close_pairs(g, percent / 100)
        links = []
        for x, y in zip(i.tolist(), j.tolist()):
            if joined.find(comp[x]) != joined.find(comp[y]) and (common is not None or _linked(percent, sets[x], sets[y])):
                joined.join(comp[x], comp[y])
                links.append((min(g["rep"][x], g["rep"][y]), max(g["rep"][x], g["rep"][y])))
        return links

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, _ in _groups(batches, None):
            links = links_of(g)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    return emit


def _shingled(width: int):
    """(rep, text) -> (rep, shingles): the set as sorted little-endian 64-bit hashes."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_process("word hashes", WordHashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = [shingle_set(t.as_py(), cache, width).astype("<u8").tobytes() for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return emit


def _in_parts(rows: DataFrame, weight: Column, bound: int) -> DataFrame:
    """``rows`` with each node of more than twice ``bound`` in nodes of two parts each; any two of its rows meet in one of them.

    A part weighs about ``bound``; rows are dealt to parts by a hash, and a row goes to as many nodes as there are other parts.
    """
    parts = checkpointed(rows.groupBy("node").agg(F.ceil(F.sum(weight) / bound).cast("int").alias("__parts")).where("__parts > 2"))
    if parts.isEmpty():
        return rows
    marked = rows.join(F.broadcast(parts) if parts.count() <= MAX_BROADCAST_IDS else parts, "node", "left")
    own = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("__parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("__parts") - 1), lambda k: k != own)
    met = marked.select("*", own.alias("__own"), F.explode(F.when(F.col("__parts").isNull(), F.array(F.lit(-1))).otherwise(others)).alias("__other"))
    node = F.when(F.col("__parts").isNull(), F.col("node")).otherwise(F.xxhash64("node", F.least("__own", "__other"), F.greatest("__own", "__other")))
    return met.select(*[node.alias(c) if c == "node" else F.col(c) for c in rows.columns])


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of the distinct ``id``s."""
    ids = checkpointed(ids)
    wanted = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    return docs.join(wanted, F.col("doc_id") == F.col("id"), "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union.

    Every a is sent to the texts of its b, ``_PARTNERS`` or so at a time, and each b's text travels once a pair.
    """
    pairs = checkpointed(pairs.distinct())
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / _PARTNERS).alias("parts"))
    dealt = pairs.join(parts, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    roles = dealt.select(F.col("b").alias("id"), "a", "part", F.lit(True).alias("partner")).union(dealt.select(F.col("a").alias("id"), "a", "part", F.lit(False)).distinct())
    roles = checkpointed(roles)
    wanted = F.broadcast(roles) if roles.count() <= MAX_BROADCAST_IDS else roles
    rows = docs.join(wanted, F.col("doc_id") == F.col("id")).select("a", "part", "partner", "id", F.col("text").cast("binary").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, group, own = per_process("word hashes", WordHashes), None, []
        for batch in batches:
            links: list[tuple[int, int]] = []
            for k, (a, part, partner, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)))):
                found = shingle_set(batch.column(4)[k].as_py(), cache, width)
                if group != (a, part):
                    group, own = (a, part), []
                if not partner:
                    own.append(found)
                elif any(_linked(percent, x, found) for x in own):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", "partner", "id")
    return ordered.mapInArrow(tidy(emit), "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, trees: int = 12, small: int = 24, block: int = 2_048, max_depth: int = 12, held: int = 500_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    similarity = percent / 100
    docs = df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sketched = checkpointed(docs.mapInArrow(tidy(_sketches(width)), _SKETCH_DDL))
    classed = sketched.where("n > 0 AND doc_id IS NOT NULL")
    reps = checkpointed(classed.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("b1", "b2", "sig")]))

    roots = reps.withColumn("node", F.explode(F.array(*[F.lit(t).cast("bigint") for t in range(trees)])))
    first = _branch(roots, similarity, ["rep", "n", "b1", "b2", F.col("rep").alias("comp")])
    found = checkpointed(_by_node(first).mapInArrow(tidy(_compare(similarity, small)), "kind tinyint, a bigint, b bigint"))
    links = checkpointed(_confirmed(found.where(F.col("kind") == PAIR).select("a", "b"), docs, width, percent))
    joined = checkpointed(components(links))

    members = found.where(F.col("kind") != PAIR).select("kind", F.col("a").alias("node"), F.col("b").alias("rep"))
    placed = members.join(joined, F.col("rep") == F.col("id"), "left").select("kind", "node", "rep", F.coalesce("component", "rep").alias("comp"))
    several = placed.groupBy("node").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("node")
    rows = checkpointed(placed.join(several, "node", "left_semi").join(reps.select("rep", "n", "b1", "b2", "sig"), "rep").select(*_LEVEL.names))
    active = [rows.where(F.col("kind") == ACTIVE).select(*_NODE)]
    for depth in range(2, max_depth + 1):
        rows = rows.where(F.col("kind") == MEMBER)
        if rows.isEmpty():
            break
        children = _branch(rows, similarity, [*_NODE[1:], "sig"])
        last = depth == max_depth
        children = _in_parts(children, F.lit(1), block) if last else children
        rows = checkpointed(_by_node(children, "sig").mapInArrow(tidy(_level(similarity, None if last else block)), _LEVEL_DDL))
        active.append(rows.where(F.col("kind") == ACTIVE).select(*_NODE))
    rest = checkpointed(reduce(DataFrame.union, active))
    if not rest.isEmpty():
        texts = _texts(docs, rest.select(F.col("rep").alias("id")).distinct())
        sets = texts.select(F.col("doc_id").alias("rep"), F.col("text").cast("binary").alias("text")).mapInArrow(tidy(_shingled(width)), "rep bigint, shingles binary")
        whole = _in_parts(rest, F.col("n"), held).join(sets, "rep")
        links = links.union(_by_node(whole, "shingles").mapInArrow(tidy(_full_compare(percent)), "a bigint, b bigint"))
        joined = checkpointed(components(links))

    placed = reps.select("h1", "h2", "n", "rep").join(joined, F.col("rep") == F.col("id"), "left").select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("n").alias("__n"), F.coalesce("component", "rep").alias("component_id"))
    own = (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")) & (F.col("n") == F.col("__n"))
    linked = classed.join(placed, own, "left").select("doc_id", "n", "component_id")
    alone = sketched.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.union(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
