"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit packing.

Column expressions only. A document's word shingles are hashed once; the top
bits of a hash name its bin, the rest orders it within the bin, so one sort of
the hashes yields every bin's minimum. An empty bin copies the first non-empty
bin in its own pseudo-random order of all bins (optimal densification: every
bin probes independently). Each bin keeps its ``BITS`` low-order bits, as one
hex digit. Likeness is the share of equal digits m, corrected for chance:
(m - 2^-b) / (1 - 2^-b), bounded to [0, 1].

Defined cases: A-Z is lower-cased; fewer than five words are one shingle. Null
and empty texts, and those without words, have the empty fingerprint ``''``:
their likeness is 1 to each other and 0 to the rest. Texts count whole, whatever their length. Rows follow each
other by id, nulls first, then by the 64-bit hash of the text, then by the text; repeated rows are rows of
their own. The last row is followed by the first, a single one by itself. An empty table gives no rows. Ids are integers (or cast to them). Only the
id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slateql.llm.exprs import ascii_lower, indices, let, words
from slateql.llm.graph import checkpointed

BINS = 256
BITS = 4
WIDTH = 5
#: Probes of an empty bin that are tried at once; only documents with bins still empty go through the whole order.
ROUNDS = 32


def _probe(k: Column, r: Column | int) -> Column:
    """The r-th bin that bin k looks into: (start + r * step) mod BINS by a hash of k; an odd step reaches every bin."""
    h = F.xxhash64(k)
    start, step = h.bitwiseAND(F.lit(BINS - 1)), F.shiftright(h, 8).bitwiseAND(F.lit(BINS - 1)).bitwiseOR(F.lit(1))
    return (start + r * step).bitwiseAND(F.lit(BINS - 1)).cast("int")


def shingle_hashes(text: Column) -> Column:
    """The 64-bit hashes of the word shingles, repeated ones included."""

    def of(ws: Column) -> Column:
        n = F.size(ws)
        many = F.transform(indices(n - (WIDTH - 1)), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WIDTH)]))
        return F.when(n >= WIDTH, many).when(n > 0, F.array(F.xxhash64(F.array_join(ws, " ")))).otherwise(F.array().cast("array<bigint>"))

    return let(words(ascii_lower(text)), of)


#: One entry above every hash of each bin, so that every bin has a first entry after the sort.
_LOW = 64 - BINS.bit_length() + 1
_TOP = (1 << _LOW) - 1


def _digits(hashes: Column) -> Column:
    """For each bin, in signed order of its hashes, the low-order digit of its minimum; null for an empty bin."""
    bin_of = lambda h: F.shiftright(h, _LOW)
    none = F.lit(_TOP)

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))

    least = let(F.sort_array(F.concat(hashes, F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda k: F.shiftleft(k.cast("bigint"), _LOW) + _TOP))), firsts)
    return F.transform(least, lambda h: F.when(h.bitwiseAND(none) != none, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))


def _densified(found: Column) -> Column:
    """Every empty bin filled from the first non-empty one that it probes."""

    def filled(m: Column) -> Column:
        first = F.transform(m, lambda v, k: F.coalesce(v, *[F.get(m, _probe(k, r)) for r in range(ROUNDS)]))

        def rest(v: Column) -> Column:
            late = lambda k: F.get(F.filter(F.sequence(F.lit(ROUNDS), F.lit(BINS - 1)), lambda r: F.get(m, _probe(k, r)).isNotNull()), F.lit(0))
            return F.when(F.exists(v, lambda x: x.isNull()), F.transform(v, lambda x, k: F.coalesce(x, F.get(m, _probe(k, late(k)))))).otherwise(v)

        return let(first, rest)

    return let(found, filled)


def fingerprint(text: Column) -> Column:
    """``BINS`` hex digits, or '' for a text without words."""

    def of(hashes: Column) -> Column:
        digits = F.transform(_densified(_digits(hashes)), lambda v: F.substring(F.lit("0123456789abcdef"), v + 1, F.lit(1)))
        return F.when(F.size(hashes) == 0, F.lit("")).otherwise(F.array_join(digits, ""))

    return let(shingle_hashes(text), of)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, with bias correction."""
    chance = 2.0**-BITS
    eight = lambda t, k: F.conv(F.substring(t, 8 * k + 1, F.lit(8)), 16, 10).cast("bigint")
    ones = lambda d: d.bitwiseOR(F.shiftright(d, 1)).bitwiseOR(F.shiftright(d, 2)).bitwiseOR(F.shiftright(d, 3)).bitwiseAND(F.lit(0x11111111))
    differ = F.aggregate(F.sequence(F.lit(0), F.lit(BINS // 8 - 1)), F.lit(0), lambda n, k: n + let(eight(a, k).bitwiseXOR(eight(b, k)), lambda d: F.bit_count(ones(d))))
    same = F.lit(BINS) - differ
    found = F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance))
    return F.when((a == "") | (b == ""), F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))).when(a == b, F.lit(1.0)).otherwise(found)


def _following(values: DataFrame, block: int = 1024) -> DataFrame:
    """(v, next) for the distinct longs of ``values``; null behind the last.

    Values are dealt by blocks of ``block`` consecutive longs; between blocks the
    same is done with the block numbers, until they fit one block.
    """
    values = checkpointed(values.toDF("v").distinct())
    low, high = values.agg(F.min("v"), F.max("v")).first()
    by = F.expr(f"v div {block}")
    within = values.withColumn("block", by).withColumn("next", F.lead("v").over(Window.partitionBy("block").orderBy("v")))
    quotient = lambda v: v // block if v >= 0 else -(-v // block)
    if low is None or quotient(low) == quotient(high):
        return within.select("v", "next")
    heads = values.groupBy(by.alias("block")).agg(F.min("v").alias("head"))
    after = _following(heads.select("block"), block).join(heads.toDF("next", "next_head"), "next", "left").select(F.col("v").alias("block"), "next_head")
    return within.join(after, "block").select("v", F.coalesce("next", "next_head").alias("next"))


def _dealt(docs: DataFrame, block: int, most: int, max_broadcast: int) -> DataFrame:
    """``docs`` with the ordered block numbers __b, __p, __s of their rows: by ``block`` consecutive keys o, each of these by itself
    where they have more than ``most`` rows, and a key of more than ``most`` rows by the first bits of the texts' hash x."""
    by = docs.withColumn("__b", F.expr(f"o div {block}"))
    whole = by.withColumns({"__p": F.lit(0).cast("bigint"), "__s": F.lit(0).cast("bigint")})
    full = checkpointed(by.groupBy("__b").count().where(F.col("count") > most).select("__b"))
    if full.isEmpty():
        return whole
    small = lambda df: F.broadcast(df) if df.count() <= max_broadcast else df
    full = small(full)
    keys = by.join(full, "__b", "left_semi").groupBy("o").count()
    bits = small(checkpointed(keys.select("o", F.ceil(F.log2(F.col("count") / most)).cast("int").alias("bits")).where("bits > 0")))
    marked = by.join(full.withColumn("full", F.lit(True)), "__b", "left").join(bits, "o", "left")
    own = {"__p": F.when(F.col("full"), F.col("o")).otherwise(F.lit(0)), "__s": F.coalesce(F.expr("shiftright(x, 64 - bits)"), F.lit(0).cast("bigint"))}
    return marked.withColumns(own).drop("full", "bits")


def with_next(df: DataFrame, key: str, compute, block: int = 256, most: int = 8_192, text: str = "text", max_broadcast: int = 200_000) -> DataFrame:
    """key, text, ``compute``'s columns, and each of text and those as ``next_...`` of the row that follows by (key, hash of the text, text).

    After the last row comes the first. ``compute`` maps the text column to
    named columns, computed before the one shuffle that deals rows by blocks of
    about ``most`` rows at the most, whatever rows a key has; only rows equal in key and text stay together. The first row of a block is added to the block
    before it; these first rows are found from keys and hashes alone. A null key comes first.
    """
    ordered = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    docs = df.select(F.col(key).cast("bigint").alias("key"), ordered.alias("o"), F.coalesce(text, F.lit("")).alias("text")).withColumn("x", F.xxhash64("text"))
    at = ["__b", "__p", "__s"]
    dealt = _dealt(docs, block, most, max_broadcast)
    heads = checkpointed(dealt.groupBy(*at).agg(F.min(F.struct("o", "x")).alias("head")))
    after = _following(heads.select("__b").distinct())
    first = heads.agg(F.min("__b")).first()[0]
    start = heads.groupBy(F.col("__b").alias("n_b")).agg(F.min(F.struct("__p", "__s")).alias("n_at"))
    turn = after.select(F.col("v").alias("__b"), F.coalesce("next", F.lit(first)).alias("n_b")).join(start, "n_b")
    inside = F.lead(F.struct(F.col("__b").alias("n_b"), F.struct("__p", "__s").alias("n_at"))).over(Window.partitionBy("__b").orderBy("__p", "__s"))
    follows = heads.select(*at, inside.alias("n")).join(turn, "__b").select(*at, F.coalesce("n", F.struct("n_b", "n_at")).alias("n"))
    to = follows.select(*[F.col(c).alias(f"to{c}") for c in at], F.col("n.n_b").alias("__b"), F.col("n.n_at.__p").alias("__p"), F.col("n.n_at.__s").alias("__s"))
    before = to.join(heads, at).select(*[f"to{c}" for c in at], F.col("head.o").alias("o"), F.col("head.x").alias("x"))
    if heads.count() <= max_broadcast:
        before = F.broadcast(before)
    computed = lambda d: d.withColumns(compute(F.col("text")))
    names = ["text", *compute(F.col("text"))]
    own = computed(dealt.withColumn("__extra", F.lit(0)))
    led_in = docs.join(before, ["o", "x"]).groupBy("o", "x", *[f"to{c}" for c in at]).agg(F.min("text").alias("text"))
    extra = computed(led_in.select(F.lit(None).cast("bigint").alias("key"), "o", "text", "x", *[F.col(f"to{c}").alias(c) for c in at], F.lit(1).alias("__extra")))
    window = Window.partitionBy(*at).orderBy("__extra", "o", "x", "text")
    led = own.unionByName(extra).select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in names])
    return led.where("__extra = 0").select("key", *names, *[f"next_{c}" for c in names])


def fingerprint_edited(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The edited text has the last half (rounded down) of the code points replaced
    by as many of the next document's first ones, or all it has.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(df, doc_id, lambda t: {"fingerprint": fingerprint(t)}, text=text)
    edited = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    printed = edited.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return printed.select(
        F.col("key").alias("doc_id"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
