"""The queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slateql.llm import chat, fingerprint, linededup, mixing, neardup, packing, pii, quality, settings, toxicity, urlfilter

QUERIES = {}
ORACLE_SQL = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


# --- 1: chat formatting

TEMPLATE = chat.ChatTemplate()
PROBE = "</s>[INST] ok [/INST]"
_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean, reason string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, read back from its segments, which come in order and within one partition."""
    names = [c.split()[0] for c in _DIGESTS.split(", ")]
    kinds = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _DIGESTS.split(", ")]
    began, conv, state, done = False, None, None, []

    def end():
        n, turns, loss_chars, loss, chars, reason, last = state
        reason = reason or (None if last in TEMPLATE.final else f"ends after {last}")
        done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, reason is None, reason))

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], names=names)
        done.clear()
        return out

    for batch in batches:
        for c, segments, entered, reason in zip(*(x.to_pylist() for x in batch.columns)):
            if not began or c != conv:
                if began:
                    end()
                began, conv, state = True, c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None, None]
            head, body, _ = segments
            text = TEMPLATE.unescaped(body["text"])
            state[0] += 1
            state[1].update(f"{TEMPLATE.parse_open(head['text'])}\n{text}\n".encode())
            state[4] += sum(len(s["text"]) for s in segments)
            state[5], state[6] = state[5] or reason, entered
            for s in segments:
                if s["loss"]:
                    plain = TEMPLATE.unescaped(s["text"])
                    state[2] += len(plain)
                    state[3].update(plain.encode())
        if done:
            yield flush()
    if began:
        end()
        yield flush()


@_query
def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], turns.schema)
    formatted = chat.format_conversations(turns.unionByName(probe), TEMPLATE)
    return formatted.select("conv_id", "segments", "state", "reason").mapInArrow(_digest, _DIGESTS)


def _escaped_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in TEMPLATE.control:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


_OPEN = len(TEMPLATE.open_mark.format(role=""))
_ENTERED = " ".join(f"WHEN role = '{r}' THEN '{to}'" for r, to in TEMPLATE.enters.items())
_IN_ORDER = " OR ".join(f"(state = '{a}' AND entered = '{b}')" for a, to in TEMPLATE.order.items() for b in to)
_LOSS = " OR ".join(f"entered = '{x}'" for x in TEMPLATE.loss)
ORACLE_SQL["op1_chat"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
n AS (SELECT *, CASE {_ENTERED} ELSE '{chat.UNKNOWN}' END AS entered, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM turns),
s AS (SELECT *, coalesce(lag(entered) OVER (PARTITION BY conv_id ORDER BY k), '{TEMPLATE.start}') AS state FROM n),
r AS (SELECT *, CASE WHEN {_IN_ORDER} THEN NULL ELSE CASE WHEN role = '' THEN 'no role' ELSE role END || ' after ' || state END AS why FROM s),
c AS (SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER ({_LOSS}), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER ({_LOSS}), '')) AS loss_sha256,
  sum({_OPEN + len(TEMPLATE.close_mark)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')}))::BIGINT AS formatted_chars,
  arg_min(why, k) FILTER (why IS NOT NULL) AS why, arg_max(entered, k) AS last FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  why IS NULL AND last IN ({", ".join(f"'{x}'" for x in TEMPLATE.final)}) AS valid,
  coalesce(why, CASE WHEN last NOT IN ({", ".join(f"'{x}'" for x in TEMPLATE.final)}) THEN 'ends after ' || last END) AS reason
FROM c
"""


# --- 2: quality rules


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_marks", "n_stop_words")


def _rule_sql(r: quality.Rule) -> str:
    bounds = [f"{r.statistic} >= {r.least}"] * (r.least is not None) + [f"{r.statistic} <= {r.most}"] * (r.most is not None)
    return " AND ".join(bounds)


ORACLE_SQL["op2_quality"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), range(0, 3) AS o(k) WHERE c >= 2 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_lines, 0)::BIGINT AS n_lines, (length(t) - length(regexp_replace(t, '[!|]', '', 'g')))::BIGINT AS n_marks,
        len(list_filter(w, lambda x: list_contains([{", ".join(f"'{s}'" for s in dict.fromkeys(quality.STOP_WORDS))}], lower(x))))::BIGINT AS n_stop_words
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
s AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
        CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END AS mark_ratio, CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_ratio,
        CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {" AND ".join(f"({_rule_sql(r)})" for r in quality.RULES)} AS kept, n_lines, n_marks, n_stop_words
FROM s
"""


# --- 3: mixing sources to target weights

@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")
    order = F.conv(F.substring(F.md5(F.concat_ws("|", "doc_id", "source", "lang", "n_chars")), 1, 15), 16, 10).cast("bigint")
    mixed = mixing.mix(docs, settings.SOURCE_WEIGHTS, settings.OTHER_WEIGHT, block_rows=MIX_BLOCK, bucket_rows=MIX_BUCKET, order=order)
    return mixed.select("doc_id", "source", *[F.col(f"__mixed.{c}").alias(c) for c in ("block", "within", "slot", "release", "deadline")])


MIX_BLOCK, MIX_BUCKET = 16, 2_048
_SOURCES = ", ".join(f"({i}, '{s}', {w})" for i, (s, w) in enumerate(settings.SOURCE_WEIGHTS.items(), 1))
_OTHERS = len(settings.SOURCE_WEIGHTS) + 1
# One step a slot: of the sources with blocks left and one released, the earliest deadline; anew when a source runs out.
ORACLE_SQL["op3_mixing"] = f"""
WITH RECURSIVE src AS (SELECT * FROM (VALUES {_SOURCES}, ({_OTHERS}, NULL, {settings.OTHER_WEIGHT})) AS t(i, name, w)),
d AS (SELECT doc_id, source, coalesce(i, {_OTHERS}) AS i, ('0x' || substr(md5(concat_ws('|', doc_id, source, lang, n_chars)), 1, 15))::BIGINT AS h FROM documents LEFT JOIN src ON name = source),
n AS (SELECT i, count(*) AS n FROM d GROUP BY i),
r AS (SELECT doc_id, source, d.i, row_number() OVER (PARTITION BY d.i ORDER BY h % ((n + {MIX_BUCKET - 1}) // {MIX_BUCKET}), h, doc_id) - 1 AS r FROM d JOIN n USING (i)),
p AS (SELECT list(w::BIGINT ORDER BY i) AS w, list((coalesce(n, 0) + {MIX_BLOCK - 1}) // {MIX_BLOCK} ORDER BY i) AS b, list(0::BIGINT) AS none FROM src LEFT JOIN n USING (i)),
s AS (
  SELECT -1::BIGINT AS slot, 0::BIGINT AS t, 0::BIGINT AS start, none AS had, none AS done, NULL::BIGINT AS i, NULL::BIGINT AS block, NULL::BIGINT AS release, NULL::BIGINT AS deadline FROM p
  UNION ALL
  SELECT slot + 1, CASE WHEN over THEN 0 ELSE t + 1 END, CASE WHEN over THEN slot + 2 ELSE start END,
    CASE WHEN over THEN none ELSE list_transform(had, lambda x, k: CASE WHEN k = pick THEN x + 1 ELSE x END) END,
    list_transform(done, lambda x, k: CASE WHEN k = pick THEN x + 1 ELSE x END), pick, done[pick], start + had[pick] * q // w[pick], start + ((had[pick] + 1) * q + w[pick] - 1) // w[pick]
  FROM (SELECT *, done[pick] + 1 = b[pick] AS over FROM (
    SELECT *, list_min(list_transform(list_filter(range(1, {_OTHERS + 1}), lambda k: done[k] < b[k] AND had[k] * q // w[k] <= t), lambda k: ((had[k] + 1) * q + w[k] - 1) // w[k] * 1000 + k)) % 1000 AS pick
    FROM (SELECT s.slot, s.t, s.start, s.had, s.done, p.w, p.b, p.none, list_sum(list_transform(range(1, {_OTHERS + 1}), lambda k: CASE WHEN s.done[k] < p.b[k] THEN p.w[k] ELSE 0 END))::BIGINT AS q FROM s, p)
    WHERE q > 0)))
SELECT doc_id, source, block, r % {MIX_BLOCK} AS within, slot, release, deadline FROM r JOIN s ON s.i = r.i AND s.block = r // {MIX_BLOCK}
"""


# --- 4: packing


@_query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = packing.pack_documents(docs, settings.TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


# --- 5: line dedup


@_query
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the blocks that an earlier document holds, and how many lines went."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cut = linededup.cut_lines(docs, linededup.line_cuts(docs))
    return cut.select("doc_id", "text", F.col("__cut.lines").cast("bigint").alias("n_cut_lines"))


# A line goes if a run of lines with 25 words or more, the shortest from or up to some line, stands in an earlier document as well.
_WORDS = "[^\\x20\\x09-\\x0D]+"
ORACLE_SQL["op5_lines"] = f"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS raw_lines FROM documents WHERE text IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(line, '{_WORDS}')) AS n FROM (SELECT doc_id, unnest(raw_lines) AS line, generate_subscripts(raw_lines, 1) AS raw FROM d) WHERE regexp_matches(line, '{_WORDS}')),
c AS (SELECT *, row_number() OVER p AS no, sum(n) OVER p AS upto FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY raw)),
p AS (SELECT a.doc_id, a.no AS s, b.no AS t FROM c a ASOF JOIN c b ON a.doc_id = b.doc_id AND a.upto - a.n + 25 <= b.upto
      UNION SELECT b.doc_id, a.no, b.no FROM c b ASOF JOIN c a ON a.doc_id = b.doc_id AND b.upto - 25 >= a.upto - a.n),
k AS (SELECT doc_id, list(line ORDER BY no) AS lines FROM c GROUP BY doc_id),
h AS (SELECT doc_id, s, t, min(doc_id) OVER (PARTITION BY part) AS first FROM (SELECT p.doc_id, s, t, lines[s:t] AS part FROM p JOIN k USING (doc_id))),
m AS (SELECT DISTINCT doc_id, unnest(range(s, t + 1)) AS no FROM h WHERE first < doc_id),
g AS (SELECT doc_id, raw, CASE WHEN lead(no) OVER p = no + 1 THEN lead(raw) OVER p ELSE raw + 1 END AS upto FROM m JOIN c USING (doc_id, no) WINDOW p AS (PARTITION BY doc_id ORDER BY no)),
x AS (SELECT doc_id, list(r) AS gone FROM (SELECT doc_id, unnest(range(raw, upto)) AS r FROM g) GROUP BY doc_id)
SELECT doc_id, CASE WHEN gone IS NULL THEN text
    ELSE array_to_string(list_transform(list_filter(range(1, len(raw_lines) + 1), lambda i: NOT list_contains(gone, i)), lambda i: raw_lines[i]), chr(10)) END AS text,
  coalesce(len(gone), 0)::BIGINT AS n_cut_lines
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN x USING (doc_id)
"""


# --- 6: URL filters

URL_RULES = [
    urlfilter.Rule.parse("allow", "org/"),
    urlfilter.Rule.parse("block", "example.org/es/"),
    urlfilter.Rule.parse("block", "example.org/en/1"),
    urlfilter.Rule.parse("allow", "com/fr/"),
    urlfilter.Rule.parse("block", "com/de/"),
]


@_query
def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES, keep=["page_id"])


def _fits_sql(r: urlfilter.Rule) -> str:
    return f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"


_LONGEST_FIRST = sorted(URL_RULES, key=lambda r: (-r.host.count("."), -len(r.path)))
ORACLE_SQL["op6_urls"] = f"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {" ".join(f"WHEN {_fits_sql(r)} THEN '{r.name}'" for r in _LONGEST_FIRST)} END AS rule FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in URL_RULES)} ELSE 'allow' END AS verdict FROM r
"""


# --- 7: document fingerprints


@_query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))


# --- 8: toxicity

@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out())
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= settings.TOXIC_FROM).cast("int").alias("predicted"))


# --- 9: PII

@_query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms, and how many values of each kind got one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = pii.pseudonymize(docs, settings.PII_KEY)
    kinds = F.coalesce(F.col("__found.kind"), F.array().cast("array<string>"))

    def count(kind: str):
        return F.size(F.filter(kinds, lambda x: x == kind)).cast("bigint").alias(f"n_{kind}")

    return done.select("doc_id", "text", *map(count, pii.KINDS))


# --- 10: MinHash near-dedup


@_query
def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)


ORACLE_SQL["op10_neardup"] = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.g = q.g AND p.doc_id < q.doc_id GROUP BY ALL) x
      JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id GROUP BY d.doc_id, n.n
"""


QUERIES["pipeline"] = corpus_pipeline.run
