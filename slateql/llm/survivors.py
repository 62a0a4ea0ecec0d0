"""One document of each group of near duplicates.

Only rows that are near duplicates of one that stays go, and of rows equal in id and text one stays. Rows that share
an id but not the text are different documents: each is compared on its own. They give way to documents whose id is
theirs alone: the row of the smallest such id of a group stays, or, in a group without any, one of them. Null and empty texts count as equal there.

Defined cases: null ids, null and empty texts, and texts without words stay. Which of several rows equal in id and text stays is
decided by a hash of all their columns. An empty table gives an empty result. Columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slateql.llm.exprs import fresh, hashable
from slateql.llm.graph import checkpointed
from slateql.llm.neardup import MAX_BROADCAST_IDS, near_duplicates

#: Rows that share an id with another text get ids from here on.
_FIRST_OWN = 1 << 62


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids


def drop_near_duplicates(df: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one row of each group of near duplicates, that of the smallest id."""
    own, seen = fresh(df, "own"), fresh(df, "seen")
    content = lambda c: F.xxhash64(F.coalesce(c, F.lit("")))
    ids = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), content(F.col(text)).alias("h"))
    twice = checkpointed(ids.groupBy("id").agg(F.count("*").alias("n"), (F.min("h") != F.max("h")).alias("differ")).where("n > 1"))
    if twice.isEmpty():
        return _survivors(df, percent, F.col(doc_id).cast("bigint"), doc_id, text)
    marks = _small(twice.select(F.col("id").alias(own), F.col("differ").alias(seen)))
    marked = df.join(marks, F.col(doc_id).cast("bigint") == F.col(own), "left")
    separate = F.xxhash64(F.col(doc_id).cast("bigint"), content(F.col(text))).bitwiseAND(F.lit(_FIRST_OWN - 1)) + _FIRST_OWN
    key = F.when(F.col(seen), separate).otherwise(F.col(doc_id).cast("bigint"))
    keyed = marked.select(*df.columns, key.alias(own), F.col(seen).isNotNull().alias(seen))
    left = _survivors(keyed, percent, F.col(own), own, text)
    again = left.where(F.col(seen) & F.col(own).isNotNull())
    row, order = F.struct(*df.columns), F.xxhash64(*[c for c in df.columns if hashable(df.schema[c].dataType)])
    one = again.groupBy(own).agg(F.min_by(row, order).alias(seen)).select(*[F.col(seen)[c].alias(c) for c in df.columns])
    return left.where(~F.col(seen) | F.col(own).isNull()).select(*df.columns).union(one)


def _survivors(df: DataFrame, percent: int, key: Column, doc_id: str, text: str) -> DataFrame:
    found = near_duplicates(df, percent, doc_id=doc_id, text=text)
    gone = fresh(df, "gone")
    ids = checkpointed(found.where(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct())
    return df.join(_small(ids), key == F.col(gone), "left_anti")
