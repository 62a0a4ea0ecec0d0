"""Small column-expression helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
#: The six separators themselves, for ``translate``.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fresh(df: DataFrame, name: str) -> str:
    """``name`` behind as many underscores, two or more, as make it no column of ``df``."""
    name = f"__{name}"
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def hashable(t: T.DataType) -> bool:
    """Whether ``xxhash64`` takes a type: one that holds no map and no variant."""
    if isinstance(t, T.ArrayType):
        return hashable(t.elementType)
    if isinstance(t, T.StructType):
        return all(hashable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def kept_as(keep: Iterable[str], taken: Iterable[str]) -> list[Column]:
    """The columns __k0, __k1, ... under their names in ``keep``; one that is ``taken``, whatever its case, as ``input_...``."""
    used = {c.lower() for c in taken}
    return [F.col(f"__k{i}").alias(f"input_{c}" if c.lower() in used else c) for i, c in enumerate(keep)]


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, which is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def indices(n: Column) -> Column:
    """0 .. n-1 as an array; empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
