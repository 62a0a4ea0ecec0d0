"""WHERE clauses as column expressions.

Predicates are two-valued and a literal is its text, whatever its token kind:
what the text means depends on the column's type alone. All of it is decided
here, on the driver, so the expressions are plain comparisons with constants
that Catalyst pushes into the Parquet scan.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slateql.functions.literals import ascii_upper, integer, type_name
from slateql.plans.syntax import Comparison, Logical, Predicate

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}


def find(name: str, schema: T.StructType) -> T.StructField | None:
    """A column by its case-insensitive name."""
    return next((f for f in schema.fields if ascii_upper(f.name) == ascii_upper(name)), None)


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _of_bool(c: Column, op, text: str) -> Column:
    """TRUE and FALSE are compared as text; both outcomes are known beforehand."""
    if_true, if_false = op("TRUE", ascii_upper(text)), op("FALSE", ascii_upper(text))
    if if_true and if_false:
        return c.isNotNull()
    return c if if_true else ~c if if_false else F.lit(False)


def _comparison(p: Comparison, schema: T.StructType) -> Column:
    field = find(p.column, schema)
    if field is None:
        return F.lit(False)
    c, op, text = column(field.name), COMPARE[p.operator], p.literal.text
    kind = type_name(field.dataType)
    if kind == "TEXT":
        return op(c, F.lit(text))
    if kind == "BOOL":
        return _of_bool(c, op, text)
    if kind == "INT":
        found = integer(text)
        return F.lit(False) if found is None else op(c, F.lit(found))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):  # external tables only
        try:
            return op(c, F.lit(float(text)))
        except ValueError:
            return F.lit(False)
    return F.lit(False)


def _any(p: Predicate, schema: T.StructType) -> Column:
    if isinstance(p, Logical):
        left, right = _any(p.left, schema), _any(p.right, schema)
        return left & right if p.operator == "AND" else left | right
    return _comparison(p, schema)


def compile_where(p: Predicate | None, schema: T.StructType) -> Column | None:
    """For ``where``: rows for which it is null are left out, as two-valued logic wants."""
    return None if p is None else _any(p, schema)


def holds(p: Predicate | None, schema: T.StructType) -> Column:
    """Never null; for negation and CASE."""
    return F.lit(True) if p is None else F.coalesce(_any(p, schema), F.lit(False))


def may_hold(p: Predicate | None, schema: T.StructType, low: int, high: int) -> bool:
    """Whether a row whose key, an INT and the first column, is from ``low`` to ``high`` may satisfy ``p``; decides which files are read."""
    if p is None:
        return True
    if isinstance(p, Logical):
        left, right = (may_hold(x, schema, low, high) for x in (p.left, p.right))
        return left and right if p.operator == "AND" else left or right
    field = find(p.column, schema)
    if field is None:
        return False
    if field != schema.fields[0] or type_name(field.dataType) != "INT":
        return True
    value = integer(p.literal.text)
    if value is None:
        return False
    return {"=": low <= value <= high, "!=": not low == value == high, "<": low < value, "<=": low <= value, ">": high > value, ">=": high >= value}[p.operator]


def pins(p: Predicate | None, schema: T.StructType, key: str) -> bool:
    """Whether all rows that satisfy ``p`` have the same value of the column ``key``."""
    if isinstance(p, Logical):
        return p.operator == "AND" and (pins(p.left, schema, key) or pins(p.right, schema, key))
    field = None if p is None else find(p.column, schema)
    return field is not None and field.name == key and p.operator == "=" and type_name(field.dataType) in ("INT", "TEXT")
