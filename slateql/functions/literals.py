"""Types INT, TEXT and BOOL, and the strict literal typing of INSERT and UPDATE."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from slateql.errors import ExecutionError
from slateql.plans.syntax import Literal

SPARK_TYPES = {"INT": T.LongType(), "TEXT": T.StringType(), "BOOL": T.BooleanType()}
LEAST_INT, MOST_INT = -(1 << 63), (1 << 63) - 1
MOST_KEY = (1 << 32) - 1
MOST_TEXT_BYTES = 65_535

_INTEGER = re.compile(r"[+-]?[0-9]+\Z")
_UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def ascii_upper(text: str) -> str:
    return text.translate(_UPPER)


def integer(text: str) -> int | None:
    """A signed 64-bit integer, or None."""
    if not _INTEGER.match(text):
        return None
    value = int(text)
    return value if LEAST_INT <= value <= MOST_INT else None


def type_name(kind: T.DataType) -> str:
    """The dialect's name of a Spark type; other types keep Spark's."""
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "INT"
    return {"string": "TEXT", "boolean": "BOOL"}.get(kind.simpleString(), kind.simpleString().upper())


def matches(literal: Literal, kind: T.DataType) -> bool:
    wanted = type_name(kind)
    if wanted == "BOOL":
        return literal.kind == "identifier" and ascii_upper(literal.text) in ("TRUE", "FALSE")
    return (literal.kind, wanted) in (("number", "INT"), ("string", "TEXT"))


def value(literal: Literal, kind: T.DataType):
    """The literal as a value of a managed column; it must match."""
    if not matches(literal, kind):
        raise ExecutionError("Literal type mismatch")
    wanted = type_name(kind)
    if wanted == "BOOL":
        return ascii_upper(literal.text) == "TRUE"
    if wanted == "TEXT":
        if len(literal.text.encode()) > MOST_TEXT_BYTES:
            raise ExecutionError(f"TEXT is longer than {MOST_TEXT_BYTES} bytes")
        return literal.text
    found = integer(literal.text)
    if found is None:
        raise ExecutionError(f"failed to parse INT literal: {literal.text} is out of range")
    return found


def primary_key(literal: Literal) -> int:
    found = int(literal.text) if re.fullmatch(r"[0-9]+", literal.text, re.ASCII) else None
    if found is None or found > MOST_KEY:
        raise ExecutionError(f"unable to convert literal to primary key: {literal.text!r} is not an integer from 0 to {MOST_KEY}")
    return found
