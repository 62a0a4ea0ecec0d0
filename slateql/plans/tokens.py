"""Tokens of the dialect (X1-X8), by one regular expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from slateql.errors import TokenizeError

# The reserved words of the dialect.
KEYWORDS = frozenset("SELECT FROM WHERE INSERT INTO VALUES UPDATE SET DELETE CREATE TABLE DROP".split())
TYPES = frozenset("INT TEXT BOOL".split())
LOGICAL = frozenset("AND OR".split())

_TOKEN = re.compile(
    r"""(?P<blank>[ \t\n]+)
      | (?P<word>[A-Za-z_][A-Za-z0-9_]*)
      | (?P<number>[0-9]+)
      | '(?P<string>[^']*)'
      | (?P<operator>[<>!]=|[=<>])
      | (?P<punctuation>[*,()])""",
    re.VERBOSE | re.ASCII,
)


@dataclass(frozen=True)
class Token:
    """kind is keyword, type, operator, identifier, number, string or the punctuation itself."""

    kind: str
    value: str
    position: int


def _kind_of_word(word: str) -> tuple[str, str]:
    upper = word.upper()
    for kind, reserved in (("keyword", KEYWORDS), ("type", TYPES), ("operator", LOGICAL)):
        if upper in reserved:
            return kind, upper
    return "identifier", word


def tokenize(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        found = _TOKEN.match(sql, at)
        if found is None:
            if sql[at] == "'":
                raise TokenizeError("unterminated string literal")
            raise TokenizeError(f"unexpected character '{sql[at]}' at position {len(sql[:at].encode())}")
        group = found.lastgroup
        if group == "word":
            out.append(Token(*_kind_of_word(found[0]), at))
        elif group == "punctuation":
            out.append(Token(found[0], found[0], at))
        elif group != "blank":
            out.append(Token(group, found[group], at))
        at = found.end()
    return out
