"""Tokens to statements.

``strict`` (the default) rejects tokens behind a complete statement; without it
they are ignored, as in the dialect's original form (G1), so that
``SELECT * FROM t ORDER BY x`` reads the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from slateql.errors import ParseError
from slateql.plans import syntax
from slateql.plans.tokens import Token, tokenize

_COMPARISONS = ("=", "!=", "<", ">", "<=", ">=")
_LITERALS = ("number", "string", "identifier")


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"') + '"'


class _Cursor:
    def __init__(self, tokens: list[Token]):
        self.clause = ""  # of the statement, for messages
        self.rest = tokens[::-1]

    def take(self, *kinds: str, value: str | None = None, wanted: str = "") -> Token:
        """The next token, which must be of one of the kinds and have the value."""
        wanted = wanted or (_quoted(value) if value else kinds[0])
        if not self.rest:
            raise ParseError(f"expected {wanted} but got end of input")
        token = self.rest.pop()
        if token.kind not in kinds or value not in (None, token.value):
            raise ParseError(f"expected {wanted} but got {_quoted(token.value)}" if value else f"unexpected token {_quoted(token.value)}")
        return token

    def accept(self, kind: str, value: str) -> bool:
        if self.rest and (self.rest[-1].kind, self.rest[-1].value) == (kind, value):
            self.rest.pop()
            return True
        return False

    def listed(self, item: Callable):
        """One or more items between commas."""
        found = [item()]
        while self.accept(",", ","):
            found.append(item())
        return tuple(found)

    def name(self) -> str:
        return self.take("identifier").value

    def literal(self) -> syntax.Literal:
        token = self.take(*_LITERALS, wanted="literal")
        return syntax.Literal(token.kind, token.value)

    def comparison(self) -> syntax.Comparison:
        column, operator = self.name(), self.take("operator").value
        if operator not in _COMPARISONS:
            raise ParseError(f"comparison: unexpected operator {_quoted(operator)}")
        return syntax.Comparison(column, operator, self.literal())

    def chain(self, operator: str, item: Callable) -> syntax.Predicate:
        left = item()
        while self.accept("operator", operator):
            left = syntax.Logical(operator, left, item())
        return left

    def where(self) -> syntax.Predicate | None:
        if not self.accept("keyword", "WHERE"):
            return None
        self.clause = " WHERE"
        return self.chain("OR", lambda: self.chain("AND", self.comparison))


def _select(c: _Cursor) -> syntax.Select:
    columns = None if c.accept("*", "*") else c.listed(c.name)
    c.take("keyword", value="FROM")
    return syntax.Select(c.name(), columns, c.where())


def _insert(c: _Cursor) -> syntax.Insert:
    c.take("keyword", value="INTO")
    table = c.name()
    c.take("keyword", value="VALUES")
    c.take("(")
    c.clause = " VALUES"
    values = c.listed(c.literal)
    c.clause = ""
    c.take(")")
    return syntax.Insert(table, values)


def _update(c: _Cursor) -> syntax.Update:
    table = c.name()
    c.take("keyword", value="SET")
    c.clause = " SET"
    column = c.name()
    c.take("operator", value="=")
    return syntax.Update(table, column, c.literal(), c.where())


def _delete(c: _Cursor) -> syntax.Delete:
    c.take("keyword", value="FROM")
    return syntax.Delete(c.name(), c.where())


def _create(c: _Cursor) -> syntax.CreateTable:
    c.take("keyword", value="TABLE")
    table = c.name()
    c.take("(")
    columns = c.listed(lambda: (c.name(), c.take("type").value))
    c.take(")")
    return syntax.CreateTable(table, columns)


def _drop(c: _Cursor) -> syntax.DropTable:
    c.take("keyword", value="TABLE")
    return syntax.DropTable(c.name())


_STATEMENTS = {"SELECT": _select, "INSERT": _insert, "UPDATE": _update, "DELETE": _delete, "CREATE": _create, "DROP": _drop}


def parse(tokens: list[Token], strict: bool = True) -> syntax.Statement:
    if not tokens:
        raise ParseError("empty input")
    first = tokens[0]
    if first.kind != "keyword":
        raise ParseError(f"expected SQL keyword, got {_quoted(first.value)}")
    if first.value not in _STATEMENTS:
        raise ParseError(f"unknown statement keyword {_quoted(first.value)}")
    cursor = _Cursor(tokens[1:])
    try:
        statement = _STATEMENTS[first.value](cursor)
    except ParseError as e:
        raise ParseError(f"{first.value}{cursor.clause}: {e}") from None
    if strict and cursor.rest:
        raise ParseError(f"unexpected token {_quoted(cursor.rest[-1].value)} after the statement")
    return statement


def parse_sql(sql: str, strict: bool = True) -> syntax.Statement:
    return parse(tokenize(sql), strict)
