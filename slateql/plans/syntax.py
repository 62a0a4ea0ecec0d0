"""Syntax tree of the six statements."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Literal:
    kind: str  # number, string or identifier
    text: str


@dataclass(frozen=True)
class Comparison:
    column: str
    operator: str
    literal: Literal


@dataclass(frozen=True)
class Logical:
    operator: str  # AND or OR
    left: Predicate
    right: Predicate


Predicate = Comparison | Logical


@dataclass(frozen=True)
class Select:
    table: str
    columns: tuple[str, ...] | None  # None: all
    where: Predicate | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Literal
    where: Predicate | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate | None = None


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class DropTable:
    table: str


Statement = Select | Insert | Update | Delete | CreateTable | DropTable
