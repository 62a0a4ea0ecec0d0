"""Command-line front ends: the shell over a root (A1, S10) and the client of a service."""

from __future__ import annotations

import json
import sys
import urllib.error
import urllib.request
from collections.abc import Callable, Iterable
from typing import TextIO

from pyspark.sql import DataFrame

from slateql.engine import Engine
from slateql.errors import SqlError


def shown(value) -> str:
    if value is None:
        return "NULL"
    return str(value).upper() if isinstance(value, bool) else str(value)


def table_lines(df: DataFrame) -> Iterable[str]:
    """Header, dashes, rows and their number; rows come partition by partition."""
    header = " | ".join(df.columns)
    yield header
    yield "-" * max(1, len(header.encode()))
    n = 0
    for n, row in enumerate(df.toLocalIterator(), 1):
        yield " | ".join(map(shown, row))
    yield f"({n} row(s))"


def _loop(prompt: str, run: Callable[[str], Iterable[str]], lines: TextIO, out: TextIO, err: TextIO) -> None:
    print(prompt, end="", file=out, flush=True)
    for line in lines:
        line = line.strip()
        if line.lower() in ("exit", "quit"):
            return
        if line:
            try:
                for text in run(line):
                    print(text, file=out)
            except SqlError as e:
                print(f"error: {e}", file=err)
        print(prompt, end="", file=out, flush=True)
    print(file=out)


def repl(engine: Engine, lines: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> None:
    def run(line: str) -> Iterable[str]:
        found = engine.sql(line)
        return ["OK"] if found is None else table_lines(found)

    _loop("sql> ", run, lines, out, err)


def client_lines(answer: Iterable[str]) -> Iterable[str]:
    """Header, dashes and rows of an answer, line by line as it comes."""
    answer = iter(answer)
    columns = json.loads(f"{next(answer, '').rstrip()}]}}")["columns"]
    if columns:
        yield "\t".join(columns)
        yield "-" * 40
    for line in answer:
        line = line.rstrip()
        if line == "]}":
            break
        yield "\t".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in json.loads(line.removesuffix(",")))
    else:
        raise SqlError("the answer was cut short")
    if not columns:
        yield "OK"


def client(address: str, lines: TextIO = sys.stdin, out: TextIO = sys.stdout, err: TextIO = sys.stderr) -> None:
    def run(line: str) -> Iterable[str]:
        request = urllib.request.Request(f"http://{address}/", json.dumps({"sql": line}).encode())
        try:
            with urllib.request.urlopen(request) as response:
                yield from client_lines(line.decode() for line in response)
        except urllib.error.HTTPError as e:
            found = json.load(e)
            raise SqlError(f"{found['code']}: {found['message']}") from None
        except urllib.error.URLError as e:
            raise SqlError(str(e.reason)) from None

    _loop("db> ", run, lines, out, err)
