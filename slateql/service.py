"""The query service: statements in, rows out, errors by status (A2, S12, X9); also over HTTP as JSON.

    python -m slateql serve --db ROOT [--port 5555]

Rows are streamed, a partition of the result at a time, so neither side holds a result whole.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from itertools import chain, islice

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from slateql.engine import Engine
from slateql.errors import ParseError, SqlError, TokenizeError
from slateql.plans.parser import parse
from slateql.plans.tokens import tokenize

INVALID_ARGUMENT, INTERNAL = "InvalidArgument", "Internal"


@dataclass
class Response:
    """``rows`` can be read once."""

    columns: list[str] = field(default_factory=list)
    rows: Iterable[list] = ()


class ServiceError(Exception):
    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


class Service:
    def __init__(self, engine: Engine):
        self.engine = engine

    def execute(self, sql: str) -> Response:
        try:
            statement = parse(tokenize(sql), self.engine.strict)
        except TokenizeError as e:
            raise ServiceError(INVALID_ARGUMENT, f"tokenize: {e}") from e
        except ParseError as e:
            raise ServiceError(INVALID_ARGUMENT, f"parse: {e}") from e
        try:
            found = self.engine.execute(statement)
            return Response() if found is None else Response(found.columns, _streamed(found))
        except (SqlError, PySparkException, Py4JError) as e:
            raise ServiceError(INTERNAL, f"execute: {e}") from e


def _streamed(df: DataFrame) -> Iterator[list]:
    """The rows; the first one is fetched here, so that what fails at once fails before anything is sent."""
    rows = df.toLocalIterator()
    first = list(islice(rows, 1))
    return (list(r) for r in chain(first, rows))


def lines(found: Response) -> Iterator[str]:
    """The answer as one JSON document, a row a line."""
    yield f'{{"columns": {json.dumps(found.columns)}, "rows": ['
    before = None
    for row in found.rows:
        if before is not None:
            yield f"{before},"
        before = json.dumps(row, default=str)
    if before is not None:
        yield before
    yield "]}"


def http_server(service: Service, port: int = 5555, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """POST {"sql": ...} -> {"columns", "rows"}, or {"code", "message"} with status 400 or 500; an answer cut short has no end."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            try:
                sql = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))["sql"]
                found = service.execute(sql)
                self._begin(200)
                for line in lines(found):
                    self.wfile.write(f"{line}\n".encode())
            except ServiceError as e:
                self._answer(400 if e.code == INVALID_ARGUMENT else 500, {"code": e.code, "message": str(e)})
            except (ValueError, KeyError, TypeError) as e:
                self._answer(400, {"code": INVALID_ARGUMENT, "message": f"request: {e}"})

        def _begin(self, status: int) -> None:
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()

        def _answer(self, status: int, body: dict) -> None:
            self._begin(status)
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
