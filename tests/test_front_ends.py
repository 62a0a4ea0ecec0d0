import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from slateql import shell
from slateql.engine import Engine
from slateql.errors import SqlError
from slateql.service import INTERNAL, INVALID_ARGUMENT, Service, ServiceError, http_server


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def test_repl(engine):
    out, err = io.StringIO(), io.StringIO()
    lines = "CREATE TABLE f (id INT, ok BOOL)\n\nINSERT INTO f VALUES (2, false)\nINSERT INTO f VALUES (1, true)\nSELECT * FROM f\nbad\nSELECT x FROM f\nEXIT\nSELECT * FROM f\n"
    shell.repl(engine, io.StringIO(lines), out, err)
    assert out.getvalue() == "sql> OK\nsql> sql> OK\nsql> OK\nsql> id | ok\n-------\n1 | TRUE\n2 | FALSE\n(2 row(s))\nsql> sql> sql> "
    assert err.getvalue().splitlines() == ['error: expected SQL keyword, got "bad"', 'error: column "x" not found in table "f"']


def test_service_codes(engine):
    service = Service(engine)
    assert service.execute("CREATE TABLE t (id INT, s TEXT, b BOOL)").columns == []
    service.execute("INSERT INTO t VALUES (1, 'x', true)")
    found = service.execute("SELECT * FROM t")
    assert (found.columns, list(found.rows)) == (["id", "s", "b"], [[1, "x", True]])
    for sql, code, text in (("@", INVALID_ARGUMENT, "tokenize: "), ("SELECT", INVALID_ARGUMENT, "parse: "), ("SELECT * FROM u", INTERNAL, "execute: ")):
        with pytest.raises(ServiceError, match=text) as e:
            service.execute(sql)
        assert e.value.code == code


def test_http_and_client(engine):
    server = http_server(Service(engine), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"127.0.0.1:{server.server_address[1]}"
    try:
        out, err = io.StringIO(), io.StringIO()
        shell.client(address, io.StringIO("CREATE TABLE t (id INT, b BOOL)\nINSERT INTO t VALUES (1, true)\nSELECT * FROM t\nSELECT\nquit\n"), out, err)
        assert out.getvalue() == "db> OK\ndb> OK\ndb> id\tb\n" + "-" * 40 + "\n1\ttrue\ndb> db> "
        assert err.getvalue().startswith("error: InvalidArgument: parse: ")
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(f"http://{address}/", b"no json")
        assert e.value.code == 400 and json.load(e.value)["code"] == INVALID_ARGUMENT
    finally:
        server.shutdown()


def test_rows_are_streamed(spark, engine, monkeypatch):
    """Nothing is collected, and an answer that fails on the way has no end."""
    engine.create_from("t", spark.range(5000).selectExpr("id", "id % 3 AS rest"), "id")
    monkeypatch.setattr("pyspark.sql.DataFrame.collect", lambda self: 1 / 0)
    server = http_server(Service(engine), 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"127.0.0.1:{server.server_address[1]}"
    try:
        out, err = io.StringIO(), io.StringIO()
        shell.client(address, io.StringIO("SELECT * FROM t WHERE rest = 1\nSELECT * FROM t WHERE rest = 9\n"), out, err)
        lines = out.getvalue().splitlines()
        assert lines[0] == "db> id\trest" and lines[2] == "1\t1" and lines[1668] == "4999\t1" and lines[1669] == "db> id\trest" and len(lines) == 1672
        assert err.getvalue() == ""
        whole = json.load(urllib.request.urlopen(f"http://{address}/", json.dumps({"sql": "SELECT id FROM t WHERE id < 3"}).encode()))
        assert whole == {"columns": ["id"], "rows": [[0], [1], [2]]}
    finally:
        server.shutdown()
    with pytest.raises(SqlError, match="cut short"):
        list(shell.client_lines(['{"columns": ["a"], "rows": [\n', "[1],\n"]))
