"""python -m slateql repl --db ROOT | serve --db ROOT [--port N] | client [--addr HOST:PORT]"""

from __future__ import annotations

import argparse
import signal
import threading


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="slateql", description=__doc__)
    modes = parser.add_subparsers(dest="mode", required=True)
    for name in ("repl", "serve"):
        mode = modes.add_parser(name)
        mode.add_argument("--db", required=True)
        if name == "serve":
            mode.add_argument("--port", type=int, default=5555)
    modes.add_parser("client").add_argument("--addr", default="localhost:5555")
    args = parser.parse_args(argv)

    from slateql import shell

    if args.mode == "client":
        shell.client(args.addr)
        return

    from pyspark.sql import SparkSession

    from slateql.engine import Engine

    spark = SparkSession.builder.appName("slateql").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    engine = Engine(spark, args.db)
    if args.mode == "repl":
        shell.repl(engine)
        return
    from slateql.service import Service, http_server

    server = http_server(Service(engine), args.port)
    for sign in (signal.SIGINT, signal.SIGTERM):
        signal.signal(sign, lambda *_: threading.Thread(target=server.shutdown).start())
    server.serve_forever()


if __name__ == "__main__":
    main()
