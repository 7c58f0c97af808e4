"""Command line: python -m tessera [--store DIR] [--data DIR] COMMAND ..."""

from __future__ import annotations

import argparse
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions.vectors import http_shape
from tessera.operators import graph
from tessera.session import session
from tessera.sources.records import Records


def answer(engine: Engine, url: str) -> tuple[int, str]:
    """Status and JSON of an API address: /api/graph, /api/node/{id}, /api/search?q=&limit=."""
    parts = urlparse(url)
    if parts.path == "/api/graph":
        return 200, engine.graph_json().first()[0]
    if parts.path.startswith("/api/node/"):
        key = unquote(parts.path.removeprefix("/api/node/"))
        row = graph.node_detail(engine.graph()[0].where(F.col("key") == key), engine.calls()).first()
        return (200, json.dumps(row.asDict())) if row else (404, "null")
    if parts.path == "/api/search":
        asked = parse_qs(parts.query)
        if not asked.get("q"):
            return 200, "[]"
        return 200, json.dumps([r.asDict() for r in http_shape(engine.search(asked["q"][0], int(asked.get("limit", ["20"])[0]))).collect()])  # limit rows
    return 404, "null"


def serve(engine: Engine, port: int) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, body = answer(engine, self.path)
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.end_headers()
            self.wfile.write(body.encode())

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("--store", default="tessera-store")
    p.add_argument("--data", default="~/.tessera")
    p.add_argument("--master", default="local[*]")
    c = p.add_subparsers(dest="command", required=True)
    for name, *arguments in (("new", "prompt"), ("status",), ("list",), ("delete", "id"), ("switch", "id"), ("advance",), ("search", "text"), ("research", "text"), ("kg-status",), ("kg-clear",)):
        s = c.add_parser(name)
        for a in arguments:
            s.add_argument(a, nargs="+" if a in ("prompt", "text") else None)
        if name == "search":
            s.add_argument("-l", "--limit", type=int, default=10)
    s = c.add_parser("init")
    s.add_argument("root", nargs="?", default=".")
    s.add_argument("--force", action="store_true")
    s = c.add_parser("graph")
    s.add_argument("what", choices=["deps", "impact", "functions"])
    s.add_argument("name", nargs="?")
    s = c.add_parser("serve")
    s.add_argument("--port", type=int, default=3333)
    return p


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    records = Records(a.data)
    if a.command == "new":
        print(records.create(" ".join(a.prompt))["id"])
    elif a.command == "status":
        own = records.current()
        print(json.dumps(records.load(own), indent=2) if own else "no current task")
    elif a.command == "delete":
        records.delete(records.by_prefix(a.id))
    elif a.command == "switch":
        records.switch(records.by_prefix(a.id))
    elif a.command == "advance":
        print(records.advance(records.current() or "")["phase"])
    else:
        spark = session(master=a.master)
        engine = Engine(spark, a.store)
        if a.command == "kg-clear":
            engine.initialize(force=True)
        elif a.command == "list":
            records.table(spark).show(truncate=False)
        elif a.command == "init":
            engine.initialize(a.force)
            engine.index_directory(a.root).show()
        elif a.command == "search":
            for k, r in enumerate(engine.search(" ".join(a.text), a.limit).collect(), 1):  # limit rows
                print(f"{k}. {r.path}:{r.start_line}-{r.end_line} ({r.score:.2f})", *(r.preview or "").split("\n")[:3], sep="\n   ")
        elif a.command == "research":
            print(engine.context(" ".join(a.text), "."))
        elif a.command == "kg-status":
            engine.stats().show()
        elif a.command == "graph":
            found = engine.list_functions() if a.what == "functions" else (engine.dependencies if a.what == "deps" else engine.impact)(a.name)
            found.select("name").show(truncate=False)
        elif a.command == "serve":
            serve(engine, a.port)


if __name__ == "__main__":
    main()
