"""The REST interface, on the standard library's HTTP server.

Binds the loopback interface unless told otherwise, and can restrict loads to one folder: a load
reads any path that Spark can read.
"""

from __future__ import annotations

import json
import re
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from marlstone import __version__
from marlstone.plans.definitions import Status, parse
from marlstone.plans.engine import Engine, NotAvailable, QueryMissing
from marlstone.service.spec import INTERFACE_VERSION, PAGE, openapi
from marlstone.sources.catalog import CatalogError, TableMissing
from marlstone.sources.tables import PlanError
from marlstone.types import Column


class Refused(Exception):
    def __init__(self, code: int, body: object):
        self.code, self.body = code, body


def _message(code: int, text: str) -> Refused:
    return Refused(code, {"message": text})


def _problems(problems: list[tuple[str, str | None]]) -> dict:
    return {"problems": [{"error": e} | ({"context": c} if c else {}) for e, c in problems]}


class Api:
    """Routes and their handlers: (body, path parameters, query string) to a JSON value."""

    def __init__(self, engine: Engine):
        self.engine, self.catalog, self.began = engine, engine.catalog, time.monotonic()
        self.routes = [
            ("GET", re.compile(r"/tables"), self.tables),
            ("GET", re.compile(r"/table/([^/]+)"), self.table),
            ("PUT", re.compile(r"/table"), self.create_table),
            ("DELETE", re.compile(r"/table/([^/]+)"), self.drop_table),
            ("GET", re.compile(r"/queries"), self.queries),
            ("GET", re.compile(r"/query/([^/]+)"), self.query),
            ("POST", re.compile(r"/query"), self.submit),
            ("GET", re.compile(r"/result/([^/]+)"), self.result),
            ("GET", re.compile(r"/error/([^/]+)"), self.error),
            ("GET", re.compile(r"/system/info"), self.info),
            ("GET", re.compile(r"/api-docs/openapi\.json"), lambda body, query: openapi()),
        ]

    def call(self, method: str, target: str, body: bytes) -> object:
        url = urlsplit(target)
        for verb, pattern, handler in self.routes:
            if verb == method and (m := pattern.fullmatch(url.path.rstrip("/") or "/")):
                try:
                    parsed = json.loads(body) if body.strip() else None
                except ValueError as e:
                    raise _message(400, f"Malformed JSON: {e}") from e
                try:
                    return handler(parsed, parse_qs(url.query), *m.groups())
                except (TableMissing, QueryMissing) as e:
                    raise _message(404, f"No object with id {e.args[0]}") from e
                except CatalogError as e:
                    raise Refused(400, _problems(e.problems)) from e
        raise _message(404, "No such path")

    def tables(self, body, query):
        return [{"tableId": i, "name": n} for i, n in self.catalog.list_tables()]

    def table(self, body, query, table_id):
        t = self.catalog.get(table_id)
        return {"name": t.name, "columns": [{"name": c.name, "type": c.type} for c in t.columns]}

    def create_table(self, body, query):
        try:
            name, columns = body["name"], [Column(c["name"], c["type"]) for c in body["columns"]]
        except (TypeError, KeyError) as e:
            raise _message(422, "a table has a name and columns with names and types") from e
        return self.catalog.create(name, columns)

    def drop_table(self, body, query, table_id):
        self.catalog.drop(table_id)

    def queries(self, body, query):
        return [{"queryId": i, "status": s.value} for i, s in self.engine.list_queries()]

    def query(self, body, query, query_id):
        q = self.engine.get(query_id)
        return {"queryId": q.query_id, "status": q.status.value, "isResultAvailable": q.snapshot is not None and q.status == Status.COMPLETED, "queryDefinition": q.definition.wire()}

    def submit(self, body, query):
        try:
            definition = parse((body or {}).get("queryDefinition") if isinstance(body, dict) else None)
        except ValueError as e:
            raise Refused(400, _problems([(str(e), "queryDefinition")])) from e
        return self.engine.submit(definition)

    def result(self, body, query, query_id):
        body = body if isinstance(body, dict) else {}
        limit = body.get("rowLimit", query.get("rowLimit", [None])[0])
        flush = body.get("flushResult", query.get("flushResult", ["false"])[0] == "true")
        try:
            found = self.engine.fetch(query_id, None if limit is None else int(limit)).wire()
        except (NotAvailable, PlanError, ValueError) as e:
            raise _message(400, str(e)) from e
        if flush:
            self.engine.flush(query_id)
        return found

    def error(self, body, query, query_id):
        try:
            return _problems([(self.engine.error(query_id), None)])
        except NotAvailable as e:
            raise _message(400, str(e)) from e

    def info(self, body, query):
        return {"interfaceVersion": INTERFACE_VERSION, "version": __version__, "author": "marlstone", "uptime": int(time.monotonic() - self.began)}


def server(engine: Engine, port: int = 3000, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    api = Api(engine)

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def _answer(self):
            data = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            kind = "application/json"
            if self.command == "GET" and urlsplit(self.path).path.rstrip("/") == "/swagger-ui":
                code, body, kind = 200, PAGE.encode(), "text/html; charset=utf-8"
            else:
                try:
                    value, code = api.call(self.command, self.path, data), 200
                except Refused as r:
                    value, code = r.body, r.code
                except Exception as e:  # a handler's fault must not end the server
                    value, code = {"message": f"{type(e).__name__}: {e}"}, 500
                body = b"" if value is None else json.dumps(value, ensure_ascii=False).encode()
            self.send_response(code)
            self.send_header("Content-Type", kind)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        do_GET = do_PUT = do_POST = do_DELETE = _answer

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)


