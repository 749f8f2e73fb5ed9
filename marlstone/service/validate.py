"""A black-box check of a running server against the description that it publishes.

Walks through every route with a table and queries of its own, and compares status codes and the
shape of each answer with the server's OpenAPI document. Polls queries before it fetches results.
"""

from __future__ import annotations

import json
import time
import uuid
from urllib.error import HTTPError
from urllib.request import Request, urlopen


def mismatches(value: object, schema: dict, spec: dict, at: str = "$") -> list[str]:
    """Where a JSON value departs from a schema."""
    if "$ref" in schema:
        schema = spec["components"]["schemas"][schema["$ref"].rpartition("/")[2]]
    if value is None and schema.get("nullable"):
        return []
    if "oneOf" in schema:
        found = [mismatches(value, s, spec, at) for s in schema["oneOf"]]
        return [] if any(not f for f in found) else min(found, key=len)
    kinds = {"object": dict, "array": list, "string": str, "integer": int, "boolean": bool}
    kind = kinds[schema["type"]]
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        return [f"{at}: {type(value).__name__} instead of {schema['type']}"]
    if "enum" in schema and value not in schema["enum"]:
        return [f"{at}: '{value}' is none of {schema['enum']}"]
    if kind is list:
        return [m for i, v in enumerate(value) for m in mismatches(v, schema["items"], spec, f"{at}[{i}]")]
    if kind is dict:
        missing = [f"{at}: '{k}' is missing" for k in schema.get("required", []) if k not in value]
        extra = [f"{at}: '{k}' is not described" for k in value if k not in schema["properties"]]
        return missing + extra + [m for k, v in value.items() if k in schema["properties"] for m in mismatches(v, schema["properties"][k], spec, f"{at}.{k}")]
    return []


class Validator:
    def __init__(self, url: str):
        self.url, self.problems, self.checks = url.rstrip("/"), [], 0
        self.spec = self._send("GET", "/api-docs/openapi.json")[1]

    def _send(self, method: str, path: str, body: object = None) -> tuple[int, object]:
        request = Request(self.url + path, None if body is None else json.dumps(body).encode(), {"Content-Type": "application/json"}, method=method)
        try:
            with urlopen(request, timeout=60) as answer:
                code, data = answer.status, answer.read()
        except HTTPError as e:
            code, data = e.code, e.read()
        return code, json.loads(data) if data else None

    def expect(self, method: str, route: str, code: int, body: object = None, **path: str) -> object:
        """Sends a request; notes another status than expected, or an answer of another shape."""
        self.checks += 1
        taken = self.spec["paths"][route][method.lower()].get("requestBody")
        if code == 200 and body is not None and taken:
            self.problems += [f"{method} {route}, request: {m}" for m in mismatches(body, taken["content"]["application/json"]["schema"], self.spec)]
        got, value = self._send(method, route.format(**path), body)
        if got != code:
            self.problems.append(f"{method} {route}: status {got} instead of {code}: {value}")
            return None
        described = self.spec["paths"][route][method.lower()]["responses"].get(str(code))
        if described is None:
            self.problems.append(f"{method} {route}: status {code} is not described")
        elif "content" in described:
            self.problems += [f"{method} {route}, {code}: {m}" for m in mismatches(value, described["content"]["application/json"]["schema"], self.spec)]
        return value

    def finished(self, query: str) -> dict:
        while (state := self.expect("GET", "/query/{queryId}", 200, queryId=query)) and state["status"] not in ("COMPLETED", "FAILED"):
            time.sleep(0.1)
        return state or {}

    def _rows(self, table: str) -> int:
        query = self.expect("POST", "/query", 200, {"queryDefinition": {"tableName": table}})
        self.finished(query)
        return sum(part["rowCount"] for part in self.expect("GET", "/result/{queryId}", 200, queryId=query) or [])

    def run(self, csv_path: str | None = None) -> list[str]:
        """All checks; ``csv_path``: a file the server can read, of a number and a text in each row."""
        name = f"validate_{uuid.uuid4().hex}"
        columns = [{"name": "id", "type": "INT64"}, {"name": "name", "type": "VARCHAR"}]
        self.expect("GET", "/system/info", 200)
        self.expect("PUT", "/table", 400, {"name": "", "columns": []})
        table = self.expect("PUT", "/table", 200, {"name": name, "columns": columns})
        self.expect("PUT", "/table", 400, {"name": name, "columns": columns})
        self.expect("GET", "/tables", 200)
        if self.expect("GET", "/table/{tableId}", 200, tableId=table) != {"name": name, "columns": columns}:
            self.problems.append("GET /table/{tableId}: another table than was created")
        self.expect("GET", "/table/{tableId}", 404, tableId="none")
        self.expect("POST", "/query", 400, {"queryDefinition": {"tableName": f"{name}_none"}})
        select = self.expect("POST", "/query", 200, {"queryDefinition": {"tableName": name}})
        if self.finished(select).get("status") == "COMPLETED":
            self.expect("GET", "/result/{queryId}", 200, queryId=select)
            self.expect("GET", "/error/{queryId}", 400, queryId=select)
            self.expect("GET", "/result/{queryId}", 200, {"flushResult": True}, queryId=select)
            self.expect("GET", "/result/{queryId}", 400, queryId=select)
        else:
            self.problems.append("SELECT of an empty table failed")
        if csv_path:
            copy = {"sourceFilepath": csv_path, "destinationTableName": name}
            done = self.expect("POST", "/query", 200, {"queryDefinition": copy})
            if self.finished(done).get("status") != "COMPLETED":
                self.problems.append(f"COPY failed: {self.expect('GET', '/error/{queryId}', 200, queryId=done)}")
            self.expect("GET", "/result/{queryId}", 400, queryId=done)
            without = self._rows(name)
            self.finished(self.expect("POST", "/query", 200, {"queryDefinition": copy | {"doesCsvContainHeader": True}}))
            if self._rows(name) != 2 * without - 1:
                self.problems.append("COPY: the header flag doesn't default to false, or true doesn't leave out the first record")
            bad = self.expect("POST", "/query", 200, {"queryDefinition": copy | {"destinationColumns": ["name", "id"]}})
            if self.finished(bad).get("status") == "FAILED":
                self.expect("GET", "/error/{queryId}", 200, queryId=bad)
            again = self.expect("POST", "/query", 200, {"queryDefinition": {"tableName": name}})
            self.finished(again)
            rows = self.expect("GET", "/result/{queryId}", 200, {"rowLimit": 1}, queryId=again)
            if not rows or rows[0]["rowCount"] != 1 or any(len(c) != 1 for c in rows[0]["columns"]):
                self.problems.append("GET /result/{queryId}: rowLimit 1 gave other than one row")
        for route in ("/query/{queryId}", "/result/{queryId}", "/error/{queryId}"):
            self.expect("GET", route, 404, queryId="none")
        self.expect("GET", "/queries", 200)
        self.expect("DELETE", "/table/{tableId}", 200, tableId=table)
        self.expect("DELETE", "/table/{tableId}", 404, tableId=table)
        return self.problems
