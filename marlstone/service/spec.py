"""The OpenAPI description that the server publishes."""

from __future__ import annotations

INTERFACE_VERSION = "1.0.2"


def _ref(name: str) -> dict:
    return {"$ref": f"#/components/schemas/{name}"}


def _json(schema: dict, description: str) -> dict:
    return {"description": description, "content": {"application/json": {"schema": schema}}}


def _list(item: dict) -> dict:
    return {"type": "array", "items": item}


def openapi() -> dict:
    text, number, flag = {"type": "string"}, {"type": "integer", "format": "int64"}, {"type": "boolean"}
    missing, problems = _json(_ref("Message"), "No such object"), _json(_ref("Problems"), "The request was refused")
    by = lambda name: [{"name": name, "in": "path", "required": True, "schema": text}]
    body = lambda name: {"required": True, "content": {"application/json": {"schema": _ref(name)}}}
    obj = lambda required, **p: {"type": "object", "properties": p, "required": required}
    schemas = {
        "Message": obj(["message"], message=text),
        "Problems": obj(["problems"], problems=_list(obj(["error"], error=text, context=text))),
        "TableListing": obj(["tableId", "name"], tableId=text, name=text),
        "Column": obj(["name", "type"], name=text, type={"type": "string", "enum": ["INT64", "VARCHAR"]}),
        "Table": obj(["name", "columns"], name=text, columns=_list(_ref("Column"))),
        "QueryStatus": {"type": "string", "enum": ["CREATED", "PLANNING", "RUNNING", "COMPLETED", "FAILED"]},
        "QueryListing": obj(["queryId", "status"], queryId=text, status=_ref("QueryStatus")),
        "CopyQuery": obj(["sourceFilepath", "destinationTableName"], sourceFilepath=text, destinationTableName=text, destinationColumns=_list(text), doesCsvContainHeader=flag | {"default": False}),
        "SelectQuery": obj(["tableName"], tableName=text),
        "Definition": {"oneOf": [_ref("CopyQuery"), _ref("SelectQuery")]},
        "ExecuteQuery": obj(["queryDefinition"], queryDefinition=_ref("Definition")),
        "Query": obj(["queryId", "status"], queryId=text, status=_ref("QueryStatus"), isResultAvailable=flag, queryDefinition=_ref("Definition")),
        "ResultRequest": obj([], rowLimit=number, flushResult=flag | {"default": False}),
        "Result": _list(obj(["rowCount", "columns"], rowCount=number, columns=_list(_list({"oneOf": [number, text], "nullable": True})))),
        "SystemInfo": obj(["interfaceVersion", "version", "author", "uptime"], interfaceVersion=text, version=text, author=text, uptime=number),
    }
    paths = {
        "/tables": {"get": {"responses": {"200": _json(_list(_ref("TableListing")), "All tables")}}},
        "/table/{tableId}": {
            "get": {"parameters": by("tableId"), "responses": {"200": _json(_ref("Table"), "The table"), "404": missing}},
            "delete": {"parameters": by("tableId"), "responses": {"200": {"description": "Dropped"}, "404": missing}},
        },
        "/table": {"put": {"requestBody": body("Table"), "responses": {"200": _json(text, "Id of the new table"), "400": problems}}},
        "/queries": {"get": {"responses": {"200": _json(_list(_ref("QueryListing")), "All queries")}}},
        "/query/{queryId}": {"get": {"parameters": by("queryId"), "responses": {"200": _json(_ref("Query"), "The query"), "404": missing}}},
        "/query": {"post": {"requestBody": body("ExecuteQuery"), "responses": {"200": _json(text, "Id of the query"), "400": problems}}},
        "/result/{queryId}": {"get": {"parameters": by("queryId"), "requestBody": body("ResultRequest") | {"required": False}, "responses": {"200": _json(_ref("Result"), "Rows by column"), "400": _json(_ref("Message"), "No result"), "404": missing}}},
        "/error/{queryId}": {"get": {"parameters": by("queryId"), "responses": {"200": _json(_ref("Problems"), "Why it failed"), "400": _json(_ref("Message"), "It has not failed"), "404": missing}}},
        "/system/info": {"get": {"responses": {"200": _json(_ref("SystemInfo"), "About this server")}}},
    }
    return {"openapi": "3.0.3", "info": {"title": "Columnar analytics", "version": INTERFACE_VERSION}, "paths": paths, "components": {"schemas": schemas}}


PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>API</title></head><body><h1>API</h1><script>
const add = (to, tag, text) => { const e = document.createElement(tag); e.textContent = text || ''; to.append(e); return e; };
fetch('/api-docs/openapi.json').then(r => r.json()).then(s => { for (const [p, ms] of Object.entries(s.paths)) for (const [m, o] of Object.entries(ms)) {
const f = add(document.body, 'form'); add(f, 'h3', m.toUpperCase() + ' ' + p);
add(f, 'p', Object.entries(o.responses).map(([c, r]) => c + ': ' + r.description).join('; '));
const path = add(f, 'input'); path.value = p; path.size = 60;
const body = m === 'get' ? null : add(f, 'textarea'); add(f, 'button', 'Send'); const out = add(f, 'pre');
f.onsubmit = e => { e.preventDefault(); const sent = {method: m.toUpperCase()};
if (body && body.value) { sent.body = body.value; sent.headers = {'Content-Type': 'application/json'}; }
fetch(path.value, sent).then(async r => { out.textContent = r.status + ' ' + await r.text(); }, x => { out.textContent = x; }); }; } });
</script></body></html>"""
