import json
import threading
import time
from http.client import HTTPConnection

import pytest

from marlstone.plans.engine import Engine
from marlstone.service.server import server
from marlstone.service.spec import openapi
from marlstone.service.validate import Validator, mismatches


@pytest.fixture
def call(spark, catalog):
    engine = Engine(spark, catalog)
    http = server(engine, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def send(method, path, body=None):
        connection = HTTPConnection(*http.server_address, timeout=60)
        connection.request(method, path, body if isinstance(body, (str, type(None))) else json.dumps(body), {"Content-Type": "application/json"})
        answer = connection.getresponse()
        data = answer.read()
        return answer.status, json.loads(data) if data and "json" in answer.headers["Content-Type"] else data

    send.url = f"http://{http.server_address[0]}:{http.server_address[1]}"
    yield send
    http.shutdown()
    engine.close()


TABLE = {"name": "people", "columns": [{"name": "id", "type": "INT64"}, {"name": "name", "type": "VARCHAR"}]}


def finished(call, query):
    while (state := call("GET", f"/query/{query}")[1])["status"] not in ("COMPLETED", "FAILED"):
        time.sleep(0.05)
    return state


def test_tables(call):
    code, table = call("PUT", "/table", TABLE)
    assert code == 200 and isinstance(table, str)
    assert call("GET", "/tables") == (200, [{"tableId": table, "name": "people"}])
    assert call("GET", f"/table/{table}") == (200, TABLE)
    code, answer = call("PUT", "/table", TABLE)
    assert code == 400 and "already exists" in answer["problems"][0]["error"]
    code, answer = call("PUT", "/table", {"name": "", "columns": []})
    assert code == 400 and [p["context"] for p in answer["problems"]] == ["name", "columns"]
    assert call("DELETE", f"/table/{table}") == (200, b"")
    assert call("DELETE", f"/table/{table}")[0] == call("GET", f"/table/{table}")[0] == 404


def test_queries(call, tmp_path):
    call("PUT", "/table", TABLE)
    (tmp_path / "p.csv").write_text("id,name\n1,Ann\n2,Zoé\n3,\n")
    copy = {"sourceFilepath": str(tmp_path / "p.csv"), "destinationTableName": "people", "doesCsvContainHeader": True}
    code, c = call("POST", "/query", {"queryDefinition": copy})
    assert code == 200
    assert finished(call, c) == {"queryId": c, "status": "COMPLETED", "isResultAvailable": False, "queryDefinition": copy}
    s = call("POST", "/query", {"queryDefinition": {"tableName": "people"}})[1]
    assert finished(call, s)["isResultAvailable"]
    assert call("GET", f"/result/{s}") == (200, [{"rowCount": 3, "columns": [[1, 2, 3], ["Ann", "Zoé", ""]]}])
    assert call("GET", f"/result/{s}", {"rowLimit": 2})[1] == [{"rowCount": 2, "columns": [[1, 2], ["Ann", "Zoé"]]}]
    assert call("GET", f"/result/{s}?rowLimit=1")[1][0]["rowCount"] == 1
    assert call("GET", f"/result/{s}", {"rowLimit": -1})[0] == 400
    assert call("GET", f"/result/{s}", {"flushResult": True})[0] == 200
    code, answer = call("GET", f"/result/{s}")
    assert code == 400 and "not available" in answer["message"]
    assert not call("GET", f"/query/{s}")[1]["isResultAvailable"]
    assert call("GET", f"/result/{c}")[0] == call("GET", f"/error/{c}")[0] == 400
    assert [q["queryId"] for q in call("GET", "/queries")[1]] == [c, s]


def test_failed_query(call, tmp_path):
    call("PUT", "/table", TABLE)
    (tmp_path / "p.csv").write_text("x,Ann\n")
    q = call("POST", "/query", {"queryDefinition": {"sourceFilepath": str(tmp_path / "p.csv"), "destinationTableName": "people"}})[1]
    assert finished(call, q)["status"] == "FAILED"
    assert "failed to parse 'x'" in call("GET", f"/error/{q}")[1]["problems"][0]["error"]
    assert call("GET", f"/result/{q}")[0] == 400


def test_refusals(call):
    assert call("POST", "/query", {"queryDefinition": {"tableName": "none"}})[0] == 400
    assert call("POST", "/query", {"queryDefinition": {}})[0] == 400
    assert call("PUT", "/table", "{not json")[0] == 400
    assert call("PUT", "/table", {"name": "x"})[0] == 422
    assert call("GET", "/query/none")[0] == call("GET", "/result/none")[0] == call("GET", "/error/none")[0] == call("GET", "/nowhere")[0] == 404


def test_about(call):
    info = call("GET", "/system/info")[1]
    assert set(info) == {"interfaceVersion", "version", "author", "uptime"}
    assert call("GET", "/api-docs/openapi.json")[1] == openapi()
    assert call("GET", "/swagger-ui")[0] == 200
    defined = set(openapi()["components"]["schemas"])
    used = {r.rpartition("/")[2] for r in _refs(openapi())}
    assert used <= defined


def _refs(x):
    if isinstance(x, dict):
        yield from ([x["$ref"]] if "$ref" in x else [])
        for v in x.values():
            yield from _refs(v)
    elif isinstance(x, list):
        for v in x:
            yield from _refs(v)


def test_validator(call, tmp_path):
    (tmp_path / "v.csv").write_text("1,a\n2,b\n")
    check = Validator(call.url)
    assert check.run(str(tmp_path / "v.csv")) == [] and check.checks > 25


def test_mismatches():
    spec = openapi()
    table = spec["components"]["schemas"]["Table"]
    assert mismatches({"name": "t", "columns": [{"name": "a", "type": "INT64"}]}, table, spec) == []
    assert mismatches({"name": 1, "columns": [{"name": "a", "type": "FLOAT", "x": 1}]}, table, spec) != []
    assert mismatches({"columns": None}, table, spec) == ["$: 'name' is missing", "$.columns: NoneType instead of array"]
    assert mismatches([{"rowCount": True, "columns": []}], spec["components"]["schemas"]["Result"], spec) != []
