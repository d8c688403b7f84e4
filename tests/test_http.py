"""The HTTP API over a small table."""

import json
import threading
import urllib.error
import urllib.request

import pytest

from palisade.model import Facts, UserCtx
from palisade.operators.engine import Snapshot
from palisade.queries import mask, on, policy, rows
from palisade.service import http, identity
from palisade.service.core import Governed
from palisade.sources.catalog import Catalog, FrameSource
from palisade.operators.dsl import Policy


@pytest.fixture(scope="module")
def call(spark):
    c = Catalog()
    c.add(FrameSource("lake", {"main.people": lambda s: s.createDataFrame([(1, "acme", "Ann"), (2, "beta", "Bob")], "id int, tenant string, name string")}))
    rules = [
        policy("SqlAccessPolicy", "all", effect="allow", match={"any": [{"resources": {"catalogs": ["lake"]}, "subjects": {"groups": ["g"]}}]}),
        rows("people", column="tenant", op="Equals", value="{{ request.headers.x-tenant }}"), mask("people", "name", "truncate", length=1),
        policy("ApprovalPolicy", "ask", match=on("people"), when={"columnsAccessed": ["id"]}),
    ]
    g = Governed(spark, c, Snapshot.compile(rules))
    keys = [{"id": n, "hash": identity.api_key_hash("pep", n, "s"), "groups": gs} for n, gs in (("ann", ["g"]), ("boss", ["g", "approvers"]), ("guest", []))]
    server = http.serve(g, http.authenticator([Policy("SubjectBinding", "b", spec={"apiKeys": keys})], "pep"))
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(path, body=None, who="ann", tenant="acme"):
        headers = {"X-Api-Key": f"{who}.s", "X-Tenant": tenant}
        r = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", None if body is None else json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(r) as got:
                return got.status, got.read().decode()
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())["error"]

    yield ask
    server.shutdown()


def test_queries(call):
    status, text = call("/v1/query", {"sql": "SELECT name FROM lake.main.people"})
    assert status == 200 and json.loads(text)["rows"] == [["A"]]
    assert call("/v1/query", {"sql": "SELECT name FROM lake.main.people", "format": "csv"}, tenant="beta") == (200, "name\nB\n")
    assert call("/v1/query", {"sql": "SELECT name FROM lake.main.people WHERE name = :n", "params": {"n": "A"}})[0] == 200
    assert call("/v1/query", {"sql": "DROP TABLE x"})[0] == 400 and call("/v1/query", {"sql": "SELECT name FROM lake.main.people"}, who="guest")[0] == 403
    assert call("/v1/query", {"sql": "SELECT 1", "format": "arrow"})[1]["code"] == "ERR_UNSUPPORTED_SYNTAX" and call("/v1/whoami", who="nobody")[0] == 401


def test_discovery_and_approval(call):
    assert json.loads(call("/v1/catalogs")[1]) == {"catalogs": ["lake"]} and json.loads(call("/v1/tables")[1])["tables"] == ["lake.main.people"]
    assert [c["mask"] for c in json.loads(call("/v1/tables/lake.main.people")[1])["columns"]] == [None, None, "truncate"]
    assert json.loads(call("/v1/explain", {"sql": "SELECT name FROM lake.main.people"})[1])["outcome"] == "allow" and call("/healthz")[0] == 200
    sql = {"sql": "SELECT id FROM lake.main.people"}
    status, text = call("/v1/query", sql)
    assert status == 202
    id_ = json.loads(text)["error"]["details"]["approval_id"] if isinstance(text, str) else text["details"]["approval_id"]
    assert json.loads(call(f"/v1/approvals/{id_}")[1])["state"] == "pending" and call(f"/v1/approvals/{id_}", {"approve": True})[0] == 403
    assert json.loads(call(f"/v1/approvals/{id_}", {"approve": True}, who="boss")[1]) == {"state": "approved"}
    assert json.loads(call("/v1/query", sql | {"approval_id": id_})[1])["rows"] == [[1]] and call("/v1/nothing")[0] == 400


def test_facts_reach_templates(call):
    assert Facts("1.2.3.4", "ua", {"a": "b"}).headers["a"] == "b" and UserCtx("x").groups == ()
    assert json.loads(call("/v1/query", {"sql": "SELECT count(*) AS n FROM lake.main.people"}, tenant="none")[1])["rows"] == [[0]]
