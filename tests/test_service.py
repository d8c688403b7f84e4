"""Governed queries end to end: gate, leaks, masks in place, audit, limits, approvals, discovery, sources, streams."""

import datetime as dt
import random
import sqlite3

import pytest

from palisade.model import Facts, GovernError, TableKey, UserCtx
from palisade.operators.dsl import Policy, decode
from palisade.operators.engine import Snapshot
from palisade.plans import parse as P
from palisade.queries import ALICE, ALLOW, mask, on, policy, rewrite, rows
from palisade.service import identity
from palisade.service.approvals import Approvals
from palisade.service.audit import AuditLog, broken_links, verify
from palisade.service.core import Governed, Settings, as_tools
from palisade.service.limits import BudgetLimit, Budgets, Bucket, DecisionCache, Gate, RateLimiter
from palisade.service.policytest import Suite, report
from palisade.sources.catalog import Catalog, FrameSource, ParquetSource, from_manifest, view_name

PEOPLE = [(1, "acme", "Ann", "111-22-3333", 10.0), (2, "acme", "Bob", "222-33-4444", 20.0), (3, "beta", "Cy", "333-44-5555", 30.0), (4, None, None, None, None)]
TENANT = rows("people", column="tenant", op="Equals", value="{{ subject.claims.tenant }}")
USER = UserCtx("alice", groups=("analysts",), claims={"tenant": "acme"})


def session(spark, *policies, allow=True, **kw) -> Governed:
    c = Catalog()
    people = lambda s: s.createDataFrame(PEOPLE, "id int, tenant string, name string, ssn string, pay double")
    other = lambda s: s.createDataFrame([(1, "x"), (3, "y")], "id int, note string")
    c.add(FrameSource("lake", {"main.people": people, "main.other": other}))
    c.add(FrameSource("ref", {"main.other": other}))
    settings = kw.pop("settings", Settings(default_namespace=("lake", "main")))
    return Governed(spark, c, Snapshot.compile([*([policy("SqlAccessPolicy", "all", effect="allow", match={"any": [{"resources": {"catalogs": ["*"]}}]})] if allow else []), *policies]), settings=settings, **kw)


def code(f, *a, **k) -> str:
    with pytest.raises(GovernError) as e:
        f(*a, **k)
    return e.value.code


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELEC 1", "ERR_SYNTAX"), ("SELECT 1; SELECT 2", "ERR_MULTIPLE_STATEMENTS"), ("INSERT INTO people SELECT * FROM people", "ACL_REJECTED"), ("UPDATE people SET id = 1", "ACL_REJECTED"), ("DELETE FROM people", "ACL_REJECTED"),
        ("MERGE INTO people p USING other o ON p.id = o.id WHEN MATCHED THEN DELETE", "ACL_REJECTED"), ("DROP TABLE people", "ERR_UNSUPPORTED_SYNTAX"), ("SET a = 1", "ERR_UNSUPPORTED_SYNTAX"), ("SHOW TABLES", "ERR_UNSUPPORTED_SYNTAX"),
        ("CREATE TABLE x AS SELECT * FROM people", "ERR_UNSUPPORTED_SYNTAX"), ("CACHE TABLE people", "ERR_UNSUPPORTED_SYNTAX"), ("BEGIN SELECT 1; END", "ERR_UNSUPPORTED_SYNTAX"), ("SELECT TRANSFORM(id) USING 'cat' FROM people", "ERR_UNSUPPORTED_SYNTAX"),
        ("SELECT reflect('java.lang.System', 'exit', 1)", "ERR_UNSUPPORTED_SYNTAX"), ("SELECT raise_error(name) FROM people", "ERR_UNSUPPORTED_SYNTAX"), ("SELECT * FROM parquet.`/tmp/x`", "ACL_DENIED"), ("SELECT * FROM __gov_x_0", "ACL_DENIED"),
        ("SELECT * FROM IDENTIFIER('people')", "ERR_UNSUPPORTED_SYNTAX"), ("SELECT '" + "x" * (1 << 20) + "'", "ERR_PAYLOAD_TOO_LARGE"), ("SELECT * FROM nowhere", "ACL_DENIED"), ("SELECT '${spark.master}' FROM nowhere", "ACL_DENIED"), ("EXPLAIN CODEGEN SELECT 1", "ERR_UNSUPPORTED_SYNTAX"),
        ("SELECT nope FROM people", "ERR_REWRITE_FAILED"), ("SELECT 1", "ACL_DENIED"), ("SELECT * FROM range(3)", "ACL_DENIED"), ("INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1", "ERR_UNSUPPORTED_SYNTAX"),
    ],
)
def test_gate(spark, sql, want):
    assert code(session(spark).sql, sql, USER) == want


LEAKS = [
    "SELECT * FROM people", "SELECT name FROM other o JOIN people p ON o.id = p.id OR true", "SELECT (SELECT max(name) FROM people) AS x FROM other", "SELECT id FROM other WHERE 'Cy' IN (SELECT name FROM people)",
    "SELECT id FROM other ORDER BY (SELECT count(*) FROM people WHERE name = 'Cy')", "WITH x AS (SELECT * FROM people) SELECT * FROM x", "WITH people AS (SELECT * FROM people) SELECT * FROM people", "SELECT name FROM (SELECT * FROM (SELECT * FROM people) a) b",
    "SELECT name FROM people UNION SELECT note FROM other", "SELECT name FROM other, LATERAL (SELECT name FROM people) t", "SELECT a.name FROM people a JOIN people b USING (name)", "SELECT max(name) FROM people HAVING max(name) > (SELECT min(name) FROM people)",
    "SELECT PEOPLE.Name FROM LAKE.MAIN.PEOPLE", "SELECT lake.main.people.name FROM lake.main.people", "SELECT `name` FROM `lake`.`main`.`people` AS t", "SELECT upper(name) FROM people TABLESAMPLE (100 PERCENT) p", "SELECT collect_list(name) FROM people",
    "WITH RECURSIVE r(n) AS (SELECT name FROM people UNION ALL SELECT n FROM r WHERE false) SELECT * FROM r", "SELECT /* FROM people */ name FROM people -- people", "SELECT * FROM people PIVOT (max(pay) FOR tenant IN ('acme', 'beta'))",
    "SELECT first_value(name) OVER (PARTITION BY tenant ORDER BY id) FROM people", "SELECT struct(*) FROM people", "EXPLAIN SELECT name FROM people WHERE name = 'Cy'",
]


@pytest.mark.parametrize("sql", LEAKS)
def test_nothing_hidden_leaks(spark, sql):
    """Neither rows of other tenants nor raw names come out, wherever the table stands."""
    g = session(spark, TENANT, mask("people", "name", "constant", value="***"), mask("people", "ssn", "null"))
    text = str(g.execute(sql, USER).rows)
    assert not any(x in text for x in ("Ann", "Bob", "Cy", "beta", "333", "111-22"))


def test_random_nestings(spark):
    r = random.Random(5)
    wraps = ["SELECT * FROM ({q}) t", "WITH c AS ({q}) SELECT * FROM c", "SELECT name FROM ({q}) t", "SELECT DISTINCT name FROM ({q}) t", "SELECT name FROM ({q}) t WHERE EXISTS (SELECT 1 FROM people)", "({q}) UNION ALL ({q})", "SELECT max(name) AS name FROM ({q}) t"]
    g = session(spark, TENANT, mask("people", "name", "hash"))
    for _ in range(12):
        q = "SELECT name FROM people"
        for _ in range(r.randint(1, 3)):
            q = r.choice(wraps).format(q=q)
        text = str(g.execute(q, USER).rows)
        assert "Ann" not in text and "Cy" not in text


POST = [mask("people", "ssn", "fpe", keyRef="0123456789abcdef"), mask("people", "pay", "jitter", range=0.1, seed="s")]


@pytest.mark.parametrize("sql", ["SELECT ssn FROM people", "SELECT * FROM people", "SELECT ssn AS x, ssn FROM people", "WITH c AS (SELECT ssn s FROM people) SELECT s FROM c", "SELECT s FROM (SELECT ssn AS s FROM people) t LIMIT 9", "SELECT p.ssn FROM people p JOIN other o ON p.id = o.id", "SELECT ssn FROM people WHERE id < 9 ORDER BY id"])
def test_post_masks_on_bare_columns(spark, sql):
    got = session(spark, *POST).execute(sql, USER)
    assert got.row_count and not any(x in str(got.rows) for x in ("111-22", "222-33", "333-44"))


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT upper(ssn) FROM people", "SELECT id FROM people WHERE ssn = '111-22-3333'", "SELECT ssn FROM people ORDER BY ssn", "SELECT count(*) FROM people GROUP BY ssn", "SELECT max(ssn) FROM people", "SELECT ssn FROM people UNION ALL SELECT note FROM other",
        "SELECT DISTINCT ssn FROM people", "SELECT (SELECT max(ssn) FROM people)", "SELECT id FROM other WHERE 'x' IN (SELECT ssn FROM people)", "SELECT a.id FROM people a JOIN people b ON a.ssn = b.ssn", "SELECT row_number() OVER (ORDER BY ssn) FROM people",
        "SELECT pay + 1 FROM people", "SELECT struct(ssn) FROM people", "SELECT (SELECT ssn FROM people WHERE id = 1) FROM other", "SELECT a.id FROM people a JOIN people b USING (ssn)", "WITH c AS (SELECT ssn AS s FROM people) SELECT concat(s, '') FROM c",
    ],
)
def test_post_masks_refused_elsewhere(spark, sql):
    assert code(session(spark, *POST).execute, sql, USER) == "ERR_MASK_UNSUPPORTED_CONTEXT"


def test_mask_values(spark):
    get = lambda m: [r[0] for r in session(spark, m).execute(f"SELECT {m.spec['match']['any'][0]['resources']['columns'][0]} FROM people ORDER BY id", USER).rows]
    assert get(mask("people", "name", "partial", showFirst=1, showLast=1)) == ["A*n", "B*b", "Cy", None]
    assert get(mask("people", "name", "constant", value="x")) == ["x"] * 4 and get(mask("people", "id", "null")) == [None] * 4
    assert get(mask("people", "ssn", "regex", pattern="([0-9])-", replacement=r"\1/$"))[0] == "111/$22/$3333"
    assert get(mask("people", "name", "truncate", length=2, suffix="..")) == ["An..", "Bo..", "Cy", None]
    salted = get(mask("people", "name", "hash", saltRef="s"))
    assert salted[3] is not None and get(mask("people", "name", "hash"))[3] is None
    jit = [r[0] for r in session(spark, POST[1]).execute("SELECT pay FROM people WHERE id < 9 ORDER BY id", USER).rows]
    assert all(abs(a / b - 1) <= 0.1 for a, b in zip(jit, (10.0, 20.0, 30.0), strict=False)) and jit[3] is None
    for kind in ("name", "first_name", "email", "phone", "uuid", "city"):
        fake = [r[0] for r in session(spark, mask("people", "name", "fake", fakeType=kind, seed="k")).execute("SELECT name FROM people", USER).rows]
        assert fake[3] is None and all(fake[:3]) and "Ann" not in fake
    assert code(session(spark, mask("people", "name", "jitter", range=0.1, seed="x")).sql, "SELECT name FROM people", USER) == "ERR_REWRITE_FAILED"


def test_golden_mask_values(spark):
    from pyspark.sql import functions as F

    from palisade.functions.masks import default_registry

    df = spark.createDataFrame([("alice@example.com", "x", "a1b2", "abcdefgh")], "a string, x string, r string, t string")
    m = lambda n, c, **k: default_registry().column(n, F.col(c), df.schema[c].dataType, k)
    got = df.select(m("partial", "a", showFirst=2, showLast=1), m("hash", "x", saltRef="salt"), m("regex", "r", pattern="[0-9]", replacement="#"), m("truncate", "t", length=4, suffix="...")).first()
    assert tuple(got) == ("al**************m", "c9ef43a03d58f2cb9b0c4b069c179595739f5181a5565c8db5dbb124564ea819", "a#b#", "abcd...")


def test_missing_claim_denies(spark):
    assert code(session(spark, TENANT).sql, "SELECT * FROM people", UserCtx("x", groups=("analysts",))) == "ACL_DENIED"


def test_limits_and_samples(spark):
    g = session(spark, rewrite(limit={"max": 2}))
    assert g.execute("SELECT id FROM people ORDER BY id", USER).rows == [(1,), (2,)] and g.execute("SELECT id FROM people ORDER BY id LIMIT 1", USER).row_count == 1
    from palisade.plans.secure import sampled

    df = spark.range(1000)
    assert sampled(df, 0.1, "reservoir", 1).count() == 100 and sampled(df, 1.0).count() == 1000 and 50 < sampled(df, 0.1, "bernoulli", 3).count() < 160
    capped = session(spark, settings=Settings(max_rows=2, default_namespace=("lake", "main"))).execute("SELECT id FROM people", USER)
    assert (capped.row_count, capped.truncated, capped.warning) == (2, True, "ERR_RESULT_TRUNCATED")
    exact = session(spark).execute("SELECT id FROM people", USER, max_rows=4)
    assert not exact.truncated


def test_timeout(spark):
    g = session(spark, rewrite(timeout="500ms"))
    slow = "SELECT count(*) FROM people a, range(100000000) b, range(1000) c WHERE a.id + b.id + c.id < 0"
    assert code(g.execute, slow, USER) == "ERR_TIMEOUT"


def test_cross_catalog_and_arguments(spark):
    g = session(spark, settings=Settings(cross_catalog=False))
    assert code(g.sql, "SELECT * FROM lake.main.people p JOIN ref.main.other o ON p.id = o.id", USER) == "ACL_REJECTED"
    assert session(spark).execute("SELECT name FROM people WHERE id = :i", USER, args={"i": 2}).rows == [("Bob",)]


def test_results_render(spark):
    r = session(spark).execute("SELECT id, name, id = 1 AS one, TIMESTAMP '2024-01-02 03:04:05' AS t FROM people ORDER BY id LIMIT 1", USER)
    assert r.to_csv() == "id,name,one,t\n1,Ann,true,2024-01-02T03:04:05Z\n" and '"row_count": 1' in r.to_json()
    assert sorted(session(spark).stream("SELECT id FROM people", USER)) == [(1,), (2,), (3,), (4,)]


def test_shape(spark):
    s = P.parse(spark, "WITH c AS (SELECT a FROM x.y.z) SELECT t.a, count(*) FROM c t JOIN x.y.q u ON t.a = u.b, x.y.w WHERE t.d > 5 AND u.e IN ('p', 'q') AND f IS NULL AND 3 < g GROUP BY t.a ORDER BY 1 LIMIT 7").shape
    f = s.facts()
    assert (f["has_cte"], f["is_aggregate"], f["has_where"], f["has_order_by"], f["limit"], f["joins"], f["group_by_columns"]) == (True, True, True, True, 7, 1, ["t.a"])
    assert {(c.column, c.op, c.value) for c in s.comparisons} >= {("t.d", ">", "5"), ("u.e", "in", "p"), ("u.e", "in", "q"), ("f", "isnull", ""), ("g", ">", "3")}
    assert P.parse(spark, "SELECT * FROM a.b.c UNION SELECT 1").shape.has_union and P.parse(spark, "SELECT x.* FROM a.b.c x").shape.has_select_star
    assert P.fallback_tables("SELEC * FROM a.b JOIN \"c\" -- FROM d\n WHERE 'FROM e'") == [("a", "b"), ("c",)]
    assert P.fingerprint("SELECT 1 FROM t") == P.fingerprint("select  2\nfrom t") != P.fingerprint("select 2 from u")


def test_audit(spark, tmp_path):
    log = AuditLog(tmp_path, seed="s", max_bytes=600)
    g = session(spark, TENANT, audit=log)
    g.execute("SELECT id FROM people", USER, meta={"k": "v"})
    code(g.sql, "DROP TABLE people", USER)
    g.sql("SELECT id FROM people", USER)
    assert [r["event_type"] for r in log.tail()] == ["access", "completion", "denied", "access"] and log.tail(1)[0]["tables"] == ["lake.main.people"]
    assert verify(tmp_path, "s") == {"ok": True, "records": 4} and broken_links(spark, str(tmp_path), "s").count() == 0
    assert AuditLog(tmp_path, seed="s").write("config")["prior_hash"] == log.prior and len(log.files()) > 1
    target = log.files()[0]
    target.write_text(target.read_text().replace("alice", "mallory"))
    assert verify(tmp_path, "s")["reason"] == "hash does not match" and "hash does not match" in {r["reason"] for r in broken_links(spark, str(tmp_path), "s").collect()}


def test_audit_fails_closed(spark, tmp_path):
    log = AuditLog(tmp_path / "a")
    g = session(spark, audit=log)
    log.folder = tmp_path / "gone"
    assert code(g.sql, "SELECT id FROM people", USER) == "ERR_AUDIT_UNAVAILABLE"


def test_rates_budgets_gate_cache(spark):
    now = [0.0]
    b = Bucket(2, 2, lambda: now[0])
    assert [b.take(), b.take(), b.take()] == [True, True, False]
    now[0] = 0.5
    assert b.take() and not b.take()
    g = session(spark, rates=RateLimiter(subjects={"alice": (0.001, 1)}))
    g.sql("SELECT id FROM people", USER)
    assert code(g.sql, "SELECT id FROM people", USER) == "ERR_RATE_LIMITED"
    day = [dt.datetime(2024, 1, 1, tzinfo=dt.UTC)]
    budgets = Budgets(default=BudgetLimit(rows=3), now=lambda: day[0])
    g = session(spark, budgets=budgets)
    g.execute("SELECT id FROM people", USER)
    assert budgets.used(USER)[1] == 4 and code(g.execute, "SELECT id FROM people", USER) == "ERR_BUDGET_EXCEEDED"
    day[0] += dt.timedelta(days=1)
    assert g.execute("SELECT id FROM people LIMIT 1", USER).row_count == 1
    gate = Gate(1, 0.01)
    with gate.slot(), pytest.raises(GovernError), gate.slot():
        pass
    cache = DecisionCache(size=2, ttl=10, clock=lambda: now[0])
    g = session(spark, TENANT, cache=cache)
    for user in (USER, USER, UserCtx("bob", claims={"tenant": "beta"})):
        g.sql("SELECT id FROM people", user)
    assert len(cache.known) == 2 and g.execute("SELECT name FROM people", UserCtx("bob", claims={"tenant": "beta"})).rows == [("Cy",)]
    now[0] = 20
    assert cache.get(next(iter(cache.known))) is None


def test_approvals(spark):
    now, told = [0.0], []
    a = Approvals(clock=lambda: now[0], wait=100, grant=50, notify=told.append)
    g = session(spark, policy("ApprovalPolicy", "ask", match=on("people"), when={"columnsAccessed": ["ssn"]}, reason="pii"), approvals=a)
    sql = "SELECT ssn FROM people"
    with pytest.raises(GovernError) as e:
        g.sql(sql, USER)
    id_ = e.value.details["approval_id"]
    assert e.value.code == "ERR_APPROVAL_PENDING" and e.value.status == 202 and told[0].policy == "ask"
    with pytest.raises(GovernError) as again:
        g.sql(sql, USER)
    assert again.value.details["approval_id"] == id_ and code(g.sql, sql, USER, approval_id=id_) == "ERR_APPROVAL_PENDING"
    assert code(a.decide, id_, True, "alice") == "ACL_DENIED"
    a.decide(id_, True, "boss")
    assert code(g.sql, sql, UserCtx("bob"), approval_id=id_) == "ACL_DENIED" and code(g.sql, sql + " LIMIT 1", USER, approval_id=id_) == "ACL_DENIED"
    assert g.execute(sql, USER, approval_id=id_).row_count == 4 and code(g.sql, sql, USER, approval_id=id_) == "ERR_APPROVAL_EXPIRED"
    other = a.ask(USER, "x", "p", "r").id
    a.decide(other, False, "boss")
    assert code(a.redeem, other, USER, "x") == "ERR_APPROVAL_REJECTED"
    late = a.ask(USER, "y", "p", "r").id
    now[0] = 101
    assert a.get(late).state == "expired" and g.execute("SELECT id FROM people", USER).row_count == 4


def test_discovery(spark):
    g = session(spark, policy("SqlAccessPolicy", "no", effect="deny", match={"any": [{"resources": {"catalogs": ["ref"]}}]}), TENANT, mask("people", "s*", "null"))
    assert g.list_tables(USER) == (["lake.main.other", "lake.main.people"], "") and g.list_tables(USER, limit=1) == (["lake.main.other"], "lake.main.other")
    assert g.list_tables(USER, cursor="lake.main.other") == (["lake.main.people"], "") and g.catalogs(USER) == ["lake"]
    cols = {c["name"]: c for c in g.describe("people", USER)}
    assert cols["ssn"]["mask"] == "null" and cols["id"]["mask"] is None and cols["id"]["filtered"] and code(g.describe, "ref.main.other", USER) == "ACL_DENIED"
    e = g.explain_access("SELECT * FROM people", USER)
    assert e["outcome"] == "allow" and e["masks"] == ["lake.main.people.ssn=null"] and e["filters"] == ["lake.main.people"]
    tools = as_tools(g)
    assert tools["execute_sql"](USER, "SELECT count(*) AS n FROM people")["rows"] == [[2]] and tools["whoami"](USER)["subject"] == "alice" and len(tools) == 9


def test_sources(spark, tmp_path):
    db = tmp_path / "shop.db"
    with sqlite3.connect(db) as c:
        c.execute("CREATE TABLE orders (id INTEGER, who TEXT, total REAL, raw BLOB)")
        c.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", [(i, f"w{i % 3}", i / 2, b"x") for i in range(50)] + [(None, None, None, None)])
        c.execute("CREATE TABLE hidden (a INTEGER)")
    manifest = decode(f"apiVersion: example/v1alpha1\nkind: DataSource\nmetadata: {{name: shop}}\nspec: {{type: sqlite, path: {db}, readonly: true, tables: ['o*']}}")[0]
    duck = tmp_path / "d.duckdb"
    import duckdb

    with duckdb.connect(str(duck)) as d:
        d.execute("CREATE TABLE t AS SELECT range AS i, 'v' || range AS s FROM range(100)")
    c = Catalog()
    c.add(from_manifest(manifest))
    c.add(from_manifest(Policy("DataSource", "duck", spec={"type": "duckdb_file", "path": str(duck)})))
    c.add(ParquetSource("lake", {"allowedPaths": ["/root/testdata/sf0.001/nation.parquet"]}))
    assert [str(t) for t in c.tables(spark)] == ["duck.main.t", "lake.main.nation", "shop.main.orders"]
    g = Governed(spark, c, Snapshot.compile([policy("SqlAccessPolicy", "all", effect="allow", match={"any": [{"resources": {"catalogs": ["*"]}}]})]))
    assert g.execute("SELECT count(*), sum(id), max(who), count(raw) FROM shop.main.orders", USER).rows == [(51, 1225, "w2", 50)]
    assert g.execute("SELECT count(*), max(s) FROM duck.main.t JOIN lake.main.nation ON i = n_nationkey", USER).rows == [(25, "v9")]
    assert c.health(spark) == {"shop": "ok", "duck": "ok", "lake": "ok"}
    assert code(from_manifest, Policy("DataSource", "m", spec={"type": "motherduck"})) == "ERR_CONFIG_INVALID"
    c.add(ParquetSource("bad", {"allowedPaths": ["/nowhere/x.parquet"]}))
    assert code(g.sql, "SELECT * FROM bad.main.x", USER) == "ERR_DATASOURCE_UNAVAILABLE"
    assert [view_name(x) for x in ("a/b.parquet", "s3://x/My-Data/*.parquet", "2024.pq", "x/y/")] == ["b", "my_data", "t_2024", "y"]
    assert list(ParquetSource("z", {"bucket": "b", "prefix": "p", "allowedPaths": ["q.parquet", "r/q.parquet"]}).paths.items()) == [("q", "s3a://b/p/q.parquet"), ("q_2", "s3a://b/p/r/q.parquet")]


def test_policy_suites(spark):
    suite = Suite({"schema": {"pg.public.t": ["id int", "email"]}, "cases": [
        {"name": "ok", "identity": {"subject": "a", "groups": ["analysts"]}, "sql": "SELECT * FROM pg.public.t", "expect": {"outcome": "allow", "masks": ["pg.public.t.email=hash"], "applied": ["ColumnMaskPolicy/m", "SqlAccessPolicy/all"], "planContains": ["sha2"]}},
        {"name": "wrong", "identity": {"subject": "a"}, "sql": "SELECT id FROM pg.public.t", "expect": {"outcome": "deny"}},
        {"name": "gate", "identity": {"subject": "a"}, "sql": "DROP TABLE t", "expect": {"outcome": "deny", "errorCode": "ERR_UNSUPPORTED_SYNTAX"}},
    ]})
    snap = Snapshot.compile([policy("SqlAccessPolicy", "all", effect="allow", match={"any": [{"resources": {"catalogs": ["*"]}}]}), policy("ColumnMaskPolicy", "m", match={"any": [{"resources": {"tables": ["t"], "columns": ["email"]}}]}, mask={"type": "hash"})])
    assert [(r["name"], r["passed"]) for r in report(spark, snap, [suite]).collect()] == [("ok", True), ("wrong", False), ("gate", True)]
    with pytest.raises(GovernError):
        Suite({"cases": [{"name": "x", "expect": {"surprise": 1}}]})


def test_identities(monkeypatch):
    import base64
    import hashlib
    import hmac
    import json

    monkeypatch.setenv("SECRET_KEY", "topsecret")
    monkeypatch.setenv("KEY_HASH", identity.api_key_hash("pepper", "key.demo", "s3cret"))
    b = [Policy("SubjectBinding", "b", spec={"issuer": "iss", "audience": "me", "hmacSecretRef": "secret://env/SECRET_KEY", "claims": {"groups": "realm.roles"}, "apiKeys": [{"id": "key.demo", "hashRef": "secret://env/KEY_HASH", "groups": ["g"]}]})]
    u = identity.from_api_key("key.demo.s3cret", "pepper", b)
    assert (u.subject, u.groups, u.auth_method) == ("key.demo", ("g",), "api_key") and code(identity.from_api_key, "key.demo.nope", "pepper", b) == "ERR_UNAUTHORIZED"

    def token(claims, key=b"topsecret", alg="HS256"):
        p = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
        head = f"{p({'alg': alg})}.{p(claims)}"
        return head + "." + base64.urlsafe_b64encode(hmac.new(key, head.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()

    good = {"iss": "iss", "aud": ["me"], "sub": "ann", "exp": 1000, "realm": {"roles": ["a", 1]}}
    u = identity.from_jwt(token(good), b, clock=lambda: 900)
    assert (u.subject, u.groups) == ("ann", ("a",))
    for bad in (token(good, b"other"), token(good | {"aud": "you"}), token(good | {"exp": 1}), token(good, alg="none"), "x.y", token({k: v for k, v in good.items() if k != "sub"})):
        assert code(identity.from_jwt, bad, b, clock=lambda: 900) == "ERR_UNAUTHORIZED"


def test_public_key_tokens():
    """The ES256 example of RFC 7515, and an RSA key made of two Mersenne-like primes for the test."""
    import base64
    import hashlib
    import json

    p = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    head = "eyJhbGciOiJFUzI1NiJ9"
    body = "eyJpc3MiOiJqb2UiLA0KICJleHAiOjEzMDA4MTkzODAsDQogImh0dHA6Ly9leGFtcGxlLmNvbS9pc19yb290Ijp0cnVlfQ"
    sign = "DtEhU3ljbEg8L38VWAfUAqOyKAM6-Xx-F4GawxaepmXFCgfTjDxw5djxLa8ISlSApmWQxfKTUJqPP3-Kg6NU1Q"
    key = {"kty": "EC", "crv": "P-256", "x": "f83OJ3D2xF1Bg8vub9tLe1gHMzV76e8Tus9uPHvRVEU", "y": "x_FEzRu9m36HLN_tue659LNpXW6pCyStikYjKIWI5a0"}
    b = [Policy("SubjectBinding", "b", spec={"issuer": "joe", "jwksUrl": "https://keys", "claims": {"subjectId": "iss"}})]
    keys = {"keys": [key]}
    assert identity.from_jwt(f"{head}.{body}.{sign}", b, clock=lambda: 1300819000, fetch=lambda u: keys).subject == "joe"
    assert code(identity.from_jwt, f"{head}.{body}.{sign[:-2]}2Q", b, clock=lambda: 1300819000, fetch=lambda u: keys) == "ERR_UNAUTHORIZED"
    primes = 2**1279 - 1, 2**2203 - 1
    n, e = primes[0] * primes[1], 65537
    d = pow(e, -1, (primes[0] - 1) * (primes[1] - 1))
    size = (n.bit_length() + 7) // 8
    data = f"{p(json.dumps({'alg': 'RS256', 'kid': 'k'}).encode())}.{p(json.dumps({'iss': 'joe', 'exp': 10}).encode())}"
    digest = bytes.fromhex(identity.DIGESTS["256"][1]) + hashlib.sha256(data.encode()).digest()
    padded = b"\0\1" + b"\xff" * (size - len(digest) - 3) + b"\0" + digest
    good = pow(int.from_bytes(padded), d, n).to_bytes(size)
    rsa = {"keys": [{"kty": "RSA", "kid": "k", "n": p(n.to_bytes(size)), "e": p(e.to_bytes(3))}]}
    assert identity.from_jwt(f"{data}.{p(good)}", b, clock=lambda: 5, fetch=lambda u: rsa).subject == "joe"
    assert code(identity.from_jwt, f"{data}.{p(good[:-1] + b'x')}", b, clock=lambda: 5, fetch=lambda u: rsa) == "ERR_UNAUTHORIZED"


def test_filters_reach_the_scan(spark):
    from palisade.queries import governed

    policies = [rows("customer", column="c_mktsegment", op="Equals", value="BUILDING"), mask("customer", "c_name", "hash")]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        g = governed(spark, "/root/testdata/sf0.001", policies)
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = g.sql("SELECT c_custkey FROM customer WHERE c_nationkey < 5", ALICE)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in plan and "LessThan(c_nationkey,5)" in plan and "c_name" not in plan and "sha2" not in plan


def test_streams(spark):
    from palisade.operators.engine import Engine
    from palisade.streaming.governed import secured_stream

    schema = spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    key = TableKey("lake", "main", "events")
    masked = Engine(Snapshot.compile([ALLOW, mask("events", "user_id", "hash")]))
    q = secured_stream(stream, key, masked, ALICE).writeStream.format("memory").queryName("palisade_s").start()
    q.processAllAvailable()
    q.stop()
    assert len(spark.table("palisade_s").first()["user_id"]) == 64 and spark.table("palisade_s").count() == spark.read.schema(schema).parquet("/root/testdata/sf0.001/events.parquet").count()
    assert code(secured_stream, stream, key, masked, UserCtx("guest"), Facts()) == "ACL_DENIED"
    post = Engine(Snapshot.compile([ALLOW, mask("events", "user_id", "jitter", range=0.1, seed="s")]))
    assert code(secured_stream, stream, key, post, ALICE) == "ERR_MASK_UNSUPPORTED_CONTEXT"
