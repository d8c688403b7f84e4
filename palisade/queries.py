"""Governed queries over the test tables, each with the SQL that writes its effect by hand."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from palisade.model import UserCtx
from palisade.operators.dsl import Kinds, Policy
from palisade.operators.engine import Snapshot
from palisade.service.core import Governed, Settings
from palisade.sources.catalog import Catalog, ParquetSource

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
ALICE = UserCtx("alice", issuer="https://id.example", email="alice@example.com", groups=("analysts",), claims={"tenant_id": "BUILDING", "level": 3, "nations": [1, 2, 3]})
SEED = "palisade-test-seed"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def policy(kind: str, name: str, priority: int = 10, **spec: Any) -> Policy:
    spec.setdefault("enforcementMode", "Enforce")
    Kinds().checks[kind](spec)
    return Policy(kind, name, priority, spec=spec)


def on(*tables: str, columns: list[str] | None = None, groups: list[str] | None = None, **more: Any) -> dict[str, Any]:
    resources: dict[str, Any] = {"catalogs": ["lake"], "tables": list(tables) or ["*"]} | more
    if columns:
        resources["columns"] = columns
    return {"any": [{"resources": resources} | ({"subjects": {"groups": groups}} if groups else {})]}


ALLOW = policy("SqlAccessPolicy", "allow-analysts", effect="allow", match=on(groups=["analysts"]))


def rows(table: str, name: str = "rows", combine: str = "restrictive", priority: int = 10, expression: str = "", exclude: Any = None, **predicate: Any) -> Policy:
    f = {"expression": expression} if expression else {"predicate": predicate}
    return policy("RowFilterPolicy", name, priority, match=on(table), filter=f, combine=combine, **({"exclude": exclude} if exclude else {}))


def mask(table: str, column: str, kind: str, name: str = "", priority: int = 10, **args: Any) -> Policy:
    return policy("ColumnMaskPolicy", name or f"mask-{column}", priority, match=on(table, columns=[column]), mask={"type": kind, "args": args})


def rewrite(**r: Any) -> Policy:
    return policy("QueryRewritePolicy", "rewrite", match=on(), rewrite=r)


def governed(spark: SparkSession, sf_dir: str, policies: list[Policy], **settings: Any) -> Governed:
    catalog = Catalog()
    catalog.add(ParquetSource("lake", {"allowedPaths": [f"{sf_dir}/{t}.parquet" for t in TABLES]}))
    return Governed(spark, catalog, Snapshot.compile([ALLOW, *policies]), settings=Settings(default_namespace=("lake", "main"), **settings))


def query(key: str, policies: list[Policy], sql: str, oracle: str | None, user: UserCtx = ALICE) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return governed(spark, sf_dir, policies).sql(sql, user)

    QUERIES[key] = run
    if oracle:
        ORACLES[key] = oracle


# Predicates.

CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer"


def _predicate(key: str, where: str, table: str = "customer", sql: str = CUSTOMER, **p: Any) -> None:
    query(key, [rows(table, **p)], sql, f"{sql} WHERE {where}")


_predicate("rf_equals", "c_mktsegment = 'BUILDING'", column="c_mktsegment", op="Equals", value="BUILDING")
_predicate("rf_not_equals", "c_mktsegment <> 'BUILDING'", column="c_mktsegment", op="NotEquals", value="BUILDING")
_predicate("rf_gt", "c_nationkey > 10", column="c_nationkey", op="GreaterThan", value=10)
_predicate("rf_gte", "c_nationkey >= 10", column="c_nationkey", op="GreaterThanOrEqual", value=10)
_predicate("rf_lt", "c_nationkey < 10", column="c_nationkey", op="LessThan", value=10)
_predicate("rf_lte", "c_nationkey <= 10", column="c_nationkey", op="LessThanOrEqual", value=10)
_predicate("rf_between", "c_nationkey BETWEEN 5 AND 9", column="c_nationkey", op="Between", values=[5, 9])
_predicate("rf_in", "c_nationkey IN (1, 2, 3)", column="c_nationkey", op="In", values=[1, 2, 3])
_predicate("rf_not_in", "c_nationkey NOT IN (1, 2, 3)", column="c_nationkey", op="NotIn", values=[1, 2, 3])
_predicate("rf_like", "c_name LIKE 'Customer#_______1%'", column="c_name", op="Like", value="Customer#_______1%")
_predicate("rf_not_like", "c_name NOT LIKE '%7'", column="c_name", op="NotLike", value="%7")
_predicate("rf_is_null", "c_name IS NULL OR c_nationkey < 7", any=[{"column": "c_name", "op": "IsNull"}, {"column": "c_nationkey", "op": "LessThan", "value": 7}])
_predicate("rf_is_not_null", "c_name IS NOT NULL AND c_nationkey < 7", all=[{"column": "c_name", "op": "IsNotNull"}, {"column": "c_nationkey", "op": "LessThan", "value": 7}])
_predicate("rf_starts_with", "starts_with(c_mktsegment, 'BU')", column="c_mktsegment", op="StartsWith", value="BU")
_predicate("rf_ends_with", "ends_with(c_name, '9')", column="c_name", op="EndsWith", value="9")
_predicate("rf_contains", "contains(c_name, '13')", column="c_name", op="Contains", value="13")
_predicate("rf_matches", "regexp_matches(c_name, '[13579]$')", column="c_name", op="Matches", value="[13579]$")
_predicate(
    "rf_all_any_not", "c_nationkey > 3 AND (c_mktsegment = 'BUILDING' OR c_nationkey IN (7, 8)) AND NOT c_name LIKE '%5'",
    all=[{"column": "c_nationkey", "op": "GreaterThan", "value": 3}, {"any": [{"column": "c_mktsegment", "op": "Equals", "value": "BUILDING"}, {"column": "c_nationkey", "op": "In", "values": [7, 8]}]}, {"not": {"column": "c_name", "op": "Like", "value": "%5"}}],
)
_predicate("rf_template_claim", "c_mktsegment = 'BUILDING'", column="c_mktsegment", op="Equals", value="{{ subject.claims.tenant_id }}")
_predicate("rf_template_list", "c_nationkey IN (1, 2, 3)", column="c_nationkey", op="In", values=["{{ subject.claims.nations }}"])
query("rf_cel_expression", [rows("customer", expression="row.c_mktsegment == subject.claims.tenant_id && row.c_nationkey in [1, 2, 3, 4, 5] || row.c_name.endsWith(\"42\")")], CUSTOMER,
      f"{CUSTOMER} WHERE (c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3, 4, 5)) OR c_name LIKE '%42'")

# Combining.

TENANT = {"column": "c_mktsegment", "op": "Equals", "value": "{{ subject.claims.tenant_id }}"}
LOW = {"column": "c_nationkey", "op": "LessThan", "value": 10}
query("rf_restrictive_and", [rows("customer", "a", **TENANT), rows("customer", "b", **LOW)], CUSTOMER, f"{CUSTOMER} WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")
query("rf_permissive_or", [rows("customer", "a", priority=20, **TENANT), rows("customer", "b", "permissive", **LOW)], CUSTOMER, f"{CUSTOMER} WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 10")
query("rf_two_tables_join", [rows("customer", "c", **TENANT), rows("orders", "o", column="o_orderstatus", op="Equals", value="F")],
      "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_nationkey",
      "SELECT c_nationkey, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' GROUP BY c_nationkey")
query("rf_exclude_per_table", [policy("RowFilterPolicy", "all", match=on("nation", "region"), exclude=on("region"), filter={"predicate": {"any": [{"column": "n_nationkey", "op": "LessThan", "value": 5}]}})],
      "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 5")
query("rf_breakglass_subject", [policy("RowFilterPolicy", "tenant", match=on("customer"), exclude=on("customer", groups=["oncall"]), filter={"predicate": TENANT})], CUSTOMER, CUSTOMER,
      UserCtx("oscar", groups=("analysts", "oncall")))
query("rf_audit_mode_only_recorded", [Policy("RowFilterPolicy", "shadow", spec={"enforcementMode": "Audit", "match": on("customer"), "filter": {"predicate": LOW}, "combine": "restrictive"})], CUSTOMER, CUSTOMER)

# Masks.

NAMES = "SELECT c_custkey, c_name FROM customer"


def _mask(key: str, expression: str, kind: str, **args: Any) -> None:
    query(key, [mask("customer", "c_name", kind, **args)], NAMES, f"SELECT c_custkey, {expression} AS c_name FROM customer")


def _hmac(message: str, key: bytes = SEED.encode()) -> str:
    """DuckDB's HMAC-SHA256 of a blob expression."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in k).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || {message})))"


def _u64(hexa: str) -> str:
    return f"(('0x' || substr({hexa}, 1, 16))::UBIGINT)"


_mask("mask_null_typed", "NULL::VARCHAR", "null")
_mask("mask_constant", "'hidden'", "constant", value="hidden")
_mask("mask_partial", "substr(c_name, 1, 2) || repeat('*', greatest(length(c_name) - 3, 0)) || substr(c_name, greatest(length(c_name), 3))", "partial", showFirst=2, showLast=1)
_mask("mask_hash", "sha256(c_name)", "hash")
_mask("mask_hash_salted", "sha256('salt' || c_name)", "hash", saltRef="salt")
_mask("mask_hmac", _hmac("encode(c_name)"), "hash", algorithm="hmac_sha256", saltRef=SEED)
_mask("mask_regex", "regexp_replace(c_name, '[0-9]+', '<\\0>', 'g')", "regex", pattern="[0-9]+", replacement="<\\0>")
_mask("mask_truncate", "CASE WHEN length(c_name) > 4 THEN substr(c_name, 1, 4) || '...' ELSE c_name END", "truncate", length=4, suffix="...")
query("mask_jitter", [mask("customer", "c_custkey", "jitter", range=0.1, seed=SEED)], NAMES,
      f"SELECT round(c_custkey * (1 + (2 * ({_u64(_hmac('encode(c_custkey::VARCHAR)'))}::DOUBLE / 18446744073709551615.0::DOUBLE) - 1) * 0.1::DOUBLE))::BIGINT AS c_custkey, c_name FROM customer")


def _fakes() -> None:
    from palisade.functions.masks import WORDS

    quoted = {k: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for k, ws in WORDS.items()}
    n = _u64(_hmac("encode('first_name') || unhex('00') || encode(c_name)"))
    _mask("mask_fake_first_name", f"{quoted['first_name']}[({n} % {len(WORDS['first_name'])})::INT + 1]", "fake", fakeType="first_name", seed=SEED)
    n = _u64(_hmac("encode('email') || unhex('00') || encode(c_name)"))
    first = f"lower({quoted['first_name']}[({n} % {len(WORDS['first_name'])})::INT + 1])"
    last = f"lower({quoted['last_name']}[(({n} // 65536) % {len(WORDS['last_name'])})::INT + 1])"
    pick = lambda w, x: f"{quoted[w]}[(({x}) % {len(WORDS[w])})::INT + 1]"
    of = lambda kind: _u64(_hmac(f"encode('{kind}') || unhex('00') || encode(c_name)"))
    for kind in ("last_name", "company", "city", "country"):
        _mask(f"mask_fake_{kind}", pick(kind, of(kind)), "fake", fakeType=kind, seed=SEED)
    _mask("mask_fake_name", f"{pick('first_name', of('name'))} || ' ' || {pick('last_name', of('name') + ' // 65536')}", "fake", fakeType="name", seed=SEED)
    _mask("mask_fake_phone", f"'+1-555-' || lpad(({of('phone')} % 1000)::VARCHAR, 3, '0') || '-' || lpad((({of('phone')} // 1024) % 10000)::VARCHAR, 4, '0')", "fake", fakeType="phone", seed=SEED)
    h = _hmac("encode('uuid') || unhex('00') || encode(c_name)")
    variant = f"['8', '9', 'a', 'b'][('0x' || substr({h}, 17, 1))::INT % 4 + 1]"
    _mask("mask_fake_uuid", f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)", "fake", fakeType="uuid", seed=SEED)
    _mask("mask_fake_email", f"{first} || '.' || {last} || (({n} // 4294967296) % 1000)::INT::VARCHAR || '@example.com'", "fake", fakeType="email", seed=SEED)


_fakes()
query("mask_wildcard_columns", [policy("ColumnMaskPolicy", "names", match=on("nation", "region", columns=["*_name"]), mask={"type": "constant", "args": {"value": "x"}})],
      "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey", "SELECT n_nationkey, 'x' AS n_name, 'x' AS r_name FROM nation")
query("mask_priority", [mask("customer", "c_name", "constant", "low", 5, value="low"), mask("customer", "c_*", "hash", "high", 50)], "SELECT c_name FROM customer", "SELECT sha256(c_name) AS c_name FROM customer")
query("mask_tag_classified",
      [policy("DataClassification", "pii", rules=[{"resources": {"tables": ["customer"], "columns": ["c_name"]}, "tags": ["pii"]}, {"resources": {"tables": ["supplier"], "columns": ["s_name"]}, "tags": ["pii"]}]),
       policy("ColumnMaskPolicy", "pii", match={"any": [{"resources": {"tags": ["pii"]}}]}, mask={"type": "truncate", "args": {"length": 3}})],
      "SELECT c_custkey, c_name, s_name FROM customer JOIN supplier ON c_custkey = s_suppkey", "SELECT c_custkey, left(c_name, 3) AS c_name, left(s_name, 3) AS s_name FROM customer JOIN supplier ON c_custkey = s_suppkey")

# Where masked columns stand.

HASHED = [mask("customer", "c_name", "hash")]
MASKED = "(SELECT * REPLACE (sha256(c_name) AS c_name) FROM customer)"
SHORT = [mask("customer", "c_mktsegment", "truncate", length=1)]
CUT = "(SELECT * REPLACE (left(c_mktsegment, 1) AS c_mktsegment) FROM customer)"


def _placed(key: str, policies: list[Policy], sql: str, masked: str) -> None:
    query(key, policies, sql, sql.replace("FROM customer", f"FROM {masked} customer").replace("JOIN customer", f"JOIN {masked} customer"))


_placed("mask_in_where", HASHED, "SELECT c_custkey FROM customer WHERE c_name < '8'", MASKED)
_placed("mask_in_group_by", SHORT, "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment", CUT)
_placed("mask_in_order_by", HASHED, "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey", MASKED)
_placed("mask_in_join_on", SHORT, "SELECT a.n_name, count(*) AS n FROM nation a JOIN customer ON left(a.n_name, 1) <> c_mktsegment AND n_nationkey = c_nationkey GROUP BY a.n_name", CUT)
_placed("mask_in_case", SHORT, "SELECT c_custkey, CASE WHEN c_mktsegment = 'B' THEN 'yes' ELSE 'no' END AS b FROM customer", CUT)
_placed("mask_count_distinct", SHORT, "SELECT count(DISTINCT c_mktsegment) AS n FROM customer", CUT)
query("mask_star", HASHED, "SELECT * FROM customer", f"SELECT * FROM {MASKED}")
query("mask_cte", HASHED, "WITH x AS (SELECT c_custkey, c_name FROM customer) SELECT max(c_name) AS top FROM x", f"SELECT max(c_name) AS top FROM {MASKED}")
query("mask_scalar_subquery", HASHED, "SELECT n_name, (SELECT max(c_name) FROM customer WHERE c_nationkey = n_nationkey) AS top FROM nation", f"SELECT n_name, (SELECT max(c_name) FROM {MASKED} WHERE c_nationkey = n_nationkey) AS top FROM nation")
query("mask_derived_table", HASHED, "SELECT c_name FROM (SELECT * FROM (SELECT * FROM customer) a) b", f"SELECT c_name FROM {MASKED}")
query("mask_window", SHORT, "SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer", f"SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM {CUT}")
query("mask_filter_sees_raw", [*SHORT, rows("customer", **TENANT)], "SELECT c_custkey, c_mktsegment FROM customer", "SELECT c_custkey, left(c_mktsegment, 1) AS c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")

# Structure.

FILTER = [rows("customer", **TENANT)]
SEEN = "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')"


def _gov(key: str, sql: str, policies: list[Policy] | None = None) -> None:
    seen = sql
    for word in ("FROM", "JOIN"):
        seen = seen.replace(f"{word} customer a", f"{word} {SEEN} a").replace(f"{word} customer b", f"{word} {SEEN} b")
        seen = seen.replace(f"{word} customer ", f"{word} {SEEN} customer ").replace(f"{word} customer)", f"{word} {SEEN} customer)")
    query(key, FILTER if policies is None else policies, sql, seen)


_gov("gov_union", "SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation ")
_gov("gov_union_one_branch", "SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier ")
_gov("gov_intersect", "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier ")
_gov("gov_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier ")
_gov("gov_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier ")
_gov("gov_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier ")
_gov("gov_cte", "WITH x AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) SELECT n_name, n FROM nation JOIN x ON n_nationkey = c_nationkey ")
_gov("gov_recursive_cte", "WITH RECURSIVE r(k, n) AS (SELECT n_nationkey, 0 FROM nation WHERE n_nationkey = 0 UNION ALL SELECT c_nationkey, n + 1 FROM r JOIN (SELECT DISTINCT c_nationkey FROM customer) t ON c_nationkey = k + 1) SELECT k, n, count(c_custkey) AS c FROM r LEFT JOIN customer a ON a.c_nationkey = k GROUP BY k, n ")
_gov("gov_in_subquery", "SELECT n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer) ")
_gov("gov_not_in_subquery", "SELECT s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer) ")
_gov("gov_exists", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM customer a WHERE c_nationkey = n_nationkey AND c_acctbal > 9500) ")
_gov("gov_not_exists", "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer a WHERE c_nationkey = n_nationkey AND c_acctbal > 9500) ")
_gov("gov_self_join", "SELECT a.c_nationkey, count(*) AS n FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey GROUP BY a.c_nationkey ")
_gov("gov_left_join", "SELECT n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer a ON c_nationkey = n_nationkey GROUP BY n_name ")
_gov("gov_right_join", "SELECT s_suppkey, c_custkey FROM supplier RIGHT JOIN customer a ON s_suppkey = c_custkey ")
_gov("gov_cross_join", "SELECT r_name, count(*) AS n FROM region CROSS JOIN customer a GROUP BY r_name ")
_gov("gov_lateral", "SELECT n_name, top FROM nation, LATERAL (SELECT max(c_acctbal) AS top FROM customer a WHERE c_nationkey = n_nationkey) t ")
_gov("gov_distinct_aggregate", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS rich FROM customer GROUP BY c_mktsegment ")
_gov("gov_full_join", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer a ON s_suppkey = c_custkey ")
_gov("gov_join_using", "SELECT c_custkey, a.c_nationkey AS x, b.c_mktsegment AS y FROM customer a JOIN customer b USING (c_custkey) ")
_gov("gov_cube", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey) ")
_gov("gov_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey) ")
_gov("gov_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ()) ")
_gov("gov_having", "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 5 ")
_gov("gov_window_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_custkey DESC) AS r FROM customer ")
_gov("gov_window_frame", "SELECT c_custkey, sum(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM customer ")
_gov("gov_topk", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey DESC LIMIT 10 ")
_gov("gov_limit_offset", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 5 ")
_gov("gov_distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer ")
_gov("gov_scalar_functions", "SELECT c_custkey, upper(c_name) AS u, length(c_name) AS n, coalesce(nullif(c_nationkey, 3), -1) AS k FROM customer ")
_gov("gov_derived_table", "SELECT k, max(n) AS m FROM (SELECT c_nationkey AS k, c_custkey AS n FROM customer) t GROUP BY k ")
_gov("gov_tpch_q3", "SELECT o_orderkey, o_orderpriority, count(*) AS n, sum(l_quantity)::BIGINT AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority ".replace("FROM customer JOIN", "FROM customer a JOIN"))

# Rewrites and access.

query("limit_inject_ordered", [rewrite(limit={"max": 25})], "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25")
query("limit_clamp", [rewrite(limit={"max": 25})], "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 500", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25")
query("limit_keep", [rewrite(limit={"max": 25})], "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7")
query("sample_full_rate", [rewrite(sample={"rate": 1.0, "method": "reservoir"})], CUSTOMER, CUSTOMER)


def _sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample itself is random; its size and that it is drawn without repeats are not."""
    from pyspark.sql import functions as F

    got = governed(spark, sf_dir, [rewrite(sample={"rate": 0.1})]).sql(CUSTOMER, ALICE)
    return got.agg(F.count("*").alias("n"), F.count_distinct("c_custkey").alias("kinds"))


QUERIES["sample_reservoir_size"] = _sample_size
ORACLES["sample_reservoir_size"] = "SELECT round_even(0.1 * count(*), 0)::BIGINT AS n, round_even(0.1 * count(*), 0)::BIGINT AS kinds FROM customer"
query("mask_fpe", [mask("customer", "c_name", "fpe", keyRef="0123456789abcdef")], NAMES, None)


# Decisions: what subjects see, and why not.

GUARD = policy("QueryRejectPolicy", "guard", match=on(), reject={"rules": [{"name": "star", "expression": "query.has_select_star && query.joins > 0", "message": "no star over joins"}, {"name": "all", "expression": "!query.has_where && query.tables.exists(t, t.endsWith('.orders'))", "code": "NO_SCAN", "message": "filter orders"}]})
ASK = policy("ApprovalPolicy", "ask", match=on("supplier"), when={"columnsAccessed": ["s_acctbal"]}, reason="balances")
BOSS = policy("SqlAccessPolicy", "no-parts", effect="deny", match=on("part"), conditions=[{"name": "juniors", "expression": "subject.claims.level < 5"}])
CHIEF = UserCtx("carol", groups=("analysts",), claims={"tenant_id": "BUILDING", "level": 9})
STATEMENTS = [
    ("plain", ALICE, "SELECT c_name FROM customer"), ("star join", ALICE, "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey"), ("scan", ALICE, "SELECT o_orderkey FROM orders"),
    ("filtered scan", ALICE, "SELECT o_orderkey FROM orders WHERE o_custkey = 1"), ("balance", ALICE, "SELECT s_acctbal FROM supplier"), ("no balance", ALICE, "SELECT s_name FROM supplier"),
    ("part", ALICE, "SELECT p_partkey FROM part"), ("part of a chief", CHIEF, "SELECT p_partkey FROM part"), ("guest", UserCtx("bob", groups=("guests",)), "SELECT c_name FROM customer"),
]


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = governed(spark, sf_dir, [GUARD, ASK, BOSS])
    found = [(name, d["outcome"], d["code"] or "", ",".join(d["rejections"])) for name, user, sql in STATEMENTS for d in [g.explain_access(sql, user)]]
    return spark.createDataFrame(found, "name string, outcome string, code string, rejections string")


QUERIES["decisions"] = _decided
ORACLES["decisions"] = """SELECT * FROM (VALUES ('plain', 'allow', '', ''), ('star join', 'reject', 'ACL_REJECTED', 'guard/star'), ('scan', 'reject', 'NO_SCAN', 'guard/all'), ('filtered scan', 'allow', '', ''),
('balance', 'approval', 'ERR_APPROVAL_PENDING', ''), ('no balance', 'allow', '', ''), ('part', 'deny', 'ACL_DENIED', ''), ('part of a chief', 'allow', '', ''), ('guest', 'deny', 'ACL_DENIED', '')) t(name, outcome, code, rejections)"""

SHAPES = {
    "star": "SELECT * FROM customer", "plain": "SELECT c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_name LIMIT 4", "groups": "SELECT c_nationkey, count(*) FROM customer GROUP BY c_nationkey",
    "cte": "WITH x AS (SELECT c_custkey FROM customer) SELECT c_custkey FROM x", "union": "SELECT c_nationkey FROM customer UNION SELECT n_nationkey FROM nation",
    "joins": "SELECT count(*) FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey",
}


def _shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shape of a statement tells the policies."""
    from palisade.plans.parse import parse

    found = []
    for name, sql in SHAPES.items():
        x = parse(spark, sql).shape
        found.append((name, x.has_select_star, x.is_aggregate, x.has_cte, x.has_union, x.has_limit, x.limit, x.has_order_by, x.has_where, ",".join(x.where_columns), ",".join(x.group_by_columns), x.joins))
    return spark.createDataFrame(found, "name string, star boolean, agg boolean, cte boolean, unions boolean, limited boolean, n int, ordered boolean, filtered boolean, wheres string, groups string, joins int")


QUERIES["query_shapes"] = _shaped
ORACLES["query_shapes"] = """SELECT * FROM (VALUES ('star', true, false, false, false, false, 0, false, false, '', '', 0), ('plain', false, false, false, false, true, 4, true, true, 'c_nationkey', '', 0),
('groups', false, true, false, false, false, 0, false, false, '', 'c_nationkey', 0), ('cte', false, false, true, false, false, 0, false, false, '', '', 0), ('union', false, false, false, true, false, 0, false, false, '', '', 0),
('joins', false, true, false, false, false, 0, false, false, '', '', 2)) t(name, star, agg, cte, unions, limited, n, ordered, filtered, wheres, groups, joins)"""


def _composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines and a decision function: filters of all members hold together."""
    from palisade.operators.engine import CallableEngine, Composite, Engine

    g = governed(spark, sf_dir, [])
    more = CallableEngine(lambda doc: {"allow": True, "filters": [{"table": "lake.main.customer", "predicate": {"column": "c_nationkey", "op": "GreaterThan", "value": 4}}], "masks": [{"table": "lake.main.customer", "column": "c_name", "type": "hash"}]})
    g.engine = Composite(Engine(Snapshot.compile([ALLOW, *FILTER])), Engine(Snapshot.compile([ALLOW, rows("customer", "low", **LOW)])), more)
    return g.sql(CUSTOMER, ALICE)


QUERIES["composite_engines"] = _composite
ORACLES["composite_engines"] = "SELECT c_custkey, sha256(c_name) AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10 AND c_nationkey > 4"


def _flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = [rows("customer", **TENANT), mask("customer", "c_name", "partial", showFirst=2, showLast=1)]
    return governed(spark, sf_dir, policies).sql(FLAGSHIP, ALICE)


FLAGSHIP = "SELECT c_name, c_nationkey, count(*) AS n_orders, count(DISTINCT o_orderstatus) AS n_status FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name, c_nationkey"
QUERIES["flagship"] = _flagship
ORACLES["flagship"] = FLAGSHIP.replace(
    "FROM customer", "FROM (SELECT * REPLACE (substr(c_name, 1, 2) || repeat('*', greatest(length(c_name) - 3, 0)) || substr(c_name, greatest(length(c_name), 3)) AS c_name) FROM customer WHERE c_mktsegment = 'BUILDING') customer"
)


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    deny = policy("SqlAccessPolicy", "no-suppliers", effect="deny", match=on("supplier"))
    g = governed(spark, sf_dir, [deny])
    return spark.createDataFrame([(str(t),) for t in g.tables(ALICE)], "table_name string")


QUERIES["list_tables_visible"] = _listed
ORACLES["list_tables_visible"] = " UNION ALL ".join(f"SELECT 'lake.main.{t}' AS table_name" for t in TABLES if t != "supplier")
ORACLES["describe_masked"] = " UNION ALL ".join(
    f"SELECT 'lake.main.{t}' AS table_name, c.ordinal_position::INT AS position, c.column_name, CASE c.data_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'TIMESTAMP WITH TIME ZONE' THEN 'timestamp' "
    f"ELSE lower(c.data_type) END AS sql_type, {'CASE WHEN c.column_name = ' + repr('c_name') + ' THEN ' + repr('hash') + ' END' if t == 'customer' else 'NULL::VARCHAR'} AS mask, false AS filtered "
    f"FROM information_schema.columns c WHERE c.table_name = '{t}'" for t in TABLES
)
QUERIES["describe_masked"] = lambda spark, sf_dir: governed(spark, sf_dir, HASHED).describe_frame(ALICE)


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = governed(spark, sf_dir, [*HASHED, *FILTER]).explain_access("SELECT c_name FROM customer", ALICE)
    return spark.createDataFrame([(k, str(v)) for k, v in got.items()], "field string, value string")


QUERIES["explain_access"] = _explained


def _audited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of three statements, written and verified."""
    import tempfile

    from palisade.service.audit import AuditLog, verify

    folder = tempfile.mkdtemp(prefix="palisade-audit-")
    g = governed(spark, sf_dir, FILTER)
    g.audit = AuditLog(folder, seed="test")
    g.execute("SELECT count(*) AS n FROM customer", ALICE)
    g.sql("SELECT c_custkey FROM customer", ALICE)
    got = verify(folder, "test")
    return spark.createDataFrame([(r["event_type"], r["decision"], bool(got["ok"])) for r in g.audit.tail()], "event string, decision string, chain_ok boolean")


QUERIES["audit_verify"] = _audited
ORACLES["audit_verify"] = "SELECT * FROM (VALUES ('access', 'allow', true), ('completion', 'allow', true), ('access', 'allow', true)) t(event, decision, chain_ok)"


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.service.policytest import Suite, report

    suite = Suite({
        "schema": {"lake.main.customer": ["c_custkey bigint", "c_name", "c_mktsegment"]},
        "cases": [
            {"name": "filtered", "identity": {"subject": "alice", "groups": ["analysts"], "claims": {"tenant_id": "x"}}, "sql": "SELECT c_name FROM lake.main.customer", "expect": {"outcome": "allow", "filters": ["lake.main.customer"]}},
            {"name": "guest", "identity": {"subject": "bob", "groups": ["guests"]}, "sql": "SELECT c_name FROM lake.main.customer", "expect": {"outcome": "deny", "errorCode": "ACL_DENIED"}},
        ],
    })
    return report(spark, Snapshot.compile([ALLOW, *FILTER]), [suite])


QUERIES["policytest_report"] = _tested
ORACLES["policytest_report"] = "SELECT * FROM (VALUES ('filtered', true, ''), ('guest', true, '')) t(name, passed, problems)"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed hourly counts of a stream of events, drained into a table in memory."""
    import uuid

    from palisade.model import TableKey
    from palisade.operators.engine import Engine
    from palisade.streaming.governed import secured_stream, windowed_counts

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # The stream's folder holds one table's file; other tables' files are left out by name.
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    engine = Engine(Snapshot.compile([ALLOW, rows("events", column="event_type", op="NotEquals", value="purchase")]))
    seen = secured_stream(stream, TableKey("lake", "main", "events"), engine, ALICE)
    name = f"palisade_{uuid.uuid4().hex}"
    q = windowed_counts(seen, "ts", ["event_type"]).writeStream.outputMode("complete").format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name)


QUERIES["stream_governed_counts"] = _stream
ORACLES["stream_governed_counts"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY ALL"
