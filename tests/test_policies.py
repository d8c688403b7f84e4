"""Manifests, selectors, decisions, expressions: no Spark."""

import pytest

from palisade.functions import cel, fpe, predicates, template, wildcard
from palisade.functions.masks import WORDS, default_registry, java_replacement
from palisade.model import Decision, Facts, GovernError, MaskRule, Shape, TableKey, UserCtx
from palisade.operators.dsl import Kinds, decode, load_directory, seconds
from palisade.operators.engine import CallableEngine, Composite, Engine, Snapshot, resolve_masks, triggered
from palisade.operators.rebac import RebacEngine

ORDERS, PII = TableKey("pg", "public", "orders"), TableKey("pg", "public", "customer_pii")
USER = UserCtx("alice", issuer="iss", groups=("analysts",), claims={"tenant_id": "t-42", "n": 1, "deep": {"x": ["a"]}, "roles": ["reader"]})


def manifest(kind: str, name: str, spec: str, priority: int = 0) -> str:
    body = "\n".join("  " + line for line in spec.strip("\n").split("\n"))
    return f"---\napiVersion: example/v1alpha1\nkind: {kind}\nmetadata: {{name: {name}, priority: {priority}}}\nspec:\n{body}\n"


ALLOW = manifest("SqlAccessPolicy", "allow-all", 'effect: allow\nmatch: {any: [{resources: {catalogs: ["**"]}}]}')


def decide(text: str, *tables: TableKey, user: UserCtx = USER, facts: Facts | None = None, **shape) -> Decision:
    return Engine(Snapshot.from_yaml(text)).evaluate(user, facts, Shape(tables=list(tables or [ORDERS]), **shape))


@pytest.mark.parametrize(("pattern", "name", "hit"), [("a*", "abc", True), ("a*", "a.b", False), ("a**", "a.b", True), ("A", "a", False), (r"a\*", "a*", True), (r"a\*", "ab", False), ("a.c", "abc", False), ("*", "", True)])
def test_wildcards(pattern, name, hit):
    assert wildcard.matches(pattern, name) is hit


def test_wildcard_errors_and_order():
    for bad in ("", "a\\"):
        with pytest.raises(GovernError):
            wildcard.compiled(bad)
    assert wildcard.specificity("email") > wildcard.specificity("emai*") > wildcard.specificity("e*") > wildcard.specificity("*")


def test_default_is_deny():
    d = decide(manifest("SqlAccessPolicy", "x", 'effect: allow\nmatch: {any: [{resources: {tables: ["other"]}}]}'))
    assert (d.outcome, d.abstained, d.code) == ("deny", True, "ACL_DENIED")
    assert decide(manifest("SqlAccessPolicy", "x", "effect: allow\nmatch: {}")).outcome == "deny"  # an empty selector matches nothing


def test_deny_beats_allow_and_names_the_policy():
    text = ALLOW + manifest("SqlAccessPolicy", "low", 'effect: deny\nmatch: {any: [{resources: {tables: ["*_pii"]}}]}', 1) + manifest("SqlAccessPolicy", "top", 'effect: deny\nmessage: nope\nerrorCode: X\nmatch: {any: [{resources: {tables: ["*_pii"]}}]}', 9)
    d = decide(text, PII)
    assert (d.outcome, d.deny_policy, d.code, d.message) == ("deny", "top", "X", "nope")
    assert set(d.applied) == {"SqlAccessPolicy/allow-all", "SqlAccessPolicy/top", "SqlAccessPolicy/low"}
    assert decide(text, ORDERS).outcome == "allow"


def test_any_table_and_strict_access():
    text = manifest("SqlAccessPolicy", "orders", 'effect: allow\nmatch: {any: [{resources: {tables: ["orders"]}}]}')
    snap, shape = Snapshot.from_yaml(text), Shape(tables=[ORDERS, PII])
    assert Engine(snap).evaluate(USER, None, shape).outcome == "allow"
    assert Engine(snap, strict_access=True).evaluate(USER, None, shape).outcome == "deny"


@pytest.mark.parametrize(
    ("subjects", "hit"),
    [
        ("groups: [analysts, x]", True), ("groups: [x]", False), ("roles: [reader]", True), ("roles: [analysts]", False), ("apiKeys: [k]", False), ("ipRanges: [10.0.0.0/8]", True), ("ipRanges: [192.168.0.0/16]", False),
        ("jwtClaims: [{claim: tenant_id, op: Equals, value: t-42}]", True), ("jwtClaims: [{claim: n, op: Equals, value: '1'}]", False), ("jwtClaims: [{claim: n, op: Equals, value: 1.0}]", True),
        ("jwtClaims: [{claim: nope, op: NotEquals, value: 1}]", True), ("jwtClaims: [{claim: n, op: In, values: [2, 1]}]", True), ("jwtClaims: [{claim: nope, op: NotIn, values: [1]}]", True),
        ("jwtClaims: [{claim: deep.x, op: Exists}]", True), ("jwtClaims: [{claim: tenant_id, op: Matches, pattern: '-4'}]", True), ("jwtClaims: [{claim: n, op: Matches, pattern: '1'}]", False),
        ("groups: [analysts]\njwtClaims: [{claim: n, op: Equals, value: 2}]", False),
    ],
)
def test_subjects(subjects, hit):
    inner = "\n".join("      " + x for x in subjects.split("\n"))
    d = decide(manifest("SqlAccessPolicy", "x", f"effect: allow\nmatch:\n  any:\n  - subjects:\n{inner}"), facts=Facts(remote_ip="10.1.2.3"))
    assert (d.outcome == "allow") is hit


def test_all_any_exclude_actions():
    both = manifest("SqlAccessPolicy", "x", 'effect: allow\nmatch: {all: [{resources: {tables: ["orders"]}}, {subjects: {groups: ["analysts"]}}]}')
    assert decide(both).outcome == "allow" and decide(both, PII).outcome == "deny"
    out = manifest("SqlAccessPolicy", "x", 'effect: allow\nmatch: {any: [{resources: {catalogs: ["*"]}}]}\nexclude: {any: [{subjects: {groups: ["analysts"]}}]}')
    assert decide(out).outcome == "deny"
    act = manifest("SqlAccessPolicy", "x", 'effect: allow\nmatch: {any: [{resources: {actions: ["INSERT"]}}]}')
    assert decide(act).outcome == "deny" and decide(act, kind="INSERT").outcome == "allow"


def test_full_name_in_tables_never_matches():
    assert decide(manifest("SqlAccessPolicy", "x", 'effect: allow\nmatch: {any: [{resources: {tables: ["pg.public.orders"]}}]}')).outcome == "deny"


def test_conditions():
    gate = lambda e: manifest("SqlAccessPolicy", "x", f'effect: allow\nconditions: [{{name: c, expression: "{e}"}}]\nmatch: {{any: [{{resources: {{catalogs: ["*"]}}}}]}}')
    assert decide(gate("query.joins == 0 && 'analysts' in subject.groups")).outcome == "allow"
    assert decide(gate("query.has_limit")).outcome == "deny"
    broken = decide(gate("subject.claims.nothing == 1"))
    assert broken.outcome == "deny" and "condition" in broken.message


def test_filters_fold_and_shadow():
    f = lambda n, p, c="restrictive", m="Enforce": manifest("RowFilterPolicy", n, f'enforcementMode: {m}\nmatch: {{any: [{{resources: {{tables: ["orders"]}}}}]}}\nfilter: {{predicate: {{column: {n}, op: IsNull}}}}\ncombine: {c}', p)
    d = decide(ALLOW + f("a", 1, "permissive") + f("b", 5) + f("c", 9, m="Audit"))
    assert [(p["column"], c) for p, c in d.filters[ORDERS]] == [("b", "restrictive"), ("a", "permissive")]
    assert d.shadow == ["RowFilterPolicy/c"]


def test_masks_by_priority_and_tags():
    m = lambda n, p, res, t="null": manifest("ColumnMaskPolicy", n, f'match: {{any: [{{resources: {res}}}]}}\nmask: {{type: "{t}"}}', p)
    d = decide(ALLOW + m("wide", 5, '{tables: ["orders"], columns: ["*"]}') + m("one", 1, '{tables: ["orders"], columns: ["email"]}', "hash") + m("no-columns", 9, '{tables: ["orders"]}'))
    got = resolve_masks(d.masks[ORDERS], ["id", "email"])
    assert {c: r.policy for c, r in got.items()} == {"id": "wide", "email": "wide"}
    tie = [MaskRule("b", 1, "e*", "null", {}), MaskRule("a", 1, "email", "hash", {}), MaskRule("c", 1, "*", "null", {})]
    assert resolve_masks(tie, ["email", "else", "x"]) == {"email": tie[1], "else": tie[0], "x": tie[2]}
    tagged = manifest("DataClassification", "d", 'rules: [{resources: {tables: ["orders"], columns: ["ssn"]}, tags: [pii]}]') + m("t", 1, "{tags: [pii]}")
    d = decide(ALLOW + tagged, ORDERS, PII)
    assert [r.pattern for r in d.masks[ORDERS]] == ["ssn"] and PII not in d.masks
    with pytest.raises(GovernError, match="unknown tag"):
        Snapshot.from_yaml(m("t", 1, "{tags: [nope]}"))


def test_rewrites_rejects_approvals():
    r = lambda n, x, p=0: manifest("QueryRewritePolicy", n, f'match: {{any: [{{resources: {{catalogs: ["*"]}}}}]}}\nrewrite: {x}', p)
    d = decide(ALLOW + r("a", "{limit: {max: 50}, timeout: 1m30s}") + r("b", "{limit: {max: 20}, timeout: 2m, sample: {rate: 0.5}}", 3) + r("c", "{sample: {rate: 0.1, method: bernoulli}}"))
    assert (d.limit, d.timeout, d.sample) == (20, 90.0, (0.5, "reservoir"))
    reject = manifest("QueryRejectPolicy", "guard", 'match: {any: [{resources: {catalogs: ["*"]}}]}\nreject:\n  rules:\n  - {name: star, expression: "query.has_select_star == true && query.joins > 0", message: no star}\n  - {name: many, expression: "size(query.catalogs) > 1", code: X}')
    assert decide(ALLOW + reject).outcome == "allow"
    d = decide(ALLOW + reject, has_select_star=True, joins=1)
    assert (d.outcome, d.code, d.message, d.rejections[0]["rule"]) == ("reject", "ACL_REJECTED", "no star", "star")
    approve = manifest("ApprovalPolicy", "ask", 'match: {any: [{resources: {catalogs: ["*"]}}]}\nwhen: {columnsAccessed: ["ssn"]}\nreason: why')
    assert decide(ALLOW + approve).outcome == "allow"
    assert decide(ALLOW + approve, columns=["o.ssn"]).approval == {"policy": "ask", "reason": "why"}
    assert decide(ALLOW + approve + reject, columns=["ssn"], has_select_star=True, joins=1).outcome == "reject"
    from palisade.model import Comparison

    shape = Shape(comparisons=[Comparison("c.country", "=", "DE")])
    assert triggered({"predicates": [{"column": "country", "op": "=", "value": "DE"}]}, shape) and not triggered({"predicates": [{"column": "country", "op": "<"}]}, shape)
    assert triggered({}, shape) and triggered({"columnsAccessed": ["x"]}, None)


def test_composite():
    allow, deny = Engine(Snapshot.from_yaml(ALLOW)), Engine(Snapshot.from_yaml(ALLOW.replace("effect: allow", "effect: deny")))
    silent = Engine(Snapshot.from_yaml(ALLOW.replace('"**"', '"zz"')))
    shape = Shape(tables=[ORDERS])
    at = lambda *m: Composite(*m).evaluate(USER, None, shape)
    assert at(allow, silent).outcome == "allow" and at(allow, deny).outcome == "deny" and at(silent, silent).abstained
    outside = CallableEngine(lambda doc: {"allow": doc["subject"]["id"] == "alice", "limit": 7, "filters": [{"table": str(ORDERS), "predicate": {"column": "a", "op": "IsNull"}}], "masks": [{"table": str(ORDERS), "column": "b", "type": "null"}]})
    d = at(allow, outside)
    assert d.limit == 7 and d.filters[ORDERS][0][0]["column"] == "a" and d.masks[ORDERS][0].pattern == "b"
    with pytest.raises(GovernError):
        at(CallableEngine(lambda doc: {"allow": True, "surprise": 1}))


def test_relationships():
    text = manifest("RelationshipPolicy", "r", 'match: {any: [{resources: {tables: ["orders"]}}]}\nbackend: {type: tuples}\nchecks: [{objectTemplate: "table:{{catalog}}/{{table}}", relation: reader}]')
    asked, now = [], [0.0]

    def checker(user, relation, obj):
        asked.append((user, relation, obj))
        return user == "user:alice"

    e = RebacEngine(Snapshot.from_yaml(text), checker, clock=lambda: now[0])
    assert e.evaluate(USER, None, Shape(tables=[ORDERS])).outcome == "allow" and e.evaluate(USER, None, Shape(tables=[ORDERS])).outcome == "allow"
    assert asked == [("user:alice", "reader", "table:pg/orders")]
    now[0] = 11
    assert e.evaluate(UserCtx("bob"), None, Shape(tables=[ORDERS])).deny_policy == "r" and e.evaluate(USER, None, Shape(tables=[PII])).abstained
    with pytest.raises(GovernError, match="check failed"):
        RebacEngine(Snapshot.from_yaml(text), lambda *a: 1 / 0).evaluate(USER, None, Shape(tables=[ORDERS]))


ENV = {"subject": {"id": "a", "groups": ["g"], "claims": {"n": 2}}, "request": {"headers": {}}, "query": {"joins": 1, "tables": ["a.b.c"], "flag": True}}


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("query.joins + 1 == 2", True), ("!query.flag || 'g' in subject.groups", True), ("subject.claims.missing == 1 || true", True), ("true || subject.claims.missing == 1", True), ("false && subject.claims.missing == 1", False),
        ("has(subject.claims.n) && !has(subject.claims.x)", True), ("query.tables.exists(t, t.startsWith('a.'))", True), ("query.tables.all(t, t.endsWith('z'))", False), ("size(subject.groups) == 1 ? 1 < 2 : false", True),
        ("'abc'.matches('^a.c$')", True), ("subject['id'] == \"a\"", True), ("1 == 1.0 && '1' != 1 && true != 1", True), ("-1 < 0 && [1, 2][1] == 2", True), ("subject.id in ['b', 'a']", True), ("r'\\d' == '\\\\d'", True),
    ],
)
def test_cel(text, value):
    assert cel.evaluate(cel.parse(text), ENV) is value


@pytest.mark.parametrize("text", ["", "a.b", "foo(1)", "subject.id.foo()", "1 +", "(1", "subject.", "query.x == = 1", "'a'.matches('(?=x)')", "{}", "a" * 20_000, "(" * 100 + "1" + ")" * 100])
def test_cel_refused(text):
    with pytest.raises(GovernError):
        cel.parse(text)


@pytest.mark.parametrize("text", ["subject.claims.missing == 1", "subject.claims.missing == 1 || false", "1 < 'a'", "query.joins", "subject.groups[5] == 'x'", "1 in 2"])
def test_cel_errors(text):
    with pytest.raises(cel.CelError):
        cel.condition(cel.parse(text), ENV)


def test_cel_row_filters():
    low = lambda t: cel.lower(cel.parse(t))
    assert low("row.a == subject.claims.t && !(3 < row.b)") == {"all": [{"column": "a", "op": "Equals", "value": "{{ subject.claims.t }}"}, {"not": {"column": "b", "op": "GreaterThan", "value": 3}}]}
    assert low("row.x in ['a', 'b'] || row.y.contains('%')")["any"][0] == {"column": "x", "op": "In", "values": ["a", "b"]}
    assert low("row.a == null") == {"column": "a", "op": "IsNull"} and low("subject.id == row.a")["value"] == "{{ subject.sub }}"
    for bad in ("row.a == row.b", "row.a + 1 == 2", "query.joins == 1", "row.a.contains(subject.id)", "row.a < null", "row.a in []"):
        with pytest.raises(GovernError):
            low(bad)


def test_templates():
    r = lambda t, f=None: template.resolve(template.path_of(t), USER, f)
    assert r("{{ subject.sub }}") == "alice" and r("{{subject.tenant_id}}") == "t-42" and r("{{ subject.jwt.deep.x }}") == ["a"] and r("{{ subject.groups }}") == ["analysts"]
    assert r("{{ request.headers.x-a }}", Facts(headers={"x-a": "v"})) == "v"
    for missing in ("{{ subject.claims.nope }}", "{{ request.remote_ip }}", "{{ subject.sub.x }}", "{{ request.headers.q }}"):
        with pytest.raises(template.Missing):
            r(missing, Facts())
    for bad in ("x{{ subject.sub }}", "{{ other.x }}", "{{ }}"):
        with pytest.raises(GovernError):
            template.path_of(bad)
    assert template.path_of("plain") is None and template.path_of(3) is None


@pytest.mark.parametrize("bad", [{}, {"column": "a"}, {"column": "a", "op": "Nope"}, {"column": "a", "op": "Equals"}, {"column": "a", "op": "In", "values": []}, {"column": "a", "op": "Between", "values": [1]}, {"column": "a", "op": "IsNull", "value": 1}, {"all": []}, {"all": [{}], "any": [{}]}, {"column": "a", "op": "Matches", "value": "("}, {"column": "a", "op": "Equals", "value": [1]}, {"column": "a", "op": "Equals", "value": "x{{ subject.sub }}"}])
def test_bad_predicates(bad):
    with pytest.raises(GovernError):
        predicates.check(bad)


@pytest.mark.parametrize(
    ("kind", "spec"),
    [
        ("SqlAccessPolicy", "effect: maybe"), ("SqlAccessPolicy", "effect: allow\nsurprise: 1"), ("SqlAccessPolicy", "effect: allow\nenforcementMode: Sometimes"), ("RowFilterPolicy", "filter: {}"),
        ("RowFilterPolicy", "filter: {predicate: {column: a, op: IsNull}, expression: 'row.a == 1'}"), ("RowFilterPolicy", "filter: {predicate: {column: a, op: IsNull}}\ncombine: xor"), ("ColumnMaskPolicy", "mask: {type: custom}"),
        ("ColumnMaskPolicy", "mask: {type: external}"), ("ColumnMaskPolicy", "mask: {type: partial, args: {maskChar: ab}}"), ("ColumnMaskPolicy", "mask: {type: jitter, args: {range: 2, seed: x}}"), ("ColumnMaskPolicy", "mask: {type: truncate}"),
        ("ColumnMaskPolicy", "mask: {type: hash, args: {algorithm: hmac_sha256}}"), ("ColumnMaskPolicy", "mask: {type: fpe, args: {keyRef: k, customAlphabet: aa}}"), ("ColumnMaskPolicy", "mask: {type: fake, args: {fakeType: dog}}"),
        ("ColumnMaskPolicy", "mask: {type: regex, args: {pattern: '(?<=a)b'}}"), ("QueryRewritePolicy", "rewrite: {hint: [{key: a, value: b}]}"), ("QueryRewritePolicy", "rewrite: {limit: {max: 0}}"), ("QueryRewritePolicy", "rewrite: {sample: {rate: 2}}"),
        ("QueryRejectPolicy", "reject: {rules: []}"), ("DataSource", "type: oracle"), ("DataSource", "type: sqlite\npath: x\nreadonly: false"), ("DataClassification", "rules: [{resources: {tags: [a]}, tags: [b]}]"), ("Nope", "a: 1"), ("AuditSink", "type: s3"),
    ],
)
def test_bad_manifests(kind, spec):
    with pytest.raises(GovernError) as e:
        Snapshot.compile(decode(manifest(kind, "x", spec)))
    assert e.value.code == "ERR_POLICY_INVALID"


def test_duplicate_names_and_directories(tmp_path):
    with pytest.raises(GovernError, match="twice"):
        Snapshot.from_yaml(ALLOW + ALLOW)
    (tmp_path / "a.yaml").write_text(ALLOW)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.yml").write_text(ALLOW.replace("allow-all", "other"))
    policies, digest = load_directory(tmp_path)
    assert [p.name for p in policies] == ["allow-all", "other"] and len(digest) == 64
    kinds = Kinds()
    kinds.register("Own", {"x"}, lambda s: None)
    assert decode(manifest("Own", "o", "x: 1"), kinds)[0].spec["x"] == 1
    assert seconds("1m30s") == 90 and seconds("250ms") == 0.25


def test_mask_registry():
    r = default_registry()
    assert [n for n in r.providers if r.is_post(n, {})] == ["jitter", "fpe", "fake"] and r.is_post("hash", {"algorithm": "hmac_sha256"})
    with pytest.raises(GovernError):
        r.register("hash", r.get("null"))
    assert java_replacement(r"a\1$b\x") == r"a$1\$b\\x" and all(len(set(w)) == len(w) for w in WORDS.values())


def test_format_preserving_encryption():
    """Sample vectors of the FF1 standard."""
    key = bytes.fromhex("2B7E151628AED2A6ABF7158809CF4F3C")
    digits, letters = fpe.ALPHABETS["numeric"], fpe.ALPHABETS["alphanumeric"]
    assert fpe.Ff1(key).text("0123456789", digits) == "2433477484"
    assert fpe.Ff1(key, bytes.fromhex("39383736353433323130")).text("0123456789", digits) == "6124200773"
    assert fpe.Ff1(key, bytes.fromhex("3737373770717273373737"), 36).text("0123456789abcdefghi", letters) == "a9tv40mll9kdu509eum"
    f = fpe.Ff1(key)
    hidden = f.text("123-45-6789", digits)
    assert hidden[3] == hidden[6] == "-" and f.text(hidden, digits, decrypt=True) == "123-45-6789" and f.text("--", digits) == "--"
    with pytest.raises(ValueError, match="needs 6"):
        f.text("12345", digits)
