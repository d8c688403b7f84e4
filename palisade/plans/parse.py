"""Reading SQL text through Spark's own parser: statement gate, table occurrences, query shape, accessed columns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from palisade.model import Comparison, GovernError, Shape, TableRef

MAX_SQL = 1 << 20
#: Plan nodes a query may have; anything else is no query.
NODES = frozenset(
    "Project Aggregate Filter Sort GlobalLimit LocalLimit Offset Tail Distinct Union Except Intersect UnresolvedWith SubqueryAlias UnresolvedInlineTable OneRowRelation "
    "UnresolvedHaving Join LateralJoin WithWindowDefinition Generate Pivot Unpivot UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases Sample UnresolvedRelation "
    "ParameterizedQuery RebalancePartitions Repartition RepartitionByExpression UnresolvedHint LocalRelation View Window UnionLoop".split()
)
WRITES = {"InsertIntoStatement": "INSERT", "UpdateTable": "UPDATE", "DeleteFromTable": "DELETE", "MergeIntoTable": "UPDATE", "InsertIntoDir": "COPY"}
FORBIDDEN = frozenset(
    "java_method reflect try_reflect raise_error assert_true input_file_name input_file_block_start input_file_block_length spark_partition_id current_database current_catalog "
    "current_schema session_user current_user user version typeof_plan read_files read_kafka read_parquet from_protobuf try_to_variant_object".split()
) - {"current_database", "current_catalog", "current_schema", "session_user", "current_user", "user"}
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode collations".split()) - {"collations"}
AGGREGATES = frozenset("count sum avg min max stddev stddev_pop stddev_samp variance var_pop var_samp array_agg string_agg listagg median mean first last any_value collect_list collect_set approx_count_distinct every some bool_and bool_or percentile mode".split())


def seq(s: Any) -> list:
    return [s.apply(i) for i in range(s.size())]


def simple_name(node: Any) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def option(o: Any) -> Any:
    return o.get() if o.isDefined() else None


def span(node: Any) -> tuple[int, int] | None:
    a, z = option(node.origin().startIndex()), option(node.origin().stopIndex())
    return None if a is None or z is None else (a, z)


@dataclass
class Parsed:
    sql: str
    kind: str
    plan: Any
    refs: list[TableRef] = field(default_factory=list)
    shape: Shape = field(default_factory=Shape)
    qualified: list[tuple[tuple[str, ...], int, int]] = field(default_factory=list)
    explain: tuple[str, int] | None = None  # mode and where the inner query starts
    fingerprint: str = ""


class _Walk:
    def __init__(self, out: Parsed):
        self.out = out
        self.seen: set[tuple[int, int]] = set()

    def plan(self, p: Any, ctes: frozenset[str], above: tuple = ()) -> None:
        name = simple_name(p)
        if name not in NODES:
            raise GovernError("ERR_UNSUPPORTED_SYNTAX", f"not allowed in a query: {name}")
        if name == "UnresolvedRelation":
            self.relation(p, ctes, above)
            return
        if name == "UnresolvedTableValuedFunction":
            fn = ".".join(seq(p.name())).lower()
            if fn not in TABLE_FUNCTIONS:
                raise GovernError("ERR_UNSUPPORTED_SYNTAX", f"table function not allowed: {fn}")
        if name == "UnresolvedWith":
            inner = ctes
            recursive = p.allowRecursion()
            for r in seq(p.cteRelations()):
                cte = r._1().lower()
                self.plan(r._2(), inner | {cte} if recursive else inner)
                inner |= {cte}
            self.plan(p.child(), inner)
            return
        if name == "Join" and not (simple_name(p.joinType()) == "Inner" and not p.condition().isDefined()):
            self.out.shape.joins += 1
        for e in seq(p.expressions()):
            self.expression(e, ctes)
        for c in seq(p.children()):
            self.plan(c, ctes, (*above, p) if name in ("SubqueryAlias", "Sample") else ())
        if name == "LateralJoin":
            self.plan(p.right().plan(), ctes)

    def relation(self, p: Any, ctes: frozenset[str], above: tuple) -> None:
        parts = tuple(seq(p.multipartIdentifier()))
        if len(parts) == 1 and parts[0].lower() in ctes:
            return
        where = span(p)
        if where is None:
            raise GovernError("ERR_UNSUPPORTED_SYNTAX", "a table without a place in the text")
        if where in self.seen:
            return
        self.seen.add(where)
        alias = next((x.alias() for x in reversed(above) if simple_name(x) == "SubqueryAlias"), None)
        sampled = any(simple_name(x) == "Sample" for x in above)
        self.out.refs.append(TableRef(parts, *where, alias if alias is not None else ("" if sampled else None)))

    def expression(self, e: Any, ctes: frozenset[str]) -> None:
        name = simple_name(e)
        if name in ("PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier", "UnresolvedIdentifier"):
            raise GovernError("ERR_UNSUPPORTED_SYNTAX", "IDENTIFIER() is not allowed")
        if name == "UnresolvedAttribute":
            parts = tuple(seq(e.nameParts()))
            self.out.shape.columns.append(".".join(parts))
            if len(parts) > 2 and (at := span(e)):
                self.out.qualified.append((parts, *at))
        elif name == "UnresolvedFunction":
            fn = seq(e.nameParts())[-1].lower()
            self.out.shape.functions.append(fn)
            if fn in FORBIDDEN:
                raise GovernError("ERR_UNSUPPORTED_SYNTAX", f"function not allowed: {fn}")
        elif name in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "InSubquery", "FunctionTableSubqueryArgumentExpression", "UnresolvedExists"):
            if name == "InSubquery":
                for v in seq(e.values()):
                    self.expression(v, ctes)
                self.plan(e.query().plan(), ctes)
                return
            self.plan(e.plan(), ctes)
        self.comparison(e, name)
        for c in seq(e.children()):
            self.expression(c, ctes)

    OPS = {"EqualTo": "=", "EqualNullSafe": "=", "LessThan": "<", "LessThanOrEqual": "<=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "Like": "like", "ILike": "ilike"}
    FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}

    def comparison(self, e: Any, name: str) -> None:
        facts = self.out.shape.comparisons
        if name == "Not" and simple_name(e.child()) == "EqualTo":
            self.fact(seq(e.child().children()), "!=")
        elif name in self.OPS:
            self.fact(seq(e.children()), self.OPS[name])
        elif name == "In" and (c := _attribute(e.value())):
            facts += [Comparison(c, "in", v) for x in seq(e.list()) if (v := _literal(x)) is not None]
        elif name in ("IsNull", "IsNotNull") and (c := _attribute(e.child())):
            facts.append(Comparison(c, "isnull" if name == "IsNull" else "isnotnull", ""))

    def fact(self, sides: list, op: str) -> None:
        for a, b, o in ((sides[0], sides[1], op), (sides[1], sides[0], self.FLIP.get(op, op))):
            if (c := _attribute(a)) and (v := _literal(b)) is not None:
                self.out.shape.comparisons.append(Comparison(c, o, v))
                return


def _attribute(e: Any) -> str | None:
    return ".".join(seq(e.nameParts())) if simple_name(e) == "UnresolvedAttribute" else None


def _literal(e: Any) -> str | None:
    while simple_name(e) in ("Cast", "UnresolvedCast", "Alias"):
        e = e.child()
    if simple_name(e) != "Literal":
        return None
    v = e.value()
    return None if v is None else str(v if isinstance(v, (str, int, float, bool)) else v.toString())


def _nodes(e: Any) -> Iterator[Any]:
    yield e
    for c in seq(e.children()):
        yield from _nodes(c)


def _attributes(es: list) -> list[str]:
    return list(dict.fromkeys(a for e in es for x in _nodes(e) if (a := _attribute(x))))


def _shape(p: Any, s: Shape, top: bool = True) -> None:
    """Flags of the outermost query; of a set operation, those of its left arm."""
    name = simple_name(p)
    if name == "UnresolvedWith":
        s.has_cte, s.is_recursive_cte = True, p.allowRecursion()
        _shape(p.child(), s)
    elif name in ("GlobalLimit", "LocalLimit"):
        s.has_limit = True
        if (v := _literal(p.limitExpr())) is not None:
            s.limit = int(v)
        _shape(p.child(), s)
    elif name == "Sort":
        s.has_order_by = True
        _shape(p.child(), s)
    elif name in ("Offset", "Distinct", "WithWindowDefinition", "SubqueryAlias", "RepartitionByExpression", "Repartition", "UnresolvedHint"):
        if name == "Distinct" and simple_name(p.child()) == "Union":
            s.has_union = True
        _shape(p.child(), s)
    elif name in ("Union", "Intersect", "Except"):
        s.has_union = True
        _shape(seq(p.children())[0], s)
    elif name == "UnresolvedHaving":
        s.is_aggregate = True
        _shape(p.child(), s)
    elif name in ("Project", "Aggregate"):
        items = seq(p.projectList() if name == "Project" else p.aggregateExpressions())
        s.has_select_star = any(simple_name(x).startswith("UnresolvedStar") for x in items)
        used = {seq(x.nameParts())[-1].lower() for i in items for x in _nodes(i) if simple_name(x) == "UnresolvedFunction"}
        s.is_aggregate |= name == "Aggregate" or bool(used & AGGREGATES)
        if name == "Aggregate":
            s.group_by_columns = _attributes(seq(p.groupingExpressions()))
        _below(p.child(), s)


def _below(p: Any, s: Shape) -> None:
    if simple_name(p) == "Filter":
        s.has_where = True
        s.where_columns = _attributes([p.condition()])


def fallback_tables(sql: str) -> list[tuple[str, ...]]:
    """Table names after FROM, JOIN, UPDATE and INTO of text that does not parse; for audit records and denials only."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL)
    text = re.sub(r"'(?:[^']|'')*'", "''", text)
    part = r"(?:[A-Za-z_]\w*|\"[^\"]+\"|`[^`]+`)"
    found = re.findall(rf"\b(?:FROM|JOIN|UPDATE|INTO)\s+({part}(?:\s*\.\s*{part}){{0,2}})", text, flags=re.IGNORECASE)
    return list(dict.fromkeys(tuple(x.strip().strip("\"`") for x in f.split(".")) for f in found))


def fingerprint(sql: str) -> str:
    """A digest of the text with literals, comments and spacing evened out."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.DOTALL)
    text = re.sub(r"'(?:[^']|'')*'|\b\d+(?:\.\d+)?\b", "?", text)
    return hashlib.sha256(" ".join(text.split()).lower().encode()).hexdigest()[:32]


def parse(spark: SparkSession, sql: str) -> Parsed:
    """The parsed statement, past the gate: one query, or EXPLAIN of one."""
    if len(sql.encode()) > MAX_SQL:
        raise GovernError("ERR_PAYLOAD_TOO_LARGE", "the statement is longer than 1 MiB")
    text = sql.strip().rstrip(";").rstrip() if sql.strip().endswith(";") else sql
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        said = next((x.strip() for x in str(e).splitlines() if x.strip()), type(e).__name__)[:300]
        if ";" in re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*", "", text):
            raise GovernError("ERR_MULTIPLE_STATEMENTS", "one statement at a time") from None
        raise GovernError("ERR_SYNTAX", said) from None
    name = simple_name(plan)
    out = Parsed(text, "SELECT", plan, fingerprint=fingerprint(text))
    if name in WRITES:
        kind = WRITES[name]
        raise GovernError("ACL_REJECTED" if kind != "COPY" else "ERR_UNSUPPORTED_SYNTAX", f"{kind} is not allowed: queries are read-only")
    if name == "ExplainCommand":
        inner = plan.logicalPlan()
        m = re.match(r"\s*EXPLAIN(?:\s+(EXTENDED|CODEGEN|COST|FORMATTED))?\s+", text, flags=re.IGNORECASE)
        if simple_name(inner) not in NODES or m is None or (m[1] or "").upper() == "CODEGEN":
            raise GovernError("ERR_UNSUPPORTED_SYNTAX", "EXPLAIN explains a query")
        found = parse(spark, text[m.end() :])
        found.explain = ((m[1] or "simple").lower(), m.end())
        found.kind = "EXPLAIN"
        return found
    if name not in NODES:
        raise GovernError("ERR_UNSUPPORTED_SYNTAX", f"statement not allowed: {name}")
    _Walk(out).plan(plan, frozenset())
    _shape(plan, out.shape)
    out.refs.sort(key=lambda r: r.start)
    out.shape.columns = list(dict.fromkeys(out.shape.columns))
    return out
