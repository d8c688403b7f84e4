"""Row-filter predicates: a tree of dicts, checked when policies load, made a Column for each request."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions import cel, template
from palisade.model import Facts, UserCtx, invalid

ONE = ("Equals", "NotEquals", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Like", "NotLike", "StartsWith", "EndsWith", "Contains", "Matches")
MANY = ("In", "NotIn", "Between")
NONE = ("IsNull", "IsNotNull")
DEPTH = 50
ESCAPE = "\x01"


def check(p: Any, depth: int = 0) -> None:
    """Raises ERR_POLICY_INVALID unless ``p`` is a well-formed predicate."""
    if not isinstance(p, dict) or depth > DEPTH:
        raise invalid("a predicate is a mapping, nested up to 50 levels")
    inner = [k for k in ("all", "any", "not") if p.get(k) is not None]
    if inner:
        if len(inner) > 1 or "column" in p or "op" in p:
            raise invalid("a predicate is one of all, any, not, or a comparison")
        below = p[inner[0]]
        if inner[0] != "not" and (not isinstance(below, list) or not below):
            raise invalid(f"{inner[0]} needs a list")
        for x in [below] if inner[0] == "not" else below:
            check(x, depth + 1)
        return
    if unknown := set(p) - {"column", "op", "value", "values", "literal"}:
        raise invalid(f"unknown predicate fields: {sorted(unknown)}")
    op, value, values = p.get("op"), p.get("value"), p.get("values")
    if not isinstance(p.get("column"), str) or not p["column"]:
        raise invalid("a comparison needs a column")
    if op in ONE:
        if value is None or values is not None:
            raise invalid(f"{op} needs a value")
        found = [value]
    elif op in MANY:
        if not isinstance(values, list) or not values or value is not None or (op == "Between" and len(values) != 2):
            raise invalid(f"{op} needs {'two values' if op == 'Between' else 'values'}")
        found = values
    elif op in NONE:
        if value is not None or values is not None:
            raise invalid(f"{op} takes no value")
        found = []
    else:
        raise invalid(f"unknown operator {op}")
    for v in found:
        if isinstance(v, (dict, list)):
            raise invalid("values are scalars")
        if not p.get("literal"):
            template.path_of(v)
    if op == "Matches" and template.path_of(value) is None:
        cel.safe_regex(value)


def _rendered(v: Any, p: dict, user: UserCtx | None, facts: Facts | None) -> Any:
    path = None if p.get("literal") else template.path_of(v)
    return v if path is None else template.resolve(path, user, facts)


def _scalar(v: Any, op: str) -> Any:
    if isinstance(v, (list, tuple, dict)):
        raise invalid(f"{op} needs a scalar")
    return v


def to_column(p: dict, user: UserCtx | None, facts: Facts | None, column=F.col) -> Column:
    """The Boolean Column of a checked predicate; ``column`` gives a column for a name.  Nulls follow SQL."""
    if p.get("all") is not None or p.get("any") is not None:
        parts = [to_column(x, user, facts, column) for x in (p.get("all") or p.get("any"))]
        out = parts[0]
        for x in parts[1:]:
            out = out & x if p.get("all") is not None else out | x
        return out
    if p.get("not") is not None:
        return ~to_column(p["not"], user, facts, column)
    c, op = column(p["column"]), p["op"]
    if op in NONE:
        return c.isNull() if op == "IsNull" else c.isNotNull()
    if op in MANY:
        values: list[Any] = []
        for v in p["values"]:
            r = _rendered(v, p, user, facts)
            values += r if isinstance(r, (list, tuple)) and op != "Between" else [_scalar(r, op)]
        if op == "Between":
            return c.between(F.lit(values[0]), F.lit(values[1]))
        if not values:  # an empty list of groups, say
            return F.lit(op == "NotIn")
        return c.isin(values) if op == "In" else ~c.isin(values)
    v = _scalar(_rendered(p["value"], p, user, facts), op)
    if op in ("Like", "NotLike"):  # no character escapes
        like = F.like(c, F.lit(str(v)), F.lit(ESCAPE))
        return like if op == "Like" else ~like
    if op == "Matches":
        cel.safe_regex(v)
        return c.rlike(str(v))
    if op in ("StartsWith", "EndsWith", "Contains"):
        f = {"StartsWith": F.startswith, "EndsWith": F.endswith, "Contains": F.contains}[op]
        return f(c, F.lit(str(v)))
    lit = F.lit(v)
    return {
        "Equals": lambda: c == lit, "NotEquals": lambda: c != lit, "GreaterThan": lambda: c > lit,
        "GreaterThanOrEqual": lambda: c >= lit, "LessThan": lambda: c < lit, "LessThanOrEqual": lambda: c <= lit,
    }[op]()


def columns(p: dict) -> set[str]:
    if "column" in p:
        return {p["column"]}
    below = [p["not"]] if p.get("not") is not None else p.get("all") or p.get("any") or []
    return set().union(*map(columns, below))


def fold(parts: list[tuple[Column, str]]) -> Column:
    """Each predicate joins what precedes it by its own rule: restrictive AND, permissive OR."""
    out = parts[0][0]
    for c, combine in parts[1:]:
        out = out | c if combine == "permissive" else out & c
    return out
