"""Securing a parsed query: every table occurrence becomes a view with its row filter and column masks.

The view filters raw values first and projects plain and masked columns; the query's text then reads the views, so
Catalyst pushes the filter into the scan and drops masks that nobody asks for.  Columns with a post mask carry a mark
in their metadata, which follows them through projections; on the analysed plan a marked column may only be passed on
as it is, up to the outermost select list, where the mask is applied.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import predicates
from palisade.functions.masks import MaskRegistry
from palisade.model import Decision, Facts, GovernError, TableKey, UserCtx
from palisade.operators.engine import resolve_masks
from palisade.plans.parse import Parsed, option, seq, simple_name

MARK = "__governed"
Loader = Callable[[SparkSession, TableKey], DataFrame]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def secured_table(df: DataFrame, key: TableKey, d: Decision, user: UserCtx, facts: Facts | None, masks: MaskRegistry) -> tuple[DataFrame, dict[str, str]]:
    """The secured rows of a table, and the post masks among its columns (column -> type)."""
    names = {n.lower(): n for n in df.columns}

    def column(name: str):
        if name.lower() not in names:
            raise GovernError("ERR_REWRITE_FAILED", f"{key} has no column {name}")
        return df[quoted(names[name.lower()])]

    if d.filters.get(key):
        df = df.where(predicates.fold([(predicates.to_column(p, user, facts, column), combine) for p, combine in d.filters[key]]))
    rules = resolve_masks(d.masks.get(key, []), df.columns)
    post: dict[str, str] = {}
    if rules:
        items = []
        for f in df.schema.fields:
            c = df[quoted(f.name)]
            if (r := rules.get(f.name)) is None:
                items.append(c)
            elif masks.is_post(r.type, r.args):
                post[f.name] = r.type
                items.append(c.alias(f.name, metadata={MARK: json.dumps([str(key), f.name])}))
            else:
                items.append(masks.column(r.type, c, f.dataType, r.args).alias(f.name))
        df = df.select(*items)
    return df, post


def substituted(parsed: Parsed, keys: dict[tuple[str, ...], TableKey], views: dict[TableKey, str]) -> str:
    """The text with table names replaced by view names, right to left."""
    edits: list[tuple[int, int, str]] = []
    for r in parsed.refs:
        name = quoted(views[keys[r.parts]])
        edits.append((r.start, r.stop, name if r.alias is not None else f"{name} AS {quoted(r.parts[-1])}"))
    for parts, a, z in parsed.qualified:  # catalog.schema.table.column
        if any(parts[: len(r.parts)] == r.parts and len(parts) > len(r.parts) > 1 for r in parsed.refs):
            n = max(len(r.parts) for r in parsed.refs if parts[: len(r.parts)] == r.parts)
            edits.append((a, z, ".".join(map(quoted, parts[n - 1 :]))))
    text = parsed.sql
    for a, z, new in sorted(edits, reverse=True):
        text = text[:a] + new + text[z + 1 :]
    return text


def _marked(e: Any) -> bool:
    return simple_name(e) == "AttributeReference" and e.metadata().contains(MARK)


def _holds_mark(e: Any) -> bool:
    return _marked(e) or any(_holds_mark(c) for c in seq(e.children())) or (hasattr(e, "plan") and _is_subquery(e) and _subquery_leaks(e))


def _is_subquery(e: Any) -> bool:
    return simple_name(e) in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery")


def _subquery_leaks(e: Any) -> bool:
    check_marks(e.plan())
    return simple_name(e) != "Exists" and any(_marked(a) for a in seq(e.plan().output()))


def _refuse() -> None:
    raise GovernError("ERR_MASK_UNSUPPORTED_CONTEXT", "a column with this mask can only be selected as it is")


def check_marks(p: Any) -> None:
    """Raises unless marked columns are only passed on as they are."""
    name = simple_name(p)
    if name == "Project":
        for e in seq(p.projectList()):
            bare = _marked(e) or (simple_name(e) == "Alias" and _marked(e.child()))
            if not bare and _holds_mark(e):
                _refuse()
    elif name not in ("SubqueryAlias", "View", "CTERelationRef", "CTERelationDef", "WithCTE"):
        if any(_holds_mark(e) for e in seq(p.expressions())):
            _refuse()
        if name in ("Union", "Intersect", "Except", "Distinct", "Deduplicate", "UnionLoop", "Unpivot", "Expand") and any(_marked(a) for c in seq(p.children()) for a in seq(c.output())):
            _refuse()
    if name == "WithCTE":
        for c in seq(p.cteDefs()):
            check_marks(c)
        check_marks(p.plan())
        return
    for c in seq(p.children()):
        check_marks(c)


def apply_post_masks(df: DataFrame, marks: dict[tuple[str, str], tuple[str, dict]], masks: MaskRegistry) -> DataFrame:
    check_marks(df._jdf.queryExecution().analyzed())
    fields = df.schema.fields
    found = [json.loads(f.metadata[MARK]) if MARK in f.metadata else None for f in fields]
    if not any(found):
        return df
    plain = df.toDF(*(f"__c{i}" for i in range(len(fields))))
    items = []
    for i, (f, m) in enumerate(zip(fields, found, strict=True)):
        c = F.col(f"__c{i}")
        if m is not None:
            kind, args = marks[m[0], m[1]]
            c = masks.column(kind, c, f.dataType, args)
        items.append(c.alias(f.name, metadata={k: v for k, v in f.metadata.items() if k != MARK}))
    return plain.select(*items)


def secure(session: SparkSession, parsed: Parsed, keys: dict[tuple[str, ...], TableKey], load: Loader, d: Decision, user: UserCtx, facts: Facts | None, masks: MaskRegistry, args: Any = None) -> tuple[DataFrame, str]:
    """The secured DataFrame of a query, and the text that made it."""
    tag, views, marks = uuid.uuid4().hex, {}, {}
    try:
        for n, key in enumerate(dict.fromkeys(keys[r.parts] for r in parsed.refs)):
            df, post = secured_table(load(session, key), key, d, user, facts, masks)
            if post:
                rules = resolve_masks(d.masks[key], list(post))
                marks |= {(str(key), c): (rules[c].type, rules[c].args) for c in post}
            views[key] = f"__gov_{tag}_{n}"
            df.createOrReplaceTempView(views[key])
        text = substituted(parsed, keys, views)
        try:
            out = session.sql(text, args=args) if args else session.sql(text)
        except Exception as e:
            said = str(e).splitlines()[0]
            for key, v in views.items():
                said = said.replace(v, str(key))
            raise GovernError("ERR_REWRITE_FAILED", said[:300]) from None
        if marks:
            out = apply_post_masks(out, marks, masks)
    finally:
        for v in views.values():
            session.catalog.dropTempView(v)
    return limited(out, d), text


def limited(df: DataFrame, d: Decision, seed: int | None = None) -> DataFrame:
    """The row cap, then the sample."""
    if d.limit is not None:
        df = df.limit(d.limit)
    if d.sample is not None:
        df = sampled(df, *d.sample, seed=seed)
    return df


def sampled(df: DataFrame, rate: float, method: str = "reservoir", seed: int | None = None) -> DataFrame:
    """bernoulli and system keep each row with probability ``rate``; reservoir keeps round(rate * n) rows, by one count and a top-k of random keys."""
    if rate >= 1:
        return df
    if method != "reservoir":
        return df.sample(False, rate, seed) if seed is not None else df.sample(False, rate)
    n = round(rate * df.count())
    key = F.rand(seed) if seed is not None else F.rand()
    return df.withColumn("__key", key).orderBy("__key").limit(n).drop("__key")


def explain_text(df: DataFrame, mode: str = "simple") -> str:
    """The plan's operators without expressions, which could name hidden values."""
    plan = df._jdf.queryExecution().executedPlan()

    def lines(p: Any, depth: int) -> list[str]:
        out = ["  " * depth + p.nodeName()]
        inner = [p.initialPlan()] if p.nodeName() == "AdaptiveSparkPlan" else seq(p.children())
        for c in inner:
            out += lines(c, depth + 1)
        return out

    return "\n".join(lines(plan, 0))


__all__ = ["apply_post_masks", "check_marks", "explain_text", "limited", "option", "sampled", "secure", "secured_table", "substituted"]
