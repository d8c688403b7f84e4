"""The governed session: from SQL text and identity to a secured DataFrame, with audit before any row."""

from __future__ import annotations

import csv
import datetime as dt
import hashlib
import io
import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from palisade.functions.masks import MaskRegistry, default_registry
from palisade.model import Decision, Facts, GovernError, TableKey, UserCtx
from palisade.operators.engine import Engine, PolicyEngine, Snapshot, resolve_masks
from palisade.plans import parse as P
from palisade.plans import secure as S
from palisade.service.approvals import Approvals
from palisade.service.audit import AuditLog
from palisade.service.limits import Budgets, DecisionCache, Gate, RateLimiter
from palisade.sources.catalog import Catalog


@dataclass
class Settings:
    max_rows: int = 100_000
    timeout: float = 30.0
    concurrency: int = 100
    cross_catalog: bool = True
    default_namespace: tuple[str, str] | None = None
    strict_access: bool = False
    page: int = 500
    max_page: int = 1000
    confs: dict[str, str] = field(default_factory=lambda: {"spark.sql.runSQLOnFiles": "false", "spark.sql.variable.substitute": "false", "spark.sql.ansi.doubleQuotedIdentifiers": "true"})


@dataclass
class Prepared:
    query_id: str
    parsed: P.Parsed
    decision: Decision
    keys: dict[tuple[str, ...], TableKey]


@dataclass
class Result:
    query_id: str
    columns: list[dict[str, str]]
    rows: list[tuple]
    row_count: int
    truncated: bool
    warning: str = ""

    def to_json(self) -> str:
        return json.dumps({"query_id": self.query_id, "columns": self.columns, "rows": [[_plain(v) for v in r] for r in self.rows], "row_count": self.row_count, "truncated": self.truncated} | ({"warning": self.warning} if self.warning else {}))

    def to_csv(self) -> str:
        """Nulls are empty, times are RFC 3339 in UTC, booleans true and false."""
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow([c["name"] for c in self.columns])
        w.writerows([["" if v is None else ("true" if v else "false") if isinstance(v, bool) else _plain(v) for v in r] for r in self.rows])
        return out.getvalue()


def _plain(v: Any) -> Any:
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=v.tzinfo or dt.UTC).astimezone(dt.UTC).isoformat().replace("+00:00", "Z")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


class Governed:
    """Governed SQL over a catalog of sources."""

    def __init__(
        self, spark: SparkSession, catalog: Catalog, policies: Snapshot | str | PolicyEngine, *, settings: Settings | None = None, masks: MaskRegistry | None = None,
        audit: AuditLog | None = None, rates: RateLimiter | None = None, budgets: Budgets | None = None, approvals: Approvals | None = None, cache: DecisionCache | None = None,
    ):
        self.settings = settings or Settings()
        clone = spark._jsparkSession.cloneSession()
        self.session = SparkSession(spark.sparkContext, clone)
        for k, v in self.settings.confs.items():
            self.session.conf.set(k, v)
        self.catalog, self.masks = catalog, masks or default_registry()
        if isinstance(policies, str):
            policies = Snapshot.from_yaml(policies)
        self.engine: PolicyEngine = Engine(policies, self.settings.strict_access) if isinstance(policies, Snapshot) else policies
        self.audit, self.rates, self.budgets, self.approvals, self.cache = audit, rates, budgets, approvals or Approvals(), cache
        self.gate = Gate(self.settings.concurrency)

    # Preparing.

    def _keys(self, parsed: P.Parsed) -> dict[tuple[str, ...], TableKey]:
        keys = {}
        for r in parsed.refs:
            if r.parts not in keys:
                key = self.catalog.resolve(self.session, r.parts, self.settings.default_namespace)
                if key is None:  # also engine-internal views and files named as tables
                    raise GovernError("ACL_DENIED", f"no such table for you: {'.'.join(r.parts)}")
                keys[r.parts] = key
        return keys

    def prepare(self, sql: str, user: UserCtx, facts: Facts | None = None) -> Prepared:
        parsed = P.parse(self.session, sql)
        keys = self._keys(parsed)
        parsed.shape.tables = list(dict.fromkeys(keys[r.parts] for r in parsed.refs))
        if not self.settings.cross_catalog and len(parsed.shape.catalogs) > 1:
            raise GovernError("ACL_REJECTED", "a query reads one catalog")
        return Prepared(uuid.uuid4().hex, parsed, self._decide(sql, parsed, user, facts), keys)

    def _decide(self, sql: str, parsed: P.Parsed, user: UserCtx, facts: Facts | None) -> Decision:
        if self.cache is None or not isinstance(self.engine, Engine):
            return self.engine.evaluate(user, facts, parsed.shape)
        snap = self.engine.snapshot
        who = json.dumps([user.subject, user.issuer, user.email, user.groups, user.claims, user.auth_method, user.remote_addr, user.api_key, facts and [facts.remote_ip, facts.user_agent, facts.headers]], sort_keys=True, default=str)
        key = (snap.version, snap.digest, hashlib.sha256(sql.encode()).hexdigest(), hashlib.sha256(who.encode()).hexdigest())
        if (d := self.cache.get(key)) is None:
            d = self.engine.evaluate(user, facts, parsed.shape)
            self.cache.put(key, d)
        return d

    @staticmethod
    def _admit(p: Prepared) -> None:
        d = p.decision
        if d.outcome == "deny":
            raise GovernError(d.code or "ACL_DENIED", d.message or "access denied", policy=d.deny_policy)
        if d.outcome == "reject":
            raise GovernError(d.code, d.message, rejections=[f"{r['policy']}/{r['rule']}" for r in d.rejections])

    # Running.

    def sql(self, sql: str, user: UserCtx, facts: Facts | None = None, args: Any = None, approval_id: str | None = None, meta: dict[str, str] | None = None) -> DataFrame:
        """The secured DataFrame, lazy; the access record is written before it is handed out."""
        return self._secured(sql, user, facts, args, approval_id, meta)[1]

    def _secured(self, sql: str, user: UserCtx, facts: Facts | None, args: Any, approval_id: str | None, meta: dict[str, str] | None) -> tuple[Prepared, DataFrame]:
        p = None
        try:
            if self.rates:
                self.rates.check(user)
            if self.budgets:
                self.budgets.check(user)
            p = self.prepare(sql, user, facts)
            self._admit(p)
            if p.decision.outcome == "approval":
                if approval_id is None:
                    r = self.approvals.ask(user, sql, p.decision.approval["policy"], p.decision.approval["reason"])
                    raise GovernError("ERR_APPROVAL_PENDING", p.decision.approval["reason"] or "approval needed", approval_id=r.id)
            df, text = S.secure(self.session, p.parsed, p.keys, self.catalog.load, p.decision, user, facts, self.masks, args)
            if p.decision.outcome == "approval":  # a statement that cannot be secured leaves the grant
                self.approvals.redeem(approval_id, user, sql)
            if p.parsed.explain:
                df = self.session.createDataFrame([(S.explain_text(df),)], "plan string")
            self._record("access", p, sql, user, facts, meta, rewritten_fingerprint=P.fingerprint(re.sub(r"__gov_[0-9a-f]{32}", "", text)))
            return p, df
        except GovernError as e:
            if e.code != "ERR_AUDIT_UNAVAILABLE":
                self._record("denied", p, sql, user, facts, meta, error_code=e.code, message=e.message)
            raise

    def _record(self, event: str, p: Prepared | None, sql: str, user: UserCtx, facts: Facts | None, meta: dict[str, str] | None, **more: Any) -> None:
        if self.audit is None:
            return
        tables = [str(t) for t in p.parsed.shape.tables] if p else [".".join(t) for t in P.fallback_tables(sql)]
        self.audit.write(
            event, query_id=p.query_id if p else "", subject={"subject": user.subject, "issuer": user.issuer, "groups": list(user.groups)}, sql_fingerprint=P.fingerprint(sql), sql_sample=sql[:1000],
            tables=tables, catalogs=list(dict.fromkeys(t.split(".")[0] for t in tables)), policies_applied=p.decision.applied if p else [], decision=p.decision.outcome if p else "deny",
            remote_ip=(facts and facts.remote_ip) or user.remote_addr, binding_name=user.binding, client_meta=dict(list((meta or {}).items())[:20]), **more,
        )

    def execute(self, sql: str, user: UserCtx, facts: Facts | None = None, args: Any = None, max_rows: int | None = None, timeout: float | None = None, approval_id: str | None = None, meta: dict[str, str] | None = None) -> Result:
        """Runs a query within rows and time; a completion record follows."""
        cap = min(max_rows or self.settings.max_rows, self.settings.max_rows)
        began = time.monotonic()
        with self.gate.slot():
            p, df = self._secured(sql, user, facts, args, approval_id, meta)
            limit = min(x for x in (timeout, p.decision.timeout, self.settings.timeout) if x)
            rows = self._collect(df.limit(cap + 1), limit)
        truncated = len(rows) > cap
        rows = rows[:cap]
        spent = int((time.monotonic() - began) * 1000)
        if self.budgets:
            self.budgets.add(user, spent, len(rows))
        self._record("completion", p, sql, user, facts, meta, row_count=len(rows), truncated=truncated, duration_ms=spent)
        columns = [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields]
        return Result(p.query_id, columns, [tuple(r) for r in rows], len(rows), truncated, "ERR_RESULT_TRUNCATED" if truncated else "")

    def _collect(self, df: DataFrame, timeout: float) -> list:
        tag, late = f"palisade-{uuid.uuid4().hex}", threading.Event()
        sc = self.session.sparkContext

        def stop() -> None:
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(timeout, stop)
        timer.daemon = True
        sc.addJobTag(tag)
        timer.start()
        try:
            return df.collect()
        except Exception as e:
            if late.is_set():
                raise GovernError("ERR_TIMEOUT", f"the query took longer than {timeout:g} s") from None
            raise GovernError("ERR_INTERNAL", f"the query failed: {getattr(e, 'getCondition', lambda: type(e).__name__)() or type(e).__name__}") from None
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def stream(self, sql: str, user: UserCtx, facts: Facts | None = None) -> Iterator[tuple]:
        """Rows one by one, up to the cap and within time, without collecting them; they hold a slot and count to budgets."""
        began, n = time.monotonic(), 0
        with self.gate.slot():
            p, df = self._secured(sql, user, facts, None, None, None)
            limit = min(x for x in (p.decision.timeout, self.settings.timeout) if x)
            try:
                for r in df.limit(self.settings.max_rows).toLocalIterator(prefetchPartitions=True):
                    if time.monotonic() - began > limit:
                        raise GovernError("ERR_TIMEOUT", f"the query took longer than {limit:g} s")
                    n += 1
                    yield tuple(r)
            finally:
                spent = int((time.monotonic() - began) * 1000)
                if self.budgets:
                    self.budgets.add(user, spent, n)
                self._record("completion", p, sql, user, facts, None, row_count=n, duration_ms=spent)

    # Discovery.

    def _decision(self, key: TableKey, user: UserCtx, facts: Facts | None) -> Decision:
        shape = P.Shape(tables=[key])
        return self.engine.evaluate(user, facts, shape)

    def tables(self, user: UserCtx, facts: Facts | None = None, catalog: str | None = None) -> list[TableKey]:
        return [t for t in self.catalog.tables(self.session, catalog) if self._decision(t, user, facts).outcome in ("allow", "approval")]

    def catalogs(self, user: UserCtx, facts: Facts | None = None) -> list[str]:
        return list(dict.fromkeys(t.catalog for t in self.tables(user, facts)))

    def list_tables(self, user: UserCtx, facts: Facts | None = None, catalog: str | None = None, cursor: str = "", limit: int | None = None) -> tuple[list[str], str]:
        """A page of visible tables in name order, and the cursor of the next page (empty at the end)."""
        n = min(limit or self.settings.page, self.settings.max_page)
        names = [s for t in self.tables(user, facts, catalog) if (s := str(t)) > cursor]
        return names[:n], names[n - 1] if len(names) > n else ""

    def describe(self, name: str, user: UserCtx, facts: Facts | None = None) -> list[dict[str, Any]]:
        key = self.catalog.resolve(self.session, tuple(name.split(".")), self.settings.default_namespace)
        d = self._decision(key, user, facts) if key else None
        if d is None or d.outcome not in ("allow", "approval"):
            raise GovernError("ACL_DENIED", f"no such table for you: {name}")
        cols = self.catalog.columns(self.session, key)
        rules = resolve_masks(d.masks.get(key, []), [c.name for c in cols])
        return [{"name": c.name, "type": c.sql_type, "nullable": c.nullable, "position": c.position, "comment": c.comment, "mask": rules[c.name].type if c.name in rules else None, "filtered": key in d.filters} for c in cols]

    def describe_frame(self, user: UserCtx, facts: Facts | None = None) -> DataFrame:
        """Visible columns of all visible tables."""
        rows = [(str(t), c["position"], c["name"], c["type"], c["mask"], c["filtered"]) for t in self.tables(user, facts) for c in self.describe(str(t), user, facts)]
        return self.session.createDataFrame(rows, "table_name string, position int, column_name string, sql_type string, mask string, filtered boolean")

    def explain_access(self, sql: str, user: UserCtx, facts: Facts | None = None) -> dict[str, Any]:
        """The decision on a query without running it."""
        p = self.prepare(sql, user, facts)
        d = p.decision
        masks = [f"{t}.{c}={r.type}" for t, rules in d.masks.items() for c, r in resolve_masks(rules, [x.name for x in self.catalog.columns(self.session, t)]).items()]
        return {
            "outcome": d.outcome, "tables": [str(t) for t in p.parsed.shape.tables], "applied": d.applied, "shadow": d.shadow, "deny_policy": d.deny_policy, "code": d.code, "message": d.message,
            "rejections": [f"{r['policy']}/{r['rule']}" for r in d.rejections], "filters": [str(t) for t in d.filters], "masks": sorted(masks), "limit": d.limit, "timeout": d.timeout, "sample": d.sample,
            "approval": d.approval, "shape": p.parsed.shape.facts(),
        }

    def whoami(self, user: UserCtx) -> dict[str, Any]:
        return {"subject": user.subject, "issuer": user.issuer, "email": user.email, "groups": list(user.groups), "auth_method": user.auth_method}

    def rewritten(self, sql: str, user: UserCtx, facts: Facts | None = None) -> DataFrame:
        """The secured DataFrame without audit, rates or budgets: for tests of policies."""
        p = self.prepare(sql, user, facts)
        self._admit(p)
        return S.secure(self.session, p.parsed, p.keys, self.catalog.load, p.decision, user, facts, self.masks)[0]


def as_tools(g: Governed) -> dict[str, Callable[..., Any]]:
    """The calls a tool server offers, by name."""

    def await_approval(id_: str, timeout: float = 30) -> str:
        return g.approvals.wait_for(id_, timeout).state

    return {
        "execute_sql": lambda user, sql, **k: json.loads(g.execute(sql, user, **k).to_json()), "list_catalogs": g.catalogs, "list_tables": g.list_tables, "describe_table": lambda user, name: g.describe(name, user),
        "whoami": g.whoami, "explain_access": lambda user, sql: g.explain_access(sql, user), "list_accessible_tables": lambda user: [str(t) for t in g.tables(user)],
        "check_approval": lambda id_: g.approvals.get(id_).state, "await_approval": await_approval,
    }


__all__ = ["Governed", "Prepared", "Result", "Settings", "as_tools"]
