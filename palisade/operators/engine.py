"""Policy evaluation: compiled snapshots, decisions, composition of engines."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from palisade.functions import cel, wildcard
from palisade.model import Decision, Facts, GovernError, MaskRule, Shape, TableKey, UserCtx, invalid
from palisade.operators.dsl import Kinds, Policy, _unique, decode, load_directory, seconds
from palisade.operators.selector import Resources, Selector


@dataclass
class Compiled:
    policy: Policy
    match: Selector
    exclude: Selector
    conditions: list[cel.Node]
    rules: list[tuple[dict, cel.Node | None]] = field(default_factory=list)

    @property
    def spec(self) -> dict[str, Any]:
        return self.policy.spec


@dataclass(frozen=True)
class Snapshot:
    """Policies by kind, priority descending, then name; immutable once compiled."""

    by_kind: dict[str, tuple[Compiled, ...]]
    digest: str
    version: int
    reads_headers: frozenset[str] = frozenset()

    @classmethod
    def compile(cls, policies: Iterable[Policy], digest: str | None = None, version: int = 1) -> Snapshot:
        policies = list(policies)
        _unique(policies)
        tags: dict[str, list[Resources]] = {}
        for p in policies:
            if p.kind == "DataClassification":
                for rule in p.spec["rules"]:
                    for t in rule["tags"]:
                        tags.setdefault(t, []).append(Resources.of(rule["resources"]))
        by: dict[str, list[Compiled]] = {}
        for p in sorted(policies, key=lambda p: (-p.priority, p.name)):
            try:
                rules = [(r, cel.parse(r["expression"]) if r.get("expression") else None) for r in (p.spec.get("reject") or {}).get("rules") or []]
                by.setdefault(p.kind, []).append(
                    Compiled(p, Selector.of(p.spec.get("match"), tags), Selector.of(p.spec.get("exclude"), tags), [cel.parse(c["expression"]) for c in p.spec.get("conditions") or []], rules)
                )
            except GovernError as e:
                raise invalid(f"{p.id}: {e.message}") from None
        if digest is None:
            digest = hashlib.sha256(json.dumps([[p.kind, p.name, p.priority, p.spec] for p in policies], sort_keys=True, default=str).encode()).hexdigest()
        return cls({k: tuple(v) for k, v in by.items()}, digest, version)

    @classmethod
    def from_yaml(cls, text: str, kinds: Kinds | None = None) -> Snapshot:
        return cls.compile(decode(text, kinds))

    @classmethod
    def from_directory(cls, path: str, kinds: Kinds | None = None) -> Snapshot:
        policies, digest = load_directory(path, kinds)
        return cls.compile(policies, digest)

    def of(self, kind: str) -> tuple[Compiled, ...]:
        return self.by_kind.get(kind, ())


class PolicyEngine(Protocol):
    def evaluate(self, user: UserCtx, facts: Facts | None, shape: Shape) -> Decision: ...


class Engine:
    """The engine over a snapshot.  Order of weight: deny, reject, approval, allow."""

    def __init__(self, snapshot: Snapshot, strict_access: bool = False):
        self.snapshot, self.strict_access = snapshot, strict_access

    def replace(self, snapshot: Snapshot) -> None:
        self.snapshot = snapshot

    def evaluate(self, user: UserCtx, facts: Facts | None, shape: Shape) -> Decision:
        d, snap = Decision(), self.snapshot
        action, tables = shape.kind if shape.kind in ("SELECT", "INSERT", "UPDATE", "DELETE") else "SELECT", shape.tables
        env = environment(user, facts, shape)

        def conditions(c: Compiled) -> bool:
            return all(cel.condition(n, env) for n in c.conditions)

        def whole(kind: str) -> list[Compiled]:
            out = []
            for c in snap.of(kind):
                if c.match.matches(user, facts, action, tables) and not c.exclude.matches(user, facts, action, tables) and conditions(c):
                    self._note(d, c)
                    if c.spec["enforcementMode"] == "Enforce":
                        out.append(c)
            return out

        def by_table(kind: str) -> list[tuple[Compiled, list[TableKey]]]:
            out = []
            for c in snap.of(kind):
                found = [t for t in c.match.tables(user, facts, action, tables) if not c.exclude.matches(user, facts, action, [t])]
                if found and conditions(c):
                    self._note(d, c)
                    if c.spec["enforcementMode"] == "Enforce":
                        out.append((c, found))
            return out

        try:
            access = whole("SqlAccessPolicy")
            denies = [c for c in access if c.spec["effect"] == "deny"]
            allows = [c for c in access if c.spec["effect"] == "allow"]
            if denies:
                first = denies[0]
                d.deny_policy, d.code, d.message = first.policy.name, first.spec.get("errorCode") or "ACL_DENIED", first.spec.get("message") or "access denied"
                return d
            uncovered = [t for t in tables if not any(c.match.matches(user, facts, action, [t]) for c in allows)] if self.strict_access else []
            if not allows or uncovered:
                d.abstained, d.code, d.message = not allows, "ACL_DENIED", "no policy allows this query"
                return d
            d.outcome = "allow"
            for c, found in by_table("RowFilterPolicy"):
                for t in found:
                    d.filters.setdefault(t, []).append((c.spec["filter"]["predicate"], c.spec["combine"]))
            for c, found in sorted(by_table("ColumnMaskPolicy"), key=lambda x: (-x[0].policy.priority, -x[0].match.specificity, x[0].policy.name)):
                m = c.spec["mask"]
                for t in found:
                    rules = d.masks.setdefault(t, [])
                    rules += [MaskRule(c.policy.name, c.policy.priority, p, m["type"] or "null", m.get("args") or {}) for p in c.match.columns(user, facts, action, t) if all(r.pattern != p for r in rules)]
            for c in whole("QueryRewritePolicy"):
                r = c.spec["rewrite"]
                if r.get("limit"):
                    d.limit = min(r["limit"]["max"], d.limit or r["limit"]["max"])
                if r.get("timeout") is not None:
                    d.timeout = min(seconds(r["timeout"]), d.timeout or seconds(r["timeout"]))
                if r.get("sample") and d.sample is None:
                    d.sample = (float(r["sample"]["rate"]), r["sample"]["method"])
            for c in whole("QueryRejectPolicy"):
                for rule, node in c.rules:
                    if node is None or cel.condition(node, env):
                        d.rejections.append({"policy": c.policy.name, "rule": rule["name"], "message": rule.get("message") or "query rejected", "code": rule.get("code") or "ACL_REJECTED"})
            if d.rejections:
                d.outcome, d.code, d.message = "reject", d.rejections[0]["code"], d.rejections[0]["message"]
                return d
            for c in whole("ApprovalPolicy"):
                if triggered(c.spec.get("when"), shape) and d.approval is None:
                    d.outcome, d.code = "approval", "ERR_APPROVAL_PENDING"
                    d.approval = {"policy": c.policy.name, "reason": c.spec.get("reason") or ""}
        except cel.CelError as e:
            return Decision(deny_policy="", code="ACL_DENIED", message=f"a condition failed: {e.message}", applied=d.applied, shadow=d.shadow)
        return d

    @staticmethod
    def _note(d: Decision, c: Compiled) -> None:
        (d.applied if c.spec["enforcementMode"] == "Enforce" else d.shadow).append(c.policy.id)


def environment(user: UserCtx, facts: Facts | None, shape: Shape) -> dict[str, Any]:
    subject = {"id": user.subject, "issuer": user.issuer, "email": user.email, "groups": list(user.groups), "auth_method": user.auth_method, "claims": user.claims}
    request = {"remote_ip": (facts and facts.remote_ip) or user.remote_addr, "user_agent": (facts and facts.user_agent) or "", "headers": dict(facts.headers) if facts else {}}
    return {"subject": subject, "request": request, "query": shape.facts()}


def triggered(when: dict | None, shape: Shape | None) -> bool:
    """Whether an approval is due; always if nothing narrows it or the query could not be read."""
    columns, preds = (when or {}).get("columnsAccessed") or [], (when or {}).get("predicates") or []
    if not columns and not preds or shape is None:
        return True
    bare = lambda name: name.rpartition(".")[2]
    if any(wildcard.matches(p, c) or wildcard.matches(p, bare(c)) for p in columns for c in shape.columns):
        return True
    return any(
        (wildcard.matches(t["column"], f.column) or wildcard.matches(t["column"], bare(f.column))) and t.get("op", "*") in ("", "*", f.op) and str(t.get("value", "")) in ("", f.value)
        for t in preds
        for f in shape.comparisons
    )


def resolve_masks(rules: Sequence[MaskRule], columns: Iterable[str]) -> dict[str, MaskRule]:
    """The rule of each column: priority, then the pattern's specificity, then the policy's name."""
    out = {}
    for c in columns:
        found = [r for r in rules if wildcard.matches(r.pattern, c)]
        if found:
            out[c] = min(found, key=lambda r: (-r.priority, -wildcard.specificity(r.pattern), r.policy))
    return out


class Composite:
    """Several engines as one: any error is an error, an explicit deny wins, rejections add up, one allow is enough,
    filters are joined by AND, the first member's mask of a column holds, limits and timeouts take the least."""

    def __init__(self, *members: PolicyEngine):
        if not members:
            raise ValueError("no engines")
        self.members = members

    def evaluate(self, user: UserCtx, facts: Facts | None, shape: Shape) -> Decision:
        found = [m.evaluate(user, facts, shape) for m in self.members]
        out = Decision(applied=[a for d in found for a in d.applied], shadow=[s for d in found for s in d.shadow])
        if denied := next((d for d in found if d.outcome == "deny" and not d.abstained), None):
            out.deny_policy, out.code, out.message = denied.deny_policy, denied.code, denied.message
            return out
        out.rejections = [r for d in found for r in d.rejections]
        if out.rejections:
            out.outcome, out.code, out.message = "reject", out.rejections[0]["code"], out.rejections[0]["message"]
            return out
        voted = [d for d in found if d.outcome in ("allow", "approval")]
        if not voted:
            out.abstained, out.code, out.message = True, "ACL_DENIED", "no policy allows this query"
            return out
        out.outcome = "allow"
        for d in voted:
            for t, fs in d.filters.items():
                whole = and_of(fs)
                out.filters.setdefault(t, []).append((whole, "restrictive"))
            for t, rules in d.masks.items():
                have = out.masks.setdefault(t, [])
                have += [r for r in rules if all(r.pattern != h.pattern for h in have)]
            out.limit = min((x for x in (out.limit, d.limit) if x is not None), default=None)
            out.timeout = min((x for x in (out.timeout, d.timeout) if x is not None), default=None)
            out.sample = out.sample or d.sample
            if d.outcome == "approval" and out.approval is None:
                out.outcome, out.code, out.approval = "approval", d.code, d.approval
        return out


def and_of(filters: list[tuple[Any, str]]) -> dict[str, Any]:
    """One member's filters of a table as a single predicate."""
    out = filters[0][0]
    for p, combine in filters[1:]:
        out = {"any" if combine == "permissive" else "all": [out, p]}
    return out


class CallableEngine:
    """An external decision: ``decide(input) -> output``, both plain documents; any unknown output field is an error."""

    OUT = {"allow", "deny", "message", "code", "filters", "masks", "limit"}

    def __init__(self, decide: Callable[[dict[str, Any]], dict[str, Any]], name: str = "external"):
        self.decide, self.name = decide, name

    def evaluate(self, user: UserCtx, facts: Facts | None, shape: Shape) -> Decision:
        env = environment(user, facts, shape)
        got = self.decide({"subject": env["subject"], "request": env["request"], "query": env["query"], "action": shape.kind})
        if not isinstance(got, dict) or set(got) - self.OUT:
            raise GovernError("ERR_INTERNAL", "an external engine broke its contract")
        if got.get("deny"):
            return Decision(deny_policy=self.name, code=got.get("code") or "ACL_DENIED", message=got.get("message") or "access denied", applied=[self.name])
        if got.get("allow") is not True:
            return Decision(abstained=True, code="ACL_DENIED", message="no policy allows this query")
        d = Decision("allow", applied=[self.name], limit=got.get("limit"))
        from palisade.functions import predicates

        for f in got.get("filters") or []:
            predicates.check(f["predicate"])
            d.filters.setdefault(TableKey.parse(f["table"]), []).append((f["predicate"], f.get("combine") or "restrictive"))
        for m in got.get("masks") or []:
            d.masks.setdefault(TableKey.parse(m["table"]), []).append(MaskRule(self.name, int(m.get("priority") or 0), m["column"], m["type"], m.get("args") or {}))
        return d
