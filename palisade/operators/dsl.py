"""Policy manifests: multi-document YAML with a body check for each kind."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from palisade.functions import cel, predicates, wildcard
from palisade.functions.masks import MaskRegistry, default_registry
from palisade.model import GovernError, invalid

SELECTING = {"SqlAccessPolicy", "RowFilterPolicy", "ColumnMaskPolicy", "QueryRejectPolicy", "QueryRewritePolicy", "ApprovalPolicy", "RelationshipPolicy"}
FIELDS = {
    "SqlAccessPolicy": {"effect", "message", "errorCode"},
    "RowFilterPolicy": {"filter", "combine"},
    "ColumnMaskPolicy": {"mask"},
    "QueryRejectPolicy": {"reject"},
    "QueryRewritePolicy": {"rewrite"},
    "ApprovalPolicy": {"when", "reason"},
    "RelationshipPolicy": {"backend", "checks"},
    "DataClassification": {"rules"},
    "DataSource": {"type", "connection", "credentialsRef", "path", "bucket", "prefix", "region", "allowedPaths", "endpoint", "database", "tokenRef", "readonly", "schemas", "tables", "attachMode", "healthCheck"},
    "SubjectBinding": {"issuer", "audience", "jwksUrl", "hmacSecretRef", "claims", "rateLimit", "budget", "apiKeys"},
    "AuditSink": {"type", "path", "bucket", "prefix", "region", "endpoint", "dsn", "address", "network", "rotation", "options"},
}
SELECTOR = {"match", "exclude", "conditions", "enforcementMode"}
SOURCES = ("postgres", "mysql", "sqlite", "s3_parquet", "duckdb_file", "motherduck")


@dataclass
class Policy:
    kind: str
    name: str
    priority: int = 0
    namespace: str = ""
    labels: dict[str, str] = field(default_factory=dict)
    annotations: dict[str, str] = field(default_factory=dict)
    spec: dict[str, Any] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return f"{self.kind}/{self.name}"


def seconds(text: Any) -> float:
    """A duration such as 30s, 1m30s, 250ms; plain numbers are seconds."""
    if isinstance(text, (int, float)) and not isinstance(text, bool):
        return float(text)
    unit = {"ms": 0.001, "s": 1, "m": 60, "h": 3600}
    if not isinstance(text, str) or not re.fullmatch(r"(?:\d+(?:\.\d+)?(?:ms|s|m|h))+", text):
        raise invalid(f"not a duration: {text!r}")
    return sum(float(n) * unit[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h)", text))


class Kinds:
    """Known kinds and their checks; ``register`` adds one of your own."""

    def __init__(self, masks: MaskRegistry | None = None):
        self.masks = masks or default_registry()
        self.checks: dict[str, Callable[[dict], None]] = {
            "SqlAccessPolicy": self.access, "RowFilterPolicy": self.row_filter, "ColumnMaskPolicy": self.mask, "QueryRejectPolicy": self.reject,
            "QueryRewritePolicy": self.rewrite, "ApprovalPolicy": self.approval, "RelationshipPolicy": self.relationship,
            "DataClassification": self.classification, "DataSource": self.source, "SubjectBinding": lambda s: None, "AuditSink": self.sink,
        }

    def register(self, kind: str, fields: set[str], check: Callable[[dict], None]) -> None:
        FIELDS[kind], self.checks[kind] = fields, check

    def access(self, s: dict) -> None:
        if s.get("effect") not in ("allow", "deny"):
            raise invalid("effect is allow or deny")

    def row_filter(self, s: dict) -> None:
        f = s.get("filter")
        if not isinstance(f, dict) or (f.get("predicate") is None) == (not f.get("expression")):
            raise invalid("a filter has a predicate or an expression")
        if f.get("expression"):
            s["filter"] = {"expression": f["expression"], "predicate": cel.lower(cel.parse(f["expression"]))}
        predicates.check(s["filter"]["predicate"])
        if s.setdefault("combine", "restrictive") not in ("restrictive", "permissive"):
            raise invalid("combine is restrictive or permissive")

    def mask(self, s: dict) -> None:
        m = s.get("mask")
        if not isinstance(m, dict) or m.get("type") is None and "type" not in m:
            raise invalid("a mask has a type")
        if m.get("expression"):
            raise invalid("mask expressions are not supported")
        self.masks.check("null" if m["type"] is None else m["type"], m.get("args") or {})  # YAML's bare null is the null mask

    def reject(self, s: dict) -> None:
        rules = (s.get("reject") or {}).get("rules")
        if not isinstance(rules, list) or not rules:
            raise invalid("reject needs rules")
        for r in rules:
            if not r.get("name"):
                raise invalid("a rule needs a name")
            if r.get("expression"):
                cel.parse(r["expression"])

    def rewrite(self, s: dict) -> None:
        r = s.get("rewrite")
        if not isinstance(r, dict) or not r:
            raise invalid("rewrite is empty")
        if r.get("hint"):
            raise invalid("hints are not supported")
        if (lim := r.get("limit")) is not None and not (isinstance(lim.get("max"), int) and 1 <= lim["max"] <= 2**31 - 1):
            raise invalid("limit.max is between 1 and 2147483647")
        if (sm := r.get("sample")) is not None:
            if not isinstance(sm.get("rate"), (int, float)) or not 0 < sm["rate"] <= 1:
                raise invalid("sample.rate is above 0 and at most 1")
            if sm.setdefault("method", "reservoir") not in ("reservoir", "bernoulli", "system"):
                raise invalid("sample.method is reservoir, bernoulli or system")
        if r.get("timeout") is not None and seconds(r["timeout"]) <= 0:
            raise invalid("timeout is positive")

    def approval(self, s: dict) -> None:
        w = s.get("when") or {}
        for p in w.get("columnsAccessed") or []:
            wildcard.compiled(p)
        for t in w.get("predicates") or []:
            if not t.get("column"):
                raise invalid("a trigger needs a column")
            wildcard.compiled(t["column"])
            if t.get("op", "*") not in ("", "*", "=", "!=", "<", "<=", ">", ">=", "like", "ilike", "in", "isnull"):
                raise invalid(f"unknown trigger operator {t['op']}")

    def relationship(self, s: dict) -> None:
        if not s.get("checks") or any(not c.get("objectTemplate") or not c.get("relation") for c in s["checks"]):
            raise invalid("a relationship policy needs checks with objectTemplate and relation")

    def classification(self, s: dict) -> None:
        if not s.get("rules"):
            raise invalid("a classification needs rules")
        for r in s["rules"]:
            res = r.get("resources") or {}
            if not res or res.get("tags") or res.get("actions") or not r.get("tags"):
                raise invalid("a classification rule has resources (without tags and actions) and tags")

    def source(self, s: dict) -> None:
        if s.get("type") not in SOURCES:
            raise invalid(f"unknown data source type {s.get('type')}")
        if s.get("readonly") is False or s.get("attachMode", "readonly") != "readonly":
            raise invalid("data sources are read-only")
        for need, types in (("connection", ("postgres", "mysql")), ("path", ("sqlite", "duckdb_file")), ("allowedPaths", ("s3_parquet",))):
            if s["type"] in types and not s.get(need):
                raise invalid(f"{s['type']} needs {need}")

    def sink(self, s: dict) -> None:
        if s.get("type") != "file":
            raise invalid("audit sinks from manifests are files")


def _selector(s: Any, what: str) -> None:
    if not isinstance(s, dict) or set(s) - {"any", "all"}:
        raise invalid(f"{what} has any and all")
    for clause in [*(s.get("any") or []), *(s.get("all") or [])]:
        if not isinstance(clause, dict) or set(clause) - {"subjects", "resources"}:
            raise invalid(f"a clause of {what} has subjects and resources")


def decode(text: str, kinds: Kinds | None = None, strict: bool = True) -> list[Policy]:
    kinds = kinds or Kinds()
    try:
        documents = [d for d in yaml.safe_load_all(text) if d is not None]
    except yaml.YAMLError as e:
        raise invalid(f"bad YAML: {e}") from None
    out = []
    for d in documents:
        kind, meta = (d.get("kind"), d.get("metadata") or {}) if isinstance(d, dict) else (None, {})
        if kind not in kinds.checks:
            raise invalid(f"unknown kind {kind}")
        if not str(d.get("apiVersion", "")).rpartition("/")[2].startswith("v1"):
            raise invalid(f"unknown apiVersion {d.get('apiVersion')}")
        if not meta.get("name"):
            raise invalid(f"a {kind} needs metadata.name")
        spec = dict(d.get("spec") or {})
        try:
            allowed = FIELDS[kind] | (SELECTOR if kind in SELECTING else set())
            if strict and (more := set(spec) - allowed):
                raise invalid(f"unknown fields {sorted(more)}")
            if kind in SELECTING:
                _selector(spec.setdefault("match", {}), "match")
                if spec.get("exclude") is not None:
                    _selector(spec["exclude"], "exclude")
                if spec.setdefault("enforcementMode", "Enforce") not in ("Enforce", "Audit", "DryRun"):
                    raise invalid("enforcementMode is Enforce, Audit or DryRun")
                for c in spec.get("conditions") or []:
                    cel.parse(c.get("expression"))
            kinds.checks[kind](spec)
        except GovernError as e:
            raise invalid(f"{kind}/{meta['name']}: {e.message}") from None
        out.append(Policy(kind, meta["name"], int(meta.get("priority") or 0), meta.get("namespace") or "", meta.get("labels") or {}, meta.get("annotations") or {}, spec))
    return out


def load_directory(path: str | Path, kinds: Kinds | None = None, strict: bool = True) -> tuple[list[Policy], str]:
    """All policies of a folder's YAML files, in name order, and the digest of their text."""
    digest, out = hashlib.sha256(), []
    for p in sorted(x for x in Path(path).rglob("*") if x.suffix in (".yaml", ".yml")):
        text = p.read_text()
        digest.update(f"{p.name}\0{text}\0".encode())
        out += decode(text, kinds, strict)
    _unique(out)
    return out, digest.hexdigest()


def _unique(policies: Iterable[Policy]) -> None:
    seen: set[tuple[str, str, str]] = set()
    for p in policies:
        if (k := (p.kind, p.namespace, p.name)) in seen:
            raise invalid(f"{p.id} is defined twice")
        seen.add(k)
