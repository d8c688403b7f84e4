"""Selectors: who asks for what.  Compiled once for each snapshot."""

from __future__ import annotations

import ipaddress
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from palisade.functions import cel, template, wildcard
from palisade.model import Facts, TableKey, UserCtx, invalid

ACTIONS = ("SELECT", "INSERT", "UPDATE", "DELETE")


@dataclass(frozen=True)
class Resources:
    catalogs: tuple[str, ...] = ()
    schemas: tuple[str, ...] = ()
    tables: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    @classmethod
    def of(cls, d: dict) -> Resources:
        out = cls(*(tuple(d.get(k) or ()) for k in ("catalogs", "schemas", "tables", "columns")))
        for p in (*out.catalogs, *out.schemas, *out.tables, *out.columns):
            wildcard.compiled(p)
        return out

    def holds(self, t: TableKey) -> bool:
        """Each list matches one segment of the key; an empty list matches all."""
        return all(not ps or any(wildcard.matches(p, s) for p in ps) for ps, s in ((self.catalogs, t.catalog), (self.schemas, t.schema), (self.tables, t.table)))


@dataclass(frozen=True)
class Clause:
    subjects: dict[str, Any] | None
    resources: Resources
    tags: tuple[Resources, ...] | None
    n_tags: int
    actions: tuple[str, ...]
    claims: tuple = ()
    networks: tuple = ()

    def subject_matches(self, user: UserCtx, facts: Facts | None) -> bool:
        s = self.subjects
        if s is None:
            return True
        if s.get("groups") and not set(s["groups"]) & set(user.groups):
            return False
        if s.get("apiKeys") and not (user.auth_method in ("api_key", "apikey") and (user.api_key or user.subject) in s["apiKeys"]):
            return False
        if s.get("roles"):
            roles = user.claims.get("roles", user.groups)
            if not set(s["roles"]) & {r for r in ([roles] if isinstance(roles, str) else roles) if isinstance(r, str)}:
                return False
        if self.networks:
            try:
                ip = ipaddress.ip_address((facts and facts.remote_ip) or user.remote_addr)
            except ValueError:
                return False
            if not any(ip in n for n in self.networks):
                return False
        return all(_claim(c, user.claims) for c in self.claims)

    def table_matches(self, t: TableKey) -> bool:
        return self.resources.holds(t) and (self.tags is None or any(r.holds(t) for r in self.tags))

    def constrained(self) -> bool:
        r = self.resources
        return bool(r.catalogs or r.schemas or r.tables or self.tags is not None)

    def matches(self, user: UserCtx, facts: Facts | None, action: str, tables: Iterable[TableKey]) -> bool:
        if self.actions and action not in self.actions:
            return False
        return self.subject_matches(user, facts) and (not self.constrained() or any(self.table_matches(t) for t in tables))

    def column_patterns(self, t: TableKey) -> tuple[str, ...]:
        """Patterns of the columns meant in ``t``; those of a tag come from its rules."""
        own = self.resources.columns
        tagged = tuple(p for r in self.tags or () if r.holds(t) for p in r.columns)
        return own + tagged

    @property
    def specificity(self) -> int:
        r = self.resources
        return sum(wildcard.is_literal(p) for p in (*r.catalogs, *r.schemas, *r.tables, *r.columns)) + self.n_tags


def _claim(c: tuple, claims: dict[str, Any]) -> bool:
    path, op, value, values, pattern = c
    got, found = template.walk(claims, path)
    if op == "Exists":
        return found
    if op == "Equals":
        return found and cel.same(got, value)
    if op == "NotEquals":
        return not (found and cel.same(got, value))
    hit = found and any(cel.same(got, v) for v in values)
    if op in ("In", "NotIn"):
        return hit is (op == "In")
    return found and isinstance(got, str) and pattern.search(got) is not None


def compile_clause(d: dict, tags: dict[str, list[Resources]]) -> Clause:
    res, sub = d.get("resources") or {}, d.get("subjects")
    for tag in res.get("tags") or []:
        if tag not in tags:
            raise invalid(f"unknown tag {tag}")
    if unknown := [a for a in res.get("actions") or [] if a not in ACTIONS]:
        raise invalid(f"unknown actions {unknown}")
    claims = []
    for c in (sub or {}).get("jwtClaims") or []:
        op = c.get("op")
        if not c.get("claim") or op not in ("Equals", "NotEquals", "In", "NotIn", "Exists", "Matches"):
            raise invalid("a claim check has a claim and a known op")
        claims.append((c["claim"].split("."), op, c.get("value"), c.get("values") or [], cel.safe_regex(c.get("pattern")) if op == "Matches" else None))
    try:
        networks = tuple(ipaddress.ip_network(x, strict=False) for x in (sub or {}).get("ipRanges") or [])
    except ValueError as e:
        raise invalid(str(e)) from None
    found = tuple(r for t in res.get("tags") or [] for r in tags[t]) if res.get("tags") else None
    return Clause(sub, Resources.of(res), found, len(res.get("tags") or []), tuple(res.get("actions") or ()), tuple(claims), networks)


@dataclass
class Selector:
    any: list[Clause] = field(default_factory=list)
    all: list[Clause] = field(default_factory=list)

    @classmethod
    def of(cls, d: dict | None, tags: dict[str, list[Resources]]) -> Selector:
        d = d or {}
        return cls([compile_clause(c, tags) for c in d.get("any") or []], [compile_clause(c, tags) for c in d.get("all") or []])

    @property
    def empty(self) -> bool:
        return not (self.any or self.all)

    def matches(self, user: UserCtx, facts: Facts | None, action: str, tables: Iterable[TableKey]) -> bool:
        """Some clause of any, or every clause of all; an empty selector matches nothing."""
        tables = list(tables)
        if any(c.matches(user, facts, action, tables) for c in self.any):
            return True
        return bool(self.all) and all(c.matches(user, facts, action, tables) for c in self.all)

    def tables(self, user: UserCtx, facts: Facts | None, action: str, tables: Iterable[TableKey]) -> list[TableKey]:
        return [t for t in tables if self.matches(user, facts, action, [t])]

    def columns(self, user: UserCtx, facts: Facts | None, action: str, t: TableKey) -> list[str]:
        found = [c for c in (*self.any, *self.all) if c.matches(user, facts, action, [t])]
        return list(dict.fromkeys(p for c in found for p in c.column_patterns(t)))

    @property
    def specificity(self) -> int:
        return max((c.specificity for c in (*self.any, *self.all)), default=0)
