"""Relationship checks: every table and check must hold; the checker is a callable or a table of relation tuples."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.model import Decision, Facts, GovernError, Shape, TableKey, UserCtx
from palisade.operators.engine import Snapshot

Checker = Callable[[str, str, str], bool]  # (user, relation, object)


def tuple_checker(tuples: DataFrame) -> Checker:
    """A checker over a DataFrame (user, relation, object): one filtered lookup, pushed down to the source."""

    def check(user: str, relation: str, object_: str) -> bool:
        return bool(tuples.where((F.col("user") == user) & (F.col("relation") == relation) & (F.col("object") == object_)).select(F.lit(1)).take(1))

    return check


class RebacEngine:
    """Allow if all checks of all matching policies hold, deny if one does not, abstain if none applies."""

    def __init__(self, snapshot: Snapshot, checker: Checker, ttl: float = 10, size: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.snapshot, self.checker, self.ttl, self.size, self.clock = snapshot, checker, ttl, size, clock
        self.known: OrderedDict[tuple[str, str, str], tuple[float, bool]] = OrderedDict()

    def _check(self, key: tuple[str, str, str]) -> bool:
        now = self.clock()
        if (hit := self.known.get(key)) and now - hit[0] < self.ttl:
            self.known.move_to_end(key)
            return hit[1]
        try:
            got = bool(self.checker(*key))
        except Exception as e:
            raise GovernError("ERR_INTERNAL", f"the relationship check failed: {type(e).__name__}") from e
        self.known[key] = (now, got)
        self.known.move_to_end(key)
        while len(self.known) > self.size:
            self.known.popitem(last=False)
        return got

    def evaluate(self, user: UserCtx, facts: Facts | None, shape: Shape) -> Decision:
        d, checked = Decision(), False
        for c in self.snapshot.of("RelationshipPolicy"):
            found = [t for t in c.match.tables(user, facts, "SELECT", shape.tables) if not c.exclude.matches(user, facts, "SELECT", [t])]
            if not found:
                continue
            enforced = c.spec["enforcementMode"] == "Enforce"
            (d.applied if enforced else d.shadow).append(c.policy.id)
            if not enforced:
                continue
            for t in found:
                for rule in c.spec["checks"]:
                    checked = True
                    who = render(rule.get("subjectTemplate") or "user:{{subject.id}}", t, user)
                    if not self._check((who, rule["relation"], render(rule["objectTemplate"], t, user))):
                        d.deny_policy, d.code, d.message = c.policy.name, "ACL_DENIED", f"relationship {rule['relation']} is missing"
                        return d
        if checked:
            d.outcome = "allow"
        else:
            d.abstained, d.code = True, "ACL_DENIED"
        return d


def render(text: str, t: TableKey, user: UserCtx) -> str:
    values = {"catalog": t.catalog, "schema": t.schema, "table": t.table, "subject.id": user.subject, "subject.email": user.email}

    def one(m: re.Match[str]) -> str:
        if m[1] not in values:
            raise GovernError("ERR_POLICY_INVALID", f"unknown placeholder {m[1]}")
        return values[m[1]]

    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", one, text)
