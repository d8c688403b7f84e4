"""Rates, concurrency, budgets and the cache of decisions; clocks are arguments."""

from __future__ import annotations

import datetime as dt
import sqlite3
import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from typing import Any

from palisade.model import GovernError, UserCtx

Clock = Callable[[], float]


class Bucket:
    def __init__(self, rps: float, burst: int | None = None, clock: Clock = time.monotonic):
        self.rps, self.burst, self.clock = rps, burst if burst else max(1, int(rps)), clock
        self.tokens, self.at, self.lock = float(self.burst), clock(), threading.Lock()

    def take(self) -> bool:
        with self.lock:
            now = self.clock()
            self.tokens, self.at = min(self.burst, self.tokens + (now - self.at) * self.rps), now
            if self.tokens < 1:
                return False
            self.tokens -= 1
            return True


class RateLimiter:
    """One bucket for each subject (or issuer, or address), with the closest rate: subject, issuer, default."""

    def __init__(self, default: tuple[float, int | None] | None = None, subjects: dict | None = None, issuers: dict | None = None, clock: Clock = time.monotonic, size: int = 100_000):
        self.default, self.subjects, self.issuers, self.clock, self.size = default, subjects or {}, issuers or {}, clock, size
        self.buckets: OrderedDict[str, Bucket] = OrderedDict()
        self.lock = threading.Lock()

    def check(self, user: UserCtx) -> None:
        rate = self.subjects.get(user.subject) or self.issuers.get(user.issuer) or self.default
        if rate is None:
            return
        with self.lock:
            key = f"{user.issuer}\0{user.subject}"
            if key not in self.buckets:
                self.buckets[key] = Bucket(*rate, clock=self.clock)
                while len(self.buckets) > self.size:
                    self.buckets.popitem(last=False)
            self.buckets.move_to_end(key)
            b = self.buckets[key]
        if not b.take():
            raise GovernError("ERR_RATE_LIMITED", "too many requests")


class Gate:
    """At most ``n`` queries at once; a short grace, then ERR_RATE_LIMITED."""

    def __init__(self, n: int = 100, grace: float = 0.05):
        self.slots, self.grace = threading.BoundedSemaphore(n), grace

    @contextmanager
    def slot(self):
        if not self.slots.acquire(timeout=self.grace):
            raise GovernError("ERR_RATE_LIMITED", "too many queries at once")
        try:
            yield
        finally:
            self.slots.release()


@dataclass
class BudgetLimit:
    cpu_seconds: float | None = None
    rows: int | None = None


class Budgets:
    """Daily use of each subject (UTC), kept in SQLite for 35 days."""

    KEEP = 35

    def __init__(self, path: str = ":memory:", default: BudgetLimit | None = None, subjects: dict[str, BudgetLimit] | None = None, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.lock, self.now, self.default, self.subjects = threading.Lock(), now, default, subjects or {}
        with self.db:
            self.db.execute("CREATE TABLE IF NOT EXISTS budget (day TEXT, subject TEXT, issuer TEXT, cpu_ms INTEGER, rows_served INTEGER, PRIMARY KEY (day, subject, issuer))")

    def used(self, user: UserCtx) -> tuple[int, int]:
        with self.lock:
            got = self.db.execute("SELECT cpu_ms, rows_served FROM budget WHERE day = ? AND subject = ? AND issuer = ?", (self.now().date().isoformat(), user.subject, user.issuer)).fetchone()
        return got or (0, 0)

    def check(self, user: UserCtx) -> None:
        limit = self.subjects.get(user.subject) or self.default
        if limit is None:
            return
        cpu_ms, rows = self.used(user)
        if (limit.cpu_seconds is not None and cpu_ms >= limit.cpu_seconds * 1000) or (limit.rows is not None and rows >= limit.rows):
            raise GovernError("ERR_BUDGET_EXCEEDED", "the daily budget is used up")

    def add(self, user: UserCtx, cpu_ms: int, rows: int) -> None:
        day = self.now().date()
        with self.lock, self.db:
            self.db.execute(
                "INSERT INTO budget VALUES (?, ?, ?, ?, ?) ON CONFLICT (day, subject, issuer) DO UPDATE SET cpu_ms = cpu_ms + excluded.cpu_ms, rows_served = rows_served + excluded.rows_served",
                (day.isoformat(), user.subject, user.issuer, cpu_ms, rows),
            )
            self.db.execute("DELETE FROM budget WHERE day < ?", ((day - dt.timedelta(days=self.KEEP)).isoformat(),))


class DecisionCache:
    """Decisions by snapshot, text and identity; least recently used go first."""

    def __init__(self, size: int = 4096, ttl: float = 60, clock: Clock = time.monotonic):
        self.size, self.ttl, self.clock, self.known, self.lock = size, ttl, clock, OrderedDict(), threading.Lock()

    def get(self, key: tuple) -> Any:
        with self.lock:
            hit = self.known.get(key)
            if hit is None or self.clock() - hit[0] >= self.ttl:
                self.known.pop(key, None)
                return None
            self.known.move_to_end(key)
            return hit[1]

    def put(self, key: tuple, value: Any) -> None:
        with self.lock:
            self.known[key] = (self.clock(), value)
            self.known.move_to_end(key)
            while len(self.known) > self.size:
                self.known.popitem(last=False)
