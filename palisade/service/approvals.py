"""Approvals: a query waits for a grant, which is good for one run of the same text by the same subject."""

from __future__ import annotations

import hashlib
import sqlite3
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from palisade.model import GovernError, UserCtx


@dataclass(frozen=True)
class Request:
    id: str
    subject: str
    issuer: str
    sql_sha256: str
    policy: str
    reason: str
    state: str  # pending, approved, rejected, used, expired
    created: float
    decided_by: str = ""


class Approvals:
    def __init__(self, path: str = ":memory:", wait: float = 3600, grant: float = 900, clock: Callable[[], float] = time.time, notify: Callable[[Request], None] | None = None):
        self.db = sqlite3.connect(path, check_same_thread=False)
        self.wait, self.grant, self.clock, self.notify, self.lock = wait, grant, clock, notify, threading.RLock()
        with self.db:
            self.db.execute("CREATE TABLE IF NOT EXISTS approval (id TEXT PRIMARY KEY, subject TEXT, issuer TEXT, sql_sha256 TEXT, policy TEXT, reason TEXT, state TEXT, created REAL, decided_by TEXT, decided REAL)")

    @staticmethod
    def digest(sql: str) -> str:
        return hashlib.sha256(sql.encode()).hexdigest()

    def get(self, id_: str) -> Request:
        with self.lock:
            row = self.db.execute("SELECT id, subject, issuer, sql_sha256, policy, reason, state, created, decided_by, decided FROM approval WHERE id = ?", (id_,)).fetchone()
            if row is None:
                raise GovernError("ERR_APPROVAL_EXPIRED", "no such approval")
            r, decided = Request(*row[:8], row[8] or ""), row[9]
            late = (r.state == "pending" and self.clock() - r.created > self.wait) or (r.state == "approved" and self.clock() - decided > self.grant)
            return self._set(r, "expired") if late else r

    def _set(self, r: Request, state: str, by: str = "") -> Request:
        with self.db:
            self.db.execute("UPDATE approval SET state = ?, decided_by = ?, decided = ? WHERE id = ?", (state, by or r.decided_by, self.clock(), r.id))
        return Request(r.id, r.subject, r.issuer, r.sql_sha256, r.policy, r.reason, state, r.created, by or r.decided_by)

    def ask(self, user: UserCtx, sql: str, policy: str, reason: str) -> Request:
        """The subject's open request for the text, or a new one."""
        with self.lock:
            for (id_,) in self.db.execute("SELECT id FROM approval WHERE subject = ? AND issuer = ? AND sql_sha256 = ? AND state = 'pending'", (user.subject, user.issuer, self.digest(sql))).fetchall():
                if (r := self.get(id_)).state == "pending":
                    return r
            r = Request(uuid.uuid4().hex, user.subject, user.issuer, self.digest(sql), policy, reason, "pending", self.clock())
            with self.db:
                self.db.execute("INSERT INTO approval VALUES (?, ?, ?, ?, ?, ?, ?, ?, '', NULL)", (r.id, r.subject, r.issuer, r.sql_sha256, policy, reason, r.state, r.created))
        if self.notify:
            self.notify(r)
        return r

    def decide(self, id_: str, approve: bool, by: str) -> Request:
        with self.lock:
            r = self.get(id_)
            if r.state != "pending":
                raise GovernError("ERR_APPROVAL_EXPIRED" if r.state == "expired" else "ERR_APPROVAL_REJECTED", f"the approval is {r.state}")
            if by == r.subject:
                raise GovernError("ACL_DENIED", "nobody approves their own request")
            return self._set(r, "approved" if approve else "rejected", by)

    def redeem(self, id_: str, user: UserCtx, sql: str) -> None:
        """Uses a grant up; raises unless it is there for this subject and text."""
        with self.lock:
            r = self.get(id_)
            if (r.subject, r.issuer, r.sql_sha256) != (user.subject, user.issuer, self.digest(sql)):
                raise GovernError("ACL_DENIED", "the approval is for another subject or query")
            codes = {"pending": "ERR_APPROVAL_PENDING", "rejected": "ERR_APPROVAL_REJECTED", "expired": "ERR_APPROVAL_EXPIRED", "used": "ERR_APPROVAL_EXPIRED"}
            if r.state != "approved":
                raise GovernError(codes[r.state], f"the approval is {r.state}", approval_id=id_)
            self._set(r, "used")

    def wait_for(self, id_: str, timeout: float = 30, poll: float = 0.1) -> Request:
        end = time.monotonic() + timeout
        while (r := self.get(id_)).state == "pending" and time.monotonic() < end:
            time.sleep(poll)
        return r
