"""The audit log: JSON lines in a hash chain, checked in plain Python or by Spark."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import threading
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.model import GovernError

EVENTS = ("access", "completion", "denied", "approval", "config")


def canonical(record: dict[str, Any]) -> str:
    """Without ``hash`` and empty fields, keys in order."""
    return json.dumps({k: v for k, v in record.items() if k != "hash" and v not in (None, "", [], {})}, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def genesis(seed: str | bytes) -> str:
    return hashlib.sha256(seed.encode() if isinstance(seed, str) else seed).hexdigest()


def chained(prior: str, record: dict[str, Any]) -> str:
    return hashlib.sha256(f"{prior}\n{canonical(record)}".encode()).hexdigest()


class AuditLog:
    """Appends records to files of a folder; every record is on disk before ``write`` returns, or ERR_AUDIT_UNAVAILABLE."""

    def __init__(self, folder: str | Path, seed: str = "palisade", max_bytes: int = 64 << 20, now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.UTC)):
        self.folder, self.seed, self.max_bytes, self.now, self.lock = Path(folder), seed, max_bytes, now, threading.Lock()
        self.folder.mkdir(parents=True, exist_ok=True)
        self.prior = genesis(seed)
        files = self.files()
        if files and (lines := files[-1].read_text().splitlines()):
            self.prior = json.loads(lines[-1])["hash"]

    def files(self) -> list[Path]:
        return sorted(self.folder.glob("audit-*.jsonl"))

    def _target(self) -> Path:
        """A file a day, and a new one when it is full."""
        day, n = self.now().strftime("%Y%m%d"), 0
        while True:
            p = self.folder / f"audit-{day}-{n:06d}.jsonl"
            if not p.exists() or p.stat().st_size < self.max_bytes:
                return p
            n += 1

    def write(self, event_type: str, **fields: Any) -> dict[str, Any]:
        with self.lock:
            record = {"timestamp": self.now().isoformat(), "event_type": event_type} | fields | {"prior_hash": self.prior}
            record = json.loads(json.dumps(record, default=str))
            record["hash"] = chained(self.prior, record)
            try:
                with self._target().open("a", encoding="utf-8") as f:
                    f.write(json.dumps(record, ensure_ascii=False) + "\n")
                    f.flush()
                    os.fsync(f.fileno())
            except OSError as e:
                raise GovernError("ERR_AUDIT_UNAVAILABLE", "the audit log cannot be written") from e
            self.prior = record["hash"]
            return record

    def tail(self, n: int = 20) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        for p in reversed(self.files()):
            out = [json.loads(x) for x in p.read_text().splitlines()] + out
            if len(out) >= n:
                break
        return out[-n:]


def verify(folder: str | Path, seed: str = "palisade") -> dict[str, Any]:
    """Walks the chain; the first break is reported with file, line and reason."""
    prior, n = genesis(seed), 0
    for p in sorted(Path(folder).glob("audit-*.jsonl")):
        for k, line in enumerate(p.read_text().splitlines(), 1):
            at = {"ok": False, "records": n, "file": p.name, "line": k}
            try:
                r = json.loads(line)
            except ValueError:
                return at | {"reason": "not JSON"}
            if r.get("prior_hash") != prior:
                return at | {"reason": "prior_hash does not match"}
            if r.get("hash") != chained(prior, r):
                return at | {"reason": "hash does not match"}
            prior, n = r["hash"], n + 1
    return {"ok": True, "records": n}


def broken_links(spark: SparkSession, folder: str, seed: str = "palisade") -> DataFrame:
    """(file, line, reason) of every broken record, by Spark.

    Only (file, line, hash, prior_hash, recomputed) cross a shuffle: a window within each file, whose size is bounded,
    and one row a file to link the files.
    """

    @F.udf("struct<prior:string,hash:string,again:string>")
    def read(line: str):
        try:
            r = json.loads(line)
            return r.get("prior_hash"), r.get("hash"), chained(r.get("prior_hash") or "", r)
        except (ValueError, AttributeError):
            return None, None, None

    lines = spark.read.text(folder).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.monotonically_increasing_id().alias("at"), read("value").alias("r"))
    rows = lines.select("file", "at", "r.*")
    w = Window.partitionBy("file").orderBy("at")
    seen = rows.withColumn("line", F.row_number().over(w)).withColumn("before", F.lag("hash").over(w))
    ends = rows.groupBy("file").agg(F.max_by("hash", "at").alias("last"))
    order = ends.withColumn("carried", F.lag("last", 1, genesis(seed)).over(Window.orderBy("file"))).select("file", "carried")  # one row a file
    linked = seen.join(order, "file").withColumn("want", F.when(F.col("line") == 1, F.col("carried")).otherwise(F.col("before")))
    reason = F.when(F.col("hash").isNull(), "not JSON").when(~F.col("prior").eqNullSafe(F.col("want")), "prior_hash does not match").when(F.col("hash") != F.col("again"), "hash does not match")
    return linked.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("file", "line", "reason")
