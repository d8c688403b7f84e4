"""Data sources as catalogs of tables: catalog.schema.table -> DataFrame, with a schema cache and health probes."""

from __future__ import annotations

import re
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from palisade.functions import secrets, wildcard
from palisade.model import GovernError, TableKey
from palisade.operators.dsl import Policy


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    sql_type: str
    nullable: bool
    position: int
    comment: str = ""


class Source:
    """A named source; subclasses list tables and load them for a session."""

    def __init__(self, name: str, spec: dict[str, Any]):
        self.name, self.spec = name, spec

    def tables(self, spark: SparkSession) -> list[TableKey]:
        raise NotImplementedError

    def load(self, spark: SparkSession, key: TableKey) -> DataFrame:
        raise NotImplementedError

    def probe(self, spark: SparkSession) -> None:
        self.tables(spark)

    def visible(self, schema: str, table: str) -> bool:
        """Whether the source's own allow-lists let a table through."""
        ok = lambda ps, name: not ps or any(wildcard.matches(p, name) for p in ps)
        return ok(self.spec.get("schemas"), schema) and ok(self.spec.get("tables"), table)


class FrameSource(Source):
    """DataFrames given as loaders: {"schema.table": session -> DataFrame}."""

    def __init__(self, name: str, frames: dict[str, Callable[[SparkSession], DataFrame]]):
        super().__init__(name, {})
        self.frames = frames

    def tables(self, spark: SparkSession) -> list[TableKey]:
        return [TableKey(self.name, *k.split(".")) for k in self.frames]

    def load(self, spark: SparkSession, key: TableKey) -> DataFrame:
        return self.frames[f"{key.schema}.{key.table}"](spark)


def view_name(path: str) -> str:
    """The table name of a Parquet path: its last part without extension and wildcards, in identifier characters."""
    parts = [p for p in path.rstrip("/").split("/") if p and not set(p) & set("*?[{")]
    name = re.sub(r"\.(parquet|parq|pq)$", "", parts[-1] if parts else "data", flags=re.IGNORECASE)
    name = re.sub(r"\W", "_", name).strip("_").lower() or "data"
    return f"t_{name}" if name[0].isdigit() else name


class ParquetSource(Source):
    """Parquet files and folders: one table in schema ``main`` for each allowed path.

    A table's schema is kept for ``ttl`` seconds, so that a query does not open files only to plan.
    """

    def __init__(self, name: str, spec: dict[str, Any], ttl: float = 600, clock: Callable[[], float] = time.monotonic):
        super().__init__(name, spec)
        self.ttl, self.clock, self.schemas = ttl, clock, {}
        base = f"s3a://{spec['bucket']}/{spec.get('prefix', '').strip('/')}".rstrip("/") + "/" if spec.get("bucket") else spec.get("prefix", "")
        self.paths: dict[str, str] = {}
        for p in spec.get("allowedPaths") or []:
            if ".." in p.split("/"):
                raise GovernError("ERR_CONFIG_INVALID", f"path leaves its folder: {p}")
            full = p if re.match(r"^([a-z0-9]+://|/)", p) else base + p
            at, n = view_name(p), 2
            while at in self.paths:
                at, n = f"{view_name(p)}_{n}", n + 1
            self.paths[at] = full

    def tables(self, spark: SparkSession) -> list[TableKey]:
        return [TableKey(self.name, "main", t) for t in self.paths if self.visible("main", t)]

    def load(self, spark: SparkSession, key: TableKey) -> DataFrame:
        path, now = self.paths[key.table], self.clock()
        if (hit := self.schemas.get(path)) and now - hit[0] < self.ttl:
            return spark.read.schema(hit[1]).parquet(path)
        df = spark.read.parquet(path)
        self.schemas[path] = (now, df.schema)
        return df

    def probe(self, spark: SparkSession) -> None:
        for path in self.paths.values():
            spark.read.parquet(path)


class JdbcSource(Source):
    """PostgreSQL and MySQL over JDBC; the driver's jar must be on the class path."""

    #: URL schemes and driver classes.
    DRIVERS = {"postgres": ("postgresql", "org.postgresql.Driver"), "mysql": ("mysql", "com.mysql.cj.jdbc.Driver")}

    def options(self) -> dict[str, str]:
        scheme, driver = self.DRIVERS[self.spec["type"]]
        url = self.spec["connection"]
        url = url if url.startswith("jdbc:") else "jdbc:" + re.sub(r"^\w+://", f"{scheme}://", url)
        out = {"url": url, "driver": driver, "fetchsize": "10000", "pushDownPredicate": "true", "pushDownAggregate": "true"}
        if self.spec.get("credentialsRef"):
            user, _, password = secrets.resolve(self.spec["credentialsRef"]).partition(":")
            out |= {"user": user, "password": password}
        return out

    def tables(self, spark: SparkSession) -> list[TableKey]:
        query = "SELECT table_schema, table_name FROM information_schema.tables WHERE table_schema NOT IN ('information_schema', 'pg_catalog', 'mysql', 'sys', 'performance_schema')"
        rows = spark.read.format("jdbc").options(**self.options()).option("query", query).load().collect()
        return [TableKey(self.name, r[0], r[1]) for r in rows if self.visible(r[0], r[1])]

    def load(self, spark: SparkSession, key: TableKey) -> DataFrame:
        return spark.read.format("jdbc").options(**self.options()).option("dbtable", f"{key.schema}.{key.table}").load()


class SqliteSource(Source):
    """An SQLite file through a Python data source; the file must be on a path that executors share."""

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.spec['path']}?mode=ro", uri=True)

    def tables(self, spark: SparkSession) -> list[TableKey]:
        with self._connect() as c:
            names = [r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        return [TableKey(self.name, "main", n) for n in names if self.visible("main", n)]

    def load(self, spark: SparkSession, key: TableKey) -> DataFrame:
        from palisade.sources.embedded import SqliteDataSource

        spark.dataSource.register(SqliteDataSource)
        return spark.read.format("palisade_sqlite").option("path", self.spec["path"]).option("table", key.table).load()


class DuckFileSource(Source):
    """A DuckDB file through a Python data source; needs the duckdb package."""

    def tables(self, spark: SparkSession) -> list[TableKey]:
        import duckdb

        with duckdb.connect(self.spec["path"], read_only=True) as c:
            rows = c.execute("SELECT table_schema, table_name FROM information_schema.tables ORDER BY 1, 2").fetchall()
        return [TableKey(self.name, s, t) for s, t in rows if self.visible(s, t)]

    def load(self, spark: SparkSession, key: TableKey) -> DataFrame:
        from palisade.sources.embedded import DuckDataSource

        spark.dataSource.register(DuckDataSource)
        return spark.read.format("palisade_duckdb").option("path", self.spec["path"]).option("schema", key.schema).option("table", key.table).load()


FACTORIES: dict[str, Callable[[str, dict[str, Any]], Source]] = {"s3_parquet": ParquetSource, "postgres": JdbcSource, "mysql": JdbcSource, "sqlite": SqliteSource, "duckdb_file": DuckFileSource}


def register_factory(kind: str, make: Callable[[str, dict[str, Any]], Source]) -> None:
    FACTORIES[kind] = make


def from_manifest(p: Policy) -> Source:
    if p.spec["type"] not in FACTORIES:
        raise GovernError("ERR_CONFIG_INVALID", f"no driver for {p.spec['type']} here")
    return FACTORIES[p.spec["type"]](p.name, p.spec)


@dataclass
class Catalog:
    """All sources, with an LRU cache of schemas (10 000 tables, 10 minutes)."""

    sources: dict[str, Source] = field(default_factory=dict)
    ttl: float = 600
    size: int = 10_000
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self):
        self._known: OrderedDict[TableKey, tuple[float, list[ColumnInfo]]] = OrderedDict()
        self._lists: dict[str, tuple[float, list[TableKey]]] = {}

    def add(self, source: Source) -> None:
        if source.name in self.sources:
            raise GovernError("ERR_CONFIG_INVALID", f"source {source.name} is defined twice")
        self.sources[source.name] = source

    def tables(self, spark: SparkSession, catalog: str | None = None) -> list[TableKey]:
        out: list[TableKey] = []
        for name, s in sorted(self.sources.items()):
            if catalog in (None, name):
                hit = self._lists.get(name)
                if hit is None or self.clock() - hit[0] >= self.ttl:
                    try:
                        hit = (self.clock(), sorted(s.tables(spark)))
                    except GovernError:
                        raise
                    except Exception as e:
                        raise GovernError("ERR_DATASOURCE_UNAVAILABLE", f"source {name} cannot be listed ({type(e).__name__})") from e
                    self._lists[name] = hit
                out += hit[1]
        return out

    def resolve(self, spark: SparkSession, parts: tuple[str, ...], default: tuple[str, str] | None = None) -> TableKey | None:
        """The table a name means, in the catalog's spelling; names match without regard to case, as Spark does."""
        full = tuple(p.lower() for p in ((*default, *parts)[-3:] if default and len(parts) < 3 else parts))
        if len(full) != 3:
            return None
        return next((t for t in self.tables(spark) if (t.catalog.lower(), t.schema.lower(), t.table.lower()) == full), None)

    def load(self, spark: SparkSession, key: TableKey) -> DataFrame:
        try:
            return self.sources[key.catalog].load(spark, key)
        except GovernError:
            raise
        except Exception as e:
            raise GovernError("ERR_DATASOURCE_UNAVAILABLE", f"{key} cannot be read ({type(e).__name__})") from e

    def columns(self, spark: SparkSession, key: TableKey) -> list[ColumnInfo]:
        now = self.clock()
        if (hit := self._known.get(key)) and now - hit[0] < self.ttl:
            self._known.move_to_end(key)
            return hit[1]
        fields = self.load(spark, key).schema.fields
        cols = [ColumnInfo(f.name, f.dataType.simpleString(), f.nullable, i, f.metadata.get("comment", "")) for i, f in enumerate(fields, 1)]
        self._known[key] = (now, cols)
        while len(self._known) > self.size:
            self._known.popitem(last=False)
        return cols

    def invalidate(self) -> None:
        self._known.clear()
        self._lists.clear()

    def health(self, spark: SparkSession) -> dict[str, str]:
        out = {}
        for name, s in self.sources.items():
            try:
                s.probe(spark)
                out[name] = "ok"
            except Exception as e:  # a probe reports whatever is wrong
                out[name] = f"failed: {type(e).__name__}"
        return out
