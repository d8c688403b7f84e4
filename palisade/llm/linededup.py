"""Line dedup: range-partitioned line hashes, sorted by document and position; the first document keeps its lines.

Built-in DataFrame functions only.  Every line of enough code points becomes a row of two 64-bit hashes (128 bits
of identity), document and position; texts never enter that shuffle.  The hash rows are range-partitioned by
(hash, salt of doc_id), sorted by document and position, and each run's first document is streamed off by a
window.  A hash that a third of all documents share is thus cut into ``salts`` runs; the runs' winners meet in a
second window that holds at most ``salts`` documents of a hash.

The outcome is one compressed (run-length) keep bitmap for each document that loses lines.

Defined cases: a null or empty text is one empty line; a null doc_id takes no part (its row keeps all lines);
rows that repeat a doc_id count as one document, each with a bitmap of its own; equal lines within the first
document all stay; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import ascii_lower, partitions, table, text_hash

SPACE = " \t\n\x0b\f\r"
MIN_CHARS = 10


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(SPACE)))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, salts: int | None = None) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_runs) for each document that loses lines.

    ``keep_runs`` is the keep bitmap, run-length encoded: array<struct<start,len>> of kept line positions, from 0.
    """
    n = partitions(docs.sparkSession)
    salts = salts or max(64, n)
    lines = (
        docs.select("doc_id", "text")
        .where(F.col("doc_id").isNotNull())
        .select("doc_id", text_hash().alias("text_hash"), lines_of(F.col("text")).alias("lines"))
        .select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "text_hash", "n_lines", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(
            "doc_id", "text_hash", "n_lines", "pos",
            F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"),
            F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(salts)).cast("int").alias("salt"),
        )
    )
    run = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    local = (
        lines.repartitionByRange(n, "h1", "h2", "salt")
        .withColumn("loses", F.col("doc_id") > F.first("doc_id").over(run))
        .withColumn("group", F.when(F.col("loses"), F.col("salt") + 1).otherwise(0))
    )
    overall = Window.partitionBy("h1", "h2", "group").orderBy("doc_id", "pos")
    dropped = local.withColumn("loses", F.col("loses") | (F.col("doc_id") > F.first("doc_id").over(overall))).where("loses")
    at = F.col("at")
    i0 = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(at, i - 1) + 1)
    i1 = lambda i: F.when(i == F.size(at), F.col("n_lines")).otherwise(F.get(at, i))
    runs = F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.struct(i0(i).alias("start"), (i1(i) - i0(i)).alias("len")))
    return (
        dropped.groupBy("doc_id", "text_hash", "n_lines")
        .agg(F.sort_array(F.collect_set("pos")).alias("at"))
        .select("doc_id", "text_hash", F.size("at").cast("long").alias("n_dropped"), F.filter(runs, lambda r: r["len"] > 0).alias("keep_runs"))
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with its columns, plus n_lines, n_dropped and kept (the text with its kept lines only)."""
    d = docs.withColumn("__h", text_hash())
    b = bitmaps.select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t"), F.col("n_dropped").alias("__n"), F.col("keep_runs").alias("__r"))
    joined = d.join(b, (d["doc_id"] == b["__d"]) & (d["__h"] == b["__t"]), "left")
    text = F.coalesce("text", F.lit(""))
    lines = lines_of(F.col("text"))
    kept = F.when(F.col("__r").isNull(), text).otherwise(
        F.array_join(F.flatten(F.transform("__r", lambda r: F.slice(F.col("__l"), r["start"] + 1, r["len"]))), "\n")
    )
    return (
        joined.withColumn("__l", lines)
        .select(*docs.columns, F.size("__l").cast("long").alias("__n_lines"), F.coalesce("__n", F.lit(0)).cast("long").alias("__n_dropped"), kept.alias("__kept"))
    )


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept for each row of ``docs``."""
    d = docs.select("doc_id", "text")
    return apply_bitmaps(d, keep_bitmaps(d, min_chars)).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept").alias("kept")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS d FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.*, f.d IS NOT NULL AND k.doc_id <> f.d AS drops FROM keyed k LEFT JOIN firsts f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drops) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT drops), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
