"""The corpus pipeline: documents in, encoded documents out.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is
written as Parquet and read again for the next.  All stages but the last return the columns of ``documents``.

1. language_id drops documents whose language cannot be told (no letter; or nothing to learn from).
2. line_dedup removes repeated lines from texts, and documents of which nothing is left that were not empty before.
3. near_duplicates keeps one document of each class: the one with the least doc_id.
4. decontaminate drops documents that hold a benchmark item.
5. bpe encodes the texts and proves that the ids decode.

Documents with a null doc_id pass every stage that cannot place them (2 and 3) unchanged.  Rows that repeat a doc_id
are one document: stage 3 keeps or drops them together, and keeps one of those that repeat the text as well.
Further columns of any name pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import bpe, decontaminate, langid, linededup, neardup
from palisade.llm.common import shared_dir, table, text_hash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a told language."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return langid.predict(rows, langid.fit_on_documents(docs)).where(F.col("lang_pred") != "und").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; n_chars follows."""
    kept = linededup.apply_bitmaps(docs, linededup.keep_bitmaps(docs))
    kept = kept.where((F.col("__n_dropped") == 0) | (F.trim("__kept", F.lit(linededup.SPACE)) != ""))
    text = F.when(F.col("__n_dropped") == 0, F.col("text")).otherwise(F.col("__kept"))
    out = {"text": text, "n_chars": F.when(F.col("__n_dropped") == 0, F.col("n_chars")).otherwise(F.char_length("__kept").cast("long"))}
    return kept.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each class of near duplicates."""
    classes = neardup.near_duplicates(docs).where(F.col("doc_id") != F.col("class_id")).select("doc_id").distinct()
    first = docs.where(F.col("doc_id").isNotNull()).join(classes, "doc_id", "left_anti")
    rows = first.select("doc_id", text_hash().alias("text_hash"), F.struct(*docs.columns).alias("row"))
    one = rows.groupBy("doc_id", "text_hash").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return one.unionByName(docs.where(F.col("doc_id").isNull()))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text, and the ids (binary, little-endian unsigned 32-bit)."""
    return bpe.digests(docs, bpe.read_tokenizer(), keep_ids=True)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontaminate", without_benchmark),
    ("bpe", encoded),
]

#: Language models, edit distances and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
