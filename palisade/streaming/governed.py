"""Governed streams: row filters and scan masks are plain expressions, so they apply to streaming DataFrames as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.masks import MaskRegistry, default_registry
from palisade.model import Decision, Facts, GovernError, Shape, TableKey, UserCtx
from palisade.operators.engine import PolicyEngine
from palisade.plans.secure import secured_table


def secured_stream(stream: DataFrame, key: TableKey, engine: PolicyEngine, user: UserCtx, facts: Facts | None = None, masks: MaskRegistry | None = None) -> DataFrame:
    """The stream as its reader may see it; post masks, limits and samples have no meaning here and are refused."""
    d: Decision = engine.evaluate(user, facts, Shape(tables=[key]))
    if d.outcome != "allow":
        raise GovernError(d.code or "ACL_DENIED", d.message or "access denied")
    df, post = secured_table(stream, key, d, user, facts, masks or default_registry())
    if post or d.limit is not None or d.sample is not None:
        raise GovernError("ERR_MASK_UNSUPPORTED_CONTEXT", "this policy cannot be applied to a stream")
    return df


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and keys; state older than the watermark is dropped."""
    t = F.col(time).cast("timestamp")
    return stream.withColumn("__t", t).withWatermark("__t", late).groupBy(F.window("__t", width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
