"""Counters over the outcome of each datagram. Keys are stage and reason names only, never what a sender wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Names of the counters, in their order.
COUNTERS = ("received", "truncated", "source_limited", "envelope_drops", "parse_drops", "validation_drops", "queue_drops", "quota_drops", "forwarded")


def _counters() -> dict[str, Column]:
    stage, reason = F.col("drop_stage"), F.col("drop_reason")
    return {
        "received": F.count_if(F.coalesce(stage != "recv", F.lit(True))),
        "truncated": F.count_if(stage == "recv"),
        "source_limited": F.count_if(stage == "source_limit"),
        "envelope_drops": F.count_if(stage == "envelope"),
        "parse_drops": F.count_if(stage.isin("detect", "parse_metrics", "parse_log")),
        "validation_drops": F.count_if(stage.isin("validate_metrics", "validate_log")),
        "queue_drops": F.count_if(reason == "DroppedQueueFull"),
        "quota_drops": F.count_if(reason == "DroppedAgentQuotaExceeded"),
        "forwarded": F.count_if(reason.isNull()),
    }


def pipeline_stats(df: DataFrame) -> DataFrame:
    """One row of counters; what the size gate cut is not counted as received."""
    return df.agg(*(c.alias(name) for name, c in _counters().items()))


def drop_counts(df: DataFrame) -> DataFrame:
    """(drop_stage, drop_reason, level, n): by reason (level 0), by stage (1) and in all (3)."""
    return df.filter(F.col("drop_reason").isNotNull()).rollup("drop_stage", "drop_reason").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"))


def stats_per_interval(df: DataFrame, interval: str = "1 second") -> DataFrame:
    """The counters of each interval of arrival (start_us), with running totals."""
    timed = df.withColumn("_at", F.timestamp_micros("received_at_us"))
    each = timed.groupBy(F.window("_at", interval).alias("w")).agg(*(c.alias(name) for name, c in _counters().items()))
    each = each.select(F.unix_micros("w.start").alias("start_us"), *_counters())
    order = W.orderBy("start_us").rowsBetween(W.unboundedPreceding, W.currentRow)
    return each.select("*", *(F.sum(name).over(order).alias(f"total_{name}") for name in ("received", "forwarded")))
