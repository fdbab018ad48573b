"""Stages and the reasons for which each drops a row; a reason is only unique together with its stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stage and reason names as they are emitted.
REASONS: dict[str, tuple[str, ...]] = {
    "recv": ("Truncated",),
    "source_limit": ("SourceLimited",),
    "envelope": ("PayloadTooSmall", "LengthMismatch", "TrailingJunk"),
    "detect": ("UnknownType",),
    "parse_metrics": (
        "InputTooLarge", "InvalidJson", "NestingTooDeep", "UnexpectedField", "MissingRequiredField", "InvalidFieldType", "AgentIdTooLong", "AgentIdInvalidChars", "TooManyMetrics",
        "MetricNameTooLong", "MetricMissingName", "MetricMissingValue", "MetricValueNotNumber", "UnitTooLong", "TooManyTags", "TagKeyTooLong", "TagValueTooLong",
    ),
    "parse_log": (
        "InputTooLarge", "EmptyInput", "TooManyFields", "InvalidKeyChar", "KeyTooLong", "MissingEquals", "UnterminatedQuote", "ValueTooLong", "InvalidTimestamp", "InvalidLevel",
        "MissingTimestamp", "MissingLevel", "MissingMessage",
    ),
    "validate_metrics": (
        "AgentIdEmpty", "AgentIdTooLong", "AgentIdInvalidFormat", "TimestampMissing", "TimestampTooOld", "TimestampInFuture", "MetricNameEmpty", "MetricValueNaN", "MetricValueInfinity",
        "MetricValueTooLow", "MetricValueTooHigh",
    ),
    "validate_log": ("AgentIdEmpty", "AgentIdTooLong", "AgentIdInvalidFormat", "TimestampTooOld", "TimestampInFuture", "LevelBelowMinimum", "MessageEmpty", "MessageTooLong"),
    "forward": ("DroppedAgentQuotaExceeded", "DroppedQueueFull"),
}


def open_outcome(df: DataFrame) -> DataFrame:
    """Add empty ``drop_stage`` and ``drop_reason`` where a frame has none."""
    for name in ("drop_stage", "drop_reason"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def pinned(df: DataFrame, *names: str) -> DataFrame:
    """The same rows, with the named columns computed once where this stands.

    Catalyst copies a column's expression into every filter that it pushes below; over a chain of stages that each
    refer to the one before, the copies multiply. A generator's output is not copied.
    """
    once = F.explode(F.array(F.struct(*names))).alias("_pinned")
    return df.select(*(c for c in df.columns if c not in names), once).select("*", "_pinned.*").drop("_pinned")


def outcome(df: DataFrame, stage: str, reason: Column) -> DataFrame:
    """Set the pair on rows that have none and for which ``reason`` is not null."""
    df = open_outcome(df)
    own = F.when(F.col("drop_reason").isNull(), reason)
    hits = own.isNotNull()
    return df.withColumns({"drop_stage": F.when(hits, F.lit(stage)).otherwise(F.col("drop_stage")), "drop_reason": F.coalesce(own, "drop_reason")})


def alive() -> Column:
    return F.col("drop_reason").isNull()


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows still alive, and rows dropped: every row is in one of the two."""
    df = open_outcome(df)
    return df.filter(alive()), df.filter(~alive())
