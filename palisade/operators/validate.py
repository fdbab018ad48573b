"""Rules on decoded messages: the first broken one, in a fixed order, names the drop. Arrival is the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import LogRules, MetricsRules, TimeWindow
from palisade.functions.columns import first_reason, in_future, now_ms, too_old, valid_agent_id
from palisade.reasons import outcome


def agent_rules(agent: Column) -> list[tuple[Column, str]]:
    return [(F.length(agent) > 64, "AgentIdTooLong"), (~valid_agent_id(agent), "AgentIdInvalidFormat")]


def time_rules(ts: Column, now: Column, window: TimeWindow) -> list[tuple[Column, str]]:
    return [(too_old(ts, now, window), "TimestampTooOld"), (in_future(ts, now, window), "TimestampInFuture")]


def metric_reason(metric: Column, rules: MetricsRules) -> Column:
    """A value that is no finite number and allowed skips the range."""
    value = metric["value"]
    endless = value.isin(float("inf"), float("-inf"))
    finite = ~F.isnan(value) & ~endless
    return first_reason(
        (metric["name"] == "", "MetricNameEmpty"),
        (F.isnan(value) & F.lit(rules.reject_nan), "MetricValueNaN"),
        (endless & F.lit(rules.reject_infinity), "MetricValueInfinity"),
        (finite & (value < rules.min_value), "MetricValueTooLow"),
        (finite & (value > rules.max_value), "MetricValueTooHigh"),
    )


def metrics_reason(agent: Column, ts: Column, metrics: Column, now: Column, rules: MetricsRules = MetricsRules()) -> Column:
    stamped = [(broken & (ts != 0), name) for broken, name in time_rules(ts, now, rules.window)]
    return F.coalesce(
        first_reason((agent == "", "AgentIdEmpty"), *agent_rules(agent), ((ts == 0) & F.lit(rules.require_timestamp), "TimestampMissing"), *stamped),
        F.get(F.filter(F.transform(metrics, lambda m: metric_reason(m, rules)), F.isnotnull), F.lit(0)),
    )


def log_reason(agent: Column, ts: Column, level: Column, msg: Column, now: Column, rules: LogRules = LogRules()) -> Column:
    given = [(broken & (agent != ""), name) for broken, name in agent_rules(agent)]
    return first_reason(
        *given,
        ((agent == "") & F.lit(rules.require_agent_id), "AgentIdEmpty"),
        *time_rules(ts, now, rules.window),
        (level < rules.min_level, "LevelBelowMinimum"),
        (msg == "", "MessageEmpty"),
        ((F.length(msg) > rules.max_message_bytes) & F.lit(not rules.truncate_message), "MessageTooLong"),
    )


def validate_metrics(df: DataFrame, rules: MetricsRules = MetricsRules()) -> DataFrame:
    mine = F.col("msg_type") == "metrics"
    return outcome(df, "validate_metrics", F.when(mine, metrics_reason(F.col("metrics_agent"), F.col("metrics_ts"), F.col("metrics"), now_ms(), rules)))


def validate_log(df: DataFrame, rules: LogRules = LogRules()) -> DataFrame:
    """A message that is too long is cut to the limit in bytes, unless the rules reject it."""
    mine = F.col("msg_type") == "log"
    df = outcome(df, "validate_log", F.when(mine, log_reason(F.col("log_agent"), F.col("log_ts"), F.col("level"), F.col("msg"), now_ms(), rules)))
    return df.withColumn("msg", F.substring("msg", 1, rules.max_message_bytes))
