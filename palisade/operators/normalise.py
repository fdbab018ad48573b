"""One JSON form for both kinds of message, and their flat views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions.columns import text_as_bytes


def _number(column: str) -> Column:
    return F.col(column).cast("string")


def metrics_json() -> Column:
    head = F.concat(F.lit('{"type":"metrics","agent_id":"'), "metrics_agent", F.lit('","seq":'), _number("seq"))
    return F.concat(head, F.lit(',"ts":'), _number("metrics_ts"), F.lit(',"metric_count":'), F.size("metrics").cast("string"), F.lit("}"))


def log_json() -> Column:
    """Only ``"`` and ``\\`` are escaped; other bytes stay as they came, in byte text."""
    msg = F.replace(F.replace("msg", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('{"type":"log","agent_id":"'), "log_agent", F.lit('","ts":'), _number("log_ts"), F.lit(',"level":'), _number("level"), F.lit(',"msg":"'), msg, F.lit('"}'))


def unify_events(df: DataFrame) -> DataFrame:
    """Add agent_id, event_type and event_bytes to rows still alive; both kinds come from one scan. The bytes are what a
    sender wrote, valid UTF-8 or not; ``with_event_json`` reads them as text."""
    is_metrics, live = F.col("msg_type") == "metrics", F.col("drop_reason").isNull()
    pick = lambda a, b: F.when(live, F.when(is_metrics, a).otherwise(b))
    return df.withColumns({
        "agent_id": pick(F.col("metrics_agent"), F.col("log_agent")),
        "event_type": pick(F.lit("metrics"), F.lit("log")),
        "event_bytes": pick(text_as_bytes(metrics_json()), text_as_bytes(log_json())),
    })


def with_event_json(df: DataFrame) -> DataFrame:
    """Add event_json, the event as text, and ``repaired``: whether it had bytes that are no UTF-8 (a cut character, say),
    which the text has replaced and event_bytes still holds."""
    text = F.col("event_bytes").cast("string")
    return df.withColumns({"event_json": F.make_valid_utf8(text), "repaired": ~F.is_valid_utf8(text)})


def merge_events(metrics: DataFrame, logs: DataFrame) -> DataFrame:
    """The same from two frames on the event schema."""
    return metrics.unionByName(logs)


def explode_metrics(df: DataFrame, outer: bool = False) -> DataFrame:
    """One row a metric, with its position; ``outer`` keeps messages without any."""
    return df.select("*", (F.posexplode_outer if outer else F.posexplode)("metrics").alias("metric_pos", "metric"))


def explode_tags(df: DataFrame) -> DataFrame:
    """One row a tag of ``metric``."""
    return df.select("*", F.posexplode("metric.tags").alias("tag_pos", "tag"))


def explode_log_fields(df: DataFrame) -> DataFrame:
    return df.select("*", F.posexplode("fields").alias("field_pos", "field"))
