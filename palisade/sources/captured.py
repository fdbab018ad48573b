"""Datagrams derived from the ``events`` table, good ones and each kind of bad one, by a fixed rule.

A row's class is event_id % 40: 0-19 good metrics, 20-27 good logs, 28-39 one fault each. Arrival is one a millisecond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.reasons import pinned

START_MS = 1_705_689_600_000


def captured_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived columns from which the messages are made."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = F.col("event_id") + START_MS
    kind = (F.col("event_id") % 40).cast("int")
    return events.select(
        F.col("event_id").alias("datagram_id"),
        (now * 1000).alias("received_at_us"),
        (F.lit(167772160) + F.col("user_id") % 8).cast("long").alias("src_ip"),
        (F.lit(10000) + F.col("user_id") % 2).cast("int").alias("src_port"),
        kind.alias("kind"),
        F.when(kind == 36, F.lit("123-invalid-starts-with-number")).otherwise(F.concat(F.lit("agent"), F.col("user_id").cast("string"))).alias("agent"),
        F.when(kind == 35, now - 300_001).when(kind == 38, now + 60_001).otherwise(now).alias("stamp"),
        F.col("event_type").alias("name"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.regexp_extract("props", r"(-?[0-9]+)", 1).alias("k"),
    )


def captured_datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = captured_fields(spark, sf_dir)
    text = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    seq, stamp = F.col("datagram_id").cast("string"), F.col("stamp").cast("string")
    head = text('{"agent_id":"', F.col("agent"), '","seq":', seq, ',"ts":', stamp, ',"metrics":[')
    tags = F.when(F.col("kind") == 33, F.lit("tags")).otherwise(F.lit("t"))
    metrics = text(head, '{"n":"', F.col("name"), '","v":', F.col("cents").cast("string"), ',"u":"cents","', tags, '":{"k":"', F.col("k"), '"}}]}')
    level = F.when(F.col("name") == "error", F.lit("error")).otherwise(F.lit("info"))
    msg = F.when(F.col("kind") == 39, F.lit('""')).when(F.col("kind") == 37, text('"', F.col("name"))).otherwise(text('"', F.col("name"), '"'))
    log = text("ts=", stamp, " level=", level, " agent=", F.col("agent"), " msg=", msg)
    kind = F.col("kind")
    body = (
        F.when(kind == 28, F.repeat(F.lit("x"), 2000))
        .when(kind == 32, F.lit('{"agent_id": broken json here'))
        .when(kind == 34, text(head, "}"))
        .when(kind.isin(*range(20, 28), 37, 38, 39), log)
        .otherwise(metrics)
    )
    raw = F.encode(body, "UTF-8")
    framed = F.concat(F.unhex(F.lpad(F.hex(F.octet_length(raw)), 4, "0")), raw)
    payload = F.when(kind == 29, F.lit(b"\x00")).when(kind == 30, F.concat(F.lit(b"\xff\xff"), raw)).when(kind == 31, F.concat(framed, F.lit(b"!"))).otherwise(framed)
    # made once, as a captured payload would be read once
    return pinned(f.select("datagram_id", "received_at_us", "src_ip", "src_port", payload.alias("payload")), "payload")
