"""Reading captured datagrams, and writing events and drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from palisade.operators.normalise import with_event_json
from palisade.schemas import DATAGRAM


def read_datagrams(spark: SparkSession, path: str, streaming: bool = False, form: str = "parquet") -> DataFrame:
    """Datagrams with their source and arrival, under a fixed schema."""
    return (spark.readStream if streaming else spark.read).format(form).schema(DATAGRAM).load(path)


def read_kafka(spark: SparkSession, options: dict[str, str], streaming: bool = True) -> DataFrame:
    """Datagrams from Kafka topics. Needs Spark's Kafka package."""
    return from_records((spark.readStream if streaming else spark.read).format("kafka").options(**options, includeHeaders="true").load())


def from_records(records: DataFrame) -> DataFrame:
    """Datagrams from Kafka's records: payloads are values, arrival is the record's time, a record's place is its id, and
    source address and port come from the headers ``src_ip`` and ``src_port`` (decimal; null if absent)."""
    head = lambda name: F.get(F.filter("headers", lambda h: h["key"] == name), F.lit(0))["value"].cast("string")
    place = F.shiftleft(F.col("partition").cast("long"), 48) + F.col("offset")
    return records.select(
        place.alias("datagram_id"),
        F.unix_micros("timestamp").alias("received_at_us"),
        head("src_ip").cast("long").alias("src_ip"),
        head("src_port").cast("int").alias("src_port"),
        F.col("value").alias("payload"),
    )


#: The order in which events leave, where a frame has it.
DRAIN = ("batch", "forwarded_order")


def forwarded_events(df: DataFrame) -> DataFrame:
    """The events of a pipeline's result, with their text, and their place in the order of draining."""
    order = [c for c in DRAIN if c in df.columns]
    return with_event_json(df.filter(F.col("drop_reason").isNull()).select("datagram_id", "received_at_us", "agent_id", "event_type", "event_bytes", *order))


def write_events(df: DataFrame, path: str | None = None, form: str = "text", mode: str = "append", options: dict[str, str] | None = None) -> None:
    """One JSON object a line, byte for byte as it was sent and in the order of draining (files in the order of their
    names); other formats, such as kafka, get the column ``value``."""
    ordered = df.orderBy(*DRAIN) if set(DRAIN) <= set(df.columns) else df
    _save(ordered.select(F.col("event_bytes").cast("string").alias("value")).write, path, form, mode, options)


def write_drops(df: DataFrame, path: str | None = None, form: str = "parquet", mode: str = "append", options: dict[str, str] | None = None) -> None:
    """Dropped rows without payloads: files by stage, or for kafka one JSON object a row in ``value``."""
    drops = df.filter(F.col("drop_reason").isNotNull()).select("datagram_id", "received_at_us", "src_ip", "src_port", "drop_stage", "drop_reason")
    if form == "kafka":
        _save(drops.select(F.to_json(F.struct(*drops.columns)).alias("value")).write, path, form, mode, options)
    else:
        _save(drops.write.partitionBy("drop_stage"), path, form, mode, options)


def _save(writer: DataFrameWriter, path: str | None, form: str, mode: str, options: dict[str, str] | None) -> None:
    writer.format(form).mode(mode).options(**(options or {})).save(path)


def discard(df: DataFrame) -> int:
    """Run a frame to its end without keeping it, and say how many rows there were."""
    from pyspark.sql import Observation

    seen = Observation("discarded")
    df.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    return seen.get["n"]
