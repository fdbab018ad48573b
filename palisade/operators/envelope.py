"""Size gate, length-prefixed envelope and message type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import RecvConfig
from palisade.functions.columns import first_reason
from palisade.reasons import outcome


def size_gate(df: DataFrame, config: RecvConfig = RecvConfig()) -> DataFrame:
    """Payloads over the byte cap are dropped; the cap itself passes, and so does an empty payload."""
    return outcome(df, "recv", F.when(F.octet_length("payload") > config.max_datagram_bytes, F.lit("Truncated")))


def decode_envelope(df: DataFrame) -> DataFrame:
    """Add ``body``: what follows a big-endian 16-bit length that must be exact. A null payload counts as empty."""
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    stated = F.conv(F.hex(F.substring("payload", 1, 2)), 16, 10).cast("int")
    df = outcome(df, "envelope", first_reason((size < 2, "PayloadTooSmall"), (stated + 2 > size, "LengthMismatch"), (stated + 2 < size, "TrailingJunk")))
    return df.withColumn("body", F.when(F.col("drop_reason").isNull(), F.expr("substring(payload, 3)")))


def encode_envelope(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``payload`` from a body; one that 16 bits can't count is dropped instead of being wrapped around."""
    size = F.octet_length(body)
    df = outcome(df, "envelope", F.when(size > 65535, F.lit("LengthMismatch")))
    return df.withColumn("payload", F.when(size <= 65535, F.concat(F.unhex(F.lpad(F.hex(size), 4, "0")), F.col(body))))


def message_type(body: Column) -> Column:
    """``metrics`` or ``log`` by its look, null if neither: a body that opens a brace can only be metrics."""
    has = lambda *names: [F.contains(body, F.lit(n).cast("binary")) for n in names]
    brace = F.substring(body, 1, 1) == F.lit(b"{")
    ts, level, msg = has("ts=", "level=", "msg=")
    return F.when(brace, F.when(has('"metrics"')[0], F.lit("metrics"))).when(ts & level & msg, F.lit("log"))


def detect_type(df: DataFrame) -> DataFrame:
    df = df.withColumn("msg_type", message_type(F.col("body")))
    return outcome(df, "detect", F.when(F.col("msg_type").isNull(), F.lit("UnknownType")))
