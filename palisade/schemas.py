"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LONG, TEXT, UINT64 = T.LongType(), T.StringType(), T.DecimalType(20, 0)
DATAGRAM = _struct(datagram_id=LONG, received_at_us=LONG, src_ip=LONG, src_port=T.IntegerType(), payload=T.BinaryType())
PAIR = _struct(key=TEXT, value=TEXT)
METRIC = _struct(name=TEXT, value=T.DoubleType(), unit=TEXT, tags=T.ArrayType(PAIR))
PARSED_METRICS = _struct(reason=TEXT, agent_id=TEXT, seq=LONG, ts=UINT64, metrics=T.ArrayType(METRIC))
EVENT = _struct(datagram_id=LONG, received_at_us=LONG, agent_id=TEXT, event_type=TEXT, event_bytes=T.BinaryType())
