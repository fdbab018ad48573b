"""The sink with its own commit: tasks that die, jobs that are given up, triggers that are run again, and the order of draining."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from palisade.config import GateConfig, LimiterConfig
from palisade.plans.pipeline import run_batch
from palisade.sources import datagrams as io
from palisade.sources import event_sink
from palisade.sources.captured import captured_datagrams
from palisade.streaming import jobs
from tests.conftest import DATA

CONFIG = GateConfig(limiter=LimiterConfig(1024, 500, 900))
SCHEMA = StructType([StructField("batch", LongType()), StructField("forwarded_order", LongType()), StructField("event_bytes", BinaryType())])


def lines(spark, path):
    return [(r["batch"], r["forwarded_order"], bytes(r["line"])) for r in event_sink.read_lines(spark, path).orderBy("batch", "forwarded_order").collect()]


def rows(*parts):
    return [pa.RecordBatch.from_pylist([{"batch": b, "forwarded_order": o, "event_bytes": t} for b, o, t in part], pa.schema([("batch", pa.int64()), ("forwarded_order", pa.int64()), ("event_bytes", pa.binary())])) for part in parts]


def test_events_of_a_batch(spark, tmp_path):
    result = run_batch(captured_datagrams(spark, DATA), CONFIG, F.expr("received_at_us div 100000"))
    event_sink.write_lines(result.ledger, f"{tmp_path}/e")
    want = [(r["batch"], r["forwarded_order"], bytes(r["event_bytes"])) for r in result.ledger.filter("drop_reason is null").orderBy("batch", "forwarded_order").collect()]
    assert lines(spark, f"{tmp_path}/e") == want and len(want) > 100
    stretches = spark.read.schema(event_sink.STRETCH).json(f"{tmp_path}/e/manifests")
    assert stretches.count() == len({b for b, _, _ in want})  # an interval is one stretch of one file
    plan = result.ledger.select("batch", "forwarded_order", "event_bytes").sortWithinPartitions("batch")._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan


def test_a_task_that_died_is_never_read(spark, tmp_path):
    writer = event_sink.BatchLines({"path": f"{tmp_path}/e"}, SCHEMA)

    def dies():
        yield from rows([(1, 1, b"a")])
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dies())
    done = [writer.write(iter(rows([(1, 1, b"a"), (1, 2, b"b\xff")], [(1, 3, b"c"), (2, 1, b"")]))), writer.write(iter(rows([(3, 5, b"z"), (3, 9, b"y")]))), writer.write(iter([]))]
    writer.commit([*done, None])
    assert lines(spark, f"{tmp_path}/e") == [(1, 1, b"a"), (1, 2, b"b\xff"), (1, 3, b"c"), (2, 1, b""), (3, 5, b"z"), (3, 9, b"y")]
    assert len(os.listdir(tmp_path / "e/data")) == 4  # the dead task's file lies there, unnamed
    given_up = writer.write(iter(rows([(9, 9, b"x")])))
    writer.abort([given_up, None])
    assert len(os.listdir(tmp_path / "e/data")) == 4 and len(lines(spark, f"{tmp_path}/e")) == 6


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    df = spark.range(0, 40, 1, 4).select(F.lit(1).alias("batch"), F.col("id").alias("forwarded_order"), F.when(F.col("id") == 35, F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.encode(F.col("id").cast("string"), "UTF-8")).alias("event_bytes"))
    with pytest.raises(Exception, match="lost"):
        event_sink.write_lines(df, f"{tmp_path}/e")
    assert not os.path.exists(tmp_path / "e/manifests")
    event_sink.write_lines(df.filter("forwarded_order < 30"), f"{tmp_path}/e")
    assert [o for _, o, _ in lines(spark, f"{tmp_path}/e")] == list(range(30))


def test_triggers_that_are_run_again(spark, tmp_path):
    data = captured_datagrams(spark, DATA).filter("datagram_id < 300")
    attempts = []
    sink = event_sink.line_sink(f"{tmp_path}/e")

    def written_then_lost(df, number):
        sink(df, number)
        attempts.append(number)
        if attempts.count(number) == 1:
            raise RuntimeError("lost")

    for a, b in ((0, 120), (120, 300)):
        data.filter((F.col("datagram_id") >= a) & (F.col("datagram_id") < b)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):
            query = jobs.start_stream(io.read_datagrams(spark, f"{tmp_path}/in", streaming=True), written_then_lost, f"{tmp_path}/ck", CONFIG, batch=F.expr("received_at_us div 100000"))
            try:
                query.awaitTermination(200)
            except Exception as e:
                assert "lost" in str(e)
    assert attempts == [0, 0, 1, 1]
    want = run_batch(data, CONFIG, F.expr("received_at_us div 100000")).ledger.filter("drop_reason is null").orderBy("batch", "forwarded_order").collect()
    assert lines(spark, f"{tmp_path}/e") == [(r["batch"], r["forwarded_order"], bytes(r["event_bytes"])) for r in want]


def test_a_plain_stream_writes_lines(spark, tmp_path):
    event_sink.register(spark)
    spark.range(20).selectExpr("id div 10 as batch", "id % 10 + 1 as forwarded_order", "cast(string(id) as binary) as event_bytes").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    query = stream.writeStream.format("event_lines").option("path", f"{tmp_path}/e").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    assert query.awaitTermination(120) and query.exception() is None
    assert [t for *_, t in lines(spark, f"{tmp_path}/e")] == [str(i).encode() for i in range(20)]
