"""The whole gate in batch and stream, and the registered queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.config import ForwardConfig, GateConfig, LimiterConfig
from palisade.plans.pipeline import run_batch
from palisade.plans.queries import ORACLES, QUERIES
from palisade.reasons import split
from palisade.sources import datagrams as io
from palisade.sources.captured import captured_datagrams
from palisade.streaming import jobs
from tests.conftest import DATA


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return int(value) if type(value).__name__ == "Decimal" else value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "customer"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    want = con.sql(ORACLES[name])
    assert order == sorted(want.columns)
    rows = lambda names, found: sorted(repr([plain(r[names.index(c)]) for c in order]) for r in found)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def ledger(df):
    return sorted((r["datagram_id"], r["drop_stage"] or "", r["drop_reason"] or "") for r in df.select("datagram_id", "drop_stage", "drop_reason").collect())


CONFIG = GateConfig(limiter=LimiterConfig(1024, 20, 30), forward=ForwardConfig(100, 3))


def test_nothing_is_lost_and_order_and_partitions_do_not_matter(spark):
    data = captured_datagrams(spark, DATA)
    result = run_batch(data, CONFIG)
    first = ledger(result.ledger)
    assert [x[0] for x in first] == list(range(len(first)))
    stats = result.stats.first().asDict()
    assert sum(v for k, v in stats.items() if k != "received") == len(first) and stats["source_limited"] > 0 and stats["quota_drops"] > 0
    live, gone = split(result.ledger)
    assert live.count() + gone.count() == len(first) and result.events.count() == stats["forwarded"]
    shuffled = data.orderBy(F.rand(3)).repartition(7)
    assert ledger(run_batch(shuffled, CONFIG).ledger) == first


def test_empty_input(spark):
    nothing = captured_datagrams(spark, DATA).filter("datagram_id < 0")
    result = run_batch(nothing, CONFIG)
    assert result.ledger.count() == 0 and result.stats.first()["received"] == 0


def test_sinks(spark, tmp_path):
    data = captured_datagrams(spark, DATA)
    data.write.parquet(f"{tmp_path}/in")
    result = run_batch(io.read_datagrams(spark, f"{tmp_path}/in"), CONFIG)
    io.write_events(result.events, f"{tmp_path}/events")
    io.write_drops(result.ledger, f"{tmp_path}/drops")
    assert spark.read.text(f"{tmp_path}/events").count() == result.events.count()
    assert spark.read.parquet(f"{tmp_path}/drops").count() == result.drops.count() == io.discard(result.drops)


def test_stream_equals_batch(spark, tmp_path):
    captured_datagrams(spark, DATA).coalesce(1).write.parquet(f"{tmp_path}/in")
    query = jobs.start_stream(io.read_datagrams(spark, f"{tmp_path}/in", streaming=True), jobs.file_sink(f"{tmp_path}/events", f"{tmp_path}/drops"), f"{tmp_path}/ck", CONFIG)
    assert query.awaitTermination(120) and query.exception() is None
    want = run_batch(captured_datagrams(spark, DATA), CONFIG, F.lit(0))
    drops = spark.read.option("recursiveFileLookup", "false").parquet(f"{tmp_path}/drops/trigger=0")
    assert ledger(drops) == ledger(want.drops)
    got = [r["value"] for r in spark.read.text(f"{tmp_path}/events/trigger=0").collect()]
    assert got == [r["event_json"] for r in want.events.orderBy("forwarded_order").collect()]


def test_limiter_state_lives_across_triggers(spark, tmp_path):
    data = captured_datagrams(spark, DATA)
    for i in range(3):
        data.filter((F.col("datagram_id") >= i * 400) & (F.col("datagram_id") < (i + 1) * 400)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.rate_limit_stream(io.read_datagrams(spark, f"{tmp_path}/in", streaming=True), CONFIG.limiter)
        query = stream.select("datagram_id", "admitted").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
    from palisade.operators.limiter import rate_limit

    got = sorted((r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted((r[0], r[1]) for r in rate_limit(data, CONFIG.limiter).select("datagram_id", "admitted").collect())


def test_stream_keeps_late_rows(spark, tmp_path):
    start, minute = 1_705_689_600_000_000, 60_000_000
    arrivals = [[0, 1, 2], [20 * minute], [40 * minute, 3, minute], [5]]
    rows = [(t * 100 + i, start + a, 7, 1 + i % 2, b"x") for t, part in enumerate(arrivals) for i, a in enumerate(part)]
    schema = "datagram_id long, received_at_us long, src_ip long, src_port int, payload binary"
    for t in range(len(arrivals)):
        spark.createDataFrame([r for r in rows if r[0] // 100 == t], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        data = io.read_datagrams(spark, f"{tmp_path}/in", streaming=True)
        seen = []
        query = jobs.start_stream(data, lambda df, n: seen.extend(df.select("datagram_id", "drop_reason").collect()), f"{tmp_path}/ck", GateConfig(limiter=LimiterConfig(8, 1, 2)))
        assert query.awaitTermination(120) and query.exception() is None
        assert sorted(r["datagram_id"] for r in seen) == sorted(r[0] for r in rows if r[0] // 100 == t)


def test_stream_state_goes_with_idle_sources(spark, tmp_path):
    """What is kept between triggers is bounded by the sources active of late."""
    for i in range(3):
        data = spark.range(i * 50, i * 50 + 50).selectExpr("id as datagram_id", f"{i} * 3600000000 + id as received_at_us", "id as src_ip", "1 as src_port", "binary('x') as payload")
        data.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = jobs.rate_limit_stream(io.read_datagrams(spark, f"{tmp_path}/in", streaming=True), LimiterConfig(8, 1, 2), groups=1)
        query = stream.select("datagram_id", "admitted").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out")
        assert query.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").filter("admitted").count() == 150
    state = spark.read.format("statestore").option("path", f"{tmp_path}/ck").load().select("value.groupState.ips").first()[0]
    assert len(state) == 50 and min(state) == 100


def test_buckets_go_with_forgotten_sources(spark, tmp_path):
    for i in range(3):
        data = spark.range(i * 50, i * 50 + 50).selectExpr("id as datagram_id", f"{i} * 3600000000 + id as received_at_us", "id as src_ip", "1 as src_port", "binary('x') as payload")
        data.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = jobs.start_stream(io.read_datagrams(spark, f"{tmp_path}/in", streaming=True), lambda df, n: df.count(), f"{tmp_path}/ck", GateConfig(limiter=LimiterConfig(8, 1, 2)))
        assert query.awaitTermination(120) and query.exception() is None
    kept = [r["src_ip"] for r in spark.read.parquet(f"{tmp_path}/ck/state/version=2/buckets").collect()]
    assert sorted(kept) == list(range(142, 150))


def test_counts_by_own_stamp(spark, tmp_path):
    captured_datagrams(spark, DATA).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = jobs.event_counts(jobs.event_stream(io.read_datagrams(spark, f"{tmp_path}/in", streaming=True)), "500 milliseconds")
    query = live.writeStream.format("memory").queryName("stamped").outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    got = {(r["event_type"], r["start_us"]): r["n_events"] for r in spark.sql("select * from stamped").collect()}
    want = jobs.event_stream(captured_datagrams(spark, DATA)).filter("drop_reason is null").groupBy("event_type", F.window("event_ts", "500 milliseconds").alias("w")).count()
    assert got == {(r["event_type"], int(r["w"]["start"].timestamp() * 1_000_000)): r["count"] for r in want.collect()} and len(got) > 2


def test_one_pass(spark):
    """The limiter and the scanner stand once in the plan, and nothing is united."""
    plan = run_batch(captured_datagrams(spark, DATA), CONFIG).ledger._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("ArrowEvalPython") == 1 and "Union" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_one_batch_of_any_size_equals_the_window(spark):
    data = captured_datagrams(spark, DATA)
    assert ledger(run_batch(data, CONFIG, one_batch=True).ledger) == ledger(run_batch(data, CONFIG, F.lit(0)).ledger)


def test_events_keep_bytes_and_order(spark, tmp_path):
    lines = [b"ts=%d level=info msg=m%d" % (1_705_689_600_000, i) + tail for i, tail in enumerate((b"\xff\xc3", "é".encode(), b'"q', b""))]
    bodies = [line.replace(b'"q', b"\\q") for line in lines]
    rows = [(9 - i, 1_705_689_600_000_000 + i, 1, 1, len(b).to_bytes(2, "big") + b) for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "datagram_id long, received_at_us long, src_ip long, src_port int, payload binary")
    result = run_batch(df)
    io.write_events(result.events, f"{tmp_path}/events")
    got = b"".join(p.read_bytes() for p in sorted((tmp_path / "events").glob("part-*")))
    msg = [b.split(b"msg=")[1].replace(b"\\", b"\\\\") for b in bodies]
    assert got == b"".join(b'{"type":"log","agent_id":"","ts":1705689600000,"level":2,"msg":"%s"}\n' % m for m in msg)
    assert [r["repaired"] for r in result.events.orderBy("forwarded_order").collect()] == [True, False, False, False]
    assert [r["forwarded_order"] for r in result.events.orderBy("received_at_us").collect()] == [1, 2, 3, 4]


def test_kafka_records(spark):
    head = lambda **h: [(k, v.encode()) for k, v in h.items()]
    rows = [(b"p", 2, 5, head(src_ip="167772160", src_port="99")), (None, 0, 7, None)]
    records = spark.createDataFrame(rows, "value binary, partition int, offset long, headers array<struct<key string, value binary>>").withColumn("timestamp", F.timestamp_micros(F.lit(1_705_689_600_000_123)))
    got = [tuple(r) for r in io.from_records(records).orderBy("datagram_id").collect()]
    assert got == [(7, 1_705_689_600_000_123, None, None, None), ((2 << 48) + 5, 1_705_689_600_000_123, 167772160, 99, b"p")]
    assert ledger(run_batch(io.from_records(records)).ledger) == [(7, "envelope", "PayloadTooSmall"), ((2 << 48) + 5, "envelope", "PayloadTooSmall")]


def test_live_stats(spark, tmp_path):
    data = captured_datagrams(spark, DATA)
    data.coalesce(1).write.parquet(f"{tmp_path}/in")
    live = jobs.live_stats(jobs.event_stream(io.read_datagrams(spark, f"{tmp_path}/in", streaming=True)), "100 milliseconds", "0 seconds")
    query = live.writeStream.format("memory").queryName("live").outputMode("update").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    total = spark.sql("select sum(received + truncated) from live").first()[0]
    assert total == data.count()
