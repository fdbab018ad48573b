"""Streams whose state goes on from trigger to trigger: bounded sources, drain intervals, totals, crashes and retention."""

import os
import random

from pyspark.sql import functions as F

from palisade.config import ForwardConfig, GateConfig, LimiterConfig
from palisade.operators.limiter import rate_limit
from palisade.operators.stats import pipeline_stats
from palisade.plans.pipeline import run_batch
from palisade.schemas import DATAGRAM
from palisade.sources import datagrams as io
from palisade.sources.captured import captured_datagrams
from palisade.sources.shared import folders, shared_dir
from palisade.streaming import jobs
from tests.conftest import DATA


def run(spark, path, parts, config, batch=None, sink=None, delay_ms=600_000):
    """Each of ``parts`` as one trigger; the rows that the sink got."""
    seen = {}

    def keep(df, number):
        if sink:
            sink(df, number)
        seen[number] = df.collect()

    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
        while True:
            query = jobs.start_stream(io.read_datagrams(spark, f"{path}/in", streaming=True), keep, f"{path}/ck", config, batch=batch, delay_ms=delay_ms)
            try:
                assert query.awaitTermination(300)
                break
            except Exception as lost:
                if "lost" not in str(lost):
                    raise
    return [r for rows in seen.values() for r in rows]


def test_a_bound_on_sources_equals_the_batch(spark, tmp_path):
    """Sources are forgotten inside of triggers and between them."""
    rng = random.Random(3)
    rows = [(i, i * 40_000, rng.randrange(4) if rng.random() < 0.6 else rng.randrange(14), 1, bytearray(b"x")) for i in range(240)]
    config = GateConfig(limiter=LimiterConfig(5, 2, 3))
    df = spark.createDataFrame(rows, DATAGRAM)
    cut = lambda a, b: df.filter((F.col("datagram_id") >= a) & (F.col("datagram_id") < b))
    got = run(spark, tmp_path, [cut(0, 90), cut(90, 93), cut(93, 240)], config)
    want = rate_limit(df, config.limiter).collect()
    assert {r["datagram_id"]: (r["resident_miss"], r["admitted"]) for r in got} == {r["datagram_id"]: (r["resident_miss"], r["admitted"]) for r in want}
    assert sum(r["resident_miss"] for r in want) > 40 and sum(not r["admitted"] for r in want) > 10
    assert spark.read.parquet(f"{tmp_path}/ck/state/version=2/buckets").count() == 5
    assert [r["src_ip"] for r in spark.read.parquet(f"{tmp_path}/ck/state/version=2/known").orderBy(F.desc("pos")).limit(1).collect()] == [rows[-1][2]]


def test_intervals_go_on_over_triggers_that_crash(spark, tmp_path):
    config = GateConfig(limiter=LimiterConfig(4, 200, 400), forward=ForwardConfig(25, 3))
    data = captured_datagrams(spark, DATA).filter("datagram_id < 500")
    bounds = data.selectExpr("min(received_at_us) a", "max(received_at_us) b").first()
    batch = F.expr(f"received_at_us div {(bounds['b'] - bounds['a']) // 3}")
    attempts = set()

    def dies_once(df, number):
        if number not in attempts:
            attempts.add(number)
            df.count()
            raise RuntimeError("lost")

    before = set(os.listdir(shared_dir(spark).removeprefix("file://")))
    cuts = [0, 130, 140, 310, 500]
    parts = [data.filter((F.col("datagram_id") >= a) & (F.col("datagram_id") < b)) for a, b in zip(cuts, cuts[1:])]
    got = run(spark, tmp_path, parts, config, batch, dies_once)
    assert attempts == {0, 1, 2, 3}
    want = run_batch(data, config, batch).ledger
    told = lambda rows: sorted((r["datagram_id"], r["drop_stage"] or "", r["drop_reason"] or "", r["forwarded_order"] or 0) for r in rows)
    assert told(got) == told(want.collect())
    reasons = {r["drop_reason"] for r in got}
    assert {"DroppedAgentQuotaExceeded", "DroppedQueueFull"} & reasons
    assert jobs.live_totals(spark, f"{tmp_path}/ck").collect() == pipeline_stats(want).collect()
    assert sorted(folders(spark, f"{tmp_path}/ck/state")) == ["version=2", "version=3"]
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(shared_dir(spark).removeprefix("file://"))) - before}
    assert not {"backlog", "counts", "marks"} & left


def test_late_rows_of_a_forgotten_interval_are_counted(spark, tmp_path):
    rows = [[(1, 1_000_000, 1, 1, b"x"), (2, 1_500_000, 1, 1, b"x")], [(3, 90_000_000, 1, 1, b"x")], [(4, 1_600_000, 1, 1, b"x")]]
    body = lambda ms: (lambda line: len(line).to_bytes(2, "big") + line)(b"ts=%d level=info msg=m agent=a" % ms)
    parts = [spark.createDataFrame([(i, t, ip, port, bytearray(body(t // 1000))) for i, t, ip, port, _ in part], DATAGRAM) for part in rows]
    got = run(spark, tmp_path, parts, GateConfig(), F.expr("received_at_us div 1000000"), delay_ms=5_000)
    assert sorted((r["datagram_id"], r["batch"], r["forwarded_order"]) for r in got) == [(1, 1, 1), (2, 1, 2), (3, 90, 1), (4, 1, 1)]
    assert jobs.live_totals(spark, f"{tmp_path}/ck").first()["forwarded"] == 4
    assert [r["batch"] for r in spark.read.parquet(f"{tmp_path}/ck/state/version=1/begun").collect()] == [90]


def test_totals_before_any_trigger(spark, tmp_path):
    assert jobs.live_totals(spark, f"{tmp_path}/none").first()["received"] == 0
