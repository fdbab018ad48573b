"""Ranks made of parts: equal to the plain windows with repeated and null ids, hot agents, and intervals cut in two."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palisade.config import ForwardConfig
from palisade.operators import backlog
from palisade.reasons import open_outcome

SCHEMA = "datagram_id long, received_at_us long, agent_id string, b int, dropped boolean"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return open_outcome(df).withColumns({"drop_stage": F.when(F.col("dropped"), F.lit("recv")), "drop_reason": F.when(F.col("dropped"), F.lit("Truncated"))}).repartition(3)


def random_rows(seed, n, agents, batches):
    rng = random.Random(seed)
    hot = rng.random() < 0.5
    return [(i, i * 7, "a0" if hot and rng.random() < 0.6 else f"a{rng.randrange(agents)}", i * batches // n, rng.random() < 0.1) for i in range(n)]


def told(df):
    return {r["datagram_id"]: (r["batch"], r["drop_stage"], r["drop_reason"], r["forwarded_order"]) for r in df.collect()}


@pytest.mark.parametrize("seed, n, agents, batches, quota, depth, ranges", [(1, 400, 6, 1, 8, 30, 9), (2, 400, 3, 4, 5, 12, 30), (3, 300, 40, 2, 2, 25, 50), (4, 300, 1, 1, 10, 4, 7), (5, 300, 5, 3, 100, 1000, 1), (6, 200, 4, 1, 3, 7, 200)])
def test_parts_equal_the_windows(spark, seed, n, agents, batches, quota, depth, ranges):
    config = ForwardConfig(depth, quota)
    df = frame(spark, random_rows(seed, n, agents, batches))
    want = told(backlog.bound_backlog(df, "b", config))
    got = backlog.bound_large_backlog(df, config, "b", ranges)
    assert told(got) == want
    assert set(got.columns) == {*df.columns, "batch", "forwarded_order"}


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    config = ForwardConfig(5, 2)
    rows = [(1, 10, "a", 0, False), (1, 10, "a", 0, False), (None, 20, "a", 0, False), (None, 30, "b", 0, False), (None, 40, "c", 0, True), (2, 50, "b", 0, False), (2, 50, "c", 0, False), (3, 60, "d", 0, False)]
    kept = lambda df: Counter((r["datagram_id"], r["received_at_us"], r["agent_id"], r["drop_reason"], r["forwarded_order"]) for r in df.collect())
    df = frame(spark, rows)
    got = kept(backlog.bound_large_backlog(df, config, ranges=4))
    assert got == kept(backlog.bound_backlog(df, F.lit(0), config)) and sum(got.values()) == len(rows)
    assert backlog.bound_large_backlog(df.limit(0), config).collect() == []


def test_one_agent_is_spread_over_tasks(spark):
    rows = [(i, i, "", 0, False) for i in range(6000)]
    out = backlog.bound_large_backlog(frame(spark, rows), ForwardConfig(4000, 3000), ranges=24)
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "24"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        sizes = [r["count"] for r in out.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 6000 and len(sizes) > 8 and max(sizes) < 6000 / 4
    assert told(out) == told(backlog.bound_backlog(frame(spark, rows), F.lit(0), ForwardConfig(4000, 3000)))


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_an_interval_over_several_frames(spark, seed):
    config = ForwardConfig(20, 6)
    rows = random_rows(seed, 300, 7, 3)
    want = told(backlog.bound_backlog(frame(spark, rows), "b", config))
    got, carried = {}, None
    for a, b in ((0, 70), (70, 75), (75, 210), (210, 300)):
        bounded = backlog.bound_large_backlog(frame(spark, rows[a:b]), config, "b", 5, carried)
        got |= told(bounded)
        carried = spark.createDataFrame(backlog.carry_on(bounded, carried).collect(), "batch int, agent_id string, alive long, queued long, last long")
    assert got == want
