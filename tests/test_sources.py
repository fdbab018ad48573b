"""Bounded sources: replay by reuse distance, and the scan of recency lists, against the sequential model."""

import random
import time
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisade.config import GateConfig, LimiterConfig
from palisade.operators import limiter
from palisade.plans.pipeline import run_batch
from palisade.schemas import DATAGRAM


def sequential(sources, keep, held=()):
    held, out = OrderedDict((s, None) for s in held), []
    for s in sources:
        out.append(s not in held)
        held[s] = None
        held.move_to_end(s)
        if len(held) > keep:
            held.popitem(last=False)
    return out, list(held)


def test_larger_before():
    rng = np.random.default_rng(1)
    for n in [0, 1, 2, 3, 5, 8, 9, *rng.integers(10, 70, 60)]:
        x = rng.permutation(n * 3)[:n].astype(np.int64)
        assert limiter.larger_before(x).tolist() == [int((x[:i] > x[i]).sum()) for i in range(n)]


def replayed(rows, keep, size, names=("chunk", "src_ip", "src_port", "start", "seen", "payload")):
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), kinds)], names=list(names)) for i in range(0, len(rows), size)]
    return [x for b in limiter.replay_kernel(keep)(iter(batches)) for x in zip(b.column("payload").to_pylist(), b.column("resident_miss").to_pylist())]


def test_replay_equals_the_sequential_model(monkeypatch):
    rng = random.Random(4)
    for case in range(1500):
        monkeypatch.setattr(limiter, "REPLAYED", (rng.choice([1, 4, 30]), rng.choice([30, 60])))
        keep, pool, rows, want = rng.randint(1, 8), rng.randint(1, 14), [], []
        for chunk in range(rng.randint(1, 3)):
            start = rng.sample(range(pool), rng.randint(0, min(keep, pool)))
            rows += [(chunk, s, 7, True, True, None) for s in start]
            own = [(rng.randrange(pool), rng.random() > 0.1) for _ in range(rng.randint(0, 40))]
            missed = iter(sequential([s for s, seen in own if seen], keep, start)[0])
            for s, seen in own:
                rows.append((chunk, s, 7, False, seen, len(want)))
                want.append((len(want), next(missed) if seen else None))
        assert replayed(rows, keep, rng.randint(1, 25)) == want, case


def test_replay_of_a_million_rows():
    rng = np.random.default_rng(3)
    n, keep = 1_000_000, 1024
    ip = rng.zipf(1.2, n).clip(0, 50_000)
    columns = [pa.array(np.zeros(n, np.int32)), pa.array(ip), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, bool)), pa.array(np.ones(n, bool)), pa.array(np.arange(n))]
    whole = pa.RecordBatch.from_arrays(columns, names=["chunk", "src_ip", "src_port", "start", "seen", "payload"])
    began = time.process_time()
    got = np.concatenate([b.column("resident_miss").to_numpy(zero_copy_only=False) for b in limiter.replay_kernel(keep)(iter([whole.slice(i, 10_000) for i in range(0, n, 10_000)]))])
    assert time.process_time() - began < 30
    assert got.tolist() == sequential(ip.tolist(), keep)[0]


def stream_of(spark, n, pool, seed=2):
    rng = random.Random(seed)
    rows = [(i, i // 3, rng.randrange(pool) if rng.random() < 0.7 else 0, rng.randint(0, 1), None) for i in range(n)]
    return rows, spark.createDataFrame(rows, DATAGRAM)


@pytest.mark.parametrize("chunks", [1, 2, 40, 2000])
def test_any_number_of_chunks_equals_the_sequential_model(spark, chunks):
    keep = 9
    rows, df = stream_of(spark, 4000, 30)
    missed, held = sequential([r[2:4] for r in rows], keep)
    got = limiter.source_residency(df.repartition(5), LimiterConfig(keep), chunks=chunks).orderBy("datagram_id").collect()
    assert [r["resident_miss"] for r in got] == missed
    assert {tuple(r)[:2] for r in limiter.tracked_sources(df, LimiterConfig(keep)).collect()} == set(held)


def test_rows_handed_on_by_the_scan(spark):
    keep, chunks = 9, 200
    _, df = stream_of(spark, 4000, 30)
    bounds = limiter.arrival_bounds(df, chunks, 4000)
    last = limiter.numbered(df.select(*limiter.SOURCE, *limiter.ARRIVAL), bounds).groupBy("chunk", *limiter.SOURCE).agg(F.max(F.struct(*limiter.ARRIVAL)).alias("at"))
    last = limiter.newest(last, "chunk", keep).select("chunk", *limiter.SOURCE, "at.*")
    starts = limiter.starts_of(last, len(bounds) + 1, keep)
    assert last.count() + starts.count() <= 3 * (len(bounds) + 1) * keep
    assert starts.groupBy("chunk").count().agg(F.max("count")).first()[0] == keep


def test_sources_remembered_from_before(spark):
    keep = 9
    rows, df = stream_of(spark, 1500, 30)
    before = [(r, 0) for r in range(20, 29)]
    known = spark.createDataFrame([(*s, i) for i, s in enumerate(before)], "src_ip long, src_port int, pos long")
    missed, _ = sequential([r[2:4] for r in rows], keep, before)
    got = limiter.residency(df.withColumns({"drop_stage": F.lit(None).cast("string"), "drop_reason": F.lit(None).cast("string")}), LimiterConfig(keep), 11, known=known)
    assert [r["resident_miss"] for r in got.orderBy("datagram_id").collect()] == missed


def test_payloads_are_scanned_once_by_the_plan(spark, tmp_path):
    rows = [(i, i * 10, i % 10_000, 1, bytearray(b"x")) for i in range(12_000)]
    spark.createDataFrame(rows, DATAGRAM).write.parquet(f"{tmp_path}/d")
    ledger = run_batch(spark.read.schema(DATAGRAM).parquet(f"{tmp_path}/d"), GateConfig()).ledger
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert sum("payload" in line for line in scans) == 1 and f"{tmp_path}/d" in plan
    assert ledger.filter("resident_miss").count() == 12_000
