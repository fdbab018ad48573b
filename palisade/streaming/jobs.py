"""The gate on live streams: the same row stages, a limiter with bounded state, and counters and quotas by interval."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palisade.config import GateConfig, LimiterConfig
from palisade.operators.backlog import bound_large_backlog, carry_on
from palisade.operators.envelope import size_gate
from palisade.operators.limiter import UNIT, admit_run, limit_onwards, remembered
from palisade.operators.stats import COUNTERS, _counters, pipeline_stats
from palisade.plans.pipeline import LEDGER, row_stages
from palisade.reasons import open_outcome, outcome
from palisade.sources.datagrams import write_drops, write_events
from palisade.sources.shared import folders, remove, scratch


#: A bucket's state: a source's tokens and last arrival, and the latest arrival seen among the sources kept with it.
STATE = "ips array<long>, ports array<long>, tokens array<long>, last array<long>, clock long"


def rate_limit_stream(df: DataFrame, config: LimiterConfig = LimiterConfig(), delay_ms: int = 600_000, groups: int = 4096) -> DataFrame:
    """Add ``admitted`` to a stream; every row comes out again, however late it is.

    Sources are dealt to ``groups`` groups by hash, and a group's state holds two numbers a source. A source goes from it
    once it was idle, by the arrivals of its group, until its bucket must be full again and ``delay_ms`` longer: so state
    is bounded by the sources active in that time, and forgetting one changes nothing unless a row is later than that
    (such a row may find a full bucket). No watermark is needed, as Spark would take rows behind it away unseen. Rows in
    a trigger may come in any order; a row older than its source's last one in an earlier trigger adds no tokens.
    Forgetting an active source because of too many others, as the batch limiter does, has no counterpart here.

    This is for a limiter alone in a stream; ``start_stream`` limits by a kernel past which rows stream. Here a group's
    rows of one trigger are held together, without the payloads of rows dropped before: bound a trigger's size
    at the source (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``).
    """
    idle_us = int(np.ceil(config.burst_tokens * UNIT / max(config.tokens_per_sec, 1))) + 1 + delay_ms * 1000
    df = open_outcome(df)
    if "payload" in df.columns:
        df = df.withColumn("payload", F.when(F.col("drop_reason").isNull(), F.col("payload")))
    df = df.withColumns({"src_ip": F.col("src_ip").cast("long"), "_group": F.pmod(F.xxhash64("src_ip", "src_port"), F.lit(groups))})
    schema = T.StructType([*(f for f in df.schema.fields if f.name != "_group"), T.StructField("admitted", T.BooleanType())])

    def admit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, clock = {}, -(1 << 62)
        if state.exists:
            *columns, clock = state.get
            known = {(ip, port): (tokens, last) for ip, port, tokens, last in zip(*columns)}
        rows = pd.concat(list(parts), ignore_index=True).drop(columns="_group")
        rows["admitted"] = pd.Series(None, rows.index, "object")
        # the bucket does not see what an earlier stage dropped
        thin = rows.loc[rows["drop_reason"].isna(), ["src_ip", "src_port", "received_at_us", "datagram_id"]].fillna(-1).astype(np.int64)
        for source, own in thin.sort_values(["received_at_us", "datagram_id"]).groupby(["src_ip", "src_port"]):
            times = own["received_at_us"].to_numpy()
            tokens, last = known.get(source, (config.burst_tokens * UNIT, int(times[0])))
            # a row older than the last one adds no tokens
            rows.loc[own.index, "admitted"], tokens, now = admit_run(np.maximum(times, last), tokens, last, config)
            known[source] = tokens, now
            clock = max(clock, now)
        kept = [(*source, *bucket) for source, bucket in known.items() if bucket[1] + idle_us > clock]
        if kept:
            state.update((*(list(map(int, c)) for c in zip(*kept)), clock))
        elif state.exists:
            state.remove()
        yield rows

    limited = df.groupBy("_group").applyInPandasWithState(admit, schema, STATE, "append", GroupStateTimeout.NoTimeout)
    return outcome(limited, "source_limit", F.when(~F.col("admitted"), F.lit("SourceLimited")))


def event_stream(datagrams: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """Stateless gates on a live stream: rows with event or drop. What is late or early by its own stamp is a counted
    drop; ``event_ts`` of the others can carry a watermark of the window's width."""
    df = row_stages(size_gate(open_outcome(datagrams), config.recv), config)
    stamp = F.coalesce("metrics_ts", "log_ts").cast("long")
    ledger = [F.lit(None).cast("boolean").alias(c) if c in ("admitted", "resident_miss") and c not in df.columns else F.col(c) for c in LEDGER]
    return df.select(*ledger, F.when(F.col("drop_reason").isNull(), F.timestamp_millis(stamp)).alias("event_ts"))


def live_stats(ledger: DataFrame, interval: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Counters by interval of arrival, closed once the watermark has passed."""
    timed = ledger.withColumn("arrival", F.timestamp_micros("received_at_us")).withWatermark("arrival", delay)
    each = timed.groupBy(F.window("arrival", interval).alias("w")).agg(*(c.alias(name) for name, c in _counters().items()))
    return each.select(F.unix_micros("w.start").alias("start_us"), *_counters())


def event_counts(ledger: DataFrame, interval: str = "1 minute", delay: str = "6 minutes") -> DataFrame:
    """Events by type and interval of their own stamps. An accepted stamp is at most five minutes behind its arrival and
    one ahead of it, so a watermark of six minutes loses none of what arrives in order."""
    timed = ledger.filter(F.col("event_ts").isNotNull()).withWatermark("event_ts", delay)
    each = timed.groupBy(F.window("event_ts", interval).alias("w"), "event_type").agg(F.count("*").alias("n_events"))
    return each.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n_events")


Sink = Callable[[DataFrame, int], None]


def file_sink(events_path: str, drops_path: str) -> Sink:
    """Events and drops as files. Each trigger's carry its number, so that one that is run again writes over its own."""

    def write(bounded: DataFrame, number: int) -> None:
        write_events(bounded.filter(F.col("drop_reason").isNull()), f"{events_path}/trigger={number}", mode="overwrite")
        write_drops(bounded, f"{drops_path}/trigger={number}", mode="overwrite")

    return write


#: What a stream's state holds: sources' buckets, the sources remembered, intervals begun, and totals.
STATE_KINDS = {
    "buckets": "src_ip long, src_port int, tokens long, last long",
    "known": "src_ip long, src_port int, pos long",
    "begun": "batch long, agent_id string, alive long, queued long, last long",
    "totals": ", ".join(f"{name} long" for name in COUNTERS),
}


class Versions:
    """A stream's state in its checkpoint folder. A trigger reads the version that the one before has left and writes its
    own; one that is run again reads the same and writes over what it has left. So the last two versions are kept."""

    def __init__(self, spark: SparkSession, checkpoint: str):
        self.spark, self.path = spark, f"{checkpoint.rstrip('/')}/state"

    def read(self, kind: str, number: int) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], STATE_KINDS[kind])
        return self.spark.read.schema(STATE_KINDS[kind]).parquet(f"{self.path}/version={number}/{kind}")

    def write(self, kind: str, number: int, rows: DataFrame) -> None:
        rows.coalesce(1 if kind in ("known", "totals") else 16).write.mode("overwrite").parquet(f"{self.path}/version={number}/{kind}")

    def forget_before(self, number: int) -> None:
        for name in folders(self.spark, self.path):
            if name.startswith("version=") and int(name.removeprefix("version=")) < number:
                remove(self.spark, f"{self.path}/{name}")

    def last(self) -> int:
        """The last version that its trigger has ended; -1 if there is none."""
        ended = {int(n) for n in folders(self.spark, f"{self.path.removesuffix('/state')}/commits") if n.isdigit()}
        return max((int(n.removeprefix("version=")) for n in folders(self.spark, self.path) if n.startswith("version=") and int(n.removeprefix("version=")) in ended), default=-1)


def live_totals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """One row of counters over all triggers that a stream of ``start_stream`` has ended, running or not; a stream that is
    started again goes on from them."""
    versions = Versions(spark, checkpoint)
    held = versions.read("totals", versions.last())
    return held.agg(*(F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in COUNTERS))


def start_stream(
    datagrams: DataFrame, sink: Sink, checkpoint: str, config: GateConfig = GateConfig(), trigger: dict | None = None, delay_ms: int = 600_000, batch: Column | None = None
) -> StreamingQuery:
    """The whole gate. ``sink`` gets each trigger's ledger and number.

    A trigger is limited as a batch is, from the buckets of the sources remembered, ``max_sources`` at most, and their order:
    a source that was forgotten, in this trigger or an earlier one, comes back with a full bucket. A trigger is a drain
    interval, or, with ``batch`` (a number of each row, such as the second of its arrival), intervals go on from one
    trigger to the next: an interval's quotas and places are what earlier triggers have left. It is forgotten ``delay_ms``
    after its last row, by arrival; a row that comes later still is counted, and begins it anew. Rows of a trigger may come
    in any order; those of a later trigger stand behind it. Totals: ``live_totals``.
    """
    spark = datagrams.sparkSession
    versions = Versions(spark, checkpoint)

    def drain(rows: DataFrame, number: int) -> None:
        held = []

        def once(df: DataFrame) -> DataFrame:
            held.append(df.persist())
            return df

        with scratch(spark):
            try:
                before = {kind: versions.read(kind, number - 1) for kind in STATE_KINDS}
                limited = limit_onwards(size_gate(open_outcome(rows), config.recv), before["buckets"], config.limiter, before["known"])
                thin = once(row_stages(limited, config).select(*LEDGER, "carried"))
                ledger = thin.filter("carried is null").drop("carried")
                known = once(remembered(ledger, before["known"], config.limiter))
                versions.write("known", number, known)
                buckets = thin.filter("carried is not null").select("src_ip", "src_port", F.col("carried").alias("tokens"), F.col("received_at_us").alias("last"))
                versions.write("buckets", number, buckets.join(known, ["src_ip", "src_port"], "left_semi"))
                if batch is None:
                    bounded = once(bound_large_backlog(ledger, config.forward))
                    begun = before["begun"]
                else:
                    bounded = once(bound_large_backlog(ledger, config.forward, batch.cast("long"), carried=before["begun"]))
                    begun = once(carry_on(bounded, before["begun"]))
                    clock = begun.agg(F.max("last").alias("clock"))
                    begun = begun.join(F.broadcast(clock)).filter(F.col("last") + delay_ms * 1000 >= F.col("clock")).drop("clock")
                versions.write("begun", number, begun)
                now = pipeline_stats(bounded).unionByName(before["totals"])
                versions.write("totals", number, now.agg(*(F.sum(name).alias(name) for name in COUNTERS)))
                sink(bounded, number)
            finally:
                for df in held:
                    df.unpersist()
        versions.forget_before(number - 1)

    return datagrams.writeStream.foreachBatch(drain).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
