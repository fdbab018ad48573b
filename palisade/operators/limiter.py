"""Per-source token bucket in arrival order, with a bound on remembered sources.

Tokens are counted in millionths, so that microseconds times a whole rate are exact. A source's rows are put in order by
one shuffle and a sort; the kernel then streams over Arrow batches and carries two numbers from row to row, so a source
that floods needs no memory of its own. Rows that an earlier stage dropped stand among them and are not seen by it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from palisade.config import LimiterConfig
from palisade.reasons import open_outcome, outcome
from palisade.sources.shared import written

UNIT = 1_000_000
SOURCE = ("src_ip", "src_port")
ARRIVAL = ("received_at_us", "datagram_id")
#: Arrivals sampled for each range of arrival; rows of a range, and how many ranges there are.
SAMPLED, CHUNK_ROWS, LEAST_CHUNKS, MOST_CHUNKS = 50, 1 << 22, 16, 1 << 14


def fill(tokens: int, passed_us: int, config: LimiterConfig) -> int:
    return min(config.burst_tokens * UNIT, tokens + max(0, passed_us) * config.tokens_per_sec)


def admit_run(times: np.ndarray, tokens: int, last: int, config: LimiterConfig) -> tuple[np.ndarray, int, int]:
    """Which of one source's packets (at ascending ``times``) pass a bucket, and the bucket after them.

    While no packet is refused, the tokens before packet n are ``u[n] + min(tokens, cap - max(u[:n+1]))`` with
    ``u[n] = rate * (t[n] - last) - n * UNIT``: one running maximum finds the next refusal. After one, a search finds
    the first packet by which a whole token has come together. Pieces grow while none is refused.
    """
    n, cap, rate = len(times), config.burst_tokens * UNIT, config.tokens_per_sec
    out = np.zeros(n, bool)
    at, piece = 0, 64
    while at < n:
        now = times[at : at + piece]
        # an idle gap fills the bucket; longer gaps change nothing and could overflow
        gaps = np.diff(now, prepend=last).clip(0, cap // max(rate, 1) + 1)
        u = rate * np.cumsum(gaps) - np.arange(len(now)) * UNIT
        have = u + np.minimum(tokens, cap - np.maximum.accumulate(u))
        refused = np.flatnonzero(have < UNIT)
        ok = int(refused[0]) if len(refused) else len(now)
        out[at : at + ok] = True
        if ok == len(now):
            tokens, last, at, piece = int(have[-1]) - UNIT, int(now[-1]), at + ok, piece * 2
            continue
        tokens, last, at, piece = int(have[ok]), int(now[ok]), at + ok, 64
        wait = -(-(UNIT - tokens) // rate) if rate and cap >= UNIT else None
        stop = n if wait is None else at + int(np.searchsorted(times[at:], last + wait, side="left"))
        if stop > at + 1:
            tokens, last = fill(tokens, int(times[stop - 1]) - last, config), int(times[stop - 1])
        at = stop
    return out, tokens, last


def bucket_kernel(config: LimiterConfig, keys: tuple[str, ...], missed: bool):
    """Arrow kernel over rows sorted by ``keys`` and then arrival, with ``seen``: appends ``admitted`` (null if not
    seen). Where ``missed``, a row with ``resident_miss`` finds a full bucket; else that column is appended, and is true
    for the first row that is seen of a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, started, tokens, last = None, False, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [pc.fill_null(batch.column(k), -1).to_numpy(zero_copy_only=False) for k in keys]
            seen = batch.column("seen").to_numpy(zero_copy_only=False)
            times = pc.fill_null(batch.column(ARRIVAL[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.zeros(n, bool)
            new[0] = tuple(c[0] for c in columns) != held
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            if missed:
                miss = pc.fill_null(batch.column("resident_miss"), False).to_numpy(zero_copy_only=False)
            else:
                # the first row of each key's that is seen
                part = np.cumsum(new)
                rank = np.cumsum(seen) - seen
                before = np.concatenate([[0], rank[new]])
                miss = seen & (rank == before[part]) & ((part > 0) | (not started))
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(new | miss), [n]]))
            admitted = np.zeros(n, bool)
            for a, b in zip(cuts, cuts[1:]):
                own = times[a:b][seen[a:b]]
                if new[a]:
                    started = False
                if len(own):
                    if miss[a] or not started:
                        tokens, last, started = config.burst_tokens * UNIT, int(own[0]), True
                    admitted[a:b][seen[a:b]], tokens, last = admit_run(own, tokens, last, config)
            held = tuple(c[-1] for c in columns)
            if "segment" in keys:
                miss = miss & (columns[keys.index("segment")] == 1)  # a source's later segments go on with it
            more = [] if missed else [pa.array(miss, mask=~seen)]
            names = [c for c in batch.schema.names if c not in ("seen", "segment")]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, *more, pa.array(admitted, mask=~seen)], names=[*names, *("resident_miss",)[: len(more)], "admitted"])

    return run


def carry_kernel(config: LimiterConfig):
    """Arrow kernel over rows sorted by source, ``carried`` (nulls last) and arrival, with ``seen``: the rows with
    ``admitted``, and after each source's one that carries its bucket on. A row with ``carried`` is what was carried from
    before: that many tokens at its arrival. A row that is older than the bucket's last one adds no tokens, and one with
    ``resident_miss`` finds a full bucket; where that is null, it becomes true for a source's first row if nothing was
    carried."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, started, tokens, last, schema = None, False, 0, 0, None

        def carry(buckets: list[tuple]) -> pa.RecordBatch:
            columns = dict(zip((*SOURCE, "carried", ARRIVAL[0]), zip(*buckets)))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(len(buckets), f.type) for f in schema], schema=schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            columns = [pc.fill_null(batch.column(k), -1).to_numpy(zero_copy_only=False) for k in SOURCE]
            seen, is_carried = batch.column("seen").to_numpy(zero_copy_only=False), batch.column("carried").is_valid().to_numpy(zero_copy_only=False)
            times = pc.fill_null(batch.column(ARRIVAL[0]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            cuts = np.unique(np.concatenate([[0], *(np.flatnonzero(c[1:] != c[:-1]) + 1 for c in columns), [n]])).astype(np.int64)
            admitted, done = np.zeros(n, bool), []
            place = batch.schema.get_field_index("resident_miss")
            told = batch.column(place).is_valid().to_numpy(zero_copy_only=False)
            miss = pc.fill_null(batch.column(place), False).to_numpy(zero_copy_only=False).copy()
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(int(c[a]) for c in columns)
                if key != held:
                    if started:
                        done.append((*held, tokens, last))
                    held, started = key, False
                for i in np.flatnonzero(is_carried[a:b]) + a:
                    tokens, last, started = batch.column("carried")[int(i)].as_py(), int(times[i]), True
                mine = seen[a:b] & ~is_carried[a:b]
                own = np.flatnonzero(mine) + a
                if not len(own):
                    continue
                if not started and not told[own[0]]:
                    miss[own[0]] = True
                fresh = np.flatnonzero(miss[own])
                for x, y in zip([0, *fresh], [*fresh, len(own)]):
                    if x == y:
                        continue
                    run = times[own[x:y]]
                    if miss[own[x]] or not started:
                        tokens, last, started = config.burst_tokens * UNIT, int(run[0]), True
                    admitted[own[x:y]], tokens, last = admit_run(np.maximum(run, last), tokens, last, config)
            columns = list(batch.columns)
            columns[place] = pa.array(miss, mask=~seen)
            out = pa.RecordBatch.from_arrays([*columns, pa.array(admitted, mask=~seen)], names=[*batch.schema.names, "admitted"])
            schema = out.schema
            yield out.filter(pa.array(~is_carried))
            if done:
                yield carry(done)
        if started:
            yield carry([(*held, tokens, last)])

    return run


def limit_onwards(df: DataFrame, buckets: DataFrame, config: LimiterConfig = LimiterConfig(), known: DataFrame | None = None) -> DataFrame:
    """One trigger's rows limited from ``buckets`` (src_ip, src_port, tokens, last), for streams: the rows with
    ``admitted`` and ``resident_miss``, and rows with ``carried`` (not null; null for the others) that hold each source's
    tokens and last arrival from now on. A source's rows stream past two numbers, as in ``rate_limit``.

    ``known`` (src_ip, src_port, pos), if given: the sources remembered from before, whose ``buckets`` are given too. Then
    no more than ``max_sources`` are remembered at any row, as in ``rate_limit``."""
    df = typed(open_outcome(df))
    if known is not None and more_sources(seen := sights(df), config, known):
        df = residency(df, config, seen=seen, known=known)
    elif "resident_miss" not in df.columns:
        df = df.withColumn("resident_miss", F.lit(None).cast("boolean"))
    rows = df.withColumns({"seen": F.col("drop_reason").isNull(), "carried": F.lit(None).cast("long")})
    held = buckets.select(*SOURCE, F.col("tokens").alias("carried"), F.col("last").alias(ARRIVAL[0]), F.lit(True).alias("seen"))
    both = rows.unionByName(held, allowMissingColumns=True).repartition(*SOURCE).sortWithinPartitions(*SOURCE, F.col("carried").asc_nulls_last(), *ARRIVAL)
    fields = [T.StructField(f.name, f.dataType) for f in both.schema.fields]  # rows that carry buckets have nothing else
    limited = both.mapInArrow(carry_kernel(config), T.StructType([*fields, T.StructField("admitted", T.BooleanType())]))
    return outcome(limited.drop("seen"), "source_limit", F.when(~F.col("admitted"), F.lit("SourceLimited")))


def remembered(limited: DataFrame, known: DataFrame, config: LimiterConfig = LimiterConfig()) -> DataFrame:
    """(src_ip, src_port, pos): the sources remembered after ``limited`` rows that follow those of ``known``, the one seen
    last having the largest pos."""
    now = limited.filter("admitted is not null").groupBy(*SOURCE).agg(F.max(F.struct(*ARRIVAL)).alias("at"))
    before = known.select(*SOURCE, F.struct(F.lit(-(1 << 63)).alias(ARRIVAL[0]), F.col("pos").alias(ARRIVAL[1])).alias("at"))
    kept = now.unionByName(before).groupBy(*SOURCE).agg(F.max("at").alias("at")).orderBy(F.desc("at")).limit(config.max_sources)
    return kept.select(*SOURCE, F.row_number().over(W.orderBy("at")).cast("long").alias("pos"))


def idle_segments(df: DataFrame, config: LimiterConfig) -> DataFrame:
    """Add ``segment``, which a source's rows change (counted from 1) where it was idle for so long before that its bucket
    is full again. Arrival is cut into cells as long as a bucket takes to fill: after a cell without any of a source's
    rows a new segment begins. The cells are counted before rows are shuffled, so a flood costs one row a cell."""
    cell = F.floor(F.col(ARRIVAL[0]) / F.lit(-(-config.burst_tokens * UNIT // max(config.tokens_per_sec, 1)))).cast("long")
    df = df.withColumn("_cell", cell)
    order = W.partitionBy(*SOURCE).orderBy("_cell")
    cells = df.filter("seen").select(*SOURCE, "_cell").distinct()
    cells = cells.withColumn("_new", F.coalesce((F.col("_cell") - F.lag("_cell").over(order) > 1).cast("int"), F.lit(1)))
    cells = cells.select(*SOURCE, "_cell", F.sum("_new").over(order).cast("long").alias("segment"))
    return df.join(cells, [*SOURCE, "_cell"], "left").drop("_cell")


def rate_limit(df: DataFrame, config: LimiterConfig = LimiterConfig(), bounded: bool = True, split_idle: bool = False, many: bool | None = None) -> DataFrame:
    """Add ``admitted`` and ``resident_miss``, and drop what is refused. Rows dropped before (by the size gate) are not
    seen by the bucket.

    ``bounded``: with more than ``max_sources`` sources, one that was forgotten comes back with a full bucket. Whether there
    are so ``many`` is counted where it is not said, over sources and arrivals written once (``sights``). ``split_idle``: a source's rows may go to several tasks, cut
    where it was idle; worth one more shuffle where single sources flood.
    """
    df = open_outcome(df)
    seen = sights(df) if bounded and many is not False else None
    missed = seen is not None and (many or more_sources(seen, config))
    if missed:
        df = residency(df, config, seen=seen)
    df = df.withColumn("seen", F.col("drop_reason").isNull())
    keys = SOURCE
    if split_idle and config.tokens_per_sec:
        df, keys = idle_segments(df, config), (*SOURCE, "segment")
    ordered = df.repartition(*map(F.col, keys)).sortWithinPartitions(*keys, *ARRIVAL)
    added = ("admitted",) if missed else ("resident_miss", "admitted")
    kept = [f for f in df.schema.fields if f.name not in ("seen", "segment")]
    limited = ordered.mapInArrow(bucket_kernel(config, keys, missed), T.StructType([*kept, *(T.StructField(c, T.BooleanType()) for c in added)]))
    return outcome(limited, "source_limit", F.when(~F.col("admitted"), F.lit("SourceLimited")))


def number_kernel(bounds: list[tuple[int, int]]):
    """Arrow kernel that appends ``chunk``: how many of the ascending ``bounds`` (time, id) are below a row's arrival."""
    times, ids = (np.array([b[i] for b in bounds], np.int64) for i in range(2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t, i = (pc.fill_null(batch.column(c), -(1 << 63)).to_numpy(zero_copy_only=False) for c in ARRIVAL)
            is_bound = np.repeat([1, 0], [len(times), len(t)])
            order = np.lexsort((is_bound, np.concatenate([ids, i]), np.concatenate([times, t])))
            chunk = np.empty(len(order), np.int32)
            chunk[order] = np.cumsum(is_bound[order])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunk[len(times) :])], names=[*batch.schema.names, "chunk"])

    return run


def numbered(rows: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """Add ``chunk``, the range of arrival between ``bounds`` that a row lies in."""
    return rows.mapInArrow(number_kernel(bounds), T.StructType([*rows.schema.fields, T.StructField("chunk", T.IntegerType())]))


def arrival_bounds(df: DataFrame, chunks: int, rows: int) -> list[tuple[int, int]]:
    """At most ``chunks`` - 1 arrivals (time, id) that cut ``rows`` rows into like parts, from a sample by hash."""
    part = min(1_000_000, -(-SAMPLED * chunks * 1_000_000 // max(rows, 1)))
    known = df.select(*ARRIVAL).dropna().filter(F.pmod(F.xxhash64(*ARRIVAL), F.lit(1_000_000)) < part)
    found = sorted({tuple(r) for r in known.collect()})
    return sorted({found[len(found) * i // chunks] for i in range(1, chunks)}) if found else []


def larger_before(values: np.ndarray) -> np.ndarray:
    """For each of different numbers, how many of those before it are larger: their range is halved bit by bit, and in
    each half-open range those of the upper half that stand before one of the lower half are counted."""
    n = len(values)
    rank = np.empty(n, np.int64)
    rank[np.argsort(values)] = np.arange(n)
    out, at, index = np.zeros(n, np.int64), np.arange(n), np.arange(n)  # at: who stands where, by range and then in order
    for bit in reversed(range(max(n - 1, 0).bit_length())):
        value = rank[at]
        upper = value >> bit & 1
        first = np.concatenate([[0], np.flatnonzero(np.diff(value >> bit + 1)) + 1])
        size = np.diff(np.append(first, n))
        ones = np.cumsum(upper)
        start = np.repeat(first, size)
        seen = ones - np.repeat(ones[first] - upper[first], size)
        lower = upper == 0
        out[at[lower]] += seen[lower]
        zeros = np.repeat(size - np.add.reduceat(upper, first), size)
        place = np.where(lower, index - seen, start + zeros + seen - 1)
        moved = np.empty_like(at)
        moved[place] = at
        at = moved
    return out


def codes_of(ip: np.ndarray, port: np.ndarray) -> np.ndarray:
    """One number for each source."""
    ips, a = np.unique(ip, return_inverse=True)
    ports, b = np.unique(port, return_inverse=True)
    return a.astype(np.int64) * len(ports) + b


def reuse_distance(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many other sources were seen since a row's source was seen last (-1: never), and the last row of each source
    in order. Of the rows since then, those count whose source is not seen again before this row; that a later pair of
    sights lies inside an earlier one is what ``larger_before`` counts."""
    order = np.argsort(codes, kind="stable")
    same = codes[order][1:] == codes[order][:-1]
    before = np.full(len(codes), -1, np.int64)
    before[order[1:][same]] = order[:-1][same]
    again = np.flatnonzero(before >= 0)
    out = np.full(len(codes), -1, np.int64)
    out[again] = again - before[again] - 1 - larger_before(before[again])
    last = np.ones(len(codes), bool)
    last[before[again]] = False
    return out, np.flatnonzero(last)


#: Rows that a replay works out at once, at least and at most: in this range as many as sources are remembered.
REPLAYED = 1 << 14, 1 << 16


def replay_kernel(keep: int):
    """Arrow kernel over rows in order of chunk, ``start`` first, and arrival: the rows that are no start, with whether
    their source was forgotten (null for rows dropped before). A source is remembered as long as fewer than ``keep`` others
    were seen since; the kernel holds ``keep`` sources and the rows it works out at once."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now, known = [], 0, None, (none, none)

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal now, known
            column = lambda c, null: np.concatenate([pc.fill_null(b.column(c), null).to_numpy(zero_copy_only=False) for b in held])
            chunk, ip, port = (column(c, -1).astype(np.int64) for c in ("chunk", *SOURCE))
            is_start, seen = column("start", False), column("seen", False)
            missed = np.zeros(len(chunk), bool)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]])
            for a, b in zip(cuts, cuts[1:]):
                if chunk[a] != now:
                    now, known = chunk[a], (none, none)
                own = np.flatnonzero(seen[a:b]) + a
                ips, ports = (np.concatenate([k, c[own]]) for k, c in zip(known, (ip, port)))
                distance, last = reuse_distance(codes_of(ips, ports))
                distance = distance[len(known[0]) :]
                missed[own] = (distance < 0) | (distance >= keep)
                known = ips[last[-keep:]], ports[last[-keep:]]
            at = 0
            for batch in held:
                here = slice(at, at + batch.num_rows)
                at += batch.num_rows
                names = [c for c in batch.schema.names if c not in ("chunk", "start", "seen")]
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(missed[here], mask=~seen[here])], names=[*names, "resident_miss"])
                yield out.filter(pa.array(~is_start[here]))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= min(max(keep, REPLAYED[0]), REPLAYED[1]):
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


RECENT = "item int, src_ip long, src_port int, time long, id long"


def recent_before(keep: int):
    """Arrow kernel over rows (grp, item, source, time, id) in order of grp and item, an item being a list of sources with
    when each was seen last: for each item from 0 on, the ``keep`` sources seen last in the items of its group before it. It
    holds one such list and an item."""
    none = np.zeros(0, np.int64)

    def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        both = np.concatenate([a, b], axis=1)  # rows: ip, port, time, id
        both = both[:, np.lexsort((both[3], both[2], both[1], both[0]))]
        newest = np.append((both[:2, 1:] != both[:2, :-1]).any(0), True)[: both.shape[1]]
        both = both[:, newest]
        return both[:, np.lexsort((both[3], both[2]))[-keep:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, parts = None, np.stack([none] * 4), []

        def told(item: int) -> pa.RecordBatch:
            columns = np.full(known.shape[1], item, np.int32), known[0], known[1].astype(np.int32), known[2], known[3]
            return pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["item", *SOURCE, "time", "id"])

        for batch in batches:
            rows = np.stack([pc.fill_null(batch.column(c), -1 if c < 4 else -(1 << 63)).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(6)])
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(rows[:2], axis=1) != 0).any(0)) + 1, [rows.shape[1]]])
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if (now := tuple(rows[:2, a])) != at:
                    if parts:
                        known = merged(known, np.concatenate(parts, axis=1))
                    if at is None or now[0] != at[0]:
                        known = np.stack([none] * 4)
                    at, parts = now, []
                    if now[1] >= 0:
                        yield told(now[1])
                parts.append(rows[2:, a:b])

    return run


def starts_of(last: DataFrame, chunks: int, keep: int) -> DataFrame:
    """(chunk, src_ip, src_port, received_at_us, datagram_id): the ``keep`` sources seen last before each of ``chunks``
    chunks; ``last`` (chunk, source, arrival) has those of each chunk alone, the newest ``keep`` at most.

    A prefix scan in two levels: chunks are put into blocks, blocks' lists are run through one after the other, and each
    block's chunks then likewise, all blocks at once. So 3 * chunks * keep rows are handed on at most.
    """
    wide = math.isqrt(max(chunks - 1, 0)) + 1
    item = lambda grp, number: (grp.alias("grp"), number.cast("int").alias("item"), *SOURCE, F.col(ARRIVAL[0]).alias("time"), F.col(ARRIVAL[1]).alias("id"))
    block = F.floor(F.col("chunk") / wide).cast("int")
    ahead = last.groupBy(block.alias("block"), *SOURCE).agg(F.max(F.struct(*ARRIVAL)).alias("at"))
    ahead = newest(ahead, "block", keep).select(F.lit(0).alias("grp"), F.col("block").alias("item"), *SOURCE, F.col("at.received_at_us").alias("time"), F.col("at.datagram_id").alias("id"))
    before = ahead.repartition(1).sortWithinPartitions("item").mapInArrow(recent_before(keep), RECENT)
    before = before.select(F.col("item").alias("grp"), F.lit(-1).alias("item"), *SOURCE, "time", "id")
    both = before.unionByName(last.select(*item(block, F.col("chunk"))))
    scanned = both.repartition("grp").sortWithinPartitions("grp", "item").mapInArrow(recent_before(keep), RECENT)
    return scanned.select(F.col("item").alias("chunk"), *SOURCE, F.col("time").alias(ARRIVAL[0]), F.col("id").alias(ARRIVAL[1]))


def newest(rows: DataFrame, by: str, keep: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("at")))).filter(F.col("_r") <= keep).drop("_r")


def typed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in zip((*SOURCE, *ARRIVAL), ("long", "int", "long", "long"))})


def sights(df: DataFrame) -> DataFrame:
    """Source and arrival of the rows that the limiter sees, written once: all that is to be known of a table before its
    rows are limited is read from these, so payloads are read for them and for the rows themselves only."""
    return written(typed(df).filter("drop_reason is null").select(*SOURCE, *ARRIVAL), "sights")


def more_sources(seen: DataFrame, config: LimiterConfig, known: DataFrame | None = None) -> bool:
    """Whether there are more sources than are remembered."""
    seen = seen.select(*SOURCE) if known is None else seen.select(*SOURCE).unionByName(known.select(*SOURCE))
    return seen.distinct().limit(config.max_sources + 1).count() > config.max_sources


def residency(df: DataFrame, config: LimiterConfig, chunks: int | None = None, seen: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """Add ``resident_miss`` where there are more sources than are remembered.

    Arrival (time and id) is cut into ``chunks`` ranges of like many rows (default: of ``CHUNK_ROWS``), and all ranges are
    replayed at once, each as a stream of rows from what is remembered at its start (``starts_of``). ``seen``: what
    ``sights`` has written of ``df``. ``known`` (src_ip, src_port, pos): sources remembered from before, in the order of pos.
    """
    keep = config.max_sources
    df = typed(df)
    seen = sights(df) if seen is None else seen
    n = seen.count()
    bounds = arrival_bounds(seen, chunks or min(max(LEAST_CHUNKS, n // CHUNK_ROWS), MOST_CHUNKS), n)
    last = numbered(seen, bounds).groupBy("chunk", *SOURCE).agg(F.max(F.struct(*ARRIVAL)).alias("at"))
    last = newest(last, "chunk", keep).select("chunk", *SOURCE, "at.*")
    if known is not None:  # before all chunks, and older than any row
        older = known.select(F.lit(-1).alias("chunk"), *SOURCE, F.lit(-(1 << 63)).alias(ARRIVAL[0]), F.col("pos").alias(ARRIVAL[1]))
        last = last.unionByName(older).withColumn("chunk", F.col("chunk") + 1)
    start = starts_of(written(last, "recent"), len(bounds) + 2, keep)
    if known is not None:
        start = start.withColumn("chunk", F.col("chunk") - 1).filter("chunk >= 0")
    start = start.withColumns({"start": F.lit(True), "seen": F.lit(True)})
    rows = numbered(df, bounds).withColumns({"start": F.lit(False), "seen": F.col("drop_reason").isNull()}).unionByName(start, allowMissingColumns=True)
    ordered = rows.repartition("chunk").sortWithinPartitions("chunk", F.desc("start"), *ARRIVAL)
    return ordered.mapInArrow(replay_kernel(keep), T.StructType([*df.schema.fields, T.StructField("resident_miss", T.BooleanType())]))


def source_residency(df: DataFrame, config: LimiterConfig = LimiterConfig(), chunks: int | None = None, many: bool | None = None) -> DataFrame:
    """Add ``resident_miss`` (the row's source was not remembered) and ``residency_epoch`` (its misses so far).

    At most ``max_sources`` sources are remembered, those seen last. Without more sources than that (``many``, counted where
    it is not said) nothing is forgotten, and only a source's first row misses. Rows dropped before are not seen: null.
    """
    named = "drop_reason" in df.columns
    df = open_outcome(df)
    alive, order = F.col("drop_reason").isNull(), W.partitionBy(*SOURCE).orderBy(*ARRIVAL).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = sights(df) if many is None or many else None
    if many or many is None and more_sources(seen, config):
        df = residency(df, config, chunks, seen)
    else:
        df = df.withColumn("resident_miss", F.when(alive, F.sum(alive.cast("int")).over(order) == 1))
    df = df.withColumn("residency_epoch", F.when(alive, F.sum(F.col("resident_miss").cast("long")).over(order)))
    return df if named else df.drop("drop_stage", "drop_reason")


def tracked_sources(df: DataFrame, config: LimiterConfig = LimiterConfig()) -> DataFrame:
    """(src_ip, src_port, last_us, last_id): the sources remembered after the last row."""
    last = df.groupBy(*SOURCE).agg(F.max(F.struct(*ARRIVAL)).alias("at"))
    kept = last.orderBy(F.desc("at")).limit(config.max_sources)
    return kept.select(*SOURCE, F.col("at.received_at_us").alias("last_us"), F.col("at.datagram_id").alias("last_id"))


def limiter_stats(limited: DataFrame, config: LimiterConfig = LimiterConfig()) -> DataFrame:
    """One row: admits, drops, evictions and tracked sources, from rows with admitted and resident_miss."""
    seen = limited.filter(F.col("admitted").isNotNull())
    by_source = seen.groupBy(*SOURCE).agg(F.count_if("admitted").alias("a"), F.count_if(~F.col("admitted")).alias("d"), F.count_if("resident_miss").alias("m"))
    total = by_source.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "adm"), F.count("*").alias("n"))
    tracked = F.least(F.col("n"), F.lit(config.max_sources))
    return total.select(F.col("a").alias("total_admits"), F.col("d").alias("total_drops"), (F.col("m") - tracked).alias("eviction_count"), tracked.cast("long").alias("tracked_count"))


def source_stats(limited: DataFrame) -> DataFrame:
    """(src_ip, src_port, admits, drops) of each source."""
    return limited.filter(F.col("admitted").isNotNull()).groupBy(*SOURCE).agg(F.count_if("admitted").alias("admits"), F.count_if(~F.col("admitted")).alias("drops"))
