"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

The corpus is cut so that equal strings of ``min_bytes`` bytes always meet in one block: every window of that length
is keyed by the least hash among its ``k``-byte substrings, and the consecutive windows under one key form a *run*.
Keys seen once cannot repeat and go. Runs of equal bytes are merged by a partial aggregation (so a passage in a third
of all documents arrives as one row a task); runs of one key that differ are put into blocks, and each block's
Burrows-Wheeler transform is expanded breadth first: intervals of strings of length 1, 2, ... are extended backwards,
each new right edge fixes a common-prefix value, and the expansion stops at ``min_bytes``. Edges still open then part
no suffixes that agree on ``min_bytes`` bytes, which are the repeats.

A key whose differing runs hold more than ``block_symbols`` symbols (a frequent passage in ever new surroundings) is
*crowded*: its runs are dealt over all tasks and cut into single windows, which meet by key and window hash.

Empty or null text: nothing to remove. A text shorter than ``min_bytes`` is kept whole, and one of any length is taken
whole. Documents without doc_id stand before all others, in the order of a hash of their text, by which they are told
apart. Rows that repeat a doc_id with its text get the result of one such row; of
equal strings the one with the smallest doc_id, then the smallest start, is the earliest, so there are no ties. An empty
table gives no rows. Only doc_id, text and the columns asked for are read; those come back inside one struct, so their
names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import id_text, materialise, packed, partitions, prefix_hash, settled, signed, span_hash, text_slices

MIN_BYTES = 100
#: Substrings hashed to key a window: MIN_BYTES - ANCHORS + 1 bytes each, so that a window holds ANCHORS of them.
ANCHORS = 64
#: Symbols that one transform holds at least before a block is closed at a key's end, and of one key at most.
BLOCK_SYMBOLS = 1 << 20
#: A passage has very many copies if more than these, and more than so large a part of all that few passages can have them.
OFTEN, OFTEN_KEPT = 20_000, 100_000
RUN = "key long, body long, named boolean, doc_id long, start int, bytes int, inner boolean"
SPAN = "named boolean, doc_id long, start int, stop int"
#: A span, or, with a window hash, the earliest window of a task's piece that has the hash.
FOUND = f"{SPAN}, key long, window long"


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x


def runs_of(data: np.ndarray, offsets: np.ndarray, min_bytes: int, anchors: int) -> tuple[np.ndarray, ...]:
    """Key, body hash, row, start in the row, length and self-overlap mark of each run of windows under one key."""
    size = min_bytes - anchors + 1
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, bool))
    if len(data) < min_bytes:
        return none
    prefix = prefix_hash(data)
    at = np.arange(len(data) - size + 1)
    grams = span_hash(prefix, at, at + size)
    least = sliding_min(grams, anchors)
    at = at[: len(least)]
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(least)]
    inside = at + min_bytes <= offsets[1:][row]
    same = np.zeros(len(least), bool)
    same[1:] = (least[1:] == least[:-1]) & (row[1:] == row[:-1]) & inside[1:] & inside[:-1]
    first = np.flatnonzero(inside & ~same)
    if not len(first):
        return none
    follows = np.append(same[1:], False)
    last = np.flatnonzero(inside & ~follows)
    # a window that begins with its own least substring and yet is followed under the same key: the key stands twice
    twice = np.cumsum(np.append(0, (grams[: len(least)] == least) & follows))
    stop = last + min_bytes
    inner = twice[last + 1] > twice[first]
    return least[first], span_hash(prefix, first, stop), row[first], first - offsets[row[first]], stop - first, inner


def emit_runs(min_bytes: int, anchors: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                data, offsets = packed(part.column("text"))
                key, body, row, start, size, inner = runs_of(data, offsets, min_bytes, anchors)
                own = [part.column(c).take(pa.array(row)) for c in ("named", "doc_id")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(key)), pa.array(signed(body)), *own, pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(inner)],
                    names=["key", "body", "named", "doc_id", "start", "bytes", "inner"],
                )

    return run


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``depth`` symbols (0-256; past the end: 0), by rank doubling."""
    n, have = len(symbols), 7
    padded = np.concatenate([symbols, np.zeros(have, symbols.dtype)]).astype(np.int64)
    word = np.zeros(n, np.int64)
    for j in range(have):
        word = (word << 9) | padded[j : j + n]
    while True:
        order = np.argsort(word, kind="stable")
        ranked = word[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if have >= depth or new[-1] == n - 1:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = new + 1
        further = np.concatenate([rank[have:], np.zeros(min(have, n), np.int64)])[:n]
        word, have = (rank << 32) | further, 2 * have


def open_edges(symbols: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each place in ``order``, whether its suffix and the one before agree on ``depth`` symbols or more.

    Breadth-first backward extension on the transform. Symbol 0 parts strings and is never extended by, so what
    stands at places whose suffix meets a 0 within ``depth`` symbols is not to be read.
    """
    n = len(symbols)
    transform = symbols[order - 1]
    back = np.empty(n, np.int64)  # last-to-first mapping
    by_symbol = np.argsort(transform, kind="stable")
    back[by_symbol] = np.arange(n)
    front = transform[by_symbol]
    fixed = np.zeros(n + 1, bool)
    fixed[[0, n]] = True
    left, right = np.array([0]), np.array([n - 1])
    owner = np.full(n, -1, np.int64)
    for _ in range(depth):
        if not len(left):
            break
        sizes = right - left + 1
        which = np.repeat(np.arange(len(left)), sizes)
        place = np.arange(sizes.sum()) + np.repeat(left - (np.cumsum(sizes) - sizes), sizes)
        keep = transform[place] != 0
        place, which = back[place[keep]], which[keep]
        if not len(place):
            break
        owner[place] = which
        place = np.flatnonzero(owner >= 0) if len(place) * 8 > n else np.sort(place)
        which = owner[place]
        owner[place] = -1
        parts = np.flatnonzero((np.diff(place) != 1) | (np.diff(which) != 0) | (np.diff(front[place]) != 0)) + 1
        left = place[np.concatenate([[0], parts])]
        right = place[np.concatenate([parts - 1, [len(place) - 1]])]
        fresh = ~fixed[right + 1]
        left, right = left[fresh], right[fresh]
        fixed[right + 1] = True
    return ~fixed[:n]


def spans_of(string: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each row of neighbours among ascending places ``at``, which lie in ``string``."""
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(string) != 0)) + 1
    return np.concatenate([[0], cut]), np.concatenate([cut - 1, [len(at) - 1]])


def order_of(named: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rank of each document: those without id first."""
    order = np.lexsort((ids, named))
    rank = np.zeros(len(ids), np.int64)
    rank[order[1:]] = np.cumsum((np.diff(ids[order]) != 0) | (np.diff(named[order].astype(np.int8)) != 0))
    return rank


def repeats(strings: list[bytes], rank: np.ndarray, starts: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String number and byte range of each stretch whose windows all stand earlier in another string, or this one.
    ``rank``: of each string's document."""
    sizes = np.array([len(s) for s in strings], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int16) + 1
    joined[offsets[1:] - 1] = 0
    order = suffix_order(joined, min_bytes)
    group = np.cumsum(~open_edges(joined, order, min_bytes))
    string = np.repeat(np.arange(len(strings)), sizes + 1)
    whole = order + min_bytes <= (offsets[1:] - 1)[string[order]]
    order, group = order[whole], group[whole]
    none = np.zeros(0, np.int64)
    if not len(order):
        return none, none, none
    owner = string[order]
    key = (rank[owner] << 32) + starts[owner] + order - offsets[owner]
    heads = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    earliest = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(key))))
    at = np.sort(order[key > earliest])
    if not len(at):
        return none, none, none
    first, last = (at[i] for i in spans_of(string[at], at))
    owner = string[first]
    return owner, first - offsets[owner], last - offsets[owner] + min_bytes


def single_windows(strings: list[bytes], keys: np.ndarray, rank: np.ndarray, starts: np.ndarray, min_bytes: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Spans (string number, first and end byte) of windows that stand earlier in these strings under the same key, and
    (string number, first byte, window hash) of the earliest window of each key and hash."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    offsets = np.cumsum(sizes) - sizes
    count = np.maximum(sizes - min_bytes + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    at = offsets[owner] + inside
    window = signed(span_hash(prefix_hash(data), at, at + min_bytes))
    place = (rank[owner] << 32) + starts[owner] + inside
    order = np.lexsort((place, window, keys[owner]))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(window[order]) != 0) | (np.diff(keys[owner][order]) != 0)
    first = order[new]
    later = np.sort(order[place[order] != place[first][np.cumsum(new) - 1]])
    none = np.zeros(0, np.int64)
    spans = (none, none, none)
    if len(later):
        a, b = spans_of(owner[later], at[later])
        spans = owner[later][a], inside[later][a], inside[later][b] + min_bytes
    return spans, (owner[first], inside[first], window[first])


def expand_blocks(min_bytes: int, block_symbols: int):
    """Arrow kernel over rows (key, named, doc_id, start, body, crowded) in order of crowded and key: blocks end where a key
    ends, or, for crowded keys, anywhere."""

    def close(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        keys, named, ids, starts = (np.array([r[i] for r in held], t) for i, t in enumerate((np.int64, bool, np.int64, np.int64)))
        bodies, crowded, rank = [r[4] for r in held], held[0][5], order_of(named, ids)
        if crowded:
            spans, (own, at, window) = single_windows(bodies, keys, rank, starts, min_bytes)
            yield batch_of(named[own], ids[own], starts[own] + at, starts[own] + at + min_bytes, pa.array(keys[own]), pa.array(window))
        else:
            spans = repeats(bodies, rank, starts, min_bytes)
        owner, a, b = spans
        none = pa.nulls(len(owner), pa.int64())
        yield batch_of(named[owner], ids[owner], starts[owner] + a, starts[owner] + b, none, none)

    def batch_of(named: np.ndarray, ids: np.ndarray, start: np.ndarray, stop: np.ndarray, key: pa.Array, window: pa.Array) -> pa.RecordBatch:
        columns = [pa.array(named), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), key, window]
        return pa.RecordBatch.from_arrays(columns, names=["named", "doc_id", "start", "stop", "key", "window"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, symbols = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (row[5] != held[-1][5] or symbols >= block_symbols and (row[5] or row[0] != held[-1][0])):
                    yield from close(held)
                    held, symbols = [], 0
                held.append(row)
                symbols += len(row[4]) + 1
        if held:
            yield from close(held)

    return run


def cut_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(named, doc_id, text, wanted array of (key, start, bytes, crowded)) to (key, named, doc_id, start, body, crowded)."""
    for batch in batches:
        for part in text_slices(batch, "text"):
            keys, known, ids, starts, bodies, crowded = [], [], [], [], [], []
            for named, doc, text, wanted in zip(*(c.to_pylist() for c in part.columns)):
                raw = (text or "").encode()
                for w in wanted:
                    keys.append(w["key"])
                    known.append(named)
                    ids.append(doc)
                    starts.append(w["start"])
                    bodies.append(raw[w["start"] : w["start"] + w["bytes"]])
                    crowded.append(w["crowded"])
            columns = [pa.array(keys, pa.int64()), pa.array(known, pa.bool_()), pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(bodies, pa.binary()), pa.array(crowded, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "named", "doc_id", "start", "body", "crowded"])


def own_key() -> tuple[Column, Column]:
    """(named, doc_id): whether a row has an id, and that or a hash of its text."""
    return F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.xxhash64("text")).alias("doc_id")


def repeated_spans(df: DataFrame, min_bytes: int = MIN_BYTES, anchors: int = ANCHORS, block_symbols: int = BLOCK_SYMBOLS) -> DataFrame:
    """Byte ranges (named, doc_id, start, stop) whose every ``min_bytes``-byte window stands earlier in the corpus; they may
    overlap. Documents that are not ``named`` have a hash of their text in place of an id."""
    docs = id_text(df).select(*own_key(), "text")
    runs = docs.filter(F.octet_length("text") >= min_bytes).mapInArrow(emit_runs(min_bytes, anchors), RUN)
    again = runs.groupBy("key").agg(F.count("*").alias("n"), F.max("inner").alias("any")).filter("n > 1 or any").select("key")
    runs = materialise(runs.join(again, "key", "left_semi"), "runs")
    first = runs.groupBy("key", "body").agg(F.min(F.struct("named", "doc_id", "start")).alias("first"), F.max("bytes").alias("bytes"), F.max("inner").alias("inner"), F.count("*").alias("copies"))
    first = materialise(first, "firsts")
    # a passage with very many copies is told to all tasks, so that its copies need not meet in one
    often, total = first.select("key", "body", "first", "copies"), first.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    often = often.filter(F.col("copies") > max(OFTEN, total // OFTEN_KEPT)).drop("copies")
    later = runs.join(first.select("key", "body", "first"), ["key", "body"])
    if often.limit(1).count():
        rare = runs.join(F.broadcast(often.select("key", "body")), ["key", "body"], "left_anti")
        later = rare.join(first.select("key", "body", "first"), ["key", "body"]).unionByName(runs.join(F.broadcast(often), ["key", "body"]))
    later = later.filter(F.struct("named", "doc_id", "start") != F.col("first"))
    copies = later.select("named", "doc_id", "start", (F.col("start") + F.col("bytes")).cast("int").alias("stop"))
    mixed = first.groupBy("key").agg(F.count("*").alias("n"), F.max("inner").alias("any"), F.sum(F.col("bytes").cast("long") + 1).alias("symbols")).filter("n > 1 or any")
    mixed = mixed.select("key", (F.col("symbols") > block_symbols).alias("crowded"))
    wanted = first.join(mixed, "key").select("first.named", "first.doc_id", F.struct("key", "first.start", "bytes", "crowded").alias("w"))
    wanted = wanted.groupBy("named", "doc_id").agg(F.collect_list("w").alias("wanted"))
    bodies = docs.join(wanted.hint("shuffle_hash"), ["named", "doc_id"]).select("named", "doc_id", "text", "wanted").mapInArrow(cut_bodies, "key long, named boolean, doc_id long, start int, body binary, crowded boolean")
    dealt = F.when(F.col("crowded"), F.xxhash64("key", "doc_id", "start")).otherwise(F.col("key"))
    blocks = bodies.repartition(partitions(df.sparkSession), dealt).sortWithinPartitions("crowded", "key")
    found = materialise(blocks.mapInArrow(expand_blocks(min_bytes, block_symbols), FOUND), "repeats")
    windows = found.filter("window is not null")
    earliest = windows.groupBy("key", "window").agg(F.count("*").alias("n"), F.min(F.struct("named", "doc_id", "start")).alias("first")).filter("n > 1")
    moved = windows.join(earliest, ["key", "window"]).filter(F.struct("named", "doc_id", "start") != F.col("first")).select("named", "doc_id", "start", "stop")
    return copies.unionByName(found.filter("window is null").select("named", "doc_id", "start", "stop")).unionByName(moved)


def without(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int]:
    """``raw`` without the bytes in ``spans`` (which may overlap), and the number of maximal runs taken out."""
    kept, done, n = [], -1, 0
    for a, b in sorted(spans):
        if a > done:
            kept.append(raw[max(done, 0) : a])
            n += 1
        done = max(done, b)
    kept.append(raw[max(done, 0) :])
    return b"".join(kept), n


def cut_out(keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text"):
                out = []
                for text, starts, stops in zip(*(part.column(c).to_pylist() for c in ("text", "starts", "stops"))):
                    raw = (text or "").encode()
                    rest, n = without(raw, list(zip(starts or (), stops or ())))
                    out.append((len(raw), len(raw) - len(rest), n, hashlib.sha256(rest).hexdigest(), rest if keep else None))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                new = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                row = [part.column("row")] if "row" in part.schema.names else []
                yield pa.RecordBatch.from_arrays([*row, part.column("doc_id"), *new], names=["row"][: len(row)] + ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def remove_repeats(df: DataFrame, keep: bool = True, more: tuple[str, ...] = (), **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary; null unless ``keep``) of every row of ``df``,
    and the columns ``more`` as a struct ``row``.

    ``kept`` can cut a character in two; ``make_valid_utf8`` reads it as text.
    """
    spans = settled(df.sparkSession, "spans", lambda: repeated_spans(df, **how).groupBy("named", "doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("s")))
    spans = spans.select("named", F.col("doc_id").alias("key_id"), F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))
    named, key = own_key()
    docs = id_text(df, *([F.struct(*more).alias("row")] if more else [])).withColumns({"named": named, "key_id": key})
    joined = docs.join(spans.hint("shuffle_hash"), ["named", "key_id"], "left").drop("named", "key_id")
    row = f"row {docs.schema['row'].dataType.simpleString()}, " if more else ""
    return joined.mapInArrow(cut_out(keep), f"{row}doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
