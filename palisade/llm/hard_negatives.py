"""Hard-negative mining on an inverted multi-index.

``HalfIndex``: every vector is cut into two halves, and each half has a codebook (k-means on a sample of at most ``SAMPLE``
rows and ``SAMPLE_COMPONENTS`` components, those of the least hashed vec_ids). A pair of entries is a cell. The index holds
*every* row under its cell; the radius of an entry is the largest distance of any row's half from it, so no row of cell
(i, j) scores more with a query than first(i) + second(j), where a half's bound is its product with the entry plus the
query half's length times the radius.

A search asks for the first k rows of a query's own label, or of all others, whose score lies in a window, for several
windows at once. Cells are visited in the order of falling bounds, which a heap makes from the two halves' sorted bounds
(the multi-sequence algorithm). A first visit goes on until its cells hold ``PROBE`` rows for each row asked for; a window's
k-th best score among them, or its lower end if they are fewer, is then a score that every better row has to reach, and
the second visit goes on to the first bound below it. There the window is certified: no cell left can hold a row of the
answer. So results are exact, whatever the sample; only how many cells are visited depends on it.

Cells lie in blocks of rows; a cell of more rows than a block has several. A block's rows are held by a task while the
queries that visit the block stream past, in several tasks if they are very many. Only codebooks, radii and
the number of rows of each cell (``MOST_ENTRIES`` squared at most) are sent to all tasks.

Of vectors that are left out see ``vectors``; rows without label or without vec_id take no part. Equal scores are in the
order of vec_id, then label. Rows that repeat a vec_id with its label and vector count once; with another label or vector
they are rows of their own, but never their own anchor's positives. An anchor without positives, and a positive without
negatives, has no row. An empty table gives no rows. Only vec_id, label and the vector are read, so other columns can't
clash.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import materialise, partitions
from palisade.llm.vectors import SCALE, lists, matrix, whole_vectors

SAMPLE, SAMPLE_COMPONENTS, STEPS = 16_384, 1 << 23, 4
LEAST_ENTRIES, MOST_ENTRIES, ROWS_A_CELL = 8, 256, 64
#: Rows that a first visit sees for each row asked for.
PROBE = 64
#: Rows of a block, and components of more than the least; queries that one task passes by a block, and queries whose
#: scores with a block are worked out at once.
LEAST_BLOCK, MOST_BLOCK, BLOCK_COMPONENTS, QUERIES, QUERY_ROWS = 1024, 1 << 16, 1 << 22, 1 << 16, 64
POSITIVES, NEGATIVES, EVERY = 5, 10, 100
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

ASK = "query long, label long, same boolean, k int, low array<long>, high array<long>, v array<int>"
_ASK = ("query", "label", "same", "k", "low", "high", "v")
FOUND = "query long, window int, k int, vec_id long, label long, score long"


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 1 << 53:  # every sum on the way is a whole double
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def fitted(rows: np.ndarray, entries: int) -> np.ndarray:
    """A codebook: k-means from evenly spaced rows in the order of their first principal direction."""
    rows = rows.astype(np.float64)
    away = rows - rows.mean(0)
    along = away @ np.linalg.svd(away[:1024], full_matrices=False)[2][0] if min(rows.shape) else np.zeros(len(rows))
    book = rows[np.argsort(along, kind="stable")[np.linspace(0, len(rows) - 1, min(entries, len(rows))).astype(int)]]
    for _ in range(STEPS):
        near = closest(rows, book)
        count = np.bincount(near, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, near, rows)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def closest(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(1) - 2 * rows @ book.T).argmin(1)


class HalfIndex(NamedTuple):
    """What all tasks know of an index: codebooks and radii of the halves, rows of each cell, and the first block of each
    cell with how many blocks it has."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    block: np.ndarray
    blocks: np.ndarray

    @property
    def cut(self) -> int:
        return self.books[0].shape[1]

    def halves(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return v[:, : self.cut].astype(np.float64), v[:, self.cut :].astype(np.float64)

    def bounds(self, v: np.ndarray) -> list[np.ndarray]:
        """For each half: the most that a row of each entry scores with it, rounded up."""
        out = []
        for half, book, radius in zip(self.halves(v), self.books, self.radii):
            bound = half @ book.T + np.linalg.norm(half, axis=1)[:, None] * radius
            out.append(bound + 1 + np.abs(bound) * 1e-9)
        return out

    def visit(self, first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int]]:
        """(bound, cell) of cells that have rows, by falling bound: the multi-sequence heap."""
        one, two = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
        a, b = first[one].tolist(), second[two].tolist()
        heap, taken = [(-(a[0] + b[0]), 0, 0)], [0] * len(a)  # taken: how many of each line of cells have been visited
        while heap:
            bound, i, j = heapq.heappop(heap)
            taken[i] = j + 1
            cell = int(one[i]) * len(b) + int(two[j])
            if self.rows[cell]:
                yield -bound, cell
            # a cell enters once its neighbours of higher bound, to the left and above, have been visited
            if j + 1 < len(b) and (i == 0 or taken[i - 1] > j + 1):
                heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
            if i + 1 < len(a) and taken[i + 1] == j:
                heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))


def cells_of(index: HalfIndex, v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cell of each row, and the distances of its halves from their entries."""
    near, far = [], []
    for half, book in zip(index.halves(v), index.books):
        at = closest(half, book)
        near.append(at)
        far.append(np.linalg.norm(half - book[at], axis=1))
    return near[0] * len(index.books[1]) + near[1], far


def build(rows: DataFrame, dims: int) -> tuple[DataFrame, HalfIndex]:
    """(block, cell, vec_id, label, v) of all rows, written, and the index."""
    n = rows.count()
    entries = int(min(max((n / ROWS_A_CELL) ** 0.5, LEAST_ENTRIES), MOST_ENTRIES))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(max(1, min(SAMPLE, SAMPLE_COMPONENTS // dims))).toArrow().column("v").combine_chunks()
    points, cut = matrix(sample, dims), (dims + 1) // 2
    none = np.zeros(0, np.int64)
    books = fitted(points[:, :cut], entries), fitted(points[:, cut:], entries)
    bare = HalfIndex(books, (none, none), none, none, none)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, far = cells_of(bare, matrix(batch.column(2), dims))
                yield pa.RecordBatch.from_arrays([pa.array(cell), *map(pa.array, far), *batch.columns], names=["cell", "far1", "far2", "vec_id", "label", "v"])

    placed = materialise(rows.mapInArrow(place, "cell long, far1 double, far2 double, vec_id long, label long, v array<int>"), "placed")
    across = len(books[1])
    found = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far1").alias("far1"), F.max("far2").alias("far2")).collect()
    count, radii = np.zeros(len(books[0]) * across, np.int64), (np.zeros(len(books[0])), np.zeros(across))
    for r in found:
        count[r["cell"]] = r["n"]
        for half, at in enumerate(divmod(r["cell"], across)):
            radii[half][at] = max(radii[half][at], r[f"far{half + 1}"])
    size = int(min(max(n // (4 * partitions(rows.sparkSession)), LEAST_BLOCK), MOST_BLOCK, max(LEAST_BLOCK, BLOCK_COMPONENTS // dims)))
    # neighbouring cells share a block while they fill it at most; a larger cell has blocks of its own
    block, blocks, at, filled = np.zeros(len(count), np.int64), np.ones(len(count), np.int64), 0, 0
    for cell in np.flatnonzero(count):
        if filled and filled + count[cell] > size:
            at, filled = at + 1, 0
        block[cell], blocks[cell] = at, -(-count[cell] // size)
        at, filled = at + blocks[cell] - 1, filled + count[cell] if blocks[cell] == 1 else size
    index = HalfIndex(books, radii, count, block, blocks)

    @F.arrow_udf("long")
    def in_block(cell: pa.Array, salt: pa.Array) -> pa.Array:
        c = cell.to_numpy()
        return pa.array(block[c] + salt.to_numpy() % blocks[c])

    salt = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 31))
    return placed.select(in_block("cell", salt).alias("block"), "cell", "vec_id", "label", "v"), index


def plan_visits(index: HalfIndex, dims: int, again: bool):
    """Arrow kernel: for each ask, a row for each block that it visits, with the cells it visits there."""

    def cells(first: np.ndarray, second: np.ndarray, wanted: int, least: int) -> list[int]:
        out, seen, reached = [], 0, False
        for bound, cell in index.visit(first, second):
            reached = reached or seen >= wanted
            if again and reached and bound < least:
                break  # certified
            if reached and not again:
                break
            if reached == again:
                out.append(cell)
            seen += int(index.rows[cell])
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                column = dict(zip(batch.schema.names, batch.columns))
                first, second = index.bounds(matrix(column["v"], dims))
                at, block, visited = [], [], []
                for i, (k, low, high) in enumerate(zip(*(column[c].to_pylist() for c in ("k", "low", "high")))):
                    if not any(a <= b for a, b in zip(low, high)):
                        continue
                    by_block = defaultdict(list)
                    for cell in cells(first[i], second[i], PROBE * k, min(a for a, b in zip(low, high) if a <= b)):
                        for b in range(index.block[cell], index.block[cell] + index.blocks[cell]):
                            by_block[b].append(cell)
                    at += [i] * len(by_block)
                    block += by_block.keys()
                    visited += by_block.values()
                asks = batch.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(visited, pa.list_(pa.int64())), *asks.columns], names=["block", "cells", *asks.schema.names])

    return run


def best(score: np.ndarray, ids: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score, vec_id and label."""
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return keep[np.lexsort((labels[keep], ids[keep], -score[keep]))[:k]]
    return np.lexsort((labels, ids, -score))[:k]


def pass_by(dims: int):
    """Arrow kernel over (block, ask?, ...) in that order: a block's rows are held while its asks stream past."""

    def hold(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        cell, ids, labels = (rows.column(c).to_numpy() for c in ("cell", "vec_id", "label"))
        v = matrix(rows.column("v").combine_chunks(), dims)
        order = np.lexsort((*v.T[::-1], labels, ids))  # rows that repeat another go
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(ids[order]) != 0) | (np.diff(labels[order]) != 0) | (v[order][1:] != v[order][:-1]).any(1)
        order = order[new]
        return cell[order], ids[order], labels[order], v[order]

    def answer(held: tuple[np.ndarray, ...], asks: pa.RecordBatch) -> pa.RecordBatch:
        cell, ids, labels, v = held
        column = {c: asks.column(asks.schema.get_field_index(c)) for c in ("cells", *_ASK)}
        found = scores(matrix(column["v"], dims), v)
        out: list[tuple] = []
        for i, (cells, query, label, same, k, low, high) in enumerate(zip(*(column[c].to_pylist() for c in ("cells", "query", "label", "same", "k", "low", "high")))):
            mine = np.flatnonzero(np.isin(cell, cells) & ((labels == label) == same) & (ids != query))
            score = found[i, mine]
            for window, (a, b) in enumerate(zip(low, high)):
                inside = np.flatnonzero((score >= a) & (score <= b))
                top = inside[best(score[inside], ids[mine[inside]], labels[mine[inside]], k)]
                out += zip([query] * len(top), [window] * len(top), [k] * len(top), ids[mine[top]].tolist(), labels[mine[top]].tolist(), score[top].tolist())
        columns = list(zip(*out)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["query", "window", "k", "vec_id", "label", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            asks = batch.column(2).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(keys, axis=1) != 0).any(0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                if a == b:
                    continue
                if block != (at := tuple(keys[:, a])):
                    block, parts, held = at, [], None
                if not asks[a]:
                    parts.append(batch.slice(a, b - a))
                elif parts or held:
                    held, parts = held or hold(parts), []
                    for start in range(a, b, QUERY_ROWS):
                        yield answer(held, batch.slice(start, min(QUERY_ROWS, b - start)))

    return run


def visited(rows: DataFrame, index: HalfIndex, asks: DataFrame, dims: int, again: bool) -> DataFrame:
    """(query, window, k, vec_id, label, score): what a visit of all asks finds, k rows a window, query and block at most."""
    count = partitions(rows.sparkSession)
    visits = materialise(asks.select(*_ASK).mapInArrow(plan_visits(index, dims, again), f"block long, cells array<long>, {ASK}"), "visits")
    # the asks of a block that very many visit go past it in several tasks
    shares = visits.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    held = rows.join(shares, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(False).alias("ask"), "cell", "vec_id", "label", "v", none("cells", "array<long>"), none("query", "long"), none("same", "boolean"), none("k", "int"), none("low", "array<long>"), none("high", "array<long>"))
    past = visits.join(shares, "block").select("block", F.pmod(F.xxhash64("query"), F.col("shares")).cast("int").alias("share"), F.lit(True).alias("ask"), none("cell", "long"), none("vec_id", "long"), "label", "v", "cells", "query", "same", "k", "low", "high")
    met = held.unionByName(past).repartition(count, "block", "share").sortWithinPartitions("block", "share", "ask")
    return met.mapInArrow(pass_by(dims), FOUND)


def first_rows(found: DataFrame) -> DataFrame:
    """The first k rows of each query and window, with rank from 1."""
    order = Window.partitionBy("query", "window").orderBy(F.desc("score"), "vec_id", "label")
    return found.withColumn("rank", F.row_number().over(order)).filter("rank <= k")


def search(rows: DataFrame, index: HalfIndex, asks: DataFrame, dims: int) -> DataFrame:
    """(query, window, k, vec_id, label, score, rank) for ``asks``, one row a query: the first k rows (other than the
    query's own) of the query's label (``same``), or of all others, in each window [low, high] of scores."""
    probed = materialise(visited(rows, index, asks, dims, False), "probed")
    reached = first_rows(probed).filter("rank = k").groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    # a window's k-th best score so far is the least that the rest has to reach
    raised = F.transform("low", lambda low, i: F.coalesce(F.try_element_at("reached", i), low))
    tightened = asks.join(reached, "query", "left").withColumn("low", raised).select(*_ASK)
    certified = visited(rows, index, tightened, dims, True)
    return first_rows(probed.unionByName(certified))


def mine(df: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (30, 90), relabel: int = 0, labels: int = 10, scale: int = SCALE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (vec_id divisible by
    ``every``) and each of its first ``positives`` rows of its label, the first ``negatives`` rows of other labels whose score
    is in the ``window``, in percent of the positive's. ``relabel``: vec_ids divisible by it go to the next of ``labels`` labels."""
    rows, dims = whole_vectors(df, scale)
    rows = rows.filter("vec_id is not null and label is not null")
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("vec_id") % relabel == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))
    if not dims or not rows.take(1):
        return df.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows, index = build(rows, dims)
    rows = materialise(rows, "half-index")
    asked = lambda same, k: (F.lit(same).alias("same"), F.lit(k).alias("k"))
    anchors = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query"), "label", "v").groupBy("query").agg(F.min(F.struct("label", "v")).alias("a")).select("query", "a.*")
    any_score = F.array(F.lit(_LEAST)), F.array(F.lit(_MOST))
    anchors = materialise(anchors.repartition(partitions(df.sparkSession), "query"), "anchors")
    near = search(rows, index, anchors.select("query", "label", *asked(True, positives), any_score[0].alias("low"), any_score[1].alias("high"), "v"), dims)
    near = materialise(near.select("query", "rank", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 100 * score between the two products, in whole numbers: the lower end rounded up, the upper down
    down = lambda x: F.expr(f"CAST(({x} - pmod({x}, 100)) AS LONG) DIV 100")
    low, high = -down(f"(-{window[0]} * positive_score)"), down(f"({window[1]} * positive_score)")
    windows = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", low.alias("low"), high.alias("high")))).alias("w"))
    asks = anchors.join(windows, "query").select("query", "label", *asked(False, negatives), F.col("w.low").alias("low"), F.col("w.high").alias("high"), "v")
    hard = search(rows, index, materialise(asks, "asks"), dims).select("query", (F.col("window") + 1).alias("at"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.withColumnRenamed("rank", "at").join(hard, ["query", "at"])
    return named.select(F.col("query").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.vec_id != b.vec_id
), positive AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
