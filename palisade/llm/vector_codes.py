"""Compression of vectors to short codes: product quantisation with a lexicographic trie over distinct parts.

A vector is cut into ``parts`` equal consecutive parts, and each part position has a codebook of ``entries`` entries, first
those parts of the rows with the smallest vec_ids. A round assigns each part to its nearest entry and replaces each entry
by the floored mean of its parts; after the rounds parts are assigned again and their entries' numbers are the code.

Assignment works on the distinct parts of a batch of rows, in lexicographic order, which is a trie whose levels are the
dimensions: a node holds the distances of its prefix to all entries, and its children add one dimension's squares to
them, so common prefixes are worked out once. The walk goes depth first down to groups of neighbouring children with
``LEAVES`` leaves at most, which are expanded together, so memory is bounded by the depth and ``LEAVES``. Leaves take the
nearest entry, and sums weighted by how many rows have the part. No row is shuffled: a task sends the sums of each entry,
and codebooks, whose size does not grow with the table, go out with the tasks.

Of vectors that are left out see ``vectors``. A part as near to several entries takes the first. Rows that repeat a
vec_id each get their code, and count as often in the means; of first entries such a vec_id gives one (the least vector).
A null vec_id gives no first entry, and gets its code. With fewer than ``entries`` ids there are so many entries; an
entry without parts stays. Null labels are one label. An empty table gives no rows. The number of dimensions has to be a
multiple of ``parts``, which is at most 256 entries each. Only vec_id, label and the vector are read, so other columns
can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import materialise
from palisade.llm.vectors import SCALE, lists, matrix, whole_vectors

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Leaves that are expanded together, and components of the rows that a trie is built of.
LEAVES, BATCH_COMPONENTS = 1 << 13, 1 << 21
#: Labels whose sums are broadcast; those of more labels are joined.
BROADCAST_LABELS = 100_000


def prefixes(rows: np.ndarray) -> np.ndarray:
    """For rows in lexicographic order: from which dimension on each differs from the row before (the first: 0)."""
    differs = rows[1:] != rows[:-1]
    return np.concatenate([[0], np.where(differs.any(1), differs.argmax(1), rows.shape[1])]).astype(np.int64)


def nearest(rows: np.ndarray, book: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of ``book`` (the first of equals) and its squared distance for each of ``rows``, which are distinct
    and in lexicographic order: the depth-first walk."""
    depth = rows.shape[1]
    entry, error = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    fresh = prefixes(rows)

    def expand(low: int, high: int, level: int, held: np.ndarray) -> None:
        """All leaves in [low, high), which share the ``level`` dimensions whose distances ``held`` has."""
        distances, node = held[None], np.zeros(high - low, np.int64)
        for d in range(level, depth):
            new = fresh[low:high] <= d
            new[0] = True
            starts = np.flatnonzero(new)
            distances = distances[node[starts]] + (rows[low + starts, d][:, None] - book[None, :, d]) ** 2
            node = np.cumsum(new) - 1
        best = distances.argmin(1)
        entry[low:high], error[low:high] = best[node], distances[np.arange(len(best)), best][node]

    stack = [(0, len(rows), 0, np.zeros(len(book), np.int64))] if len(rows) else []
    while stack:
        low, high, level, held = stack.pop()
        if high - low <= leaves or level == depth:
            expand(low, high, level, held)
            continue
        children = np.concatenate([[low], low + 1 + np.flatnonzero(fresh[low + 1 : high] <= level), [high]])
        at = 0
        while at < len(children) - 1:
            # neighbours of few leaves together, a child of many alone and one level down
            to = max(at + 1, int(np.searchsorted(children, children[at] + leaves, side="right")) - 1)
            first, end = int(children[at]), int(children[to])
            if to == at + 1:
                stack.append((first, end, level + 1, held + (rows[first, level] - book[:, level]) ** 2))
            else:
                expand(first, end, level, held)
            at = to
    return entry, error


def distinct_parts(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of ``part`` in lexicographic order, and which of them each row is."""
    order = np.lexsort(part.T[::-1])
    ordered = part[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
    place = np.empty(len(part), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place


def assigned(values: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each part position: distinct parts, which each row has, and their nearest entries and distances."""
    width = books.shape[2]
    for p, book in enumerate(books):
        found, place = distinct_parts(values[:, p * width : (p + 1) * width])
        yield found, place, *nearest(found, book)


def of_many_rows(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[pa.Table]:
    """Batches put together, so that a trie has many parts."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, most := max(1, BATCH_COMPONENTS // dims)):
            held.append(batch.slice(at, most))
            n += held[-1].num_rows
            if n >= most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks before the first round, (part, entry, dimension)."""
    seeds = rows.filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    width = len(seeds[0]["v"]) // parts if seeds else 1
    return np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2)


def better_books(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every entry the floored mean of the parts nearest to it."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for table in of_many_rows(batches, parts * width):
            for p, (found, place, entry, _) in enumerate(assigned(matrix(table.column("v").combine_chunks(), parts * width), books)):
                weight = np.bincount(place, minlength=len(found))
                np.add.at(count[p], entry, weight)
                np.add.at(total[p], entry, found * weight[:, None])
        p, e = np.nonzero(count)
        where = np.repeat(p * entries + e, width), np.tile(np.arange(width), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(where[0]), pa.array(where[1]), pa.array(np.repeat(count[p, e], width)), pa.array(total[p, e].reshape(-1))], names=["entry", "d", "n", "total"])

    # at most one row an entry and dimension reaches the driver; decimals hold any sum of longs
    sent = rows.select("v").mapInArrow(sums, "entry long, d long, n long, total long")
    out = books.copy()
    for r in sent.groupBy("entry", "d").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r["entry"] // entries, r["entry"] % entries, r["d"]] = int(r["total"]) // r["n"]
    return out


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(part, entry, dimension) after all rounds; ``rows`` as ``whole_vectors`` gives them."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books.shape[1] else 0):
        books = better_books(rows, books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error of every row."""
    parts, _, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in of_many_rows(batches, parts * width):
            entries, error = np.empty((table.num_rows, parts), np.uint8), np.zeros(table.num_rows, np.int64)
            for p, (_, place, entry, distance) in enumerate(assigned(matrix(table.column("v").combine_chunks(), parts * width), books)):
                entries[:, p] = entry[place]
                error += distance[place]
            text = entries.tobytes().hex()
            codes = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
            yield from pa.table([table.column("vec_id"), table.column("label"), codes, pa.array(error)], names=["vec_id", "label", "code", "error"]).to_batches()

    return rows.mapInArrow(run, "vec_id long, label long, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` (with a column code) with v: the vector, in scaled whole numbers, that the code stands for."""
    parts, _, width = books.shape
    flat = books.reshape(-1, width)

    @F.arrow_udf("array<long>")
    def vector(code: pa.Array) -> pa.Array:
        entries = np.frombuffer(bytes.fromhex("".join(code.to_pylist())), np.uint8).reshape(-1, parts).astype(np.int64)
        return lists(flat[np.arange(parts) * books.shape[1] + entries].reshape(len(entries), parts * width))

    return codes.withColumn("v", vector("code"))


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (of all rows of the label) and codebooks_sha256 of every row with a whole vector."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part, so up to 256 entries")
    rows, dims = whole_vectors(df, scale)
    if dims % parts:
        raise ValueError(f"vectors of {dims} dimensions are not cut into {parts} equal parts")
    if not dims:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = codebooks(rows, parts, entries, rounds)
    if not books.shape[1]:  # no row has an id, so there are no entries: no code
        none = F.lit(None)
        return rows.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"), none.cast("long").alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256"))
    coded = materialise(encode(rows, books), "vector-codes")
    sums = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of_label")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of_label"]), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


_KEPT = """
kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), part AS (
  SELECT r, p, v[4 * p + 1] AS a, v[4 * p + 2] AS b, v[4 * p + 3] AS c, v[4 * p + 4] AS d FROM kept, range(16) AS t(p)
), book0 AS (
  SELECT p, e, a, b, c, d FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 64) USING (r)
)"""


def _near(n: int) -> str:
    return f"""
near{n} AS (
  SELECT r, x.p, min((x.a-y.a)*(x.a-y.a) + (x.b-y.b)*(x.b-y.b) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d)) AS dist,
    arg_min(e, ((x.a-y.a)*(x.a-y.a) + (x.b-y.b)*(x.b-y.b) + (x.c-y.c)*(x.c-y.c) + (x.d-y.d)*(x.d-y.d)) * 64 + e) AS e
  FROM part x JOIN book{n} y USING (p) GROUP BY r, x.p
)"""


def _book(n: int) -> str:
    mean = lambda c: f"coalesce(floor_div_{c}, {c}) AS {c}"
    down = lambda c: f"((sum({c}) - ((sum({c}) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floor_div_{c}"
    return f"""
book{n + 1} AS (
  SELECT p, e, {', '.join(map(mean, 'abcd'))} FROM book{n} LEFT JOIN (
    SELECT p, e, {', '.join(map(down, 'abcd'))} FROM part JOIN near{n} USING (r, p) GROUP BY p, e
  ) USING (p, e)
)"""


#: For vectors of 64 dimensions in 16 parts, 64 entries, two rounds.
ORACLE_SQL = f"""
WITH {_KEPT}, {_near(0)}, {_book(0)}, {_near(1)}, {_book(1)}, {_near(2)}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error
  FROM near2 JOIN kept USING (r) GROUP BY r, vec_id
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(a || ',' || b || ',' || c || ',' || d, ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded
"""
