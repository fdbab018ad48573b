"""SimHash fingerprints with permuted block tables.

Terms are word n-grams (three words; a shorter text is one term); a term's weight is its count. Each term's 64-bit hash
adds its weight to the votes of its set bits and takes it from the others; a fingerprint has the bits with votes over 0.

Fingerprints within ``radius`` bits agree on all but ``radius`` of ``blocks`` equal blocks, so for each choice of
``blocks - radius`` blocks a table keyed by them finds every such pair. Equal fingerprints are merged first.

Null and empty texts have no terms: fingerprint 0. Texts of any length are taken whole. A bit whose votes are 0 is not
set. An empty table gives no rows; rows that repeat a doc_id (with the same text) are one document to the order of
documents, and each gets its row. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import id_text, materialise, packed, partitions, text_slices
from palisade.llm.ngram_join import shingles

WORDS = 3
BITS = 64
#: Bits that two fingerprints may differ in, and the blocks that the tables permute.
RADIUS, BLOCKS = 3, 5
_LEAST = -(1 << 63)


def fingerprints(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> np.ndarray:
    """64-bit fingerprint of each row of packed text."""
    row, term, _ = shingles(data, offsets, size)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(row):
        return out
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    total = np.diff(np.append(heads, len(row)))
    # repeats of a term vote as often as they stand, which is its weight
    bits = np.unpackbits(term.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    votes = 2 * np.add.reduceat(bits, heads, axis=0, dtype=np.int64) - total[:, None]
    out[row[heads]] = np.packbits(votes > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.bitwise_count(a ^ b) / BITS


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following document."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def apart(spark: SparkSession, count: int) -> np.ndarray:
    """So many numbers that ``repartition(count, ...)`` sends to so many different tasks."""
    found = spark.range(32 * count).groupBy(F.pmod(F.hash("id"), F.lit(count)).alias("task")).agg(F.min("id").alias("id")).collect()
    own = {r["task"]: r["id"] for r in found}
    return np.array([own.get(task, task) for task in range(count)], np.int64)


def with_following(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows (bucket, the columns of ``docs``, own): documents in like ranges of doc_id, each range with the document before its first.
    A range's bucket is a number that goes to a task of its own.

    Only the ranges' ends, ``ranges`` rows at most, come to the driver and are broadcast.
    """
    spark = docs.sparkSession
    bounds = docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    bounds, names = np.array(sorted({min(max(int(b), _LEAST), -1 - _LEAST) for b in bounds}), np.int64), apart(spark, ranges)

    @F.arrow_udf("long")
    def bucket(ids: pa.Array) -> pa.Array:
        return pa.array(names[np.searchsorted(bounds, ids.to_numpy(zero_copy_only=False))])

    dealt = docs.withColumn("bucket", bucket("doc_id"))
    last = sorted((r["last"], r["bucket"]) for r in dealt.groupBy("bucket").agg(F.max("doc_id").alias("last")).collect())
    own = dealt.select("bucket", *docs.columns, F.lit(True).alias("own"))
    if not last:
        return own
    sends = [(doc, last[(i + 1) % len(last)][1]) for i, (doc, _) in enumerate(last)]
    ends = docs.join(F.broadcast(spark.createDataFrame(sends, "doc_id long, bucket long")), "doc_id")
    return own.unionByName(ends.select("bucket", *docs.columns, F.lit(False).alias("own")))


def compare_edits(df: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The next document is that with the next smaller doc_id; the smallest is followed by the largest. In this order
    rows without doc_id are one document at the least long.
    """
    docs = id_text(df).select(F.coalesce("doc_id", F.lit(_LEAST)).alias("doc_id"), F.col("doc_id").isNotNull().alias("named"), "text")
    count = partitions(df.sparkSession)
    dealt = with_following(docs, count).repartition(count, "bucket").sortWithinPartitions("bucket", "own", "doc_id")

    def rows(parts: list[tuple]) -> pa.RecordBatch:
        ids = [p[0] for p in parts]
        texts = [p[1] for p in parts]
        edited = [edit(p[1], p[4]) for p in parts]
        # a document's neighbour is mostly the row before, so each text is voted on once
        place = {doc: i for i, doc in enumerate(ids)}
        more = {p[3]: p[4] for p in parts if p[3] not in place}
        place |= {doc: len(ids) + i for i, doc in enumerate(more)}
        prints = fingerprints(*packed(pa.array([*texts, *more.values(), *edited], pa.string())), size)
        own, other = prints[: len(ids)], prints[len(ids) + len(more) :]
        following = prints[[place[p[3]] for p in parts]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] if p[2] else None for p in parts], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([f"{x:016x}" for x in own.tolist()], pa.string()),
                pa.array([f"{x:016x}" for x in other.tolist()], pa.string()),
                pa.array(likeness(own, other)),
                pa.array(likeness(own, following)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_now = [], 0
        at, current, before = None, None, None  # range, last document, the one before it
        for batch in batches:
            for part in text_slices(batch, "text"):
                for bucket, doc, named, text, own in zip(*(c.to_pylist() for c in part.columns)):
                    text = text or ""
                    if bucket != at:
                        at, current, before = bucket, (doc, text), (doc, text)
                        if not own:
                            continue
                    if doc != current[0] or not own:
                        before = current
                    current = (doc, text)
                    if own:
                        held.append((doc, text, named, *before))
                        size_now += len(text)
                    if size_now > 1 << 19:
                        yield rows(held)
                        held, size_now = [], 0
        if held:
            yield rows(held)

    return dealt.select("bucket", "doc_id", "named", "text", "own").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def block_keys(column: str, radius: int, blocks: int) -> F.Column:
    """The permuted tables' keys of a fingerprint: one (table, kept bits) for each choice of blocks that stay equal."""
    width = -(-BITS // blocks)
    masks = [((1 << max(0, min(width, BITS - i * width))) - 1) << (i * width) for i in range(blocks)]
    kept = [sum(masks[i] for i in choice) for choice in combinations(range(blocks), blocks - radius)]
    return F.array(*(F.struct(F.lit(t).alias("t"), F.col(column).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(kept)))


def within(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance): every fingerprint of ``prints`` (long column fp) at most ``radius`` bits from one of ``queries``.

    Both sides are made distinct first, so copies cost nothing. Each bucket meets only its queries, and a bucket that
    is large all the same is split by Spark as any skewed join.
    """
    keyed = lambda df: df.select(F.col("fp").cast("long").alias("fp")).filter("fp is not null").distinct().select("fp", F.explode(block_keys("fp", radius, blocks)).alias("k"))
    found = keyed(prints).select("k", "fp").join(keyed(queries).select("k", F.col("fp").alias("query")), "k")
    found = found.withColumn("distance", F.bit_count(F.col("fp").bitwiseXOR(F.col("query")))).filter(F.col("distance") <= radius)
    return found.select("query", "fp", "distance").distinct()


def search_every(compared: DataFrame, every: int = 100, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``compared`` with n_within: for the query documents (doc_id divisible by ``every``) the number of documents,
    itself included, whose fingerprints are at most ``radius`` bits from its own; null for the others."""
    compared = materialise(compared.withColumn("fp", F.conv("fingerprint", 16, -10).cast("long")), "fingerprints")
    counts = compared.groupBy("fp").agg(F.count("*").alias("n"))
    asked = compared.filter(F.col("doc_id") % every == 0)
    found = within(counts, asked, radius, blocks).join(counts, "fp").groupBy("query").agg(F.sum("n").alias("n_within"))
    ids = asked.join(found, asked["fp"] == found["query"]).select("doc_id", "n_within").distinct()
    return compared.drop("fp").join(ids, "doc_id", "left")
