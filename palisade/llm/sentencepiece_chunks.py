"""SentencePiece encoding and decoding by a table of distinct chunks.

In a model whose pieces hold the white-space marker only at their beginning, no piece crosses from one *chunk* (markers
and what follows up to the next marker) into another, so a text's ids are its chunks' ids end to end, and its decoded
text is its chunks' (``ChunkTable`` checks the model for this).

1. Spark counts the distinct chunks of all texts.
2. The most frequent ones, ``TABLE_CHUNKS`` at most, are segmented once each, in Spark, and broadcast with their ids
   (chunks of ``CHUNK_BYTES`` at most, which bounds the table). All others are segmented where they are met, once for each
   slice of texts.
3. A slice of texts is cut into chunks, and its distinct chunks' ids are put in their places by position. Equal texts of a
   slice, as a mixture has them side by side, are counted and cut once.

The tail stays with the tasks because joining it to its places would shuffle every text and its ids.

The model is read once on the driver and broadcast (checked: ``MAX_MODEL_BYTES``). Null text counts as empty: the end
id alone, decoded to an empty text. Rows are independent, so repeated rows get equal results, and which of equally
frequent chunks are in the table changes no result; texts of any length are taken whole; an empty table gives no rows.
Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import id_text, materialise, partitions, text_slices

MARK = "▁"
CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Chunks that are broadcast, and the longest of them; chunks that a task counts before it sends its counts on.
TABLE_CHUNKS, CHUNK_BYTES, COUNTED = 200_000, 256, 200_000
MAX_MODEL_BYTES = 64 << 20


def marked(texts: list[str | None]) -> list[list[str]]:
    """The chunks of each text."""
    return [CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]


class Segmented(NamedTuple):
    """Chunks' ids end to end with how many each has, the ids written out, and the decoded text (a marker's space first)."""

    ids: np.ndarray
    sizes: np.ndarray
    written: pa.StringArray
    decoded: pa.StringArray


class ChunkTable:
    """A model with the table of frequent chunks, as numbers into packed columns."""

    def __init__(self, model: bytes, frequent: pa.Table | None = None):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        if any(MARK in p.lstrip(MARK) for p in map(self.model.id_to_piece, range(self.model.vocab_size()))):
            raise ValueError("a piece of this model has the white-space marker inside; chunks don't part its pieces")
        if self.model.encode("a  b ", out_type=str)[0][0] != MARK or self.model.decode(self.model.encode(" a  b ")) != " a  b ":
            raise ValueError("this model changes white space; chunks need a marker put first and all others kept")
        self.alone = [self.model.piece_to_id(MARK)]
        self.place: dict[str, int] = {}
        self.known = self.segment([])
        if frequent is not None and len(frequent):
            lists, written, decoded = (frequent.column(c).combine_chunks() for c in ("ids", "written", "decoded"))
            self.place = {c: i for i, c in enumerate(frequent.column("chunk").to_pylist())}
            self.known = Segmented(lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy().astype(np.int64), written, decoded)

    def segment(self, chunks: list[str]) -> Segmented:
        # the library puts the first marker itself and takes it off again; a marker alone is no text to it
        ids = [i if c != MARK else self.alone for c, i in zip(chunks, self.model.encode([c[1:].replace(MARK, " ") for c in chunks], num_threads=1))]
        decoded = [f" {text}" for text in self.model.decode(ids, num_threads=1)] if ids else []
        flat, sizes = np.array([*chain.from_iterable(ids)], np.int32), np.array([len(i) for i in ids], np.int64)
        return Segmented(flat, sizes, pa.array([" ".join(map(str, i)) for i in ids], pa.string()), pa.array(decoded, pa.string()))

    def encode(self, texts: list[str | None]) -> tuple[pa.ListArray, list[str], list[str]]:
        """Ids with the end id, the same written in decimals, and the decoded text, of each text."""
        parts = marked(texts)
        cuts = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        distinct = pa.array(list(chain.from_iterable(parts)), pa.string()).dictionary_encode()
        # where each distinct chunk stands: in the table, or behind it among those that are segmented now
        chunks = distinct.dictionary.to_pylist()
        at = np.array([self.place.get(c, -1) for c in chunks], np.int64)
        tail = np.flatnonzero(at < 0)
        at[tail] = len(self.place) + np.arange(len(tail))
        more = self.segment([chunks[i] for i in tail])
        end = self.model.eos_id()
        ids = np.concatenate([self.known.ids, more.ids, [end]]).astype(np.int32)
        sizes = np.concatenate([self.known.sizes, more.sizes, [1]])
        start = np.cumsum(sizes) - sizes
        chunk = at[distinct.indices.to_numpy(zero_copy_only=False)]
        place = np.insert(chunk, cuts[1:], len(sizes) - 1)  # the end id after each text's last chunk
        count = sizes[place]
        flat = ids[np.arange(count.sum()) + np.repeat(start[place] - (np.cumsum(count) - count), count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], cuts[1:] + np.arange(1, len(cuts))])]
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        joined = lambda a, b, mark: pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), pa.concat_arrays([a, b]).take(pa.array(chunk))), mark).to_pylist()
        written, decoded = joined(self.known.written, more.written, " "), joined(self.known.decoded, more.decoded, "")
        return lists, [f"{w} {end}" if w else str(end) for w in written], [t[1:] for t in decoded]


#: The table of this worker process, by its broadcast: a worker's next task goes on with it.
_table: dict[str, ChunkTable] = {}


def table_of(name: str, model: bytes, frequent: pa.Table | None) -> ChunkTable:
    if name not in _table:
        _table.clear()
        _table[name] = ChunkTable(model, frequent)
    return _table[name]


def count_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow kernel: (chunk, n) of the chunks that may go into the table."""
    held, size = [], 0

    def counts() -> pa.RecordBatch:
        total = pa.concat_tables(held).group_by("chunk").aggregate([("n", "sum")])
        return total.rename_columns({"n_sum": "n"}).select(["chunk", "n"])

    for batch in batches:
        for part in text_slices(batch, "text"):
            flat = pa.array(list(chain.from_iterable(marked(part.column(0).unique().to_pylist()))), pa.string())
            found = pc.value_counts(flat.filter(pc.less_equal(pc.binary_length(flat), CHUNK_BYTES)))
            held.append(pa.table({"chunk": found.field(0), "n": found.field(1)}))
            size += len(found)
            if size > COUNTED:
                held = [counts()]
                size = held[0].num_rows
                if size > COUNTED // 2:
                    yield from held[0].to_batches()
                    held, size = [], 0
    if held:
        yield from counts().to_batches()


def frequent_chunks(df: DataFrame, shared, limit: int = TABLE_CHUNKS) -> pa.Table:
    """The most frequent chunks of all texts, ``limit`` at most, each segmented once; of equally frequent ones all or none."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(shared.value)
        for batch in batches:
            found = table.segment(batch.column(0).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(found.sizes)]).astype(np.int32)), pa.array(found.ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, found.written, found.decoded], names=["chunk", "ids", "written", "decoded"])

    counts = df.select("text").mapInArrow(count_chunks, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n")).filter("n > 1")
    # how many chunks there are of each count (large ones in steps of a hundredth) says from which on the table holds all
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise(1000 + F.floor(64 * F.log2("n"))).alias("step")
    counts = materialise(counts.select("chunk", step), "chunk-counts")
    least, room = 1 << 62, limit
    for row in sorted(counts.groupBy("step").count().collect(), reverse=True):
        if (room := room - row["count"]) < 0:
            break
        least = row["step"]
    top = counts.filter(F.col("step") >= least).select("chunk").repartition(partitions(df.sparkSession))
    return top.mapInArrow(segment, "chunk string, ids array<int>, written string, decoded string").toArrow()


def encode(df: DataFrame, model_path: str, keep_ids: bool = True, keep_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (null unless ``keep_ids``), ids_sha256, decoded (null unless ``keep_text``) and decoded_sha256 of every row of ``df``."""
    with open(model_path, "rb") as f:
        model = f.read(MAX_MODEL_BYTES + 1)
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"the model is over {MAX_MODEL_BYTES} bytes; it is not to be broadcast")
    context, docs = df.sparkSession.sparkContext, id_text(df)
    shared = context.broadcast(model)
    frequent, name = context.broadcast(frequent_chunks(docs, shared)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(name, shared.value, frequent.value)
        for batch in batches:
            for part in text_slices(batch, "text"):
                texts = part.column(1).dictionary_encode(null_encoding="encode")
                ids, written, decoded = table.encode(texts.dictionary.to_pylist())
                sha = lambda values: pa.array([hashlib.sha256(v.encode()).hexdigest() for v in values], pa.string())
                found = [
                    pc.list_value_length(ids).cast(pa.int64()),
                    ids if keep_ids else pa.nulls(len(ids), ids.type),
                    sha(written),
                    pa.array(decoded if keep_text else [None] * len(ids), pa.string()),
                    sha(decoded),
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(c.take(texts.indices) for c in found)],
                    names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"],
                )

    return docs.select("doc_id", F.col("text")).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded string, decoded_sha256 string")
