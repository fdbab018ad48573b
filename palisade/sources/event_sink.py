"""A sink for forwarded events with its own commit: one JSON object a line, no line twice or missing, in the order of draining.

``df.write.format("event_lines").option("path", folder)`` after ``register(spark)``, for frames with the columns batch,
forwarded_order and event_bytes. Each task writes one file of lines under ``data``, and says which stretches of it hold
which events (a stretch: events of one interval that leave one after the other). The commit names them all in one
manifest, which is written aside and renamed; what no manifest names, as a task that died or a job that was given up has
left it, is never read. So the order of draining needs no sort over all events: ``read_lines`` reads stretches by it.

A write with the option ``number`` (a stream's trigger) counts once: if that number was committed before, the new files go.
The folder may be on any file system that pyarrow reads by its URI; driver and executors must both see it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

COLUMNS = ("batch", "forwarded_order", "event_bytes")
STRETCH = "batch long, first long, rows long, file string, at long, bytes long"


def opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    fs, root = pa.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pa.fs.LocalFileSystem(), path)
    return fs, root.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """A task's file, and its stretches (batch, first order, rows, first byte, bytes)."""

    file: str
    stretches: list[tuple[int, int, int, int, int]]


class _Lines:
    """What batch and stream writers share."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.number = options["path"], options.get("number")
        self.places = [schema.fieldNames().index(c) for c in COLUMNS]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        name, stretches, at = f"{uuid.uuid4().hex}.jsonl", [], 0
        fs.create_dir(f"{root}/data", recursive=True)
        with fs.open_output_stream(f"{root}/data/{name}") as out:
            for rows in iterator:
                batch, order = (rows.column(p).cast(pa.int64()).to_numpy(zero_copy_only=False) for p in self.places[:2])
                lines = [line + b"\n" for line in rows.column(self.places[2]).to_pylist()]
                ends = at + np.cumsum([len(line) for line in lines], dtype=np.int64)
                cuts = np.flatnonzero((np.diff(batch) != 0) | (np.diff(order) != 1)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(lines)]):
                    if a == b:
                        continue
                    first = int(ends[a - 1]) if a else at
                    new = (int(batch[a]), int(order[a]), b - a, first, int(ends[b - 1]) - first)
                    before = stretches[-1] if stretches else None
                    if before and before[0] == new[0] and before[1] + before[2] == new[1]:
                        stretches[-1] = (*before[:2], before[2] + new[2], before[3], before[4] + new[4])
                    else:
                        stretches.append(new)
                out.write(b"".join(lines))
                at = int(ends[-1]) if len(lines) else at
        return Written(name, stretches)

    def settle(self, messages: list[Written | None], number: str) -> None:
        """Name all files in a manifest; if there is one of this number, they go."""
        fs, root = opened(self.path)
        manifest, aside = f"{root}/manifests/{number}.jsonl", f"{root}/manifests/.{uuid.uuid4().hex}"
        if fs.get_file_info(manifest).type != pa.fs.FileType.NotFound:
            self.drop(messages)
            return
        fs.create_dir(f"{root}/manifests", recursive=True)
        with fs.open_output_stream(aside) as out:
            for m in filter(None, messages):
                for batch, first, rows, at, size in m.stretches:
                    out.write(json.dumps({"batch": batch, "first": first, "rows": rows, "file": m.file, "at": at, "bytes": size}).encode() + b"\n")
        fs.move(aside, manifest)

    def drop(self, messages: list[Written | None]) -> None:
        fs, root = opened(self.path)
        for m in filter(None, messages):
            if fs.get_file_info(f"{root}/data/{m.file}").type != pa.fs.FileType.NotFound:
                fs.delete_file(f"{root}/data/{m.file}")


class BatchLines(_Lines, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self.settle(messages, f"number={self.number}" if self.number else f"job={uuid.uuid4().hex}")

    def abort(self, messages: list[Written | None]) -> None:
        self.drop(messages)


class StreamLines(_Lines, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self.settle(messages, f"number={batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self.drop(messages)


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def writer(self, schema: StructType, overwrite: bool) -> BatchLines:
        return BatchLines(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamLines:
        return StreamLines(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLines)


def write_lines(df: DataFrame, path: str, number: int | None = None) -> None:
    """Forwarded events of a frame; rows are put in order inside of each task only, and nothing is shuffled."""
    register(df.sparkSession)
    alive = df.filter(F.col("drop_reason").isNull()) if "drop_reason" in df.columns else df
    rows = alive.select(F.col("batch").cast("long").alias("batch"), F.col("forwarded_order").cast("long").alias("forwarded_order"), "event_bytes").sortWithinPartitions("batch", "forwarded_order")
    writer = rows.write.format("event_lines").mode("append").option("path", path)
    (writer if number is None else writer.option("number", str(number))).save()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(batch, forwarded_order, line) of all committed events; stretches are read by as many tasks as there are partitions."""
    stretches = spark.read.schema(STRETCH).json(f"{path}/manifests")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = opened(path)
        for rows in batches:
            for r in rows.to_pylist():
                with fs.open_input_file(f"{root}/data/{r['file']}") as f:
                    lines = f.read_at(r["bytes"], r["at"]).split(b"\n")[:-1]
                n = len(lines)
                yield pa.RecordBatch.from_arrays([pa.array([r["batch"]] * n, pa.int64()), pa.array(range(r["first"], r["first"] + n), pa.int64()), pa.array(lines, pa.binary())], names=["batch", "forwarded_order", "line"])

    return stretches.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "at").mapInArrow(read, "batch long, forwarded_order long, line binary")


def line_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for ``start_stream``: a trigger that is run again adds nothing."""
    return lambda bounded, number: write_lines(bounded, path, number)
