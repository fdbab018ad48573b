"""Token-count rollups by source, language and tokenizer version, maintained from deltas.

A change is an insert (new count), a delete (old count) or a revision (both). Each becomes signed additive rows; a
batch's rows are summed by key with map-side partial sums and written to a folder of that attempt, and the totals are
the sums over committed batches. A batch is committed by a record of its own, a small file that names its folder: it is
written aside and renamed, which fails if there is one, so a record is whole or absent and only one attempt can make it. An
attempt that died before has none, and the batch is written again; one that is committed is not applied twice, whatever is
sent under its number later. ``compact`` folds the committed batches of one snapshot into a base, whose record names them by
ranges; a batch committed meanwhile is not among them and counts beside the base.

Counts that are null count as 0 tokens, and texts of any length are counted whole. Null source and language are kept as
keys of their own. Changes of an unknown kind, and rows that repeat a change within a batch (same doc_id, tokenizer and
``change_id``), are an error and one change, respectively; without change_ids every row is a change. Sums don't depend on
the order of rows, so there are no ties. An empty batch commits, and changes nothing. Keys whose documents are all gone
remain with zeros until ``compact`` drops them. Only the columns named here are read, so others can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import materialise

KEYS = ("source", "lang", "tokenizer")
ROLLUP = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens): one row for each side of each change.

    ``changes``: change_id, doc_id, op (insert, delete, revise), source, lang, tokenizer, old_tokens, new_tokens; a
    revision may also move its document from one key to another: where there are columns old_source and old_lang, it is
    taken from what they say, null being a key. A delete need not repeat its key in them.
    """
    left = lambda c: F.when(F.col("op") == "revise", F.col(f"old_{c}")).otherwise(F.coalesce(F.col(f"old_{c}"), F.col(c)))
    moved = [left(c) if f"old_{c}" in changes.columns else F.col(c) for c in ("source", "lang")]
    known = F.when(F.col("op").isin("insert", "delete", "revise"), F.col("op")).otherwise(F.raise_error(F.lit("unknown kind of change")))
    count = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0))
    side = lambda source, lang, docs, tokens: F.struct(source.alias("source"), lang.alias("lang"), F.col("tokenizer"), docs.alias("n_docs"), tokens.alias("n_tokens"))
    one = F.lit(1).cast("long")
    new = F.when(F.col("op") != "delete", side(F.col("source"), F.col("lang"), one, count("new_tokens")))
    old = F.when(F.col("op") != "insert", side(*moved, -one, -count("old_tokens")))
    sides = changes.withColumn("op", known).select(F.explode(F.filter(F.array(new, old), lambda s: s.isNotNull())).alias("s"))
    return sides.select("s.*")


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollups:
    """Totals kept under ``path``, which every executor must see: ``data`` has one folder an attempt, ``commits`` one
    record a batch. Records are made with the driver's file system interface, so this needs a classic session."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path: Callable = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def records(self) -> list[tuple[str, int, str]]:
        """(kind, number, folder) of each record: a batch's number, or which base it is, whose folder is followed by the
        numbers of the batches in it. What is no whole record counts as absent."""
        if not self._fs.exists(self._path(f"{self.path}/commits")):
            return []
        said = (r["value"].split(" ") for r in self.spark.read.text(f"{self.path}/commits").collect())
        return [(r[0], int(r[1]), r[2]) for r in said if len(r) == 3]

    def committed(self) -> list[int]:
        return sorted(number for kind, number, _ in self.records() if kind == "batch")

    def _write(self, file: str, text: str) -> None:
        out = self._fs.create(self._path(file), False)
        out.writeBytes(text)
        out.close()

    def _put(self, aside: str, file: str) -> None:
        """Rename without overwriting; Hadoop raises where the file is there."""
        fs, context = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext
        how = context._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        how[0] = getattr(fs, "Options$Rename").NONE
        folder, name = file.rsplit("/", 1)
        if not self._fs.exists(self._path(file)):  # the checksum of a record that was removed by hand would fit no other
            self._fs.delete(self._path(f"{folder}/.{name}.crc"), False)
        fs.FileContext.getFileContext(self._path(self.path).toUri(), context._jsc.hadoopConfiguration()).rename(self._path(aside), self._path(file), how)

    def _commit(self, kind: str, number: int, folder: str) -> bool:
        """Make a record; False if there is one already."""
        file, aside = f"{self.path}/commits/{kind}-{number:012d}", f"{self.path}/commits/.{uuid.uuid4().hex}"
        self._write(aside, f"{kind} {number} {folder}\n")
        try:
            for last in (False, True):
                try:
                    self._put(aside, file)
                    return True
                except Exception:
                    if any(r[:2] == (kind, number) for r in self.records()):
                        return False
                    if last or not self._fs.exists(self._path(file)):
                        raise
                    self._fs.delete(self._path(file), False)  # no whole record: nobody has committed with it
        finally:
            self._fs.delete(self._path(aside), False)
        return False

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch of changes; False if that batch was committed before."""
        if batch in self.committed():
            return False
        once = changes.dropDuplicates(["doc_id", "tokenizer", "change_id"]) if "change_id" in changes.columns else changes
        folder = f"{batch:012d}-{uuid.uuid4().hex}"
        summed(signed(once)).write.parquet(f"{self.path}/data/{folder}")
        return self._commit("batch", batch, folder)

    def _parts(self, records: list[tuple[str, int, str]]) -> tuple[list[str], list[str]]:
        """The folders that add up to the totals, the last base's and those of batches it does not fold; and all others."""
        base = max(((number, folder) for kind, number, folder in records if kind == "base"), default=None)
        folded = within(base[1].split("+")[1]) if base else lambda number: False
        live = [folder.split("+")[0] for kind, number, folder in records if (number == base[0] if kind == "base" else not folded(number))]
        return live, [folder.split("+")[0] for kind, number, folder in records if folder.split("+")[0] not in live]

    def _sum(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ROLLUP)
        return summed(self.spark.read.schema(ROLLUP).parquet(*(f"{self.path}/data/{f}" for f in folders)))

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return self._sum(self._parts(self.records())[0])

    def compact(self) -> None:
        """Fold all batches committed by now into one base, and remove what they wrote. Batch numbers stay known, by records
        of some bytes each. Not to run while totals are computed elsewhere."""
        records = self.records()
        live, gone = self._parts(records)
        if len(live) > 1:
            folder = f"base-{uuid.uuid4().hex}"
            self._sum(live).filter("n_docs != 0 or n_tokens != 0").write.parquet(f"{self.path}/data/{folder}")
            bases = [number for kind, number, _ in records if kind == "base"]
            numbers = sorted(number for kind, number, _ in records if kind == "batch")
            # a base made meanwhile by another goes by the number, and this one's folder is of no use
            gone += live if self._commit("base", max(bases, default=0) + 1, f"{folder}+{ranges(numbers)}") else [folder]
        for path in gone:
            self._fs.delete(self._path(f"{self.path}/data/{path}"), True)
        for kind, number, _ in records:
            if kind == "base" and number < max(n for k, n, _ in records if k == "base"):
                self._fs.delete(self._path(f"{self.path}/commits/base-{number:012d}"), False)


def ranges(numbers: list[int]) -> str:
    """Ascending numbers as first-last ranges."""
    starts = [n for n, before in zip(numbers, [None, *numbers]) if before is None or n != before + 1]
    stops = [n for n, after in zip(numbers, [*numbers[1:], None]) if after != n + 1]
    return ",".join(f"{a}-{b}" for a, b in zip(starts, stops))


def within(text: str) -> Callable[[int], bool]:
    """Whether a number is in the ranges that ``ranges`` has written."""
    bounds = [tuple(map(int, r.split("-"))) for r in text.split(",") if r]
    return lambda number: any(a <= number <= b for a, b in bounds)


#: Tokenizer versions of the registered query: words between white space, and UTF-8 bytes.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    "bytes-1": lambda text: F.octet_length(text).cast("long"),
}


def count_tokens(df: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): one row for each row of ``df`` and tokenizer, in one read of the texts."""
    counts = F.array(*(F.struct(F.lit(name).alias("tokenizer"), F.coalesce(f(F.col("text")), F.lit(0)).alias("n_tokens")) for name, f in (tokenizers or TOKENIZERS).items()))
    thin = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), counts.alias("counts"))
    return thin.select("doc_id", "source", "lang", F.explode("counts").alias("c")).select("doc_id", "source", "lang", "c.tokenizer", "c.n_tokens")


def replay(df: DataFrame, path: str) -> DataFrame:
    """A history over a whole table: all documents inserted; those with doc_id % 10 = 3 deleted; those with doc_id % 10
    = 4 revised to half their tokens (rounded down) and moved to the source ``revised``; the deletes sent once more."""
    counts = materialise(count_tokens(df), "token-counts")

    def change(op: str, rows: DataFrame, old: Column, new: Column) -> DataFrame:
        return rows.select("doc_id", F.lit(op).alias("op"), "source", "lang", "tokenizer", old.cast("long").alias("old_tokens"), new.cast("long").alias("new_tokens"))

    none, n = F.lit(None), F.col("n_tokens")
    rollups = Rollups(df.sparkSession, path)
    digit = F.pmod("doc_id", F.lit(10))
    rollups.apply(1, change("insert", counts, none, n))
    gone = change("delete", counts.filter(digit == 3), n, none)
    rollups.apply(2, gone)
    rollups.apply(3, change("revise", counts.filter(digit == 4), n, F.floor(n / 2)).withColumn("old_source", F.col("source")).withColumn("source", F.lit("revised")))
    rollups.apply(2, gone)
    return rollups.totals()


ORACLE_SQL = r"""
WITH counts AS (
  SELECT doc_id, source, lang, 'words-1' AS tokenizer, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'bytes-1', coalesce(strlen(text), 0)::BIGINT FROM documents
), kept AS (
  SELECT source, lang, tokenizer, n, CASE WHEN doc_id % 10 IN (3, 4) THEN 0 ELSE 1 END AS here FROM counts
  UNION ALL
  SELECT 'revised', lang, tokenizer, n // 2, 1 FROM counts WHERE doc_id % 10 = 4
)
SELECT source, lang, tokenizer, sum(here)::BIGINT AS n_docs, sum(n * here)::BIGINT AS n_tokens FROM kept GROUP BY source, lang, tokenizer
"""
