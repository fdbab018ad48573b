"""Allow and block rules over URLs, by a broadcast trie of reversed host labels and path segments.

A rule names a host and a path. It fits the host and all its subdomains if the URL's path starts with the rule's; of
the rules that fit, the one with most host labels wins, then the one with the longest path, and of two equal rules the
block. The trie is broadcast, so it is for ``MAX_RULES`` rules at most; a larger set is joined instead
(``judge_by_join``), with equal results.

Null URLs, and URLs without ``://``, have an empty host and path, fit no rule and get the default verdict. Every row,
repeated or not, is judged by itself; URLs of any length are taken whole; an empty table gives no rows. Columns other
than page_id and url are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_RULES = 200_000


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rule list of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def build_trie(rules: Iterable[Rule]) -> dict:
    """Nested dicts by host label from the right; under ``/`` nested dicts by whole path segment; under ``*`` the
    (last segment's beginning, rule) pairs that end there."""
    root: dict = {}
    for n, rule in enumerate(rules):
        if n >= MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules; a trie of them is not to be broadcast, join them")
        node = root
        for label in reversed(rule.host.lower().split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("/", {})
        *whole, rest = rule.path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault("*", []).append((rest, rule))
    return root


def split_url(url: str | None) -> tuple[str, str]:
    before, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(65, 91)}


def longest_match(trie: dict, host: str, path: str) -> Rule | None:
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        below, depth = node.get("/"), 0
        fits = []
        while below is not None:
            rest = segments[depth] if depth < len(segments) else None
            if rest is not None:
                fits += [rule for start, rule in below.get("*", ()) if rest.startswith(start)]
            # a segment counts as whole only if a slash follows it
            below, depth = (below.get(rest) if depth + 1 < len(segments) else None), depth + 1
        if fits:
            best = max(fits, key=lambda r: (len(r.path), r.verdict == "block"))
    return best


def judge(df: DataFrame, rules: Iterable[Rule] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (null: none fits) and verdict of every row's url. ``rules`` may be a table (verdict, host,
    path)."""
    if isinstance(rules, DataFrame):
        if rules.limit(MAX_RULES + 1).count() > MAX_RULES:
            return judge_by_join(df, rules, default)
        rules = [Rule(*r) for r in rules.select("verdict", "host", "path").collect()]
    shared = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [longest_match(trie, host, path) for host, path in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([host for host, _ in parts], pa.string()),
                    pa.array([path for _, path in parts], pa.string()),
                    pa.array([r and r.name for r in found], pa.string()),
                    pa.array([r.verdict if r else default for r in found], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return pages.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def judge_by_join(df: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """As ``judge``, for any number of rules: each distinct host and path asks, for every suffix of its host that has rules
    and every length that their paths have, for the rule with just that suffix and beginning."""
    at = F.instr("url", "://")
    rest = F.regexp_extract(F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(""), r"(?s)\A[^?#]*", 0)
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), F.regexp_extract(rest, r"(?s)/.*\z", 0).alias("path"))
    rules = rules.groupBy(F.lower("host").alias("suffix"), F.col("path").alias("start")).agg(F.min(F.struct((F.col("verdict") != "block").alias("allows"), "verdict", "host")).alias("own"))
    lengths = rules.groupBy("suffix").agg(F.collect_set(F.char_length("start")).alias("lengths"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(i.alias("n"), F.array_join(F.slice(labels, -i, i), ".").alias("suffix")))
    asked = pages.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("s")).select("host", "path", "s.*").join(lengths, "suffix")
    asked = asked.select("host", "path", "n", "suffix", F.explode(F.filter("lengths", lambda k: k <= F.char_length("path"))).alias("k"))
    found = asked.withColumn("start", F.substring("path", F.lit(1), F.col("k"))).join(rules, ["suffix", "start"])
    best = found.groupBy("host", "path").agg(F.max_by(F.struct("own.host", "start", "own.verdict"), F.struct("n", "k")).alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.concat("best.host", "best.start").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN regexp_replace(substr(url, position('://' IN url) + 3), '[?#].*$', '', 's') ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, rest, CASE WHEN position('/' IN rest) > 0 THEN position('/' IN rest) ELSE length(rest) + 1 END AS cut FROM parts
), named AS (
  SELECT page_id, translate(substr(rest, 1, cut - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, cut) AS path FROM split
), ruled AS (
  SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path,
    CASE WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/'
         WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' END AS rule
  FROM named
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""
