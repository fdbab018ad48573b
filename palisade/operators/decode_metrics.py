"""Bulk decoding of metrics messages (JSON bodies) to typed columns or the first error in document order.

Spark's own JSON functions decode escapes, merge repeated members and give no typed first error. Messages in the form that
senders use (members in one order, once each, no escapes or blanks, within all limits) match one strict pattern and are
taken apart by built-in functions (``usual_list``, ``usual_message``). Only the others leave the JVM, in Arrow batches:
a scanner over byte text reads them, with one compiled pattern a token, and gives the first error.
"""

from __future__ import annotations

import re
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import MetricsLimits
from palisade.functions.columns import bytes_as_text
from palisade.reasons import outcome, pinned
from palisade.schemas import PARSED_METRICS

_GAP = re.compile(r"[ \t\n\r]*")
_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_WHOLE = re.compile(r"-?[0-9]+")
_REAL = re.compile(r"(-?[0-9]+(?:\.[0-9]*)?)(?:([eE][+-]?)([0-9]*))?")
_AGENT = re.compile(r"[A-Za-z0-9_.-]+")

class Reject(Exception):
    """Carries the reason as its only argument."""


class _Scanner:
    def __init__(self, text: str, limits: MetricsLimits):
        self.text, self.at, self.limits = text, 0, limits

    def gap(self) -> None:
        self.at = _GAP.match(self.text, self.at).end()

    def takes(self, mark: str) -> bool:
        if self.text.startswith(mark, self.at):
            self.at += 1
            return True
        return False

    def string(self, reason: str) -> str:
        found = _TEXT.match(self.text, self.at)
        if not found:
            raise Reject(reason)
        self.at = found.end()
        return found[1]

    def short(self, longest: int, reason: str) -> str:
        value = self.string("InvalidFieldType")
        if len(value) > longest:
            raise Reject(reason)
        return value

    def whole(self) -> int:
        found = _WHOLE.match(self.text, self.at)
        digits = found[0].lstrip("-").lstrip("0") if found else ""
        if not found or len(digits) > 19:
            raise Reject("InvalidFieldType")
        value = int(f"-{digits or 0}" if found[0].startswith("-") else digits or 0)
        if not -(1 << 63) <= value < 1 << 63:
            raise Reject("InvalidFieldType")
        self.at = found.end()
        return value

    def real(self) -> float:
        found = _REAL.match(self.text, self.at)
        if not found:
            raise Reject("MetricValueNotNumber")
        self.at = found.end()
        mantissa, mark, digits = found.groups()
        value = float(f"{mantissa}{mark}{digits}" if digits else mantissa)
        if value in (float("inf"), float("-inf")) or value == 0 and mantissa.strip("-0."):
            raise Reject("MetricValueNotNumber")  # beyond a double's range, at either end
        return value

    def members(self, read) -> bool:
        """Read ``{name: value, ...}``, calling ``read(name)`` at each value; False for an empty object."""
        self.gap()
        if self.takes("}"):
            return False
        while True:
            self.gap()
            name = self.string("InvalidJson")
            self.colon()
            read(name)
            self.gap()
            if self.takes("}"):
                return True
            if not self.takes(","):
                raise Reject("InvalidJson")

    def colon(self) -> None:
        self.gap()
        if not self.takes(":"):
            raise Reject("InvalidJson")
        self.gap()

    def message(self) -> dict:
        out: dict = {"ts": 0, "metrics": []}
        seen: set[str] = set()

        def read(name: str) -> None:
            if name == "agent_id":
                value = self.short(self.limits.agent_id, "AgentIdTooLong")
                if not _AGENT.fullmatch(value):
                    raise Reject("AgentIdInvalidChars")
                out["agent_id"] = value
            elif name == "seq":
                out["seq"] = self.whole() % (1 << 32)
            elif name == "ts":
                out["ts"] = self.whole() % (1 << 64)
            elif name == "metrics":
                self.metrics(out["metrics"])
            else:
                raise Reject("UnexpectedField")
            seen.add(name)

        self.gap()
        if not self.takes("{"):
            raise Reject("InvalidJson")
        # what follows the closing brace is not looked at
        if not self.members(read) or not seen >= {"agent_id", "seq", "metrics"}:
            raise Reject("MissingRequiredField")
        return out

    def metrics(self, into: list) -> None:
        """A further array goes on where the one before ended, but an empty one clears the list."""
        if not self.takes("["):
            raise Reject("InvalidFieldType")
        self.gap()
        if self.takes("]"):
            into.clear()
            return
        while True:
            if len(into) >= self.limits.metrics:
                raise Reject("TooManyMetrics")
            into.append(self.metric())
            self.gap()
            if self.takes("]"):
                return
            if not self.takes(","):
                raise Reject("InvalidJson")
            self.gap()

    def metric(self) -> dict:
        out: dict = {"unit": "", "tags": []}

        def read(name: str) -> None:
            if name == "n":
                out["name"] = self.short(self.limits.name, "MetricNameTooLong")
            elif name == "v":
                out["value"] = self.real()
            elif name == "u":
                out["unit"] = self.short(self.limits.unit, "UnitTooLong")
            elif name in self.limits.tag_members:
                self.tags(out["tags"])
            else:
                raise Reject("UnexpectedField")

        if not self.takes("{"):
            raise Reject("InvalidJson")
        self.members(read)
        for field, reason in (("name", "MetricMissingName"), ("value", "MetricMissingValue")):
            if field not in out:
                raise Reject(reason)
        return out

    def tags(self, into: list) -> None:
        if not self.takes("{"):
            raise Reject("InvalidFieldType")
        self.gap()
        if self.takes("}"):
            return
        while True:
            if len(into) >= self.limits.tags:
                raise Reject("TooManyTags")
            self.gap()
            key = self.string("InvalidJson")
            if len(key) > self.limits.tag_key:
                raise Reject("TagKeyTooLong")
            self.colon()
            into.append({"key": key, "value": self.short(self.limits.tag_value, "TagValueTooLong")})
            self.gap()
            if self.takes("}"):
                return
            if not self.takes(","):
                raise Reject("InvalidJson")


def scan(body: bytes | None, limits: MetricsLimits = MetricsLimits()) -> dict | None:
    """Fields of a body, or its ``reason``; None for None."""
    if body is None:
        return None
    if len(body) > limits.input_bytes:
        return {"reason": "InputTooLarge"}
    try:
        return _Scanner(body.decode("latin-1"), limits).message()
    except Reject as e:
        return {"reason": e.args[0]}


def parsed_metrics(body: Column, limits: MetricsLimits = MetricsLimits()) -> Column:
    """Struct (reason, agent_id, seq, ts, metrics) of a binary column; null for null."""
    pair = pa.struct([("key", pa.string()), ("value", pa.string())])
    metric = pa.struct([("name", pa.string()), ("value", pa.float64()), ("unit", pa.string()), ("tags", pa.list_(pair))])
    kind = pa.struct([("reason", pa.string()), ("agent_id", pa.string()), ("seq", pa.int64()), ("ts", pa.decimal128(20, 0)), ("metrics", pa.list_(metric))])

    @F.arrow_udf(PARSED_METRICS)
    def decode(bodies: pa.Array) -> pa.Array:
        out = [scan(b, limits) for b in bodies.to_pylist()]
        for row in out:
            if row and "ts" in row:
                row["ts"] = Decimal(row["ts"])
        return pa.array(out, kind)

    return decode(body)


_WHOLE_NUMBER, _NUMBER = "(?:0|[1-9][0-9]{0,17}+)", r"-?+(?:0|[1-9][0-9]{0,14}+)(?:\.[0-9]{1,15}+)?+"


def _string(most: int) -> str:
    return rf'[^"\\]{{0,{most}}}+'


def _usual(limits: MetricsLimits, group: str = "(?:") -> tuple[str, str, str]:
    """Patterns of a usual message's head, metric and tag, with ``group`` before what is to be taken out of them. All
    repetitions are possessive, so a match takes time in proportion to its length."""
    tag = rf'"{group}{_string(limits.tag_key)})":"{group}{_string(limits.tag_value)})"'
    tags = tag.replace(group, "(?:")
    metric = rf'\{{"n":"{group}{_string(limits.name)})","v":{group}{_NUMBER})(?:,"u":"{group}{_string(limits.unit)})")?+(?:,"t":\{{{group}(?:{tags}(?:,{tags}){{0,{max(limits.tags - 1, 0)}}}+)?+)\}})?+\}}'
    head = rf'\A\{{"agent_id":"{group}[A-Za-z0-9_.-]{{1,{limits.agent_id}}}+)","seq":{group}{_WHOLE_NUMBER})(?:,"ts":{group}{_WHOLE_NUMBER}))?+,"metrics":\['
    return head, metric, tag


def usual_list(text: Column, limits: MetricsLimits = MetricsLimits()) -> Column:
    """The metrics of a message in the usual form, as text; empty for any other. What follows a message is not looked at."""
    head, metric, _ = _usual(limits)
    return F.regexp_extract(text, rf"{head}({metric}(?:,{metric}){{0,{limits.metrics - 1}}}+)\]\}}", 1)


def usual_message(text: Column, listed: Column, limits: MetricsLimits = MetricsLimits()) -> Column:
    """The same struct as the scanner's, of a usual message and its ``usual_list``."""
    head, metric, tag = _usual(limits, "(")
    part = lambda i: F.regexp_extract(text, head, i)
    of = lambda where, pattern, i: F.regexp_extract_all(where, F.lit(pattern), F.lit(i))
    tags = lambda given: F.zip_with(of(given, tag, 1), of(given, tag, 2), lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    each = F.arrays_zip(*(of(listed, metric, i).alias(name) for i, name in enumerate(("name", "value", "unit", "tags"), 1)))
    metrics = F.transform(each, lambda m: F.struct(m["name"].alias("name"), m["value"].cast("double").alias("value"), m["unit"].alias("unit"), tags(m["tags"]).alias("tags")))
    seq = F.pmod(part(2).cast("long"), F.lit(1 << 32))
    stamp = F.when(part(3) == "", F.lit(0)).otherwise(part(3).cast("long"))
    return F.struct(F.lit(None).cast("string").alias("reason"), part(1).alias("agent_id"), seq.alias("seq"), stamp.cast("decimal(20,0)").alias("ts"), metrics.alias("metrics")).cast(PARSED_METRICS)


def decode_metrics(df: DataFrame, limits: MetricsLimits = MetricsLimits()) -> DataFrame:
    """Add agent_id, seq, ts and metrics to rows of type ``metrics``; the scanner sees the bodies that are not usual."""
    df = pinned(df, "drop_stage", "drop_reason")
    mine = F.col("drop_reason").isNull() & (F.col("msg_type") == "metrics")
    usual = "t" in limits.tag_members and limits.metrics > 0 and limits.tags > 0
    text = bytes_as_text(F.col("body"))
    listed = usual_list(F.when(mine & (F.octet_length("body") <= limits.input_bytes), text), limits) if usual else F.lit("")
    df = pinned(df.withColumn("_listed", F.coalesce(listed, F.lit(""))), "_listed")
    own = F.when(F.col("_listed") != "", usual_message(text, F.col("_listed"), limits)) if usual else F.lit(None).cast(PARSED_METRICS)
    df = df.withColumn("_m", parsed_metrics(F.when(mine & (F.col("_listed") == ""), F.col("body")), limits))
    df = pinned(df.withColumn("_m", F.coalesce("_m", own)).drop("_listed"), "_m")
    df = df.withColumns({"metrics_agent": F.col("_m.agent_id"), "seq": F.col("_m.seq"), "metrics_ts": F.col("_m.ts"), "metrics": F.col("_m.metrics")})
    return pinned(outcome(df, "parse_metrics", F.col("_m.reason")).drop("_m"), "drop_stage", "drop_reason")
