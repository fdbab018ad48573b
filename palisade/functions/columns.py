"""Column expressions that the operators share; all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.config import TimeWindow

# Level names in the order of their codes.
LEVELS = ("trace", "debug", "info", "warn", "error", "fatal")


def bytes_as_text(binary: Column | str) -> Column:
    """One character for each byte, so that lengths count bytes and no byte sequence is invalid."""
    return F.decode(binary, "ISO-8859-1")


def text_as_bytes(text: Column | str) -> Column:
    return F.encode(text, "ISO-8859-1")


def valid_agent_id(name: Column) -> Column:
    """A letter, then up to 63 letters, digits, ``_`` or ``-``."""
    return name.rlike(r"\A[a-zA-Z][a-zA-Z0-9_-]{0,63}\z")


def too_old(ts: Column, now_ms: Column, window: TimeWindow) -> Column:
    return ts < F.greatest(F.lit(0), now_ms - window.max_age_ms)


def in_future(ts: Column, now_ms: Column, window: TimeWindow) -> Column:
    return ts > now_ms + window.max_future_ms


def in_time_window(ts: Column, now_ms: Column, window: TimeWindow = TimeWindow()) -> Column:
    """Both ends are inside."""
    return ~too_old(ts, now_ms, window) & ~in_future(ts, now_ms, window)


def level_code(name: Column) -> Column:
    """Code of a lower-case level name, null for any other text."""
    at = F.array_position(F.array(*map(F.lit, LEVELS)), name)
    return F.when(at > 0, (at - 1).cast("int"))


def level_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), code), F.lit("unknown"))


def now_ms() -> Column:
    """The clock is data: a row's arrival."""
    return F.expr("received_at_us div 1000")


def first_reason(*rules: tuple[Column, str]) -> Column:
    """Name of the first rule that holds."""
    return F.coalesce(*(F.when(broken, F.lit(name)) for broken, name in rules))
