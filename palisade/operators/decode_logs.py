"""Bulk decoding of log lines (``key=value`` text) to typed columns or the first error, with built-in functions only.

One pattern that must go on where the last match ended cuts the line into tokens; what is left over tells why it could
not go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import LogLimits
from palisade.functions.columns import bytes_as_text, first_reason, level_code
from palisade.reasons import outcome, pinned

_FIELD = r'\G[ \t]*+[a-z_][a-z0-9_]*+=(?:"[^"]*+"|(?!")[^ \t"=]*+)'
_BLANK, _ENDS = " \t", " \t\r\n"
_UINT64 = (1 << 64) - 1


def _field(token: Column) -> Column:
    key, raw = F.substring_index(token, "=", 1), F.substr(token, F.instr(token, "=") + 1)
    quoted = F.startswith(raw, F.lit('"'))
    return F.struct(F.ltrim(key, F.lit(_BLANK)).alias("key"), F.when(quoted, F.btrim(raw, F.lit('"'))).otherwise(raw).alias("value"))


def last_value(fields: Column, key: Column | str) -> Column:
    """The value under a key; the last of several. Null if there is none."""
    key = F.lit(key) if isinstance(key, str) else key
    return F.try_element_at(F.filter(fields, lambda f: f["key"] == key), F.lit(-1))["value"]


def uint64(digits: Column) -> Column:
    """Decimal digits as a number, null if there are others or it is beyond 64 bits."""
    short = F.regexp_replace(digits, r"\A0+(?=[0-9])", "")
    number = F.when(short.rlike(r"\A[0-9]{1,20}\z"), short.try_cast("decimal(20,0)"))
    return F.when(number <= F.lit(str(_UINT64)).cast("decimal(20,0)"), number)


def _field_reason(field: Column, index: Column, limits: LogLimits) -> Column:
    key, value = field["key"], field["value"]
    return first_reason(
        (index >= limits.fields, "TooManyFields"),
        (F.length(key) > limits.key, "KeyTooLong"),
        (F.length(value) > limits.value, "ValueTooLong"),
        ((key == "ts") & uint64(value).isNull(), "InvalidTimestamp"),
        ((key == "level") & level_code(value).isNull(), "InvalidLevel"),
    )


def decode_logs(df: DataFrame, limits: LogLimits = LogLimits()) -> DataFrame:
    """Add log_ts, level, log_agent, msg and fields to rows of type ``log``."""
    df = pinned(df, "drop_stage", "drop_reason")
    mine = F.col("drop_reason").isNull() & (F.col("msg_type") == "log")
    size = F.octet_length("body")
    line = F.when(mine & (size <= limits.line_bytes), F.rtrim(bytes_as_text("body"), F.lit(_ENDS)))
    df = df.withColumn("_line", line).withColumn("_tokens", F.regexp_extract_all("_line", F.lit(_FIELD), F.lit(0)))
    df = pinned(df, "_line", "_tokens")
    used = F.aggregate("_tokens", F.lit(0), lambda n, t: n + F.length(t))
    df = df.withColumns({"_rest": F.ltrim(F.substr("_line", used + 1), F.lit(_BLANK)), "fields": F.transform("_tokens", _field)})
    df = df.withColumn("_wrong", F.filter(F.transform("fields", lambda f, i: _field_reason(f, i, limits)), F.isnotnull))
    df = pinned(df, "_rest", "fields", "_wrong")
    rest, key = F.col("_rest"), F.regexp_extract("_rest", r"\A[a-z_][a-z0-9_]*", 0)
    values = {name: last_value(F.col("fields"), source) for name, source in (("_ts", "ts"), ("_level", "level"), ("msg", "msg"), ("log_agent", "agent"))}
    df = pinned(df.withColumns(values), *values)
    reason = F.coalesce(
        F.when(size > limits.line_bytes, F.lit("InputTooLarge")),
        F.when(F.col("_line") == "", F.lit("EmptyInput")),
        F.get("_wrong", F.lit(0)),
        F.when(
            rest != "",
            first_reason(
                (F.size("_tokens") >= limits.fields, "TooManyFields"),
                (key == "", "InvalidKeyChar"),
                (F.length(key) > limits.key, "KeyTooLong"),
                (F.substr(rest, F.length(key) + 1, F.lit(1)) != "=", "MissingEquals"),
                (F.lit(True), "UnterminatedQuote"),
            ),
        ),
        first_reason((F.col("_ts").isNull(), "MissingTimestamp"), (F.col("_level").isNull(), "MissingLevel"), (F.col("msg").isNull(), "MissingMessage")),
    )
    df = df.withColumns({"log_ts": uint64(F.col("_ts")), "level": level_code(F.col("_level")), "log_agent": F.when(mine, F.coalesce("log_agent", F.lit("")))})
    df = outcome(df, "parse_log", F.when(mine, reason)).drop("_line", "_tokens", "_rest", "_wrong", "_ts", "_level")
    return pinned(df, "log_ts", "level", "log_agent", "drop_stage", "drop_reason")
