"""The whole gate over a table of captured datagrams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.config import GateConfig
from palisade.operators import backlog, limiter, stats
from palisade.operators.decode_logs import decode_logs
from palisade.operators.decode_metrics import decode_metrics
from palisade.operators.envelope import decode_envelope, detect_type, size_gate
from palisade.operators.normalise import unify_events
from palisade.operators.validate import validate_log, validate_metrics
from palisade.reasons import open_outcome, pinned
from palisade.sources.datagrams import forwarded_events


def row_stages(df: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """Every stage that looks at one row alone: envelope to event. One pass over the rows, in batch or stream."""
    df = pinned(detect_type(decode_envelope(open_outcome(df))), "body", "msg_type", "drop_stage", "drop_reason")
    df = decode_logs(decode_metrics(df, config.metrics), config.logs)
    df = validate_log(validate_metrics(df, config.metrics_rules), config.log_rules)
    return unify_events(pinned(df, "msg", "drop_stage", "drop_reason"))


#: What is left of a row after its last byte was read.
LEDGER = ("datagram_id", "received_at_us", "src_ip", "src_port", "admitted", "resident_miss", "agent_id", "event_type", "event_bytes", "drop_stage", "drop_reason")


@dataclass
class Result:
    """``ledger`` has one row a datagram, with where and why it was dropped, or its event."""

    ledger: DataFrame

    @property
    def events(self) -> DataFrame:
        return forwarded_events(self.ledger)

    @property
    def drops(self) -> DataFrame:
        return self.ledger.filter(F.col("drop_reason").isNotNull()).select("datagram_id", "received_at_us", "src_ip", "src_port", "drop_stage", "drop_reason")

    @property
    def stats(self) -> DataFrame:
        return stats.pipeline_stats(self.ledger)


def run_batch(
    datagrams: DataFrame, config: GateConfig = GateConfig(), batch: Column | None = None, limit: bool = True, one_batch: bool = False, large: bool = False, many: bool | None = None
) -> Result:
    """Gate, limit, decode, validate, normalise and bound, each row once: one shuffle by source, one by drain interval.

    ``batch`` is the drain interval of a row (default: a second of arrival); an interval's rows are bounded in one task, so
    where they are too many for that say ``large``, or ``one_batch`` where all rows are one interval. ``many``: whether there
    are more sources than the limiter remembers, which is counted where it is not said."""
    df = size_gate(open_outcome(datagrams), config.recv)
    df = limiter.rate_limit(df, config.limiter, many=many) if limit else df.withColumns({"admitted": F.lit(None).cast("boolean"), "resident_miss": F.lit(None).cast("boolean")})
    thin = row_stages(df, config).select(*LEDGER)
    if one_batch:
        return Result(backlog.bound_large_backlog(thin, config.forward))
    interval = F.expr("received_at_us div 1000000") if batch is None else batch
    return Result(backlog.bound_large_backlog(thin, config.forward, interval) if large else backlog.bound_backlog(thin, interval, config.forward))
