"""Limits of every stage, with a ``demo`` profile beside the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RecvConfig:
    max_datagram_bytes: int = 1472


@dataclass(frozen=True)
class LimiterConfig:
    max_sources: int = 1024
    tokens_per_sec: int = 100
    burst_tokens: int = 200


@dataclass(frozen=True)
class MetricsLimits:
    input_bytes: int = 65536
    agent_id: int = 64
    metrics: int = 50
    name: int = 128
    unit: int = 16
    tags: int = 8
    tag_key: int = 64
    tag_value: int = 64
    #: Member names under which a metric's tags are read.
    tag_members: tuple[str, ...] = ("t",)


@dataclass(frozen=True)
class LogLimits:
    line_bytes: int = 2048
    fields: int = 16
    key: int = 32
    value: int = 1024


@dataclass(frozen=True)
class TimeWindow:
    max_age_ms: int = 300_000
    max_future_ms: int = 60_000


@dataclass(frozen=True)
class MetricsRules:
    window: TimeWindow = TimeWindow()
    min_value: float = -1e15
    max_value: float = 1e15
    reject_nan: bool = True
    reject_infinity: bool = True
    require_timestamp: bool = True


@dataclass(frozen=True)
class LogRules:
    window: TimeWindow = TimeWindow()
    min_level: int = 0
    max_message_bytes: int = 1024
    truncate_message: bool = True
    require_agent_id: bool = False


@dataclass(frozen=True)
class ForwardConfig:
    max_queue_depth: int = 4096
    max_per_agent: int = 64


@dataclass(frozen=True)
class GateConfig:
    recv: RecvConfig = RecvConfig()
    limiter: LimiterConfig = LimiterConfig()
    metrics: MetricsLimits = MetricsLimits()
    logs: LogLimits = LogLimits()
    metrics_rules: MetricsRules = MetricsRules()
    log_rules: LogRules = LogRules()
    forward: ForwardConfig = field(default_factory=ForwardConfig)

    @staticmethod
    def demo() -> GateConfig:
        return GateConfig(limiter=LimiterConfig(1024, 50, 100), forward=ForwardConfig(256, 16))
