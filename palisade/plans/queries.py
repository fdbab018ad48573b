"""Registered queries over datagrams derived from ``events``, each with the SQL that says what it must return."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.config import ForwardConfig, GateConfig, LimiterConfig, LogRules, MetricsRules, RecvConfig
from palisade.functions import columns as C
from palisade.operators import backlog, decode_logs, decode_metrics, envelope, limiter, normalise, stats, validate
from palisade.plans.pipeline import run_batch, row_stages
from palisade.reasons import outcome, split
from palisade.sources import event_sink
from palisade.sources.captured import START_MS, captured_datagrams
from palisade.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Column rules of the derived datagrams, and their payloads as text.
_FIELDS = f"""
fields AS (
  SELECT event_id AS datagram_id, ({START_MS} + event_id) * 1000 AS received_at_us, {START_MS} + event_id AS now_ms, 167772160 + user_id % 8 AS src_ip, (10000 + user_id % 2)::INT AS src_port, user_id,
    (event_id % 40)::INT AS kind, CASE WHEN event_id % 40 = 36 THEN '123-invalid-starts-with-number' ELSE 'agent' || user_id END AS agent,
    CASE event_id % 40 WHEN 35 THEN {START_MS} + event_id - 300001 WHEN 38 THEN {START_MS} + event_id + 60001 ELSE {START_MS} + event_id END AS stamp,
    event_type AS name, round(value * 100)::BIGINT AS cents, regexp_extract(props, '(-?[0-9]+)', 1) AS k FROM events
), bodies AS (
  SELECT *, CASE WHEN kind = 28 THEN repeat('x', 2000) WHEN kind = 32 THEN '{{"agent_id": broken json here'
    WHEN kind = 34 THEN '{{"agent_id":"' || agent || '","seq":' || datagram_id || ',"ts":' || stamp || ',"metrics":[}}'
    WHEN kind BETWEEN 20 AND 27 OR kind IN (37, 38, 39) THEN 'ts=' || stamp || ' level=' || CASE WHEN name = 'error' THEN 'error' ELSE 'info' END || ' agent=' || agent || ' msg=' ||
      CASE kind WHEN 39 THEN '""' WHEN 37 THEN '"' || name ELSE '"' || name || '"' END
    ELSE '{{"agent_id":"' || agent || '","seq":' || datagram_id || ',"ts":' || stamp || ',"metrics":[{{"n":"' || name || '","v":' || cents ||
      ',"u":"cents","' || CASE kind WHEN 33 THEN 'tags' ELSE 't' END || '":{{"k":"' || k || '"}}}}]}}' END AS body FROM fields
), framed AS (
  SELECT *, CASE kind WHEN 29 THEN '00' WHEN 30 THEN 'FFFF' || hex(encode(body)) WHEN 31 THEN format('{{:04X}}', length(body)) || hex(encode(body)) || '21'
    ELSE format('{{:04X}}', length(body)) || hex(encode(body)) END AS payload FROM bodies
), judged AS (
  SELECT *, CASE kind WHEN 28 THEN 'recv' WHEN 29 THEN 'envelope' WHEN 30 THEN 'envelope' WHEN 31 THEN 'envelope' WHEN 32 THEN 'detect' WHEN 33 THEN 'parse_metrics' WHEN 34 THEN 'parse_metrics'
      WHEN 35 THEN 'validate_metrics' WHEN 36 THEN 'validate_metrics' WHEN 37 THEN 'parse_log' WHEN 38 THEN 'validate_log' WHEN 39 THEN 'validate_log' END AS drop_stage,
    CASE kind WHEN 28 THEN 'Truncated' WHEN 29 THEN 'PayloadTooSmall' WHEN 30 THEN 'LengthMismatch' WHEN 31 THEN 'TrailingJunk'
      WHEN 32 THEN 'UnknownType' WHEN 33 THEN 'UnexpectedField' WHEN 34 THEN 'InvalidJson'
      WHEN 35 THEN 'TimestampTooOld' WHEN 36 THEN 'AgentIdInvalidFormat' WHEN 37 THEN 'UnterminatedQuote' WHEN 38 THEN 'TimestampInFuture' WHEN 39 THEN 'MessageEmpty' END AS drop_reason,
    CASE WHEN kind < 20 OR kind BETWEEN 33 AND 36 THEN 'metrics' WHEN kind BETWEEN 20 AND 27 OR kind >= 37 THEN 'log' END AS msg_type,
    CASE WHEN kind < 20 THEN '{{"type":"metrics","agent_id":"' || agent || '","seq":' || datagram_id || ',"ts":' || stamp || ',"metric_count":1}}'
         WHEN kind < 28 THEN '{{"type":"log","agent_id":"' || agent || '","ts":' || stamp ||
           ',"level":' || CASE WHEN name = 'error' THEN '4' ELSE '2' END || ',"msg":"' || name || '"}}' END AS event_json FROM framed
)"""

#: The bucket, one packet of each source a step, on the datagrams that pass the size gate.
_BUCKET = """
arrivals AS (
  SELECT datagram_id, src_ip, src_port, received_at_us, row_number() OVER (PARTITION BY src_ip, src_port ORDER BY received_at_us, datagram_id) AS n FROM judged WHERE drop_stage IS DISTINCT FROM 'recv'
), bucket AS (
  SELECT datagram_id, src_ip, src_port, received_at_us, n, {burst} * 1000000 AS have FROM arrivals WHERE n = 1
  UNION ALL
  SELECT a.datagram_id, a.src_ip, a.src_port, a.received_at_us, a.n, least({burst} * 1000000, CASE WHEN b.have >= 1000000 THEN b.have - 1000000
  ELSE b.have END + (a.received_at_us - b.received_at_us) * {rate})
  FROM bucket b JOIN arrivals a ON a.src_ip = b.src_ip AND a.src_port = b.src_port AND a.n = b.n + 1
), limited AS (SELECT datagram_id, src_ip, src_port, have >= 1000000 AS admitted FROM bucket)"""

_QUEUE = """
queue_1 AS (SELECT *, row_number() OVER (PARTITION BY batch, agent ORDER BY received_at_us, datagram_id) <= {quota} AS pass FROM queue_0),
queue_2 AS (SELECT *, sum(pass::INT) OVER (PARTITION BY batch ORDER BY received_at_us, datagram_id) AS place FROM queue_1),
queue_3 AS (SELECT *, pass AND place <= {depth} AS queued FROM queue_2),
queue AS (SELECT *, CASE WHEN queued THEN NULL WHEN coalesce(sum(queued::INT) OVER (PARTITION BY batch, agent ORDER BY received_at_us,
  datagram_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {quota} THEN 'DroppedAgentQuotaExceeded'
  ELSE 'DroppedQueueFull' END AS queue_reason FROM queue_3)"""

LIMITS = LimiterConfig(max_sources=1024, tokens_per_sec=100, burst_tokens=200)
SMALL = LimiterConfig(max_sources=20, tokens_per_sec=5, burst_tokens=2)
QUEUE = ForwardConfig(max_queue_depth=200, max_per_agent=2)
_RATE = {"burst": LIMITS.burst_tokens, "rate": LIMITS.tokens_per_sec}
_BOUND = {"quota": QUEUE.max_per_agent, "depth": QUEUE.max_queue_depth}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.detect_type(envelope.decode_envelope(envelope.size_gate(captured_datagrams(spark, sf_dir))))


@query(f"WITH {_FIELDS} SELECT datagram_id, CASE WHEN length(payload) / 2 > 1472 THEN 'recv' END AS drop_stage, CASE WHEN length(payload) / 2 > 1472 THEN 'Truncated' END AS drop_reason FROM framed")
def size_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.size_gate(captured_datagrams(spark, sf_dir), RecvConfig()).select("datagram_id", "drop_stage", "drop_reason")


@query(f"""WITH {_FIELDS}, parts AS (SELECT datagram_id, payload, length(payload) // 2 AS n, CASE WHEN length(payload) >= 4 THEN ('0x' || substr(payload, 1, 4))::INT END AS stated FROM framed),
reasons AS (SELECT *, CASE WHEN n < 2 THEN 'PayloadTooSmall' WHEN stated + 2 > n THEN 'LengthMismatch' WHEN stated + 2 < n THEN 'TrailingJunk' END AS drop_reason FROM parts)
SELECT datagram_id, CASE WHEN drop_reason IS NOT NULL THEN 'envelope' END AS drop_stage, drop_reason, CASE WHEN drop_reason IS NULL THEN substr(payload, 5) END AS body FROM reasons""")
def decode_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.decode_envelope(captured_datagrams(spark, sf_dir)).select("datagram_id", "drop_stage", "drop_reason", F.hex("body").alias("body"))


@query("SELECT event_id, format('{:04X}', length(props)) || hex(encode(props)) AS payload FROM events")
def encode_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.encode("props", "UTF-8").alias("body"))
    return envelope.encode_envelope(bodies).select("event_id", F.hex("payload").alias("payload"))


@query(f"""WITH {_FIELDS} SELECT datagram_id, CASE WHEN kind NOT BETWEEN 28 AND 31 THEN msg_type END AS msg_type, CASE WHEN drop_stage IN ('recv',
  'envelope', 'detect') THEN drop_reason END AS drop_reason FROM judged""")
def detect_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("datagram_id", "msg_type", "drop_reason")


_NAMES = """CASE c_custkey % 6 WHEN 0 THEN c_name WHEN 1 THEN c_custkey::VARCHAR WHEN 2 THEN 'a-_' || c_custkey WHEN 3 THEN c_name || chr(10)
  WHEN 4 THEN rpad('N', (62 + c_custkey % 5)::INT, 'x') ELSE 'node.' || c_custkey END"""


@query(f"SELECT c_custkey, regexp_full_match(agent, '[a-zA-Z][a-zA-Z0-9_-]{{0,63}}') AS ok FROM (SELECT c_custkey, replace({_NAMES}, '#', '_') AS agent FROM customer)")
def valid_agent_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    kind = key % 6
    name = F.when(kind == 0, F.col("c_name")).when(kind == 1, key.cast("string")).when(kind == 2, F.concat(F.lit("a-_"), key.cast("string"))).when(kind == 3, F.concat("c_name", F.lit("\n")))
    name = name.when(kind == 4, F.rpad(F.lit("N"), (62 + key % 5).cast("int"), F.lit("x"))).otherwise(F.concat(F.lit("node."), key.cast("string")))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", C.valid_agent_id(F.replace(name, F.lit("#"), F.lit("_"))).alias("ok"))


@query(f"SELECT event_id, ({START_MS} + event_id * 40 % 400003) BETWEEN greatest(0, {START_MS} + 320000 - 300000) AND {START_MS} + 320000 + 60000 AS ok FROM events")
def in_time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("event_id") * 40 % 400_003 + START_MS
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.in_time_window(ts, F.lit(START_MS + 320_000)).alias("ok"))


@query("""SELECT event_id, code, CASE code WHEN 0 THEN 'trace' WHEN 1 THEN 'debug' WHEN 2 THEN 'info' WHEN 3 THEN 'warn' WHEN 4 THEN 'error' WHEN 5 THEN 'fatal' ELSE 'unknown' END AS level FROM (
SELECT event_id, (CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 END)::INT AS code FROM events)""")
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.get(F.array(*map(F.lit, (*C.LEVELS, "INFO", "", "info "))), (F.col("event_id") % 9).cast("int"))
    coded = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", C.level_code(name).alias("code"))
    return coded.withColumn("level", C.level_name(F.col("code")))


@query(f"""WITH {_FIELDS} SELECT datagram_id, CASE WHEN drop_stage = 'parse_metrics' THEN drop_reason END AS drop_reason,
  CASE WHEN ok THEN agent END AS agent_id, CASE WHEN ok THEN datagram_id END AS seq, CASE
  WHEN ok THEN stamp END AS ts, CASE WHEN ok THEN 1 END AS n_metrics,
CASE WHEN ok THEN name END AS name, CASE WHEN ok THEN cents::DOUBLE END AS value, CASE WHEN ok THEN 'cents' END AS unit, CASE WHEN ok THEN k END AS k
FROM (SELECT *, kind < 20 OR kind IN (35, 36) AS ok FROM judged WHERE msg_type = 'metrics') q WHERE drop_stage IS DISTINCT FROM 'validate_metrics' OR ok""")
def decode_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decode_metrics.decode_metrics(_gated(spark, sf_dir)).filter("msg_type = 'metrics'")
    m = F.get("metrics", F.lit(0))
    count = F.when(F.col("metrics").isNotNull(), F.size("metrics")).alias("n_metrics")
    return df.select("datagram_id", "drop_reason", F.col("metrics_agent").alias("agent_id"), "seq", F.col("metrics_ts").cast("long").alias("ts"), count,
                     m["name"].alias("name"), m["value"].alias("value"), m["unit"].alias("unit"), F.get(m["tags"], F.lit(0))["value"].alias("k"))


@query(f"""WITH {_FIELDS} SELECT datagram_id, CASE WHEN kind = 37 THEN 'UnterminatedQuote' END AS drop_reason, agent AS agent_id, stamp AS ts, (CASE
  WHEN name = 'error' THEN 4 ELSE 2 END)::INT AS level,
CASE kind WHEN 37 THEN NULL WHEN 39 THEN '' ELSE name END AS msg, CASE WHEN kind = 37 THEN 3 ELSE 4 END AS n_fields FROM judged WHERE msg_type = 'log'""")
def decode_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = decode_logs.decode_logs(_gated(spark, sf_dir)).filter("msg_type = 'log'")
    return df.select("datagram_id", "drop_reason", F.col("log_agent").alias("agent_id"), F.col("log_ts").cast("long").alias("ts"), "level", "msg", F.size("fields").alias("n_fields"))


@query(f"""WITH {_FIELDS}
SELECT datagram_id, CASE WHEN kind IN (33, 34) THEN 'parse_metrics' WHEN reason IS NOT NULL THEN 'validate_metrics' END AS drop_stage, CASE
  WHEN kind IN (33, 34) THEN drop_reason ELSE reason END AS drop_reason
FROM (
  SELECT *, CASE WHEN kind IN (33, 34) THEN NULL WHEN kind IN (35, 36) THEN drop_reason WHEN cents < 2000 THEN 'MetricValueTooLow' WHEN cents > 9000 THEN 'MetricValueTooHigh' END AS reason
  FROM judged WHERE msg_type = 'metrics'
)""")
def gate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding and validation of every metrics message, with bounds on values that bite."""
    decoded = decode_metrics.decode_metrics(_gated(spark, sf_dir))
    return validate.validate_metrics(decoded, MetricsRules(min_value=2000, max_value=9000)).filter("msg_type = 'metrics'").select("datagram_id", "drop_stage", "drop_reason")


@query(f"""WITH {_FIELDS}
SELECT datagram_id, drop_stage, drop_reason, CASE WHEN drop_reason IS NULL THEN substr(name, 1, 4) END AS msg FROM judged WHERE msg_type = 'log'""")
def gate_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoding and validation of every log message, with messages cut to four bytes."""
    df = validate.validate_log(decode_logs.decode_logs(_gated(spark, sf_dir)), LogRules(max_message_bytes=4)).filter("msg_type = 'log'")
    return df.select("datagram_id", "drop_stage", "drop_reason", F.when(F.col("drop_reason").isNull(), F.col("msg")).alias("msg"))


_KIND = "event_id % 12"


@query(f"""SELECT event_id, CASE {_KIND} WHEN 0 THEN 'AgentIdEmpty' WHEN 1 THEN 'AgentIdTooLong' WHEN 2 THEN 'AgentIdInvalidFormat'
  WHEN 3 THEN 'TimestampMissing' WHEN 4 THEN 'TimestampTooOld' WHEN 5 THEN 'TimestampInFuture'
WHEN 6 THEN 'MetricNameEmpty' WHEN 7 THEN 'MetricValueNaN' WHEN 8 THEN 'MetricValueInfinity' ELSE CASE WHEN value < 20 THEN 'MetricValueTooLow'
  WHEN value > 100 THEN 'MetricValueTooHigh' END END AS reason FROM events""")
def validate_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, now = F.col("event_id") % 12, F.lit(START_MS)
    agent = F.when(kind == 0, "").when(kind == 1, "x" * 65).when(kind == 2, "1node").otherwise("node-1")
    ts = F.when(kind == 3, 0).when(kind == 4, now - 300_001).when(kind == 5, now + 60_001).otherwise(now - 300_000)
    value = F.when(kind == 7, float("nan")).when(kind == 8, float("-inf")).otherwise(F.when(kind < 9, 50.0).otherwise(F.col("value")))
    metric = F.struct(F.when(kind == 6, "").otherwise("m").alias("name"), value.alias("value"))
    good = F.struct(F.lit("ok").alias("name"), F.lit(21.0).alias("value"))
    reason = validate.metrics_reason(agent, ts, F.array(good, metric), now, MetricsRules(min_value=20, max_value=100))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", reason.alias("reason"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'AgentIdTooLong' WHEN 1 THEN 'AgentIdInvalidFormat' WHEN 2 THEN 'AgentIdEmpty'
  WHEN 3 THEN 'TimestampTooOld' WHEN 4 THEN 'TimestampInFuture' WHEN 5 THEN 'LevelBelowMinimum'
WHEN 6 THEN 'MessageEmpty' ELSE CASE WHEN length(event_type) > 5 THEN 'MessageTooLong' END END AS reason FROM events""")
def validate_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, now = F.col("event_id") % 8, F.lit(START_MS)
    agent = F.when(kind == 0, "x" * 65).when(kind == 1, "node@host").when(kind == 2, "").otherwise("node")
    ts = F.when(kind == 3, 0).when(kind == 4, now + 60_001).otherwise(now)
    rules = LogRules(min_level=3, max_message_bytes=5, truncate_message=False, require_agent_id=True)
    reason = validate.log_reason(agent, ts, F.when(kind == 5, 2).otherwise(3), F.when(kind == 6, "").otherwise(F.col("event_type")), now, rules)
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", reason.alias("reason"))


@query(f"WITH {_FIELDS} SELECT datagram_id, msg_type AS event_type, agent AS agent_id, event_json FROM judged WHERE kind < 28")
def normalise_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = row_stages(envelope.size_gate(captured_datagrams(spark, sf_dir)))
    return normalise.with_event_json(split(events)[0]).select("datagram_id", "event_type", "agent_id", "event_json")


@query(f"WITH {_FIELDS} SELECT datagram_id, 0 AS metric_pos, name, cents::DOUBLE AS value, 'k' AS tag_key, k AS tag_value FROM judged WHERE kind < 20 OR kind IN (35, 36)")
def explode_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalise.explode_tags(normalise.explode_metrics(decode_metrics.decode_metrics(_gated(spark, sf_dir))))
    return df.select("datagram_id", "metric_pos", F.col("metric.name").alias("name"), F.col("metric.value").alias("value"), F.col("tag.key").alias("tag_key"), F.col("tag.value").alias("tag_value"))


@query(f"""WITH {_FIELDS}, logs AS (SELECT datagram_id, kind, stamp, agent, name, CASE WHEN name = 'error' THEN 'error' ELSE 'info' END AS level FROM judged WHERE msg_type = 'log')
SELECT datagram_id, 0 AS field_pos, 'ts' AS key, stamp::VARCHAR AS value FROM logs UNION ALL SELECT datagram_id, 1, 'level', level FROM logs UNION ALL SELECT datagram_id, 2, 'agent', agent FROM logs
UNION ALL SELECT datagram_id, 3, 'msg', CASE kind WHEN 39 THEN '' ELSE name END FROM logs WHERE kind <> 37""")
def explode_log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = normalise.explode_log_fields(decode_logs.decode_logs(_gated(spark, sf_dir)))
    return df.select("datagram_id", "field_pos", F.col("field.key").alias("key"), F.col("field.value").alias("value"))


@query(f"WITH {_FIELDS} SELECT datagram_id, CASE WHEN name = 'error' THEN 'error' ELSE 'info' END AS level, NULL::VARCHAR AS host FROM judged WHERE kind BETWEEN 20 AND 27")
def log_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = validate.validate_log(decode_logs.decode_logs(_gated(spark, sf_dir))).filter("msg_type = 'log' and drop_reason is null")
    return df.select("datagram_id", decode_logs.last_value(F.col("fields"), "level").alias("level"), decode_logs.last_value(F.col("fields"), "host").alias("host"))


def _limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.rate_limit(envelope.size_gate(captured_datagrams(spark, sf_dir)), LIMITS)


@query(f"WITH RECURSIVE {_FIELDS}, {_BUCKET.format(**_RATE)} SELECT datagram_id, admitted FROM limited")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _limited(spark, sf_dir).filter("admitted is not null").select("datagram_id", "admitted")


@query(f"""WITH RECURSIVE {_FIELDS}, {_BUCKET.format(**_RATE)} SELECT src_ip, src_port, count(*) FILTER (admitted) AS admits,
  count(*) FILTER (NOT admitted) AS drops FROM limited GROUP BY src_ip, src_port""")
def source_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.source_stats(_limited(spark, sf_dir))


def _many_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrival, port = (F.col("event_id") + START_MS) * 1000, (F.col("user_id") % 60).cast("int")
    return events.select(F.col("event_id").alias("datagram_id"), arrival.alias("received_at_us"), F.lit(1).cast("long").alias("src_ip"), port.alias("src_port"))


_SEEN = f"seen AS (SELECT event_id AS n, user_id % 60 AS s, lag(event_id) OVER (PARTITION BY user_id % 60 ORDER BY event_id) AS before FROM events)"


_MISSES = f"""{_SEEN}, misses AS (
  SELECT a.n, a.s, any_value(a.before) IS NULL OR count(DISTINCT b.s) >= {SMALL.max_sources} AS miss FROM seen a LEFT JOIN seen b ON b.n > a.before AND b.n < a.n GROUP BY a.n, a.s
), epochs AS (SELECT n, s, miss, sum(miss::INT) OVER (PARTITION BY s ORDER BY n)::BIGINT AS epoch FROM misses)"""


@query(f"WITH {_MISSES} SELECT n AS datagram_id, miss AS resident_miss, epoch AS residency_epoch FROM epochs")
def source_residency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.source_residency(_many_sources(spark, sf_dir), SMALL).select("datagram_id", "resident_miss", "residency_epoch")


@query(f"""WITH RECURSIVE {_MISSES}, arrivals AS (SELECT *, row_number() OVER (PARTITION BY s, epoch ORDER BY n) AS i FROM epochs), bucket AS (
  SELECT s, epoch, i, n, {SMALL.burst_tokens} * 1000000 AS have FROM arrivals WHERE i = 1
  UNION ALL
  SELECT a.s, a.epoch, a.i, a.n, least({SMALL.burst_tokens} * 1000000, CASE WHEN b.have >= 1000000 THEN b.have - 1000000 ELSE b.have END + (a.n - b.n) * 1000 * {SMALL.tokens_per_sec})
  FROM bucket b JOIN arrivals a ON a.s = b.s AND a.epoch = b.epoch AND a.i = b.i + 1
), sources AS (SELECT least(count(DISTINCT s), {SMALL.max_sources}) AS kept FROM seen)
SELECT (SELECT count(*) FROM bucket WHERE have >= 1000000) AS total_admits, (SELECT count(*) FROM bucket WHERE have < 1000000) AS total_drops,
  (SELECT count(*) FROM misses WHERE miss) - kept AS eviction_count, kept AS tracked_count FROM sources""")
def limiter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.limiter_stats(limiter.rate_limit(_many_sources(spark, sf_dir), SMALL), SMALL)


@query(f"SELECT 1::BIGINT AS src_ip, (user_id % 60)::INT AS src_port, max(event_id) AS last_id FROM events GROUP BY user_id % 60 ORDER BY last_id DESC LIMIT {SMALL.max_sources}")
def tracked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limiter.tracked_sources(_many_sources(spark, sf_dir), SMALL).drop("last_us")


_QUEUE_ALL = f"queue_0 AS (SELECT *, datagram_id // 500 AS batch FROM judged WHERE kind < 28), {_QUEUE.format(**_BOUND)}"


def _thin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every datagram after the stages that look at one alone, dropped or not."""
    return row_stages(envelope.size_gate(captured_datagrams(spark, sf_dir))).select("datagram_id", "received_at_us", "agent_id", "drop_stage", "drop_reason")


def _bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.bound_backlog(_thin(spark, sf_dir), F.expr("datagram_id div 500"), QUEUE)


@query(f"""WITH {_FIELDS}, {_QUEUE_ALL}
SELECT j.datagram_id, j.datagram_id // 500 AS batch, coalesce(j.drop_reason, q.queue_reason) AS drop_reason, CASE WHEN q.queued THEN q.place END::BIGINT AS forwarded_order
FROM judged j LEFT JOIN queue q ON j.datagram_id = q.datagram_id""")
def bound_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bounded(spark, sf_dir).select("datagram_id", "batch", "drop_reason", "forwarded_order")


@query(f"""WITH {_FIELDS}, queue_0 AS (SELECT *, 0 AS batch FROM judged WHERE kind < 28), {_QUEUE.format(**_BOUND)}
SELECT j.datagram_id, coalesce(j.drop_reason, q.queue_reason) AS drop_reason, CASE WHEN q.queued THEN q.place END::BIGINT AS forwarded_order
FROM judged j LEFT JOIN queue q ON j.datagram_id = q.datagram_id""")
def bound_large_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.bound_large_backlog(_thin(spark, sf_dir), QUEUE).select("datagram_id", "drop_reason", "forwarded_order")


_BATCHES = f"""WITH {_FIELDS}, {_QUEUE_ALL}
SELECT j.datagram_id, j.datagram_id // 500 AS batch, coalesce(j.drop_reason, q.queue_reason) AS drop_reason, CASE WHEN q.queued THEN q.place END::BIGINT AS forwarded_order
FROM judged j LEFT JOIN queue q ON j.datagram_id = q.datagram_id"""


@query(_BATCHES)
def bound_backlog_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals with ranks that are made of parts, so that none needs a task of its own."""
    return backlog.bound_large_backlog(_thin(spark, sf_dir), QUEUE, F.expr("datagram_id div 500")).select("datagram_id", "batch", "drop_reason", "forwarded_order")


@query(_BATCHES)
def carried_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals in two frames, each of which has a half of every interval; the second goes on from the first."""
    thin, batch = _thin(spark, sf_dir), F.expr("datagram_id div 500")
    first = backlog.bound_large_backlog(thin.filter("datagram_id % 500 < 250"), QUEUE, batch)
    second = backlog.bound_large_backlog(thin.filter("datagram_id % 500 >= 250"), QUEUE, batch, carried=backlog.carry_on(first))
    return first.unionByName(second).select("datagram_id", "batch", "drop_reason", "forwarded_order")


@query(f"""WITH {_FIELDS}, {_QUEUE_ALL} SELECT batch, agent AS agent_id, count(*) FILTER (queued) AS in_flight,
  count(*) FILTER (queue_reason = 'DroppedAgentQuotaExceeded') AS quota_rejections FROM queue GROUP BY batch, agent""")
def agent_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.agent_stats(_bounded(spark, sf_dir))


@query(f"""WITH {_FIELDS}, {_QUEUE_ALL} SELECT batch, count(DISTINCT agent) FILTER (queued) AS tracked_agents,
  count(*) FILTER (queued) AS total_in_flight, count(*) FILTER (queue_reason = 'DroppedAgentQuotaExceeded') AS quota_rejections
FROM queue GROUP BY batch""")
def batch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlog.batch_stats(_bounded(spark, sf_dir))


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline, a drain interval being 500 datagrams."""
    config = GateConfig(limiter=LIMITS, forward=QUEUE)
    return run_batch(captured_datagrams(spark, sf_dir), config, F.expr("datagram_id div 500")).ledger


_LEDGER = f"""{_FIELDS}, {_BUCKET.format(**_RATE)},
queue_0 AS (SELECT judged.*, datagram_id // 500 AS batch FROM judged JOIN limited USING (datagram_id) WHERE kind < 28 AND admitted), {_QUEUE.format(**_BOUND)},
ledger AS (
  SELECT j.datagram_id, j.received_at_us, CASE WHEN NOT l.admitted THEN 'source_limit' WHEN j.drop_stage IS NOT NULL THEN j.drop_stage WHEN q.queue_reason IS NOT NULL THEN 'forward' END AS drop_stage,
    CASE WHEN NOT l.admitted THEN 'SourceLimited' ELSE coalesce(j.drop_reason, q.queue_reason) END AS drop_reason
  FROM judged j LEFT JOIN limited l ON j.datagram_id = l.datagram_id LEFT JOIN queue q ON j.datagram_id = q.datagram_id
)"""
_COUNTS = """count(*) FILTER (drop_stage IS DISTINCT FROM 'recv') AS received, count(*) FILTER (drop_stage = 'recv') AS truncated, count(*) FILTER (drop_stage = 'source_limit') AS source_limited,
count(*) FILTER (drop_stage = 'envelope') AS envelope_drops, count(*) FILTER (drop_stage IN ('detect', 'parse_metrics', 'parse_log')) AS parse_drops,
  count(*) FILTER (drop_stage IN ('validate_metrics', 'validate_log')) AS validation_drops,
count(*) FILTER (drop_reason = 'DroppedQueueFull') AS queue_drops, count(*) FILTER (drop_reason = 'DroppedAgentQuotaExceeded') AS quota_drops, count(*) FILTER (drop_reason IS NULL) AS forwarded"""


@query(f"WITH RECURSIVE {_LEDGER} SELECT datagram_id, drop_stage, drop_reason FROM ledger")
def run_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ledger(spark, sf_dir).select("datagram_id", "drop_stage", "drop_reason")


@query(f"WITH RECURSIVE {_LEDGER} SELECT datagram_id, agent AS agent_id, event_json, batch, place::BIGINT AS forwarded_order FROM queue WHERE queued")
def drained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What leaves the gate, with its place in the order of leaving."""
    config = GateConfig(limiter=LIMITS, forward=QUEUE)
    events = run_batch(captured_datagrams(spark, sf_dir), config, F.expr("datagram_id div 500")).events
    return events.select("datagram_id", "agent_id", "event_json", "batch", "forwarded_order")


@query(f"WITH RECURSIVE {_LEDGER} SELECT batch, place::BIGINT AS forwarded_order, event_json AS line FROM queue WHERE queued")
def written_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the sink with its own commit has written, read back."""
    path = f"{shared_dir(spark)}/event-lines-{uuid.uuid4().hex}"
    event_sink.write_lines(_ledger(spark, sf_dir), path)
    return event_sink.read_lines(spark, path).withColumn("line", F.col("line").cast("string"))


@query(f"WITH RECURSIVE {_LEDGER} SELECT {_COUNTS} FROM ledger")
def pipeline_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.pipeline_stats(_ledger(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LEDGER} SELECT drop_stage, drop_reason, grouping(drop_stage, drop_reason)::INT AS level, count(*) AS n FROM ledger
  WHERE drop_reason IS NOT NULL GROUP BY ROLLUP (drop_stage, drop_reason)""")
def drop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.drop_counts(_ledger(spark, sf_dir))


@query(f"""WITH RECURSIVE {_LEDGER}, each AS (SELECT received_at_us // 1000000 * 1000000 AS start_us, {_COUNTS} FROM ledger GROUP BY 1)
SELECT *, sum(received) OVER (ORDER BY start_us)::BIGINT AS total_received, sum(forwarded) OVER (ORDER BY start_us)::BIGINT AS total_forwarded FROM each""")
def stats_per_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stats_per_interval(_ledger(spark, sf_dir))


def drops_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: envelope, detection, decoding and validation of every datagram, counted by stage and reason."""
    return stats.drop_counts(outcome(row_stages(envelope.size_gate(captured_datagrams(spark, sf_dir))), "forward", F.lit(None).cast("string")))


query(f"""WITH {_FIELDS} SELECT drop_stage, drop_reason, grouping(drop_stage, drop_reason)::INT AS level, count(*) AS n FROM judged
  WHERE drop_reason IS NOT NULL GROUP BY ROLLUP (drop_stage, drop_reason)""")(drops_by_reason)
