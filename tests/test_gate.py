"""Literal cases of every stage, at each limit and one over."""

import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.config import ForwardConfig, LimiterConfig, LogLimits, LogRules, MetricsLimits, MetricsRules, RecvConfig
from palisade.functions import columns as C
from palisade.operators import backlog, decode_logs, decode_metrics, envelope, limiter, normalise, validate
from palisade.operators.decode_metrics import scan
from palisade.reasons import REASONS, open_outcome
from palisade.schemas import EVENT

NOW = 1_705_689_600_000
HEAD = '{"agent_id":"a","seq":1,"metrics":'


def reasons_of(spark, op, rows, schema):
    df = op(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}"))
    return [r["drop_reason"] for r in df.orderBy("i").collect()]


def test_size_gate(spark):
    got = reasons_of(spark, lambda df: envelope.size_gate(df, RecvConfig(100)), [(bytearray(n),) for n in (0, 100, 101, 200)], "payload binary")
    assert got == [None, None, "Truncated", "Truncated"]


def test_envelope(spark):
    cases = [
        (b"", "PayloadTooSmall", None), (b"\0", "PayloadTooSmall", None), (b"\0\x0a" + b"x" * 9, "LengthMismatch", None), (b"\xff\xffabc", "LengthMismatch", None), (b"\0\1ab", "TrailingJunk", None),
        (b"\0\0", None, b""), (b"\0\1a", None, b"a"), (b"\1\0" + b"y" * 256, None, b"y" * 256), (b"\0\2\xff\xfe", None, b"\xff\xfe"), (None, "PayloadTooSmall", None),
    ]
    df = spark.createDataFrame([(i, None if c[0] is None else bytearray(c[0])) for i, c in enumerate(cases)], "i long, payload binary")
    got = envelope.decode_envelope(df).orderBy("i").collect()
    assert [(r["drop_reason"], r["body"] and bytes(r["body"])) for r in got] == [(c[1], c[2] or (None if c[2] is None else r["body"])) for c, r in zip(cases, got)]
    assert bytes(got[5]["body"]) == b""
    back = envelope.decode_envelope(envelope.encode_envelope(spark.createDataFrame([(bytearray(n),) for n in (0, 1, 256, 65535, 65536)], "body binary")).select("payload", "drop_stage", "drop_reason"))
    assert sorted((r["drop_reason"] or "", len(r["body"] or b"")) for r in back.collect()) == [("", 0), ("", 1), ("", 256), ("", 65535), ("LengthMismatch", 0)]


@pytest.mark.parametrize(
    "body, kind",
    [(b"", None), (b'{"metrics"', "metrics"), (b'{"x":1}', None), (b"ts=1 level=info msg=a", "log"), (b"ts=1 level=info", None), (b' {"metrics"', None), (b'{ts= level= msg=', None), (b' {"metrics"ts=level=msg=', "log")],
)
def test_detect(spark, body, kind):
    row = envelope.detect_type(open_outcome(spark.createDataFrame([(bytearray(body),)], "body binary"))).first()
    assert (row["msg_type"], row["drop_reason"]) == (kind, None if kind else "UnknownType")


METRIC = '{"n":"cpu","v":1}'


@pytest.mark.parametrize(
    "body, expected",
    [
        ('{"agent_id":"node-1","seq":42,"metrics":[]}', {"agent_id": "node-1", "seq": 42, "ts": 0, "metrics": []}),
        (HEAD + "[" + METRIC + "]}", {"metrics": [{"name": "cpu", "value": 1.0, "unit": "", "tags": []}]}),
        (HEAD + '[{"n":"c","v":-10.5,"u":"ms","t":{"a":"b","a":"c"}}]}', {"metrics": [{"name": "c", "value": -10.5, "unit": "ms", "tags": [{"key": "a", "value": "b"}, {"key": "a", "value": "c"}]}]}),
        (HEAD + '[{"n":"c","v":1.5e6}]}', {"metrics": [{"name": "c", "value": 1.5e6, "unit": "", "tags": []}]}),
        (HEAD + '[{"n":"c","v":1.},{"n":"d","v":1e}]}', {"metrics": [{"name": n, "value": 1.0, "unit": "", "tags": []} for n in "cd"]}),
        (HEAD + "[" + ",".join([METRIC] * 50) + "]}", {"agent_id": "a"}),
        (HEAD + "[" + ",".join([METRIC] * 51) + "]}", "TooManyMetrics"),
        (HEAD + "[" + ",".join([METRIC] * 50) + ",]}", "TooManyMetrics"),
        (HEAD + "[" + METRIC + ",]}", "InvalidJson"),
        (HEAD + "[}", "InvalidJson"), (HEAD + "{}}", "InvalidFieldType"), ("{}", "MissingRequiredField"), ("", "InvalidJson"), ("[]", "InvalidJson"),
        ('{"agent_id":"a","seq":1}', "MissingRequiredField"), ('{"agent_id":"a","seq":1,}', "InvalidJson"), ('{"agent_id":"a" "seq":1}', "InvalidJson"), ('{"agent_id":"a', "InvalidFieldType"),
        ('{"agent_id":1}', "InvalidFieldType"), ('{"agent_id":"' + "x" * 64 + '","seq":1,"metrics":[]}', {"seq": 1}), ('{"agent_id":"' + "x" * 65 + '"', "AgentIdTooLong"), ('{"agent_id":""', "AgentIdInvalidChars"),
        ('{"agent_id":"a b"', "AgentIdInvalidChars"), ('{"agent_id":"1.x","seq":1,"metrics":[]}', {"agent_id": "1.x"}), ('{"agent_id":"a\\"b"', "AgentIdInvalidChars"),
        ('{"seq":"1"', "InvalidFieldType"), ('{"seq":1.5}', "InvalidJson"), ('{"seq":9223372036854775808', "InvalidFieldType"), ('{"agent_id":"a","seq":4294967297,"metrics":[]}', {"seq": 1}),
        ('{"agent_id":"a","seq":007,"ts":-1,"metrics":[]}', {"seq": 7, "ts": (1 << 64) - 1}), ('{"x":', "UnexpectedField"), ('{"agent_\\u0069d":"a"}', "UnexpectedField"),
        (HEAD + "[{}]}", "MetricMissingName"), (HEAD + '[{"n":"a"}]}', "MetricMissingValue"), (HEAD + '[{"v":1}]}', "MetricMissingName"), (HEAD + '[{"n":1}]}', "InvalidFieldType"),
        (HEAD + '[{"n":"' + "n" * 129 + '"', "MetricNameTooLong"), (HEAD + '[{"n":"c","v":"string"}]}', "MetricValueNotNumber"), (HEAD + '[{"v":1e999}]}', "MetricValueNotNumber"),
        (HEAD + '[{"v":1e-999}]}', "MetricValueNotNumber"), (HEAD + '[{"n":"c","v":0e9}]}', {"seq": 1}), (HEAD + '[{"u":"' + "u" * 17 + '"', "UnitTooLong"), (HEAD + '[{"tags":{}}]}', "UnexpectedField"),
        (HEAD + '[{"n":"c","v":1,"t":[]}]}', "InvalidFieldType"), (HEAD + '[{"t":{' + ",".join(f'"k{i}":"v"' for i in range(9)) + "}", "TooManyTags"), (HEAD + '[{"t":{"' + "k" * 65 + '"x', "TagKeyTooLong"),
        (HEAD + '[{"t":{"k":1}', "InvalidFieldType"), (HEAD + '[{"t":{"k":"' + "v" * 65 + '"', "TagValueTooLong"), (HEAD + '[{"t":{"k" "v"}', "InvalidJson"), (HEAD + '[{"t":{k:"v"}', "InvalidJson"),
        ('{"agent_id":"a","seq":1,"metrics":[]} trailing {', {"seq": 1}), ('{"agent_id":"a","agent_id":"b","seq":1,"metrics":[]}', {"agent_id": "b"}),
        (HEAD + "[" + METRIC + '],"metrics":[' + METRIC + "]}", {"metrics": [{"name": "cpu", "value": 1.0, "unit": "", "tags": []}] * 2}), (HEAD + "[" + METRIC + '],"metrics":[]}', {"metrics": []}),
        (HEAD + '[{"n":"c","v":1,"t":{"a":"1"},"t":{"b":"2"}}]}', {"metrics": [{"name": "c", "value": 1.0, "unit": "", "tags": [{"key": "a", "value": "1"}, {"key": "b", "value": "2"}]}]}),
        ("x" * 65537, "InputTooLarge"), (' \t\r\n{ "agent_id" : "a" , "seq" : 1 , "metrics" : [ ] }', {"agent_id": "a"}),
    ],
)
def test_metrics_bodies(body, expected):
    got = scan(body.encode())
    if isinstance(expected, str):
        assert got == {"reason": expected} and expected in REASONS["parse_metrics"]
    else:
        assert "reason" not in got and {k: got[k] for k in expected} == expected


def test_metrics_frame(spark):
    rows = [(1, "metrics", bytearray(HEAD.encode() + b'[{"n":"\xff\xc3","v":2}]}')), (2, "metrics", bytearray(b"{}")), (3, "log", bytearray(b"x")), (4, None, None)]
    got = decode_metrics.decode_metrics(open_outcome(spark.createDataFrame(rows, "i long, msg_type string, body binary"))).orderBy("i").collect()
    assert got[0]["metrics"][0]["name"].encode("latin-1") == b"\xff\xc3" and got[0]["metrics_ts"] == Decimal(0)
    assert [r["drop_reason"] for r in got] == [None, "MissingRequiredField", None, None]
    assert scan(HEAD.encode() + b'[{"n":"c","v":1,"tags":{}}]}', MetricsLimits(tag_members=("t", "tags")))["seq"] == 1


GOOD = "ts=1705689600000 level=error agent=node-42 msg="


@pytest.mark.parametrize(
    "line, expected",
    [
        (GOOD + '"Connection refused"', {"log_ts": 1705689600000, "level": 4, "log_agent": "node-42", "msg": "Connection refused"}), (GOOD + "x host=db-1 port=5432", {"n": 6}), ("ts=1 level=info msg=x", {"log_agent": ""}),
        (GOOD + 'x Bad_Key=1', "InvalidKeyChar"), ("msg test", "MissingEquals"), (GOOD + '"open', "UnterminatedQuote"), (GOOD + '""', {"msg": ""}), (GOOD, {"msg": ""}), ("", "EmptyInput"), (" \t\r\n", "EmptyInput"),
        ("x" * 2049, "InputTooLarge"), (GOOD + "x " + " ".join(f"k{i}=1" for i in range(12)), {"n": 16}), (GOOD + "x " + " ".join(f"k{i}=1" for i in range(15)), "TooManyFields"),
        (GOOD + "x " + " ".join(f"k{i}=1" for i in range(12)) + " Z", "TooManyFields"), ("aB=1", "MissingEquals"), ("k" * 32 + "=1 " + GOOD, {"n": 5}), ("k" * 33 + "=1", "KeyTooLong"), ("k" * 33, "KeyTooLong"),
        ("a=" + "v" * 1024 + " " + GOOD, {"n": 5}), ("a=" + "v" * 1025, "ValueTooLong"), ("ts=x", "InvalidTimestamp"), ("ts=", "InvalidTimestamp"), ("ts=-1", "InvalidTimestamp"), ("ts=18446744073709551615 level=info msg=a", {"log_ts": (1 << 64) - 1}),
        ("ts=18446744073709551616", "InvalidTimestamp"), ("ts=0000000000000000000000000000000000000000000000007 level=info msg=a", {"log_ts": 7}), ("level=Error", "InvalidLevel"), ("level=info msg=a", "MissingTimestamp"),
        ("ts=1 msg=a", "MissingLevel"), ("ts=1 level=info", "MissingMessage"), ("ts=0 level=trace msg=a", {"log_ts": 0, "level": 0}), ('msg="a"b=c ts=1 level=info', {"msg": "a", "n": 4}), ("a=b=c", "InvalidKeyChar"),
        ("msg=a msg=b ts=1 level=info level=warn", {"msg": "b", "level": 3, "n": 5}), ("ts=1\t \tlevel=info \t msg=a \r\n", {"msg": "a"}), ("ts=1 level=info msg=a\nb", {"msg": "a\nb"}), ('k="a=b c" ts=1 level=info msg=x', {"n": 4}),
        ('ts=1 level=info msg=a"', "InvalidKeyChar"), ("=1", "InvalidKeyChar"), ('ts="5" level="warn" msg=x', {"log_ts": 5, "level": 3}),
    ],
)
def test_log_bodies(spark, line, expected):
    row = decode_logs.decode_logs(open_outcome(spark.createDataFrame([("log", bytearray(line.encode("latin-1")))], "msg_type string, body binary"))).withColumn("n", F.size("fields")).first()
    if isinstance(expected, str):
        assert row["drop_reason"] == expected and expected in REASONS["parse_log"]
    else:
        assert row["drop_reason"] is None and {k: row[k] for k in expected} == expected


def scan_line(line: str, limits: LogLimits):
    """The log rules, one byte at a time."""
    if len(line) > limits.line_bytes:
        return "InputTooLarge"
    line = line.rstrip(" \t\r\n")
    if not line:
        return "EmptyInput"
    fields, at = [], 0
    while True:
        while at < len(line) and line[at] in " \t":
            at += 1
        if at == len(line):
            break
        if len(fields) >= limits.fields:
            return "TooManyFields"
        start = at
        if not (line[at].islower() and line[at].isascii() or line[at] == "_"):
            return "InvalidKeyChar"
        while at < len(line) and line[at] in "abcdefghijklmnopqrstuvwxyz0123456789_":
            at += 1
        key = line[start:at]
        if len(key) > limits.key:
            return "KeyTooLong"
        if at == len(line) or line[at] != "=":
            return "MissingEquals"
        at += 1
        if at < len(line) and line[at] == '"':
            end = line.find('"', at + 1)
            if end < 0:
                return "UnterminatedQuote"
            value, at = line[at + 1 : end], end + 1
        else:
            start = at
            while at < len(line) and line[at] not in ' \t"=':
                at += 1
            value = line[start:at]
        if len(value) > limits.value:
            return "ValueTooLong"
        if key == "ts" and not (value.isascii() and value.isdigit() and int(value) < 1 << 64):
            return "InvalidTimestamp"
        if key == "level" and value not in C.LEVELS:
            return "InvalidLevel"
        fields.append((key, value))
    known = dict(fields)
    for key, reason in (("ts", "MissingTimestamp"), ("level", "MissingLevel"), ("msg", "MissingMessage")):
        if key not in known:
            return reason
    return fields


def test_log_lines_at_random(spark):
    rng, limits = random.Random(3), LogLimits(line_bytes=60, fields=4, key=4, value=5)
    parts = ["ts=1", "level=info", "msg=a", 'msg="x y"', " ", "\t", "k=", "=", '"', "b", "keyss=1", "v=123456", "Z", "\n", "ts=x", "level=", "_=", '""', "é"]
    lines = ["".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    lines += ["ts=1 level=info msg=a " + x for x in lines[:1000]]
    df = spark.createDataFrame([(i, "log", bytearray(x.encode("latin-1"))) for i, x in enumerate(lines)], "i long, msg_type string, body binary")
    got = decode_logs.decode_logs(open_outcome(df), limits).orderBy("i").select("drop_reason", "fields").collect()
    for line, row in zip(lines, got):
        want = scan_line(line, limits)
        assert (row["drop_reason"] or [(f["key"], f["value"]) for f in row["fields"]]) == want, line


def test_predicates(spark):
    names = ["a", "A-_9", "x" * 64, "x" * 65, "", "1node", "node@host", "abc\n", "node.x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(C.valid_agent_id(F.col("n"))).collect()] == [True, True, True] + [False] * 6
    stamps = [NOW - 300_001, NOW - 300_000, NOW + 60_000, NOW + 60_001]
    assert [r[0] for r in spark.createDataFrame([(s,) for s in stamps], "t long").select(C.in_time_window(F.col("t"), F.lit(NOW))).collect()] == [False, True, True, False]
    assert spark.range(1).select(C.in_time_window(F.lit(0), F.lit(1000))).first()[0]


@pytest.mark.parametrize(
    "agent, ts, values, rules, reason",
    [
        ("a", NOW, [1.0], {}, None), ("", NOW, [], {}, "AgentIdEmpty"), ("x" * 65, NOW, [], {}, "AgentIdTooLong"), ("1node", NOW, [], {}, "AgentIdInvalidFormat"), ("a.b", NOW, [], {}, "AgentIdInvalidFormat"),
        ("a", 0, [], {}, "TimestampMissing"), ("a", 0, [], {"require_timestamp": False}, None), ("a", NOW - 300_001, [], {}, "TimestampTooOld"), ("a", NOW - 300_000, [], {}, None), ("a", NOW + 60_000, [], {}, None),
        ("a", NOW + 60_001, [], {}, "TimestampInFuture"), ("a", (1 << 64) - 1, [], {}, "TimestampInFuture"), ("a", NOW, [float("nan")], {}, "MetricValueNaN"), ("a", NOW, [float("inf")], {}, "MetricValueInfinity"),
        ("a", NOW, [float("-inf")], {}, "MetricValueInfinity"), ("a", NOW, [float("nan"), float("inf")], {"reject_nan": False, "reject_infinity": False, "max_value": 1.0}, None), ("a", NOW, [100.0, -100.0], {"min_value": -100.0, "max_value": 100.0}, None),
        ("a", NOW, [100.5], {"min_value": -100.0, "max_value": 100.0}, "MetricValueTooHigh"), ("a", NOW, [-1e16, float("nan")], {}, "MetricValueTooLow"), ("a", NOW, [], {}, None),
    ],
)
def test_validate_metrics(spark, agent, ts, values, rules, reason):
    row = spark.createDataFrame([(agent, Decimal(ts), [("m", v) for v in values])], "a string, t decimal(20,0), m array<struct<name:string,value:double>>")
    assert row.select(validate.metrics_reason(F.col("a"), F.col("t"), F.col("m"), F.lit(NOW), MetricsRules(**rules))).first()[0] == reason


@pytest.mark.parametrize(
    "agent, ts, level, msg, rules, reason",
    [
        ("", NOW, 2, "m", {}, None), ("", NOW, 2, "m", {"require_agent_id": True}, "AgentIdEmpty"), ("x" * 65, NOW, 2, "m", {}, "AgentIdTooLong"), ("node@host", NOW, 2, "m", {}, "AgentIdInvalidFormat"), ("n", 0, 2, "m", {}, "TimestampTooOld"),
        ("n", NOW + 60_001, 2, "m", {}, "TimestampInFuture"), ("n", NOW, 2, "m", {"min_level": 3}, "LevelBelowMinimum"), ("n", NOW, 3, "m", {"min_level": 3}, None), ("n", NOW, 2, "", {}, "MessageEmpty"),
        ("n", NOW, 2, "m" * 11, {"max_message_bytes": 10}, None), ("n", NOW, 2, "m" * 11, {"max_message_bytes": 10, "truncate_message": False}, "MessageTooLong"), ("n", NOW, 2, "m" * 10, {"max_message_bytes": 10, "truncate_message": False}, None),
    ],
)
def test_validate_log(spark, agent, ts, level, msg, rules, reason):
    df = spark.createDataFrame([("log", agent, Decimal(ts), level, msg, NOW * 1000)], "msg_type string, log_agent string, log_ts decimal(20,0), level int, msg string, received_at_us long")
    row = validate.validate_log(df, LogRules(**rules)).first()
    assert row["drop_reason"] == reason and len(row["msg"]) <= max(len(msg) if reason else 0, LogRules(**rules).max_message_bytes)


def test_normalise(spark):
    df = spark.createDataFrame([("log", "n", Decimal(5), 4, 'a "b" \\ c\x01é'.encode().decode("latin-1"), None, None, None, None)], "msg_type string, log_agent string, log_ts decimal(20,0), level int, msg string, metrics_agent string, seq long, metrics_ts decimal(20,0), metrics array<int>")
    assert normalise.with_event_json(normalise.unify_events(open_outcome(df))).first()["event_json"] == '{"type":"log","agent_id":"n","ts":5,"level":4,"msg":"a \\"b\\" \\\\ c\x01é"}'
    df = spark.createDataFrame([("metrics", None, None, None, None, "n", 7, Decimal(0), [1, 2])], df.schema)
    assert normalise.with_event_json(normalise.unify_events(open_outcome(df))).first()["event_json"] == '{"type":"metrics","agent_id":"n","seq":7,"ts":0,"metric_count":2}'


def sequential_bucket(times, config):
    """One packet at a time."""
    tokens, last, out = config.burst_tokens * limiter.UNIT, None, []
    for t in times:
        if last is not None:
            tokens = limiter.fill(tokens, t - last, config)
        last = t
        out.append(tokens >= limiter.UNIT)
        tokens -= limiter.UNIT if out[-1] else 0
    return out


def test_bucket_kernel_against_one_packet_at_a_time():
    rng = random.Random(5)
    for _ in range(600):
        config = LimiterConfig(10, rng.choice([0, 1, 7, 100, 1000]), rng.choice([1, 2, 5, 30]))
        step = rng.choice([0, 10, 3000, 200_000, 10_000_000])
        times = np.cumsum([rng.randint(0, step) for _ in range(rng.randint(1, 400))]).astype(np.int64)
        cut = rng.randint(0, len(times))
        tokens, last, got = config.burst_tokens * limiter.UNIT, int(times[0]), []
        for part in (times[:cut], times[cut:]):
            if len(part):
                out, tokens, last = limiter.admit_run(part, tokens, last, config)
                got += out.tolist()
        assert got == sequential_bucket(times.tolist(), config)


@pytest.mark.parametrize("calls, config, admits", [([0] * 8, (100, 5), 5), ([0] * 101 + [1_000_000], (100, 100), 101), ([0] * 100 + [5_000, 10_000], (100, 100), 101)])
def test_bucket_cases(spark, calls, config, admits):
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(calls)], "datagram_id long, received_at_us long, src_ip long, src_port int")
    limits = LimiterConfig(10, *config)
    row = limiter.limiter_stats(limiter.rate_limit(df, limits), limits).first()
    assert (row["total_admits"], row["total_drops"], row["eviction_count"], row["tracked_count"]) == (admits, len(calls) - admits, 0, 1)


def test_edge_sources_are_four(spark):
    rows = [(i, 0, ip, port) for i, (ip, port) in enumerate([(0, 0), (0xFFFFFFFF, 0), (0, 0xFFFF), (0xFFFFFFFF, 0xFFFF)] * 2)]
    df = spark.createDataFrame(rows, "datagram_id long, received_at_us long, src_ip long, src_port int")
    assert [(r["admits"], r["drops"]) for r in limiter.source_stats(limiter.rate_limit(df, LimiterConfig(10, 1, 1))).collect()] == [(1, 1)] * 4


@pytest.mark.parametrize("sources, keep, evicted", [("abc", 2, 1), ("abac", 2, 1), ("abcabc", 2, 4), ("".join(map(chr, range(200, 1200))), 100, 900)])
def test_residency(spark, sources, keep, evicted):
    config = LimiterConfig(keep, 1, 1)
    df = spark.createDataFrame([(i, i, ord(s), 0) for i, s in enumerate(sources)], "datagram_id long, received_at_us long, src_ip long, src_port int")
    held, misses = [], []
    for s in sources:
        misses.append(s not in held)
        held = [x for x in held if x != s][-keep + (s not in held) :] + [s] if keep > 1 else [s]
        held = held[-keep:]
    got = limiter.source_residency(df, config, chunks=5).orderBy("datagram_id").collect()
    assert [r["resident_miss"] for r in got] == misses
    assert limiter.limiter_stats(limiter.rate_limit(df, config), config).first()["eviction_count"] == evicted
    assert [chr(r["src_ip"]) for r in limiter.tracked_sources(df, config).orderBy("last_id").collect()] == held


def test_residency_at_random(spark):
    rng = random.Random(11)
    sources = [min(int(rng.expovariate(0.08)), 90) for _ in range(3000)]
    held, misses, epoch, epochs = [], [], {}, []
    for s in sources:
        misses.append(s not in held)
        epoch[s] = epoch.get(s, 0) + misses[-1]
        epochs.append(epoch[s])
        held = [x for x in held if x != s] + [s]
        held = held[-12:]
    df = spark.createDataFrame([(i, i // 3, s, 0) for i, s in enumerate(sources)], "datagram_id long, received_at_us long, src_ip long, src_port int")
    got = limiter.source_residency(df, LimiterConfig(12), chunks=7).orderBy("datagram_id").collect()
    assert [(r["resident_miss"], r["residency_epoch"]) for r in got] == list(zip(misses, epochs))


@pytest.mark.parametrize("split_idle", [False, True])
@pytest.mark.parametrize("keep", [5, 100])
def test_limiter_on_floods_gaps_and_dropped_rows(spark, keep, split_idle):
    """One source floods, others come and go, some rows were dropped before; over many ranges of arrival."""
    rng = random.Random(keep)
    config, t, rows = LimiterConfig(keep, 100, 3), 0, []
    for i in range(4000):
        t += rng.choice([0, 500, 2000, 9000]) if i % 400 else 200_000
        rows.append((i, t, 0 if i % 3 else rng.randint(1, 9), 0, "recv" if i % 7 == 0 else None))
    held, bucket, want = [], {}, {}
    for i, t, ip, _, gone in rows:
        if gone:
            want[i] = (None, None)
            continue
        miss = ip not in held if keep < 10 else ip not in bucket
        held = [x for x in held if x != ip][-(keep - miss) :] + [ip]
        tokens = config.burst_tokens * limiter.UNIT if miss else limiter.fill(bucket[ip][0], t - bucket[ip][1], config)
        want[i] = (miss, tokens >= limiter.UNIT)
        bucket[ip] = (tokens - limiter.UNIT * want[i][1], t)
    df = spark.createDataFrame(rows, "datagram_id long, received_at_us long, src_ip long, src_port int, drop_stage string").withColumn("drop_reason", F.when(F.col("drop_stage").isNotNull(), F.lit("Truncated")))
    got = limiter.rate_limit(df.repartition(5), config, split_idle=split_idle).collect()
    assert {r["datagram_id"]: (r["resident_miss"], r["admitted"]) for r in got} == want and len(got) == len(rows)
    assert all((r["drop_reason"] == "Truncated") == (r["datagram_id"] % 7 == 0) for r in got)
    if split_idle:
        parts = limiter.idle_segments(df.withColumn("seen", F.col("drop_reason").isNull()), config).filter("src_ip = 0 and seen").select("segment").distinct().count()
        assert parts == 10


def test_limiter_goes_on_from_trigger_to_trigger(spark):
    """Triggers one after the other equal one table, rows dropped before and rows without address among them."""
    rng = random.Random(2)
    config, t, rows = LimiterConfig(100, 100, 3), 0, []
    for i in range(1500):
        t += rng.choice([0, 500, 2000, 9000])
        rows.append((i, t, rng.choice([None, 0, 0, 0, 1, 2, i]), 0, "recv" if i % 7 == 0 else None))
    schema = "datagram_id long, received_at_us long, src_ip long, src_port int, drop_stage string"
    frame = lambda some: spark.createDataFrame(some, schema).withColumn("drop_reason", F.when(F.col("drop_stage").isNotNull(), F.lit("Truncated")))
    buckets, got = spark.createDataFrame([], "src_ip long, src_port int, tokens long, last long"), {}
    for a in range(0, 1500, 500):
        out = limiter.limit_onwards(frame(rows[a : a + 500]).repartition(3), buckets, config).collect()
        got |= {r["datagram_id"]: (r["admitted"], r["drop_reason"]) for r in out if r["carried"] is None}
        buckets = spark.createDataFrame([(r["src_ip"], r["src_port"], r["carried"], r["received_at_us"]) for r in out if r["carried"] is not None], buckets.schema)
    want = limiter.rate_limit(frame(rows), config, bounded=False).collect()
    assert got == {r["datagram_id"]: (r["admitted"], r["drop_reason"]) for r in want}
    late = limiter.limit_onwards(frame([(1, 20, 5, 5, None), (2, 150_000, 5, 5, None)]), spark.createDataFrame([(5, 5, 0, 145_000)], buckets.schema), config).collect()
    assert {r["datagram_id"]: r["admitted"] for r in late if r["carried"] is None} == {1: False, 2: False}  # 5 ms are half a token


def test_usual_messages_equal_the_scanner(spark):
    rng = random.Random(3)
    text = lambda most: "".join(rng.choices("ab1_.é ", k=rng.randint(0, most)))
    number = lambda: rng.choice(["0", "-0", "7", "-1.5", "123456789012345", "0.000001"] * 5 + ["1e3", "01", "1."])
    bodies = []
    for _ in range(4000):
        tags = [f'"{text(rng.choice([3] * 9 + [66]))}":"{text(4)}"' for _ in range(rng.choice([0, 1, 2, 3, 9]))]
        metrics = [f'{{"n":"{text(rng.choice([4] * 9 + [130]))}","v":{number()}' + rng.choice(["", f',"u":"{text(5)}"'] * 4 + [',"u":"' + "u" * 17 + '"']) + rng.choice(["", ',"t":{' + ",".join(tags) + "}"]) + "}" for _ in range(rng.choice([0, 1, 2, 3, 51]))]
        body = f'{{"agent_id":"{rng.choice(["n-1"] * 7 + ["a" * 65, "", "x y"])}","seq":{rng.choice(["5", "4294967297"] * 4 + ["00", "-3"])}' + rng.choice(["", ',"ts":17056896'] * 4 + [',"ts":-1']) + f',"metrics":[{",".join(metrics)}]}}' + rng.choice(["", " x"])
        for _ in range(rng.choice([0, 0, 1])):
            at = rng.randrange(len(body))
            body = body[:at] + rng.choice(['"', "\\", ",", "}", " ", ""]) + body[at + 1 :]
        bodies.append((len(bodies), "metrics", bytearray(body.encode("latin-1"))))
    limits = MetricsLimits()
    df = open_outcome(spark.createDataFrame(bodies, "i long, msg_type string, body binary"))
    listed = decode_metrics.usual_list(decode_metrics.bytes_as_text(F.col("body")), limits)
    taken = {r["i"]: r["l"] for r in df.select("i", listed.alias("l")).collect()}
    for r in decode_metrics.decode_metrics(df, limits).collect():
        want = scan(bytes(bodies[r["i"]][2]), limits)
        assert r["drop_reason"] == want.get("reason"), bodies[r["i"]]
        if "reason" not in want:
            assert (r["metrics_agent"], r["seq"], r["metrics_ts"]) == (want["agent_id"], want["seq"], want["ts"])
            assert [m.asDict(recursive=True) for m in r["metrics"]] == want["metrics"], bodies[r["i"]]
        assert not taken[r["i"]] or "reason" not in want
    plan = decode_metrics.decode_metrics(df, limits)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
    other = decode_metrics.decode_metrics(df, MetricsLimits(tag_members=("tags",))).filter("drop_reason is null").count()
    assert other <= sum("reason" not in scan(bytes(b[2])) for b in bodies)
    assert sum(map(bool, taken.values())) > 200


def test_numbers_with_many_digits():
    body = lambda seq: b'{"agent_id":"a","seq":%s,"metrics":[]}' % seq
    assert decode_metrics.scan(body(b"0" * 5000 + b"1"))["seq"] == 1 and decode_metrics.scan(body(b"-" + b"0" * 5000))["seq"] == 0
    assert decode_metrics.scan(body(b"1" * 5000))["reason"] == "InvalidFieldType"
    assert decode_metrics.scan(body(b"-9223372036854775808"))["seq"] == 0 and decode_metrics.scan(body(b"9223372036854775808"))["reason"] == "InvalidFieldType"


def test_outer_explode_and_merge(spark):
    df = spark.createDataFrame([(1, []), (2, [5, 6])], "datagram_id long, metrics array<int>")
    assert [tuple(r) for r in normalise.explode_metrics(df, outer=True).select("datagram_id", "metric_pos", "metric").orderBy("datagram_id", "metric_pos").collect()] == [(1, None, None), (2, 0, 5), (2, 1, 6)]
    events = lambda n, kind: spark.createDataFrame([(n, n, "a", kind, b"{}")], EVENT)
    merged = normalise.merge_events(events(1, "metrics"), events(2, "log").select("event_bytes", *(f for f in EVENT.names if f != "event_bytes")))
    assert merged.schema == EVENT and sorted((r["datagram_id"], r["event_type"]) for r in merged.collect()) == [(1, "metrics"), (2, "log")]


def sequential_queue(rows, config):
    queue, held, out = 0, {}, []
    for agent in rows:
        if held.get(agent, 0) >= config.max_per_agent:
            out.append(backlog.QUOTA)
        elif queue >= config.max_queue_depth:
            out.append(backlog.FULL)
        else:
            queue, held[agent] = queue + 1, held.get(agent, 0) + 1
            out.append(None)
    return out


@pytest.mark.parametrize(
    "agents, depth, quota", [(list("abcde") * 3, 10, 2), (["A", "B", "C"] + ["X"] * 100, 2, 5), (["A", "B"], 1, 1), ([random.Random(7).choice("abcdefgh") for _ in range(300)], 20, 3), ([""] * 10 + ["a"] * 10, 12, 8)]
)
def test_backlog(spark, agents, depth, quota):
    config = ForwardConfig(depth, quota)
    rows = [(b * 1000 + i, i, a, b) for b in range(2) for i, a in enumerate(agents)]
    df = open_outcome(spark.createDataFrame(rows, "datagram_id long, received_at_us long, agent_id string, b int"))
    want = sequential_queue(agents, config)
    got = backlog.bound_backlog(df, "b", config).orderBy("datagram_id").collect()
    assert [r["drop_reason"] for r in got] == want * 2
    large = backlog.bound_large_backlog(df.filter("b = 0"), config).orderBy("datagram_id").collect()
    assert [(r["drop_reason"], r["forwarded_order"]) for r in large] == [(r["drop_reason"], r["forwarded_order"]) for r in got[: len(agents)]]
    assert [r["forwarded_order"] for r in large if r["forwarded_order"]] == list(range(1, want.count(None) + 1))
    assert backlog.batch_stats(backlog.bound_backlog(df, "b", config)).first()["total_in_flight"] == want.count(None)


def test_residency_streams_and_parts_equal_times(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 40), 7, 1000 if i % 10 else 1001) for i in range(3000)]
    df = spark.createDataFrame(rows, "datagram_id long, src_ip long, src_port int, received_at_us long").repartition(3)
    out = limiter.source_residency(df, LimiterConfig(12), chunks=6)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "MapInArrow" in plan
    held, epoch, want = [], {}, {}
    for n, ip, _, _ in sorted(rows, key=lambda r: (r[3], r[0])):
        miss = ip not in held
        held = [x for x in held if x != ip][-11 if miss else -12 :] + [ip]
        epoch[ip] = epoch.get(ip, 0) + miss
        want[n] = (miss, epoch[ip])
    assert {r["datagram_id"]: (r["resident_miss"], r["residency_epoch"]) for r in out.collect()} == want
    bounds = limiter.arrival_bounds(df, 6, 3000)
    numbered = df.mapInArrow(limiter.number_kernel(bounds), "datagram_id long, src_ip long, src_port int, received_at_us long, chunk int")
    sizes = [r["count"] for r in numbered.groupBy("chunk").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2 * 3000 / 6
