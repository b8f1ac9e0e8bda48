"""Event-time order of streams whose rows come late and shuffled."""

import functools
import random

import pandas as pd
import pytest

from tracelake.operators.trace import conversation_trace, latency
from tracelake.streaming import ordered

ROWS = "session_id string, event_uid string, ts string, event_kind string, actor_kind string"
KINDS = [("message", "user"), ("tool_call", "assistant"), ("tool_result", "tool"), ("message", "assistant"), ("note", "system"), ("tool_result", "tool"), ("message", "assistant")]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ordered.STORE)
    yield
    spark.conf.unset(key)


def frame(spark, rows):
    return spark.createDataFrame(rows, ROWS).selectExpr("session_id", "event_uid", "timestamp(ts) as event_ts", "event_kind", "actor_kind")


def run(spark, tmp_path, parts, name):
    for n, part in enumerate(parts):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(frame(spark, part).schema).parquet(str(tmp_path / "in"))
        q = ordered.ordered_latency(stream, "2 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()  # stopped and started again between the parts
    return [(r.event_uid, r.latency_ms) for r in spark.read.schema("event_uid string, latency_ms double").parquet(str(tmp_path / "out")).collect()]


def test_shuffled_batches_equal_the_batch_operator(spark, tmp_path, rocks):
    rows = [(f"s{k % 3}", f"u{k:03}", f"2024-01-01 00:{k // 60:02}:{k % 60:02}.{k % 10}00", *KINDS[(k // 3) % 7]) for k in range(118)]
    mixed = rows[:]
    random.Random(5).shuffle(mixed)  # all within the two minutes that are allowed
    parts = [mixed[:50], mixed[50:90], mixed[90:]]
    high = max(r[2] for r in parts[0])
    assert any(r[2] < high for r in parts[1])
    end = [(f"s{k}", f"z{k}", "2024-01-02 00:00:00", "message", "user") for k in range(3)]
    late = [("s0", "y0", "2024-01-01 00:00:30", "message", "assistant")]
    twice = [r for r in parts[0] if r[1] in ("u005", "u006")]
    got = run(spark, tmp_path, [parts[0] + twice, parts[1] + [(None, "n", None, "message", "user"), ("s0", "n2", None, "message", "user")], parts[2], end, late], "shuffled")
    want = {r.event_uid: r.latency_ms for r in latency(conversation_trace(frame(spark, rows))).collect()}
    assert len(got) == len(dict(got)) and dict(got) == want and any(want.values())


def test_state_calls_follow_buckets_not_rows(spark, tmp_path, rocks):
    rows = [(f"s{k % 40}", f"u{k:04}", f"2024-01-01 00:00:{k % 60:02}", *KINDS[k % 7]) for k in range(2000)]
    assert run(spark, tmp_path, [rows], "held") == []  # two minutes have not passed, so all of them wait
    state = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "c"))
    assert 0 < state.count() <= 40  # an entry for each bucket, where each row had a value of its own


def test_sessions_that_share_a_bucket_stay_apart(spark, tmp_path, rocks, monkeypatch):
    rows = [(f"s{k * k % 11}", f"u{k:03}", f"2024-01-01 00:{k // 30:02}:{k % 30:02}.{k % 10}00", *KINDS[k % 7]) for k in range(600)]
    mixed = sorted(rows, key=lambda r: (r[2][:16], random.Random(r[1]).random()))  # shuffled within each minute
    parts = [mixed[n : n + 120] for n in range(0, 600, 120)] + [[("s0", "z", "2024-01-02 00:00:00", "message", "user")]]
    monkeypatch.setattr(ordered, "ordered_latency", functools.partial(ordered.ordered_latency, buckets=2))
    got = run(spark, tmp_path, parts, "shared")  # tool results of one release are answered in later ones
    want = {r.event_uid: r.latency_ms for r in latency(conversation_trace(frame(spark, rows))).collect()}
    assert len(got) == len(dict(got)) and dict(got) == want and sum(d is not None for d in want.values()) > 20


def test_rows_ahead_of_a_release_are_kept_until_answered():
    ahead, seen = ordered._frame([]), []
    for part in ([("s", 1_000, "a", True, False), ("t", 1_500, "b", True, False)], [("s", 5_999, "d", False, True), ("s", 5_999, "c", True, False), ("s", 6_000, "c", False, True)], [("t", 9_000, "e", False, True)]):
        out, ahead = ordered.delays(pd.DataFrame(part, columns=ordered.ROW), ordered._frame([ordered._text(ahead)]))
        seen += [(r.event_uid, None if pd.isna(r.latency_ms) else r.latency_ms) for r in out.itertuples()]
    assert seen == [("a", None), ("b", None), ("c", None), ("d", 0.0), ("e", 8.0)] and not len(ahead)
