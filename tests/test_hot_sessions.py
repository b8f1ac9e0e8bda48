"""Order and turns of long sessions, worked out by hours, against one window over each session."""

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelake.operators.trace import conversation_trace, is_user_message

COLUMNS = "session_id string, event_uid string, event_ts {kind}, actor_kind string, event_kind string, turn_index int"


def events(spark, kind):
    """One session holds half of the rows over three days; some rows have no session, time or actor, some hours no user."""
    rng, start, rows = random.Random(3), datetime.datetime(2024, 3, 30, 22, 0), []
    for i in range(1500):
        session = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        at = None if rng.random() < 0.03 else start + datetime.timedelta(minutes=rng.choice([0, 1, 2, 90, 400, rng.randrange(4000)]))
        rows.append((session, f"e{i:05d}", at, rng.choice(["user", "assistant", "assistant", "tool", None]), rng.choice(["message", "tool_call", None]), rng.choice([None, 0, 3])))
    return spark.createDataFrame(rows, COLUMNS.format(kind=kind))


def plain(rows, explicit):
    w = Window.partitionBy("session_id").orderBy("event_ts", "event_uid")
    running = F.greatest(F.sum(is_user_message().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(1))
    turn = F.when(F.col("turn_index") > 0, F.col("turn_index")).otherwise(running) if explicit else running
    rows = rows.withColumns({"event_order": F.row_number().over(w), "turn_seq": turn})
    return rows.withColumn("event_ordinal", F.row_number().over(Window.partitionBy("session_id", "turn_seq").orderBy("event_order")))


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("explicit", [False, True])
def test_hours_equal_one_window(spark, kind, explicit):
    rows = events(spark, kind)
    rows = rows if explicit else rows.drop("turn_index")
    got = {r["event_uid"]: (r["event_order"], r["turn_seq"], r["event_ordinal"]) for r in conversation_trace(rows).collect()}
    want = {r["event_uid"]: (r["event_order"], r["turn_seq"], r["event_ordinal"]) for r in plain(rows, explicit).collect()}
    assert len(got) == 1500 and got == want


def test_no_events(spark):
    got = conversation_trace(events(spark, "timestamp").limit(0))
    assert got.count() == 0 and got.columns[-3:] == ["event_order", "turn_seq", "event_ordinal"]
