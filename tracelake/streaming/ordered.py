"""Streams worked off in the order of event time, however their rows arrive.

Rows are held as state until the watermark has passed them; then they are released by time and uid, so what is worked out from neighbours equals the
batch operators. A row that comes after the watermark passed its time is left out, as is one without a time or a session; of rows of a session with one
uid that are held together, one counts. What is held is bounded by the lateness allowed.

State is kept by hash bucket of the session: a key of its own for each session, and a value for each row, would cost calls between Python and the state store
that take far longer than the work. Rows of a bucket are handled as frames, and one timer a bucket is outstanding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Of a row: whether it is a tool result, and whether the assistant's.
ROW = ["session_id", "us", "event_uid", "result", "reply"]
#: The state store that map states and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _text(rows: pd.DataFrame) -> str:
    """The columns of ROW as one text."""
    return json.dumps([rows[c].tolist() for c in ROW])


def _frame(texts: list[str]) -> pd.DataFrame:
    frames = [pd.DataFrame(dict(zip(ROW, json.loads(t), strict=True))) for t in texts]
    return pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in ROW})


def delays(rows: pd.DataFrame, before: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Latencies of rows by time and uid, `before` holding each session's row ahead of them; and the rows that are ahead of what comes next, where they are tool results."""
    rows = rows.sort_values(["us", "event_uid"], kind="stable").drop_duplicates(["session_id", "event_uid"])
    both = pd.concat([before, rows], ignore_index=True) if len(before) else rows.reset_index(drop=True)
    ms, sessions = both["us"] // 1000, both["session_id"]
    after = both["result"].astype("bool").groupby(sessions, sort=False).shift(fill_value=False) & both["reply"].astype("bool")
    both["latency_ms"] = (ms - ms.groupby(sessions, sort=False).shift()).clip(lower=0).where(after)
    ahead = both.drop_duplicates("session_id", keep="last")
    return both.loc[len(before) :, ["session_id", "event_uid", "latency_ms"]], ahead.loc[ahead["result"].astype("bool"), ROW]


class Latencies(StatefulProcessor):
    """The delay of an assistant event right after a tool result."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "n long, least long", "rows string")  # entries of their own: appending to a list reads what is there
        self.ahead = handle.getValueState("ahead", "rows string")
        self.times = handle.getValueState("times", "upto long, due long, n long")

    def _wake(self, us: int) -> int:
        due = -(-us // 1000)
        self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        upto, due, n = self.times.get() or (None, None, 0)
        least = None
        for frame in rows:
            if upto is not None:
                frame = frame[frame["us"] > upto]
            if len(frame):
                first = int(frame["us"].min())
                self.held.updateValue((n, first), (_text(frame),))
                n += 1
                least = first if least is None else min(least, first)
        if least is not None:
            if due is None or -(-least // 1000) < due:
                if due is not None:
                    self.handle.deleteTimer(due)
                due = self._wake(least)
            self.times.update((upto, due, n))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        n = self.times.get()[2]
        keys = sorted(tuple(k) for k in self.held.keys())
        due, wait = [k for k in keys if k[1] <= upto], [k[1] for k in keys if k[1] > upto]
        rows = _frame([self.held.getValue(k)[0] for k in due])
        for k in due:
            self.held.removeKey(k)
        later = rows["us"] > upto
        if later.any():
            wait.append(int(rows["us"][later].min()))
            self.held.updateValue((n, wait[-1]), (_text(rows[later]),))
            n += 1
        before = self.ahead.get()
        out, ahead = delays(rows[~later], _frame(list(before or ())))
        self.ahead.update((_text(ahead),))
        self.times.update((upto, self._wake(min(wait)) if wait else None, n))
        if len(out):
            yield out

    def close(self) -> None:
        pass


def ordered_latency(events: DataFrame, late: str = "10 minutes", buckets: int = 2048) -> DataFrame:
    """Streaming `operators.trace.latency` for rows that come up to `late` after later ones; the session must name STORE as its state store.

    `buckets` must stay as it is for a checkpoint; a task holds the waiting rows of one of them at a time.
    """
    at = F.col("event_ts").cast("timestamp")
    own = events.filter(F.lower("actor_kind").isin("user", "assistant", "tool")).filter("session_id IS NOT NULL AND event_uid IS NOT NULL")
    result, reply = (F.coalesce(F.col(c) == v, F.lit(False)) for c, v in (("event_kind", "tool_result"), ("actor_kind", "assistant")))
    own = own.select(F.pmod(F.hash("session_id"), F.lit(buckets)).alias("bucket"), "session_id", "event_uid", at.alias("event_ts"), result.alias("result"), reply.alias("reply"))
    own = own.filter("event_ts IS NOT NULL").withWatermark("event_ts", late).withColumn("us", F.unix_micros("event_ts"))
    return own.groupBy("bucket").transformWithStateInPandas(Latencies(), "session_id string, event_uid string, latency_ms double", "append", "eventTime")
