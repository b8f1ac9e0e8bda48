"""JSON methods over canonical events, a page or one session at a time."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.functions import classify, cursor
from tracelake.operators import search, sessions, trace


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


class Conversations:
    """Every method collects at most a page, or the turns of one session."""

    def __init__(self, events: DataFrame):
        self.events = events

    def _summary(self, events: DataFrame) -> DataFrame:
        tool = F.coalesce("tool_name", F.lit("")) if "tool_name" in events.columns else F.lit("")
        mode = events.groupBy("session_id").agg(classify.session_mode(F.col("event_kind"), F.col("payload_type"), tool, F.lit(False)).alias("mode"))
        return trace.session_summary(trace.conversation_trace(events)).join(mode, "session_id")

    def list_conversations_json(self, limit: int = 25, after: str | None = None, mode: str | None = None) -> str:
        limit, filters = cursor.clamp(limit, 25, 1, 200), {"mode": mode}
        at = cursor.decode(after, filters) if after else None
        key = (F.lit(at["t"]).cast(self.events.schema["event_ts"].dataType), at["id"]) if at else None
        found = _rows(sessions.list_sessions(self._summary(self.events), limit, after=key, modes=[mode] if mode else None).withColumn("last_event_time", F.col("last_event_time").cast("string")))
        more = len(found) > limit
        page = found[:limit]
        last = page[-1] if page else None
        return json.dumps({"items": page, "next_cursor": cursor.encode({"t": last["last_event_time"], "id": last["session_id"]}, filters) if more else None})

    def get_conversation_json(self, session_id: str, include_turns: bool = False) -> str:
        own = self.events.filter(F.col("session_id") == cursor.safe(session_id))
        found = _rows(self._summary(own))
        if not found:
            return "null"
        turns = _rows(trace.turn_summary(trace.conversation_trace(own)).orderBy("turn_seq")) if include_turns else None
        return json.dumps(found[0] | ({"turns": turns} if include_turns else {}))

    def search_events_json(self, query: str, limit: int = 25, min_should_match: int = 1) -> str:
        seen = self.events.filter(classify.searched_by_default(F.col("event_kind"), F.col("payload_type")))
        hits = search.search_events(seen, query, "event_uid", "text_content", cursor.clamp(limit, 25, 1, 50), min_should_match)
        return json.dumps(_rows(hits.orderBy(F.desc("score"), "event_uid")))

    def search_conversations_json(self, query: str, limit: int = 25, min_should_match: int = 1) -> str:
        return json.dumps(_rows(search.search_sessions(self.events, query, "session_id", "event_uid", "text_content", cursor.clamp(limit, 25, 1, 50), min_should_match)))
