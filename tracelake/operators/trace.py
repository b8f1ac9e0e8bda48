"""Versions, event order, turns, and summaries of turns and sessions.

Order, turn and ordinal come from one window by session and hour, so wide rows are exchanged once and long sessions are split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.written import written

ORDER = ("event_ts", "source_file", "source_generation", "source_offset", "source_line_no", "emission_index", "event_uid")


def latest(df: DataFrame, keys: list[str], version: str, ties: list[str] | None = None) -> DataFrame:
    """One row of each key: the highest version (ties: the largest of `ties`). A window, as a row is wider than its key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *(F.col(t).desc() for t in ties or []))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def is_user_message() -> Column:
    return (F.col("actor_kind") == "user") & (F.col("event_kind") == "message")


def _hour(events: DataFrame, first: str) -> Column:
    """Hours of the column that rows are ordered by first, nulls before all; one value if it is no time."""
    kind, at = dict(events.dtypes).get(first), F.col(first)
    if kind == "timestamp":
        hour = F.floor(F.unix_micros(at) / 3_600_000_000)
    elif kind == "timestamp_ntz":
        hour = F.unix_date(F.to_date(at)) * 24 + F.hour(at)
    else:
        return F.lit(0).cast("long")
    return F.coalesce(hour.cast("long"), F.lit(-(1 << 62)))


def conversation_trace(events: DataFrame, order: tuple[str, ...] = ORDER) -> DataFrame:
    """events with event_order, turn_seq (an explicit turn_index wins; at least 1) and event_ordinal within the turn.

    Each hour of a session is ordered as a group of its own and shifted by what the session's earlier hours hold, so a session
    with a large part of all events is many tasks' work. A narrow pass counts the hours. Only explicit turns are numbered in one group each.
    """
    order = tuple(c for c in order if c in events.columns)
    key = F.struct("session_id").alias("_key")  # never null itself, so that window and join agree on how rows lie
    rows = events.select("*", key, _hour(events, order[0]).alias("_hour"))
    w = Window.partitionBy("_key", "_hour").orderBy(*order)
    so_far, user = w.rowsBetween(Window.unboundedPreceding, 0), is_user_message()
    narrow = rows.select(*dict.fromkeys(("_key", "_hour", *order, "actor_kind", "event_kind"))).withColumn("_n", F.row_number().over(w))
    hours = narrow.groupBy(F.col("_key").alias("_session"), F.col("_hour").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"), F.count_if(user).alias("_said"), F.max(F.when(user, F.col("_n"))).alias("_last"))
    earlier = Window.partitionBy("_session").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.withColumns({"_rows": F.coalesce(F.sum("_rows").over(earlier), F.lit(0)), "_said": F.coalesce(F.sum("_said").over(earlier), F.lit(0))})
    hours = hours.withColumn("_last", F.max(F.col("_rows") + F.col("_last")).over(earlier))
    rows = rows.withColumn("_n", F.row_number().over(w))
    rows = rows.withColumns({"_s": F.coalesce(F.sum(user.cast("int")).over(so_far), F.lit(0)), "_l": F.max(F.when(user, F.col("_n"))).over(so_far)})
    rows = rows.join(hours, (F.col("_key") == F.col("_session")) & (F.col("_hour") == F.col("_at")))
    place, said, last = F.col("_n") + F.col("_rows"), F.col("_s") + F.col("_said"), F.coalesce(F.col("_l") + F.col("_rows"), F.col("_last"))
    explicit = F.coalesce(F.col("turn_index"), F.lit(0)) if "turn_index" in events.columns else None
    turn = F.greatest(said, F.lit(1))
    turn = (turn if explicit is None else F.when(explicit > 0, explicit).otherwise(turn)).cast("long")
    start = F.when(said > 1, last).otherwise(1)  # a turn begins with a user's message, the first one with the session
    rows = rows.select(*(F.col(f"`{c}`") for c in events.columns), place.cast("long").alias("event_order"), turn.alias("turn_seq"), (place - start + 1).cast("long").alias("event_ordinal"))
    if explicit is None:
        return rows
    return rows.withColumn("event_ordinal", F.row_number().over(Window.partitionBy("session_id", "turn_seq").orderBy("event_order")).cast("long"))


def _counts() -> list[Column]:
    of = lambda kind: F.count_if(F.col("event_kind") == kind)
    said = lambda who: F.count_if((F.col("actor_kind") == who) & (F.col("event_kind") == "message"))
    return [
        F.count(F.lit(1)).alias("total_events"), said("user").alias("user_messages"), said("assistant").alias("assistant_messages"),
        of("tool_call").alias("tool_calls"), of("tool_result").alias("tool_results"), of("reasoning").alias("reasoning_items"),
    ]


def turn_summary(trace: DataFrame) -> DataFrame:
    return trace.groupBy("session_id", "turn_seq").agg(F.min("event_ts").alias("started_at"), F.max("event_ts").alias("ended_at"), *_counts())


def session_summary(trace: DataFrame) -> DataFrame:
    return trace.groupBy("session_id").agg(F.min("event_ts").alias("first_event_time"), F.max("event_ts").alias("last_event_time"), F.max("turn_seq").alias("total_turns"), *_counts())


def neighbours(trace: DataFrame) -> DataFrame:
    """trace with the uids of the previous and next event of the session."""
    w = Window.partitionBy("session_id").orderBy("event_order")
    return trace.withColumns({"prev_uid": F.lag("event_uid").over(w), "next_uid": F.lead("event_uid").over(w)})


def context_window(trace: DataFrame, targets: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Events within `before` and `after` of each target (event_uid) in its session, target flagged."""
    at = trace.join(targets.select("event_uid").distinct(), "event_uid", "left_semi").select("session_id", F.col("event_uid").alias("target_uid"), F.col("event_order").alias("target_order"))
    wanted = at.withColumn("event_order", F.explode(F.sequence(F.col("target_order") - before, F.col("target_order") + after)))
    near = trace.join(wanted, ["session_id", "event_order"])  # a few places for each target, not all events of its session
    return near.withColumn("is_target", F.col("event_uid") == F.col("target_uid"))


def open_turn(trace: DataFrame, turn_seq: int, after: int = 0, limit: int = 50, snapshot: Column | None = None) -> DataFrame:
    """Events of a turn behind an ordinal, with the turn's snapshot; stale tells that the turn is no longer the one of the given snapshot."""
    rows = trace.filter(F.col("turn_seq") == turn_seq)
    now = turn_digest(rows).select("session_id", F.col("snapshot").alias("turn_snapshot"))
    page = rows.filter(F.col("event_ordinal").between(after + 1, after + limit)).join(now, "session_id")
    stale = F.lit(False) if snapshot is None else ~F.col("turn_snapshot").eqNullSafe(snapshot)
    return page.withColumn("stale", stale)


def turn_digest(trace: DataFrame) -> DataFrame:
    """Of each turn: first user text, last assistant text, terminal event, tools in first-seen order, and its identity hash."""
    user, reply = is_user_message(), (F.col("actor_kind") == "assistant") & (F.col("event_kind") == "message")
    tool = (F.col("event_kind") == "tool_call") & (F.coalesce(F.col("tool_name"), F.lit("")) != "")
    pick = lambda f, c, cond: f(F.when(cond, F.col(c)), F.when(cond, F.col("event_order")))
    seen = F.array_sort(F.collect_list(F.when(tool, F.struct("event_order", "tool_name"))))
    ids = F.array_sort(F.collect_list(F.struct("event_order", "event_uid")))
    return trace.groupBy("session_id", "turn_seq").agg(
        pick(F.min_by, "text_content", user).alias("user_input"), pick(F.max_by, "text_content", reply).alias("final_response"),
        F.max_by("event_uid", "event_order").alias("terminal_uid"), F.array_distinct(F.transform(seen, lambda x: x["tool_name"])).alias("tools"),
        F.sha2(F.array_join(F.transform(ids, lambda x: x["event_uid"]), ","), 256).alias("snapshot"),
    )


def latency(trace: DataFrame) -> DataFrame:
    """Latency of an assistant event right after a tool result, among user, assistant and tool events, in ms."""
    rows = trace.filter(F.lower("actor_kind").isin("user", "assistant", "tool"))
    w = Window.partitionBy("session_id").orderBy("event_order")
    ms = F.unix_millis(F.col("event_ts").cast("timestamp"))
    after = (F.lag("event_kind").over(w) == "tool_result") & (F.col("actor_kind") == "assistant")
    return rows.withColumn("latency_ms", F.when(after, F.greatest(ms - F.lag(ms).over(w), F.lit(0))))


def pair_tools(trace: DataFrame) -> DataFrame:
    """Tool results with the call they answer: the most recent open call of that call_id in the turn.

    A running depth does a stack's work: each call opens a level, a result closes the one that is on top, and a result
    at depth 0 has no call. Calls and results of a level alternate, so the last call of the level is the match.
    """
    rows = trace.filter(F.col("event_kind").isin("tool_call", "tool_result") & F.col("tool_call_id").isNotNull())
    key = ["session_id", "turn_seq", "tool_call_id"]
    w = Window.partitionBy(*key).orderBy("event_order").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_kind") == "tool_call", 1).otherwise(-1)
    rows = rows.withColumn("_s", F.sum(step).over(w))
    rows = rows.withColumn("_d", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w)))
    before = F.coalesce(F.lag("_d").over(Window.partitionBy(*key).orderBy("event_order")), F.lit(0))
    rows = rows.withColumn("_level", F.when(F.col("event_kind") == "tool_call", F.col("_d")).otherwise(before))
    match = Window.partitionBy(*key, "_level").orderBy("event_order").rowsBetween(Window.unboundedPreceding, -1)
    call = F.last(F.when(F.col("event_kind") == "tool_call", F.col("event_uid")), ignorenulls=True).over(match)
    rows = rows.withColumn("call_uid", F.when(F.col("_level") > 0, call))
    return rows.filter("event_kind = 'tool_result'").select(*key, F.col("event_uid").alias("result_uid"), "call_uid")


def pair_in_order(trace: DataFrame) -> DataFrame:
    """Tool results with the call that they answer where calls wait in a line: a session's next result takes the first call that waits.

    A result that comes when none waits takes none. So the calls used up are the results so far, less those that came too early; these
    are the largest lack of calls so far, and a result is one of them if it makes that lack larger.
    tool_call_id is the result's own, else its call's, else made from its uid; a call takes over the id of the result that answers it. tool_name likewise.
    """
    rows = trace.filter(F.col("event_kind").isin("tool_call", "tool_result"))
    by = Window.partitionBy("session_id").orderBy("event_order")
    so_far, call = by.rowsBetween(Window.unboundedPreceding, 0), F.col("event_kind") == "tool_call"
    rows = rows.withColumns({"_c": F.sum(call.cast("int")).over(so_far), "_r": F.sum((~call).cast("int")).over(so_far)})
    rows = rows.withColumn("_lack", F.greatest(F.lit(0), F.max(F.when(~call, F.col("_r") - F.col("_c"))).over(so_far)))
    before = F.coalesce(F.lag("_lack").over(by), F.lit(0))
    rows = rows.withColumn("_k", F.when(call, F.col("_c")).when(F.coalesce("_lack", F.lit(0)) == before, F.col("_r") - F.coalesce("_lack", F.lit(0))))
    own = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    calls = rows.filter(call).select("session_id", "_k", F.col("event_uid").alias("call_uid"), own("tool_call_id").alias("_id"), own("tool_name").alias("_name"))
    results = rows.filter(~call).select("session_id", "_k", F.col("event_uid").alias("result_uid"), own("tool_call_id").alias("tool_call_id"), own("tool_name").alias("tool_name"))
    both = results.join(calls, ["session_id", "_k"], "left")
    made = F.concat(F.lit("result-"), F.col("result_uid"))
    return both.select("session_id", "result_uid", "call_uid", F.coalesce("tool_call_id", "_id", made).alias("tool_call_id"), F.coalesce("tool_name", "_name", F.lit("")).alias("tool_name"))


def root_sessions(links: DataFrame) -> DataFrame:
    """(session_id, parent_id) to (session_id, root_id, depth): the top of each chain of parents, by pointer jumping.

    A chain of n sessions takes log n rounds, each a join of narrow rows. Of several parents the least counts; a session that is its own parent has
    none; a parent without a row of its own is a root. Sessions on a circle, and those below it, have the circle's least session as root and a null depth.
    """
    own = links.filter("session_id is not null").groupBy("session_id").agg(F.min(F.nullif("parent_id", "session_id")).alias("parent_id"))
    inner = own.select("session_id", F.coalesce("parent_id", "session_id").alias("at"), F.col("parent_id").isNotNull().cast("long").alias("depth"))
    strangers = inner.select(F.col("at").alias("session_id")).distinct().join(own, "session_id", "left_anti")
    up = inner.unionByName(strangers.select("session_id", F.col("session_id").alias("at"), F.lit(0).cast("long").alias("depth")))
    up = written(up.withColumn("least", F.least("session_id", "at")))
    for _ in range(up.count().bit_length() + 1):
        further = up.select(F.col("session_id").alias("at"), F.col("at").alias("_to"), F.col("depth").alias("_more"), F.col("least").alias("_least"))
        rows = up.join(further, "at").select("session_id", F.col("_to").alias("at"), (F.col("depth") + F.col("_more")).alias("depth"), F.least("least", "_least").alias("least"), (F.col("_to") != F.col("at")).alias("_moved"))
        rows = written(rows)
        up = rows.drop("_moved")
        if rows.filter("_moved").isEmpty():
            break
    ends = up.select(F.col("session_id").alias("at"), F.col("depth").alias("_deep"), F.col("least").alias("_circle"))
    top = F.col("_deep") == 0
    found = up.join(ends, "at").select("session_id", F.when(top, F.col("at")).otherwise(F.col("_circle")).alias("root_id"), F.when(top, F.col("depth")).alias("depth"))
    return found.join(own.select("session_id"), "session_id", "left_semi")


def semantic_uid(fields: list[Column]) -> Column:
    """SHA-256 over length-prefixed fields (bytes), so that no two lists of fields look alike."""
    parts = [F.concat(F.octet_length(F.coalesce(f.cast("string"), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(f.cast("string"), F.lit(""))) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def number_siblings(df: DataFrame, uid: str, order: list[str]) -> DataFrame:
    """Rows of one uid get a suffix by their order, if there are several."""
    w = Window.partitionBy(uid)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    return df.withColumn(uid, F.when(n > 1, F.concat(F.col(uid), F.lit("#"), k.cast("string"))).otherwise(F.col(uid)))


def session_steps(trace: DataFrame) -> DataFrame:
    """Steps of a session: user and assistant messages, thoughts, and calls with the result that answered them and its delay."""
    calls = pair_tools(trace).filter("call_uid is not null").select("session_id", "call_uid", "result_uid")
    results = trace.select("session_id", F.col("event_uid").alias("result_uid"), F.col("text_content").alias("result_text"), F.col("event_ts").alias("result_ts"))
    answered = calls.join(results, ["session_id", "result_uid"]).select("session_id", F.col("call_uid").alias("event_uid"), "result_uid", "result_text", "result_ts")
    kind = F.col("event_kind")
    step = F.when(is_user_message(), "user").when((kind == "message") & (F.col("actor_kind") == "assistant"), "assistant").when(kind == "reasoning", "thinking").when(kind == "tool_call", "tool_call")
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    rows = trace.withColumn("step", step).filter("step is not null").join(answered, ["session_id", "event_uid"], "left")
    return rows.select("session_id", "turn_seq", "event_order", "event_uid", "step", "result_uid", "result_text", (ms("result_ts") - ms("event_ts")).alias("result_ms"))


def turn_tokens(trace: DataFrame) -> DataFrame:
    """Token maps of a turn added up by bucket."""
    rows = trace.select("session_id", "turn_seq", F.explode("token_usage_buckets").alias("token_bucket", "n"))
    return rows.groupBy("session_id", "turn_seq", "token_bucket").agg(F.sum(F.greatest("n", F.lit(0))).alias("tokens"))


def completed_by_list(trace: DataFrame, terminal: tuple[str, ...] = ("task_complete", "turn_aborted")) -> DataFrame:
    """A session is complete if its latest terminal event is task_complete and lies in its last turn."""
    end = F.col("payload_type").isin(*terminal)
    last = lambda c: F.max_by(F.when(end, F.col(c)), F.when(end, F.col("event_order")))
    rows = trace.groupBy("session_id").agg(last("payload_type").alias("_p"), last("turn_seq").alias("_t"), F.max("turn_seq").alias("_n"))
    return rows.select("session_id", F.coalesce((F.col("_p") == "task_complete") & (F.col("_t") == F.col("_n")), F.lit(False)).alias("completed"))


def hit_details(hits: DataFrame, trace: DataFrame) -> DataFrame:
    """Hits (session_id, event_uid, score) with their place in session and turn, and the score against the best one."""
    place = trace.select("session_id", "event_uid", "event_order", "turn_seq", "event_ordinal")
    totals = trace.groupBy("session_id").agg(F.max("turn_seq").alias("total_turns"), F.count(F.lit(1)).alias("total_events"))
    best = hits.agg(F.max("score").alias("_best"))
    return hits.join(place, ["session_id", "event_uid"]).join(totals, "session_id").crossJoin(F.broadcast(best)).withColumn("score_share", F.round(F.col("score") / F.col("_best"), 6)).drop("_best")
