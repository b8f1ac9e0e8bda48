"""The driver tables as canonical events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message event of each turn; times are a minute apart."""
    c = table(spark, sf_dir, "conversations")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return c.select(
        F.col("conv_id").cast("string").alias("session_id"), F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.lpad(F.col("turn").cast("string"), 4, "0")).alias("event_uid"),
        (start + F.make_interval(mins=F.col("turn").cast("int"))).alias("event_ts"), F.col("role").alias("actor_kind"), F.lit("message").alias("event_kind"),
        F.when(F.col("role") == "user", "user_message").otherwise("agent_message").alias("payload_type"), F.col("text").alias("text_content"), "turn",
    )


def activity_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events rows as tool calls, results, messages and notes of one session for each user."""
    return as_activity(table(spark, sf_dir, "events"))


def as_activity(e: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    return e.select(
        F.col("user_id").cast("string").alias("session_id"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("event_uid"), F.col("ts").alias("event_ts"),
        F.when(kind == "view", "tool_call").when(kind == "click", "tool_result").when(kind == "purchase", "message").when(kind == "signup", "session_meta").otherwise("event_msg").alias("event_kind"),
        F.when(kind == "view", "assistant").when(kind == "click", "tool").when((kind == "purchase") & (k % 2 == 0), "user").when(kind == "error", "system").otherwise("assistant").alias("actor_kind"),
        F.when(kind == "view", "tool_use").when(kind == "click", "tool_result").when((kind == "purchase") & (k % 2 == 0), "user_message").when(kind == "purchase", "agent_message").when(kind == "signup", "session_meta")
        .when(k % 3 == 0, "task_complete").when(k % 3 == 1, "token_count").otherwise("agent_reasoning").alias("payload_type"),
        F.when(kind.isin("view", "click"), F.concat(F.lit("c"), (k % 7).cast("string"))).alias("tool_call_id"),
        F.when(kind.isin("view", "click"), F.concat(F.lit("tool"), (k % 5).cast("string"))).alias("tool_name"),
        kind.alias("model"), k.alias("request_id"), "value", "event_type", "props",
        F.concat(F.lit("note "), (k % 4).cast("string")).alias("text_content"),
        F.create_map(F.lit("value"), F.floor("value"), F.lit("k"), k).alias("token_usage_buckets"),
    )


#: The same two tables in SQL, as common table expressions.
CONVERSATIONS_SQL = """
cv AS (
  SELECT CAST(conv_id AS VARCHAR) AS session_id, conv_id || '-' || lpad(CAST(turn AS VARCHAR), 4, '0') AS event_uid,
         TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)) AS event_ts, role AS actor_kind, 'message' AS event_kind,
         CASE WHEN role = 'user' THEN 'user_message' ELSE 'agent_message' END AS payload_type, text AS text_content, turn
  FROM conversations
),
tc AS (
  SELECT *, row_number() OVER w AS event_order,
         CAST(greatest(sum(CASE WHEN actor_kind = 'user' AND event_kind = 'message' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_ts, event_uid ROWS UNBOUNDED PRECEDING), 1) AS BIGINT) AS turn_seq
  FROM cv WINDOW w AS (PARTITION BY session_id ORDER BY event_ts, event_uid)
)
"""

ACTIVITY_SQL = """
raw AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ev AS (
  SELECT CAST(user_id AS VARCHAR) AS session_id, 'e' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS event_uid, ts AS event_ts,
    CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'tool_result' WHEN 'purchase' THEN 'message' WHEN 'signup' THEN 'session_meta' ELSE 'event_msg' END AS event_kind,
    CASE WHEN event_type = 'view' THEN 'assistant' WHEN event_type = 'click' THEN 'tool' WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'user' WHEN event_type = 'error' THEN 'system' ELSE 'assistant' END AS actor_kind,
    CASE WHEN event_type = 'view' THEN 'tool_use' WHEN event_type = 'click' THEN 'tool_result' WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'user_message' WHEN event_type = 'purchase' THEN 'agent_message'
         WHEN event_type = 'signup' THEN 'session_meta' WHEN k % 3 = 0 THEN 'task_complete' WHEN k % 3 = 1 THEN 'token_count' ELSE 'agent_reasoning' END AS payload_type,
    CASE WHEN event_type IN ('view', 'click') THEN 'c' || (k % 7) END AS tool_call_id,
    CASE WHEN event_type IN ('view', 'click') THEN 'tool' || (k % 5) END AS tool_name,
    event_type AS model, k AS request_id, value, event_type, props, 'note ' || (k % 4) AS text_content, CAST(floor(value) AS BIGINT) AS whole
  FROM raw
),
te AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY event_ts, event_uid) AS event_order,
         CAST(greatest(sum(CASE WHEN actor_kind = 'user' AND event_kind = 'message' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY event_ts, event_uid ROWS UNBOUNDED PRECEDING), 1) AS BIGINT) AS turn_seq
  FROM ev
)
"""
