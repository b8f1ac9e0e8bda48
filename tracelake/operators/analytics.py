"""Time series, feeds and operations reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the interval, in seconds since 1970."""
    s = F.unix_seconds(ts.cast("timestamp"))
    return s - F.pmod(s, F.lit(seconds))


def token_series(events: DataFrame, seconds: int, per_request_kinds: list[str]) -> DataFrame:
    """bucket, model, token_bucket, tokens. Kinds that repeat a request's usage count its maximum once."""
    rows = events.select(bucket(F.col("event_ts"), seconds).alias("bucket"), "model", "session_id", "request_id", "event_uid", F.explode("token_usage_buckets").alias("token_bucket", "n"))
    once = F.col("model").isin(*per_request_kinds) & F.col("request_id").isNotNull()
    unit = F.when(once, F.concat_ws("/", F.lit("r"), "session_id", F.col("request_id").cast("string"))).otherwise(F.concat(F.lit("e/"), F.col("event_uid")))
    per = rows.groupBy("bucket", "model", "token_bucket", unit.alias("unit")).agg(F.max("n").alias("n"))
    return per.groupBy("bucket", "model", "token_bucket").agg(F.sum("n").alias("tokens"))


def turn_series(events: DataFrame, seconds: int) -> DataFrame:
    """Distinct (session, request) of each bucket and model."""
    keys = events.select(bucket(F.col("event_ts"), seconds).alias("bucket"), "model", "session_id", "request_id").distinct()
    return keys.groupBy("bucket", "model").agg(F.count(F.lit(1)).alias("turns"))


def concurrency_series(events: DataFrame, seconds: int, tokens: Column) -> DataFrame:
    """Distinct sessions of each bucket that used tokens."""
    keys = events.filter(tokens > 0).select(bucket(F.col("event_ts"), seconds).alias("bucket"), "session_id").distinct()
    return keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("sessions"))


def fill_gaps(series: DataFrame, seconds: int, value: str) -> DataFrame:
    """A row for every bucket between the first and the last; missing ones are 0."""
    span = series.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter("lo is not null")
    grid = span.select(F.explode(F.sequence("lo", "hi", F.lit(seconds).cast("long"))).alias("bucket"))
    return grid.join(series, "bucket", "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def top_series(series: DataFrame, name: str, value: str, k: int = 8) -> DataFrame:
    """The rows of the k largest series; the choice is k rows, and broadcast."""
    top = series.groupBy(name).agg(F.sum(value).alias("_total")).orderBy(F.desc("_total"), name).limit(k).select(name)
    return series.join(F.broadcast(top), name, "left_semi")


def percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Nearest-rank median and 95th percentile."""
    return df.groupBy(*keys).agg(*(F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(n) for n, q in (("p50", 0.5), ("p95", 0.95))))


def hot_queries(log: DataFrame, limit: int = 10) -> DataFrame:
    return log.groupBy("query").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("latency_ms"), 6).alias("avg_latency")).orderBy(F.desc("runs"), F.desc("avg_latency"), "query").limit(limit)


def touch_rollup(touches: DataFrame) -> DataFrame:
    """Touches of a path by session: count, first and last time, sorted distinct tools."""
    return touches.groupBy("session_id").agg(F.count(F.lit(1)).alias("touches"), F.min("event_ts").alias("first_touch"), F.max("event_ts").alias("last_touch"), F.sort_array(F.collect_set("tool_name")).alias("tools"))


def merge_touches(exact: DataFrame, fallback: DataFrame) -> DataFrame:
    """Union in which an exact touch wins over a fallback of the same session, call and event."""
    from pyspark.sql import Window

    both = exact.withColumn("_branch", F.lit(0)).unionByName(fallback.withColumn("_branch", F.lit(1)))
    w = Window.partitionBy("session_id", "tool_call_id", "event_uid").orderBy("_branch")
    return both.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_branch")


def web_feed(events: DataFrame, limit: int = 100) -> DataFrame:
    """Web searches, newest first; the query by precedence of JSON fields."""
    q = F.coalesce(*(F.nullif(F.get_json_object("payload_json", p), F.lit("")) for p in ("$.action.query", "$.input.query", "$.query", "$.input.url")), F.lit(""))
    web = F.col("payload_type").isin("web_search_call", "search_results_received") | F.col("tool_name").isin("WebSearch", "WebFetch")
    return events.filter(web).withColumn("web_query", q).orderBy(F.desc("event_ts"), "event_uid").limit(max(1, min(1000, limit)))


def ingest_status(now_ms: int, last_ms: int | None, queue: int | None, errors: int, stale_ms: int = 30_000) -> dict:
    """Three-valued conditions of an ingest process from its last heartbeat."""
    fresh = None if last_ms is None else now_ms - last_ms <= stale_ms
    health = "unknown" if fresh is None else "unhealthy" if not fresh else "degraded" if errors else "healthy"
    return {"health": health, "freshness": {None: "unknown", True: "fresh", False: "stale"}[fresh], "readiness": "unknown" if queue is None else "ready" if fresh and queue == 0 else "catching_up" if fresh else "not_ready"}
