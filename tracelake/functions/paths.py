"""Lexical paths and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Analytics ranges as (seconds, bucket seconds).
RANGES = {"15m": (900, 60), "1h": (3600, 60), "6h": (21_600, 300), "24h": (86_400, 900), "7d": (604_800, 3600), "30d": (2_592_000, 86_400)}


def normal_path(path: Column) -> Column:
    """A path without empty, `.` and resolvable `..` parts; a leading slash stays."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        parts, empty,
        lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit("..")) != ".."), F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when((p == "..") & path.startswith("/"), done).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def analytics_window(events: DataFrame, now, name: str = "24h") -> DataFrame:
    """One row: scan_start, scan_end (now), display_end (the last event in between, else now) and bucket_seconds."""
    seconds, bucket = RANGES[name]
    end = F.lit(now).cast("timestamp")
    start = end - F.expr(f"INTERVAL {seconds} SECONDS")
    ts = F.col("event_ts").cast("timestamp")
    last = F.max(F.when((ts >= start) & (ts <= end), ts))
    return events.agg(last.alias("_l")).select(start.alias("scan_start"), end.alias("scan_end"), F.coalesce("_l", end).alias("display_end"), F.lit(bucket).alias("bucket_seconds"))
