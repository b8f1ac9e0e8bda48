"""Sinks: append, routed tee, JSON lines, JSON merge."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.operators.sessions import longest_root


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def route(events: DataFrame, roots: dict[str, str], default: str) -> DataFrame:
    """events with the backend of their session's first non-empty cwd: the longest root that holds it."""
    table = events.sparkSession.createDataFrame(list(roots.items()), "root string, backend string")
    first = events.groupBy("session_id").agg(F.min_by(F.when(F.col("cwd") != "", F.col("cwd")), F.when(F.col("cwd") != "", F.struct("event_ts", "event_uid"))).alias("_origin"))
    found = longest_root(first, "_origin", table)
    return events.join(found.select("session_id", F.coalesce("backend", F.lit(default)).alias("backend")), "session_id")


def tee(routed: DataFrame, paths: dict[str, str]) -> None:
    for backend, path in paths.items():
        append(routed.filter(F.col("backend") == backend).drop("backend"), path)


def export_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


@F.pandas_udf(T.StringType())
def merge_json(base: pd.Series, patch: pd.Series) -> pd.Series:
    """JSON merge patch: null deletes, objects merge, anything else replaces. A broken text counts as {}."""
    def load(s):
        try:
            return json.loads(s)
        except (TypeError, ValueError):
            return {}

    def merge(a, b):
        if not isinstance(b, dict):
            return b
        out = dict(a) if isinstance(a, dict) else {}
        for k, v in b.items():
            if v is None:
                out.pop(k, None)
            else:
                out[k] = merge(out.get(k), v)
        return out

    return pd.Series([json.dumps(merge(load(a), load(b)), separators=(",", ":"), sort_keys=True, ensure_ascii=False) for a, b in zip(base, patch, strict=True)])


def fold_tools(events: DataFrame, tools: DataFrame) -> DataFrame:
    """Tool inputs and outputs folded into their event's JSON under tool_io."""
    io: Column = F.to_json(F.struct(F.struct("input_json", "output_text", "tool_error").alias("tool_io")))
    rows = tools.select("session_id", "event_uid", io.alias("_io"))
    joined = events.join(rows, ["session_id", "event_uid"], "left")
    return joined.withColumn("payload_json", F.when(F.col("_io").isNotNull(), merge_json("payload_json", "_io")).otherwise(F.col("payload_json"))).drop("_io")
