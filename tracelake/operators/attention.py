"""Which sessions touched a path.

Exact touches match the recorded project and repository path; where a tool recorded none, its path tokens are matched by
suffix. Both look at tool requests only, and never at the tool that asks this question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelake.functions.text import ends_with_path
from tracelake.operators.analytics import merge_touches

#: Tools that only read.
READ_TOOLS = ("read", "grep", "glob", "ls", "cat", "view", "search", "read_file", "list_dir")
SCAN_ROWS = 2000
TOUCH = ("session_id", "event_uid", "event_ts", "tool_call_id", "tool_name", "touched_path", "basis")


def asks(self_tool: str = "file_attention") -> Column:
    name = F.lower(F.coalesce("tool_name", F.lit("")))
    return (F.col("tool_phase") == "request") & ~((name == self_tool) | name.endswith("_" + self_tool))


def only_mutations(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.lower("tool_name").isin(*READ_TOOLS))


def exact_touches(events: DataFrame, relative: str, project: str | None = None) -> DataFrame:
    scope = F.col("project_id") == project if project else F.col("project_id") != ""
    rows = events.filter(asks() & scope & (F.col("repo_rel_path") == relative))
    return rows.withColumns({"touched_path": F.col("repo_rel_path"), "basis": F.lit("exact")}).select(*TOUCH)


def suffix_touches(events: DataFrame, relative: str) -> DataFrame:
    """events need path_tokens (functions.text.path_tokens of the tool's input)."""
    hit = F.get(F.filter("path_tokens", lambda p: ends_with_path(p, relative)), F.lit(0))
    rows = events.filter(asks()).withColumn("touched_path", hit).filter("touched_path is not null")
    return rows.withColumn("basis", F.lit("suffix")).select(*TOUCH)


def touches(events: DataFrame, relative: str, project: str | None = None) -> DataFrame:
    """Exact touches, and suffix touches of events without one."""
    return merge_touches(exact_touches(events, relative, project), suffix_touches(events, relative))


def timeline(rows: DataFrame, limit: int = SCAN_ROWS) -> DataFrame:
    """Newest touches first; one more row than `limit` tells that there are more."""
    return rows.orderBy(F.desc("event_ts"), "event_uid").limit(limit + 1)


def roots(rows: DataFrame, relative: str) -> DataFrame:
    """Roots that the touched paths lie under, with counts; ambiguous if there are several."""
    root = F.regexp_replace(F.left("touched_path", F.length("touched_path") - len(relative)), "/$", "")
    per = rows.groupBy(root.alias("root")).agg(F.count(F.lit(1)).alias("touches"), F.min("event_ts").alias("first_touch"), F.max("event_ts").alias("last_touch"))
    total = per.agg(F.count(F.lit(1)).alias("n_roots"))
    return per.crossJoin(F.broadcast(total)).withColumn("ambiguous", F.col("n_roots") > 1).drop("n_roots")
