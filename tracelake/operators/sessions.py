"""Session listing, scope, labels and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def after_key(time: Column, key: Column, at, last: str, descending: bool = True) -> Column:
    """Keyset predicate of the next page."""
    if descending:
        return (time < F.lit(at)) | ((time == F.lit(at)) & (key < last))
    return (time > F.lit(at)) | ((time == F.lit(at)) & (key > last))


def overlaps(first: Column, last: Column, start, end) -> Column:
    """A session that touches [start, end)."""
    return (last >= F.lit(start)) & (first < F.lit(end))


def list_sessions(summary: DataFrame, limit: int, after: tuple | None = None, start=None, end=None, modes: list[str] | None = None, descending: bool = True, among: dict[str, list[str]] | None = None) -> DataFrame:
    """A page by last_event_time; one row more than `limit` tells that there is another page. `among` names the values that columns of the summary may have."""
    rows = summary
    if start is not None:
        rows = rows.filter(overlaps(F.col("first_event_time"), F.col("last_event_time"), start, end))
    if modes:
        rows = rows.filter(F.col("mode").isin(*modes))
    for column, values in (among or {}).items():
        rows = rows.filter(F.col(column).isin(*values))
    if after:
        rows = rows.filter(after_key(F.col("last_event_time"), F.col("session_id"), *after, descending))
    way = F.desc if descending else F.asc
    return rows.orderBy(way("last_event_time"), way("session_id")).limit(limit + 1)


def latest_non_null(events: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """The latest non-null value of each column by key."""
    at = F.struct(*order)
    return events.groupBy(key).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns))


def sessions_under(events: DataFrame, roots: list[str]) -> DataFrame:
    """Sessions whose first non-empty cwd lies under a root."""
    first = F.min_by(F.when(F.col("cwd") != "", F.col("cwd")), F.when(F.col("cwd") != "", F.struct("event_ts", "event_uid")))
    rows = events.groupBy("session_id").agg(first.alias("origin"))
    fits = F.lit(False)
    for r in roots:
        fits = fits | (F.col("origin") == r) | F.col("origin").startswith(r.rstrip("/") + "/")
    return rows.filter(fits)


def display_label(title: Column, first_user: Column, wire_title: Column, summary: Column, slug: Column, fallback: Column) -> Column:
    """Title, else the first user line (120 characters), else the other names in order."""
    some = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(some(title), F.left(some(F.substring_index(F.trim(first_user), "\n", 1)), F.lit(120)), some(wire_title), some(summary), some(slug), fallback)


#: The columns that an export has if none are named, and those that it has only on request.
DEFAULT_COLUMNS = (
    "session_id", "event_uid", "event_ts", "event_order", "turn_seq", "harness", "source_name", "event_kind", "payload_type", "actor_kind", "tool_name", "tool_phase", "tool_error", "model", "project_id",
)
SENSITIVE = ("source_file", "source_ref", "repo_rel_path", "worktree_root", "cwd", "text_preview", "text_content", "payload_json", "token_usage_json")


def export_columns(trace: DataFrame, names: list[str] | None = None, sensitive: bool = False) -> list[str]:
    """Columns of an export: the default ones that there are (None), all that are not sensitive (["all"]), or the named ones; sensitive ones only on request."""
    if names is None:
        return [c for c in DEFAULT_COLUMNS if c in trace.columns]
    if names == ["all"]:
        return [c for c in trace.columns if c not in SENSITIVE]
    unknown, hidden = [c for c in names if c not in trace.columns], [c for c in names if c in SENSITIVE]
    if not names or unknown or len(set(names)) < len(names):
        raise ValueError(f"columns must be known, each once: {unknown or names}")
    if hidden and not sensitive:
        raise ValueError(f"sensitive columns are exported on request only: {hidden}")
    return names


def export_events(trace: DataFrame, filters: dict[str, list[str]], columns: list[str] | None = None, limit: int | None = None, everything: bool = False, sensitive: bool = False) -> DataFrame:
    """Columns in trace order; filters are OR within a field and AND across fields, and one is needed unless `everything`."""
    if not filters and not everything:
        raise ValueError("a filter is needed")
    commas = {field: v for field, values in filters.items() for v in values if "," in v}
    if commas:
        raise ValueError(f"a filter takes one value each time it is given, not a list with commas: {commas}")
    rows = trace
    for field, values in filters.items():
        rows = rows.filter(F.col(field).isin(*values))
    rows = rows.orderBy("session_id", "event_order").select(*export_columns(trace, columns, sensitive))
    return rows.limit(limit) if limit is not None else rows


def preview(df: DataFrame, limit: int) -> DataFrame:
    """The first rows by all columns, 1 to 500 of them."""
    return df.orderBy(*df.columns).limit(max(1, min(500, limit)))


#: Most roots that are broadcast; more are joined by a shuffle.
BROADCAST_ROOTS = 200_000


def longest_root(df: DataFrame, path: str, roots: DataFrame) -> DataFrame:
    """df with the longest of the roots (root, and further columns) that holds its path, nulls if none does.

    A path lies under each of its ancestors, so the distinct paths' ancestors are joined to the roots by equality: no row meets a root that
    does not hold it. Of equal roots (slashes at the end do not count), the least of the further columns is taken.
    """
    more = [c for c in roots.columns if c != "root"]
    plain = lambda c: F.when(F.rtrim(F.col(c), F.lit("/")) == "", "/").otherwise(F.rtrim(F.col(c), F.lit("/")))
    own = roots.filter("root <> ''").withColumn("_at", plain("root")).groupBy("_at").agg(F.min(F.struct("root", *more)).alias("_r"))
    few = own.limit(BROADCAST_ROOTS + 1).count() <= BROADCAST_ROOTS
    paths = df.select(F.col(path).alias("_path")).filter("_path <> ''").distinct()
    parts = F.split(F.rtrim(F.col("_path"), F.lit("/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = paths.select("_path", F.explode(F.array_distinct(F.transform(above, lambda a: F.when(a == "", "/").otherwise(a)))).alias("_at"))
    held = steps.join(F.broadcast(own) if few else own, "_at").groupBy("_path").agg(F.max_by("_r", F.length("_at")).alias("_r"))
    rows = df.join(held, df[path] == held["_path"], "left")
    return rows.select(*(df[c] for c in df.columns), "_r.*")
