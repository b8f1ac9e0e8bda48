"""What physical plans must look like, with broadcasts off, and joins of paths to roots."""

import pytest
from pyspark.sql import functions as F

from tracelake.operators import search, sessions, trace
from tracelake.plans.canonical import activity_events


@pytest.fixture
def no_broadcast(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_wide_rows_of_a_trace_are_exchanged_once(spark, sf, no_broadcast):
    lines = plan(trace.conversation_trace(activity_events(spark, sf))).splitlines()
    below = [lines[k + 1] for k, x in enumerate(lines) if "Exchange hashpartitioning" in x]
    assert sum("token_usage_buckets" in x for x in below) == 1


def test_search_takes_a_text_apart_once_a_scan(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    terms = search.query_terms("the with erat des les und que the")
    found = plan(search.score_documents(docs, terms))
    assert found.count("regexp_extract_all") == found.count("FileScan") == 2


@pytest.mark.parametrize("most", [200_000, 0])
def test_longest_root(spark, monkeypatch, most):
    monkeypatch.setattr(sessions, "BROADCAST_ROOTS", most)
    roots = [("/", "top"), ("/w", "w"), ("/w/a/", "a"), ("/w/a", "b"), ("/w/a/b/c", "deep"), ("", "none"), ("rel", "r")]
    paths = ["/w/a/b", "/w/ab", "/w/a/b/c", "/w/a/b/c/", "/x", "/", "", None, "rel/x", "other", "/w/a", "/w"]
    df = spark.createDataFrame(list(enumerate(paths)), "k int, path string")
    found = {paths[r.k]: r.name for r in sessions.longest_root(df, "path", spark.createDataFrame(roots, "root string, name string")).collect()}
    assert found == {"/w/a/b": "b", "/w/ab": "w", "/w/a/b/c": "deep", "/w/a/b/c/": "deep", "/x": "top", "/": "top", "": None, None: None, "rel/x": "r", "other": None, "/w/a": "b", "/w": "w"}


def test_many_roots_without_a_cross_join(spark, no_broadcast):
    roots = spark.range(100_000).select(F.concat(F.lit("/r/"), (F.col("id") % 300).cast("string"), F.lit("/"), F.col("id").cast("string")).alias("root"))
    paths = spark.range(2_000).select("id", F.concat(F.lit("/r/"), (F.col("id") % 300).cast("string"), F.lit("/"), F.col("id").cast("string"), F.lit("/src/x.py")).alias("path"))
    df = sessions.longest_root(paths, "path", roots)
    assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)
    assert df.filter("path = root || '/src/x.py'").count() == 2_000


def test_filters_with_commas_are_refused(spark):
    df = spark.createDataFrame([("s", 1)], "session_id string, event_order int")
    with pytest.raises(ValueError, match="commas"):
        sessions.export_events(df, {"session_id": ["a,b"]}, ["session_id"])
