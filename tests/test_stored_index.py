"""The stored index against a rebuild from the documents that hold at the end."""

import math
import re

import pytest
from pyspark.sql import functions as F

from tracelake.operators import stored_index
from tracelake.operators.search import score_documents, query_terms

ROWS = "doc_id long, version long, text string"
WORDS = ["alpha", "beta", "gamma", "delta", "a", "x_1", "seven", "Über"]


def documents(n, version=1, shift=0):
    return [(k, version, " ".join(WORDS[(k * (j + 3) + j * j + shift) % len(WORDS)] for j in range(3 + (k + shift) % 9))) for k in range(n)]


def final(batches):
    held = {}
    for batch in batches:
        best = {}
        for d, v, t in batch:
            if d is not None:
                best[d] = max(best.get(d, (0, "")), (v, t or ""))
        held |= {d: x for d, x in best.items() if d not in held or x[0] > held[d][0]}
    return held


def plain_index(held):
    postings, df, total = set(), {}, []
    for d, (v, t) in held.items():
        found = re.findall("[a-z0-9_]+", t.lower())
        total.append(len(found))
        for term in set(found):
            if 2 <= len(term) <= 64:
                postings.add((term, d, v, len(found), found.count(term)))
                df[term] = df.get(term, 0) + 1
    return postings, df, sum(n > 0 for n in total), sum(total)


def same(index, held):
    postings, df, docs, total = plain_index(held)
    assert {tuple(r) for r in index.postings().select("term", "doc_id", "version", "doc_len", "tf").collect()} == postings
    assert {r.term: r.df for r in index.terms().collect()} == df
    assert (index.docs, index.total_doc_len) == (docs, total)


def plain_search(held, query, limit, min_match):
    postings, df, docs, total = plain_index(held)
    scores = {}
    for term, d, _, n, tf in postings:
        if term in query_terms(query):
            w = max(math.log(1 + (docs - df[term] + 0.5) / (df[term] + 0.5)), 0)
            s, m = scores.get(d, (0.0, 0))
            scores[d] = (s + w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / max(total / docs, 1.0))), m + 1)
    found = [(d, round(s, 6), m) for d, (s, m) in scores.items() if m >= min_match]
    return sorted(found, key=lambda r: (-r[1], r[0]))[:limit]


@pytest.fixture(scope="module")
def batches():
    first = documents(60)
    second = documents(20, 2, 5) + [(3, 3, None), (70, 1, "alpha omega omega"), (None, 1, "lost"), (71, 1, ""), (21, 2, "!!")] + documents(5, 1, 2)  # with stale ones
    third = [(3, 4, "gamma back"), (70, 2, "beta"), (70, 2, "alpha"), (71, 2, "delta delta"), (0, 9, "alpha " * 300)]
    return [first, second, third]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory, batches):
    base = str(tmp_path_factory.mktemp("index"))
    for k, b in enumerate(batches):
        found = stored_index.append(spark.createDataFrame(b, ROWS), base, k, 8)
        same(found, final(batches[: k + 1]))
    return found


def test_replays_and_stale_versions_change_nothing(spark, index, batches):
    again = stored_index.append(spark.createDataFrame(batches[1], ROWS), index.base, 1, 8)
    assert again.last == 2 and len(again.commits) == 3
    same(stored_index.append(spark.createDataFrame(batches[0], ROWS), index.base, 3, 8), final(batches))


def test_a_batch_that_broke_off_is_written_again(spark, tmp_path, batches):
    base = str(tmp_path / "i")
    stored_index.append(spark.createDataFrame(batches[0], ROWS), base, 0, 8)
    spark.createDataFrame([(1, "junk")], "bucket int, term string").write.partitionBy("bucket").parquet(f"{base}/forward/segment=b1")
    assert stored_index.Index(spark, base, 8).last == 0
    same(stored_index.append(spark.createDataFrame(batches[1], ROWS), base, 1, 8), final(batches[:2]))


@pytest.mark.parametrize(("query", "limit", "least"), [("alpha gamma", 5, 1), ("alpha beta gamma delta seven", 7, 2), ("omega", 3, 1), ("alpha alpha ALPHA x_1", 40, 1), ("back seven", 2, 1), ("back seven", 2, 2)])
@pytest.mark.parametrize("prune", [0, 10**9])
def test_search(index, batches, query, limit, least, prune):
    found = [tuple(r) for r in index.search(query, limit, least, prune).collect()]
    want = plain_search(final(batches), query, limit, least)
    assert [r[0] for r in found] == [r[0] for r in want] and [r[2] for r in found] == [r[2] for r in want]
    assert [r[1] for r in found] == pytest.approx([r[1] for r in want], abs=2e-6)


def test_terms_that_cannot_reach_the_page_are_left_out():
    best = {"rare": 9.0, "mid": 2.0, "common": 0.5}
    assert stored_index.needed_terms(list(best), best, 2.6) == ["rare"]
    assert stored_index.needed_terms(list(best), best, 2.5) == ["rare", "mid"]
    assert stored_index.needed_terms(list(best), best, 0.5) == ["rare", "mid", "common"]


def test_unknown_terms_and_an_empty_index(spark, index, tmp_path):
    assert index.search("nowhere").count() == 0 and index.search("a ?").count() == 0
    empty = stored_index.Index(spark, str(tmp_path / "none"), 8)
    assert empty.search("alpha").collect() == [] and (empty.docs, empty.last) == (0, -1)
    none = stored_index.append(spark.createDataFrame([], ROWS), str(tmp_path / "none"), 0, 8)
    assert (none.last, none.docs) == (0, 0)


def test_only_the_terms_buckets_are_read(index):
    plan = index.search("back", prune_rows=10**9)._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan parquet" in x)
    assert "PartitionFilters: [(bucket" in scan.replace("isnotnull(bucket", "(bucket").replace("[bucket", "[(bucket") and "EqualTo(term,back)" in scan
    held = index.table("postings")
    read = index._of_terms(held, ["back"]).select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < len(held.inputFiles())


def test_merge(spark, tmp_path, batches):
    base = str(tmp_path / "m")
    for k, b in enumerate(batches[:2]):
        stored_index.append(spark.createDataFrame(b, ROWS), base, k, 8)
    one = stored_index.merge(spark, base, 8)
    assert len(one.commits) == 1 and one.table("postings").filter("sign < 0").count() == 0
    same(one, final(batches[:2]))
    assert stored_index.merge(spark, base, 8).commits == one.commits
    same(stored_index.append(spark.createDataFrame(batches[2], ROWS), base, 2, 8), final(batches))


def test_a_stream_keeps_the_index(spark, tmp_path, batches):
    base, came = str(tmp_path / "s"), str(tmp_path / "in")
    for k, b in enumerate(batches):
        spark.createDataFrame(b, ROWS).coalesce(1).write.mode("append").parquet(came)
        stream = spark.readStream.schema(ROWS).parquet(came)
        stored_index.follow(stream, base, str(tmp_path / "c"), 8).awaitTermination()
        same(stored_index.Index(spark, base, 8), final(batches[: k + 1]))


def test_equals_a_scan_of_the_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = stored_index.append(docs.select("doc_id", F.lit(1).alias("version"), "text"), str(tmp_path / "d"), 0)
    terms = query_terms("the with erat")
    want = score_documents(docs, terms).orderBy(F.desc("score"), "doc_id").limit(25).select("doc_id", "score", "matched_terms", "text").collect()
    assert sorted(stored_index.with_text(index.search("the with erat"), docs).collect()) == sorted(want)


def test_documents_of_a_bucket_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    """One task a bucket wrote all documents before, and a row for each term of each."""
    monkeypatch.setattr(stored_index, "TASK_DOCS", 10)
    monkeypatch.setattr(stored_index, "TASK_POSTINGS", 50)
    rows = [(k, 1, f"alpha w{k % 7} w{k}") for k in range(200)]
    index = stored_index.append(spark.createDataFrame(rows, ROWS), str(tmp_path / "h"), 0, 2)
    assert index.table("forward").count() == 200 and len(index.table("forward").inputFiles()) == 20
    alpha = index.table("postings").filter("term = 'alpha'").groupBy(F.input_file_name()).count().collect()
    assert len(alpha) == 6 and max(r["count"] for r in alpha) < 60
    same(index, final([rows]))


def test_texts_of_stale_versions_are_not_moved(spark, index, batches):
    held = index.live().withColumnsRenamed({"version": "_old", "doc_len": "_old_len"})
    stale = stored_index._newest(spark.createDataFrame(batches[0], ROWS), held)
    assert stale.count() == 0 and "Exchange" not in stale._jdf.queryExecution().executedPlan().toString()
    tied = [(500, 9, "b"), (500, 9, "c"), (500, 8, "d"), (501, None, "n"), (0, 10, None)]
    found = stored_index._newest(spark.createDataFrame(tied, ROWS), held).select("doc_id", "version", "text").collect()
    assert sorted(map(tuple, found), key=lambda r: r[0]) == [(0, 10, ""), (500, 9, "c"), (501, None, "n")]
