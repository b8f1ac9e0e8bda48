"""An inverted index in Parquet that follows its documents.

A batch of documents becomes a segment: what it adds has sign +1, what it takes back of older versions has sign -1, and every view
(postings, document frequencies, totals) is a sum over segments. Under a base folder, each table with a folder for each segment:

* `postings`: bucket, term, doc_id, version, doc_len, tf, sign; a bucket (of the term) is a folder, files are sorted by term
* `terms`: bucket, term, df (signed), max_tf and min_len (of what was added)
* `forward`: bucket (of the document), doc_id, version, doc_len, terms (array of term, tf); a row for each document
* `locator`: bucket, doc_id, version, doc_len
* `commits`: batch, merged, types of the keys, docs, total_doc_len (signed); written last, so that a segment without it is not read

A batch is numbered by who calls, as `foreachBatch` does. A number that is committed changes nothing; one that broke off is written again from the
same earlier segments. Of a document, the highest version holds, of equal ones the greatest text, and a version not above the stored one is passed
over. A null or empty text withdraws a document: it stays in the locator and has no postings.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions.text import MAX_TERM, MIN_TERM, TOKEN
from tracelake.operators.search import B, K1, bm25, query_terms

#: Columns beside bucket and segment, which are folders; doc_id and version have the types of the first batch.
TABLES = {
    "postings": "term string, doc_id {0}, version {1}, doc_len long, tf long, sign long", "terms": "term string, df long, max_tf long, min_len long",
    "forward": "doc_id {0}, version {1}, doc_len long, terms array<struct<term:string,tf:long>>", "locator": "doc_id {0}, version {1}, doc_len long",
}
#: One folder each: 64 for some GB of text, thousands for some TB. A batch's tasks follow from its rows.
BUCKETS = 64
#: Documents and postings that a task writes, of some thousand words and some dozen bytes each.
TASK_DOCS, TASK_POSTINGS = 10_000, 1_000_000
#: Documents of a batch whose keys are broadcast to find their texts; beyond it the texts are shuffled.
BROADCAST_ROWS = 500_000
_TOKENS = re.compile(TOKEN.encode()).findall
COUNTED = "struct<doc_len:long,terms:array<struct<term:string,tf:long>>>"
#: Postings beyond the first terms' that make it worth a job to find the score which a page's last hit has at least.
PRUNE_ROWS = 100_000
DOC = ["doc_id", "version"]
COMMIT = "batch long, merged boolean, id_type string, version_type string, docs long, total_doc_len long"


def bucket_of(c: Column, buckets: int) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % buckets).cast("int")


def bucket_of_term(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode()) % buckets


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _read(spark: SparkSession, name: str, types: tuple[str, str], *paths: str) -> DataFrame:
    return spark.read.schema(TABLES[name].format(*types) + ", bucket int").option("basePath", os.path.dirname(paths[0])).parquet(*paths).drop("segment")


def _segment(batch: int, merged: bool) -> str:
    return f"segment={'m' if merged else 'b'}{batch}"


class Index:
    """The committed state of an index, as of when it was opened."""

    def __init__(self, spark: SparkSession, base: str, buckets: int = BUCKETS):
        self.spark, self.base, self.buckets, self._tables = spark, base, buckets, {}
        rows = spark.read.schema(COMMIT).parquet(f"{base}/commits").collect() if _exists(spark, f"{base}/commits") else []  # a row for each segment
        upto = max((r.batch for r in rows if r.merged), default=-1)
        self.commits = [r for r in rows if (r.batch == upto if r.merged else r.batch > upto)]
        self.last = max((r.batch for r in rows), default=-1)
        self.docs, self.total_doc_len = sum(r.docs for r in self.commits), sum(r.total_doc_len for r in self.commits)

    def table(self, name: str) -> DataFrame:
        """Rows of the live segments; the listing of files is made once."""
        if name not in self._tables:
            paths = [f"{self.base}/{name}/{_segment(r.batch, r.merged)}" for r in self.commits]
            self._tables[name] = _read(self.spark, name, self.types, *paths)
        return self._tables[name]

    @property
    def types(self) -> tuple[str, str]:
        return self.commits[0].id_type, self.commits[0].version_type

    def live(self) -> DataFrame:
        """bucket, doc_id, version, doc_len of the stored version of every document."""
        held = self.table("locator").groupBy("bucket", "doc_id").agg(F.max(F.struct("version", "doc_len")).alias("_v"))
        return held.select("bucket", "doc_id", "_v.version", "_v.doc_len")

    def postings(self) -> DataFrame:
        """The view of postings: those of live versions."""
        rows = self.table("postings").groupBy("bucket", "term", *DOC).agg(F.max("doc_len").alias("doc_len"), F.max("tf").alias("tf"), F.sum("sign").alias("_n"))
        return rows.filter("_n > 0").drop("_n")

    def terms(self) -> DataFrame:
        """The view of frequencies: term, df, and bounds of tf and doc_len among all versions since the last merge."""
        rows = self.table("terms").groupBy("bucket", "term").agg(F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_len").alias("min_len"))
        return rows.filter("df > 0")

    def _of_terms(self, rows: DataFrame, terms: list[str]) -> DataFrame:
        return rows.filter(F.col("bucket").isin(sorted({bucket_of_term(t, self.buckets) for t in terms})) & F.col("term").isin(terms))

    def search(self, query: str, limit: int = 25, min_match: int = 1, prune_rows: int = PRUNE_ROWS) -> DataFrame:
        """doc_id, score, matched_terms of the best documents: score descending, then doc_id.

        Only the terms' buckets are read. A term's frequency and its highest possible score are looked up first (at most
        MAX_QUERY_TERMS rows). Where the common terms have more than prune_rows postings, the score of the limit-th best document by rare terms
        alone is found, and common terms that cannot lift a document to it by themselves are scored for documents of the other terms only.
        """
        terms = query_terms(query)
        known = self._of_terms(self.terms(), terms).collect() if terms and self.commits else []
        if not known:
            return self.spark.range(0).select(F.col("id").cast(self.types[0] if self.commits else "long").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched_terms"))
        mean = max(self.total_doc_len / self.docs, 1.0)
        weight = {r.term: max(math.log(1 + (max(self.docs, r.df) - r.df + 0.5) / (r.df + 0.5)), 0.0) for r in known}
        best = {r.term: weight[r.term] * r.max_tf * (K1 + 1) / (r.max_tf + K1 * (1 - B + B * r.min_len / mean)) for r in known}
        df = {r.term: r.df for r in known}
        order = sorted(best, key=lambda t: (-best[t], t))
        part = F.element_at(F.create_map(*(F.lit(x) for t in order for x in (t, weight[t]))), F.col("term")) * bm25(F.col("tf"), F.col("doc_len"), F.lit(mean))

        def scored(rows: DataFrame) -> DataFrame:
            sums = rows.groupBy(*DOC).agg(F.sum(F.when(F.col("sign") > 0, part).otherwise(0.0)).alias("_s"), F.sum("sign").cast("long").alias("matched_terms"))
            return sums.filter(F.col("matched_terms") >= max(min_match, 1)).select("doc_id", F.round("_s", 6).alias("score"), "matched_terms")

        rows = self._of_terms(self.table("postings"), order)
        first = 1
        while first < len(order) and sum(df[t] for t in order[:first]) < limit:
            first += 1
        if sum(df[t] for t in order[first:]) > prune_rows:
            page = scored(self._of_terms(self.table("postings"), order[:first])).orderBy(F.desc("score")).limit(limit)
            bound = page.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
            needed = order if bound.n < limit else needed_terms(order, best, bound.least)
            if len(needed) < len(order):
                found = self._of_terms(self.table("postings"), needed).select(*DOC)
                others = self._of_terms(self.table("postings"), order[len(needed):]).join(found, DOC, "left_semi")
                rows = self._of_terms(self.table("postings"), needed).unionByName(others)
        return scored(rows).orderBy(F.desc("score"), "doc_id").limit(limit)


def needed_terms(order: list[str], best: dict[str, float], least: float) -> list[str]:
    """The terms (highest possible score first) of which a document must have one to reach `least`; the rest add up to less, rounding allowed for."""
    rest, cut = 0.0, len(order)
    while cut > 1 and rest + best[order[cut - 1]] < least - 2e-6:
        cut -= 1
        rest += best[order[cut]]
    return order[:cut]


def _counted(texts: pa.Array) -> pa.Array:
    """Number of tokens, and the distinct indexed terms with their uses, of lower-cased texts as UTF-8, as `functions.text.tokens` and `term_is_indexed` tell them."""
    lengths, ends, terms, uses = [], [0], [], []
    for x in texts:
        found = _TOKENS(x.as_py() or b"")
        held = {t: n for t, n in Counter(found).items() if MIN_TERM <= len(t) <= MAX_TERM}
        lengths.append(len(found))
        terms += held
        uses += held.values()
        ends.append(len(terms))
    pairs = pa.StructArray.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(uses, pa.int64())], names=["term", "tf"])
    return pa.StructArray.from_arrays([pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["doc_len", "terms"])


def _newest(docs: DataFrame, held: DataFrame | None) -> DataFrame:
    """doc_id, version, text of the documents that a batch changes.

    Keys alone are compared first, so that texts of stale versions are not moved, and no text is if every document comes once and is new.
    """
    given = docs.filter("doc_id IS NOT NULL").select(*DOC, F.coalesce("text", F.lit("")).alias("text"))
    keys = given.groupBy("doc_id").agg(F.max("version").alias("version"), F.count(F.lit(1)).alias("_rows"))
    if held is not None:
        keys = keys.join(held.select("doc_id", "_old"), "doc_id", "left").filter("_old IS NULL OR version > _old").drop("_old")
    keys = keys.withColumnsRenamed({"doc_id": "_id", "version": "_new"})
    fresh, rows = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    if not fresh:
        return given.limit(0)
    if held is None and fresh == rows:  # of the whole batch
        return given
    side = F.broadcast(keys) if fresh <= BROADCAST_ROWS else keys
    own = given.join(side, (F.col("doc_id") == F.col("_id")) & F.col("version").eqNullSafe(F.col("_new")))
    if fresh == rows:
        return own.select(*DOC, "text")
    once = own.filter("_rows = 1").select(*DOC, "text")  # several rows of a document: of its highest version, the greatest text
    return once.unionByName(own.filter("_rows > 1").groupBy(*DOC).agg(F.max("text").alias("text")))


def _dealt(rows: DataFrame, n: int, buckets: int, most: int) -> DataFrame:
    """Rows by bucket, and by document where a bucket has more than `most` of them, so that no task grows with the batch or with a frequent term."""
    parts = max(1, -(-n // (buckets * most)))
    return rows.repartitionById(buckets * parts, (F.col("bucket") * parts + F.pmod(F.xxhash64("doc_id"), F.lit(parts))).cast("int"))


def append(docs: DataFrame, base: str, batch: int, buckets: int = BUCKETS) -> Index:
    """Take a batch of (doc_id, version, text) into the index and give the index after it."""
    spark = docs.sparkSession
    before = Index(spark, base, buckets)
    if batch <= before.last:
        return before
    to = {t: f"{base}/{t}/{_segment(batch, False)}" for t in (*TABLES, "commits")}
    types = (docs.schema["doc_id"].dataType.simpleString(), docs.schema["version"].dataType.simpleString())
    held = before.live().withColumnsRenamed({"version": "_old", "doc_len": "_old_len"}) if before.commits else None
    new = _newest(docs, held)
    words = new.select(bucket_of(F.col("doc_id"), buckets).alias("bucket"), *DOC, F.arrow_udf(_counted, COUNTED)(F.lower("text").cast("binary")).alias("_c")).select("bucket", *DOC, "_c.doc_len", "_c.terms")
    _write(_dealt(words, new.select("doc_id").count(), buckets, TASK_DOCS), to["forward"], "bucket", "doc_id")
    added = _read(spark, "forward", types, to["forward"])
    _write(added.select("bucket", *DOC, "doc_len").repartition("bucket"), to["locator"], "bucket", "doc_id")
    located = _read(spark, "locator", types, to["locator"])
    signed = added.withColumn("sign", F.lit(1).cast("long"))
    gone = located.select("bucket", "doc_id").join(held, ["bucket", "doc_id"]).select("bucket", "doc_id", F.col("_old").alias("version"), F.col("_old_len").alias("doc_len")) if held is not None else located.limit(0)
    if before.commits:
        old = before.table("forward").join(gone.select("bucket", *DOC), ["bucket", *DOC], "left_semi")
        signed = signed.unionByName(old.withColumn("sign", F.lit(-1).cast("long")))
    _write_postings(signed, to["postings"], buckets)
    plus = F.col("sign") > 0
    per_term = _read(spark, "postings", types, to["postings"]).groupBy("bucket", "term").agg(F.sum("sign").alias("df"), F.max(F.when(plus, F.col("tf"))).alias("max_tf"), F.min(F.when(plus, F.col("doc_len"))).alias("min_len"))
    _write(per_term.repartition("bucket"), to["terms"], "bucket", "term")
    change = located.select("doc_len", F.lit(1).alias("sign")).unionByName(gone.select("doc_len", F.lit(-1).alias("sign"))).filter("doc_len > 0")
    _commit(change, to["commits"], batch, False, types)
    return Index(spark, base, buckets)


def _write_postings(signed: DataFrame, path: str, buckets: int) -> None:
    n = signed.agg(F.sum(F.size("terms").cast("long"))).first()[0] or 0
    rows = signed.select(*DOC, "doc_len", "sign", F.explode("terms").alias("_t")).select(F.col("_t.term").alias("term"), *DOC, "doc_len", F.col("_t.tf").alias("tf"), "sign")
    _write(_dealt(rows.withColumn("bucket", bucket_of(F.col("term"), buckets)), n, buckets, TASK_POSTINGS), path, "bucket", "term", "doc_id")


def _write(rows: DataFrame, path: str, *order: str) -> None:
    rows.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(path)


def _commit(change: DataFrame, path: str, batch: int, merged: bool, types: tuple[str, str]) -> None:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    change.agg(total(F.col("sign")).alias("docs"), total(F.col("sign") * F.col("doc_len")).alias("total_doc_len")).select(
        F.lit(batch).cast("long").alias("batch"), F.lit(merged).alias("merged"), F.lit(types[0]).alias("id_type"), F.lit(types[1]).alias("version_type"), "docs", "total_doc_len").coalesce(1).write.mode("overwrite").parquet(path)


def merge(spark: SparkSession, base: str, buckets: int = BUCKETS) -> Index:
    """One segment in place of all: what was taken back goes, bounds are exact again. The files of merged segments stay for readers that opened them."""
    now = Index(spark, base, buckets)
    if not now.commits or (len(now.commits) == 1 and now.commits[0].merged):
        return now
    to = {t: f"{base}/{t}/{_segment(now.last, True)}" for t in (*TABLES, "commits")}
    _write(now.live().repartition("bucket"), to["locator"], "bucket", "doc_id")
    located = _read(spark, "locator", now.types, to["locator"])
    live = now.table("forward").join(located.select("bucket", *DOC), ["bucket", *DOC], "left_semi")
    _write(_dealt(live, located.count(), buckets, TASK_DOCS), to["forward"], "bucket", "doc_id")
    _write_postings(_read(spark, "forward", now.types, to["forward"]).withColumn("sign", F.lit(1).cast("long")), to["postings"], buckets)
    per_term = _read(spark, "postings", now.types, to["postings"]).groupBy("bucket", "term").agg(F.sum("sign").alias("df"), F.max("tf").alias("max_tf"), F.min("doc_len").alias("min_len"))
    _write(per_term.repartition("bucket"), to["terms"], "bucket", "term")
    _commit(located.filter("doc_len > 0").withColumn("sign", F.lit(1)), to["commits"], now.last, True, now.types)
    return Index(spark, base, buckets)


def follow(docs: DataFrame, base: str, checkpoint: str, buckets: int = BUCKETS, once: bool = True) -> StreamingQuery:
    """Keep an index of a stream of (doc_id, version, text)."""
    writer = docs.writeStream.foreachBatch(lambda df, k: append(df, base, k, buckets) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()


def with_text(hits: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A page of hits with their texts, looked up by id so that blocks of other ids are passed over."""
    page = hits.collect()  # at most a page
    found = docs.filter(F.col(doc_id).isin([r.doc_id for r in page])).select(F.col(doc_id).alias("doc_id"), text)
    return found.join(F.broadcast(docs.sparkSession.createDataFrame(page, hits.schema)), "doc_id").select(*hits.columns, text)
