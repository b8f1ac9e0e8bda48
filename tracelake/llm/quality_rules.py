"""Quality rules: base statistics of a text and a hashed n-gram log-likelihood ratio.

The score of a text is the mean, over its words and word pairs, of
log p_target(bucket) - log p_raw(bucket), where the n-grams fall into hash buckets, the target
multinomial counts the labelled good documents and the raw one counts all documents. All work is
done by built-in functions.

Defined cases: a null or empty text has no words, so it fails the base rule; with no labelled
documents every ratio is 0 and only the base rule decides; repeated document ids are judged row by row;
extra columns of any name are carried along, for the result is one struct column with a free name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import SEPARATORS, free_name, literal_doubles, settle, small_join, table, words_of

BUCKETS = 1 << 15
SMOOTHING = 1.0
THRESHOLD = -0.1
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _after(a: Column, n: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(n - by, F.lit(0)))


def pair_hashes(words: Column) -> Column:
    """Hash of each pair of neighbouring words; `words` must be a column."""
    n = F.size(words)
    return F.zip_with(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), _after(words, n, 1), lambda a, b: F.xxhash64(a, b))


def base_columns(text: Column, words: Column, pairs: Column) -> dict[str, Column]:
    """Base statistics of the contract; `words` and `pairs` must be columns."""
    n = F.size(words)
    heads = F.slice(pairs, F.lit(1), F.greatest(n - 2, F.lit(0)))
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dropped = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    return {
        "n_words": n.cast("long"),
        "word_chars": (F.length(text) - dropped(BLANKS)).cast("long"),
        "n_symbols": dropped(SYMBOLS).cast("long"),
        "lines": lines,
        "triples": F.zip_with(heads, _after(words, n, 2), lambda h, c: F.xxhash64(h, c)),
    }


def repeated_hashes(triples: Column) -> Column:
    """The window hashes that occur at least twice, each once; `triples` must be a column."""
    n = F.size(triples)
    order = F.sort_array(triples)
    twice = F.zip_with(F.slice(order, F.lit(1), F.greatest(n - 1, F.lit(0))), _after(order, n, 1), lambda a, b: F.when(a == b, a))
    return F.array_distinct(F.array_compact(twice))


#: Up to so many repeated windows are looked up one by one; more are found by sorting windows with their places.
FEW_REPEATS = 24


def repeated_words(triples: Column, again: Column) -> Column:
    """Number of words inside windows found at least twice; both arguments must be columns."""
    n = F.size(triples)
    looked_up = F.array_compact(F.transform(triples, lambda h, i: F.when(F.array_contains(again, h), i)))
    order = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    keys, places = order.getField("h"), order.getField("i")
    same = F.zip_with(F.slice(keys, F.lit(1), F.greatest(n - 1, F.lit(0))), _after(keys, n, 1), lambda a, b: a == b)
    either = F.zip_with(F.concat(F.array(F.lit(False)), same), F.concat(same, F.array(F.lit(False))), lambda a, b: a | b)
    in_order = F.array_compact(F.zip_with(places, either, lambda p, r: F.when(r, p)))
    covered = lambda hit: F.size(F.array_distinct(F.flatten(F.transform(hit, lambda p: F.array(p, p + 1, p + 2)))))
    return F.when(F.size(again) == 0, F.lit(0)).when(F.size(again) <= FEW_REPEATS, covered(looked_up)).otherwise(covered(in_order)).cast("long")


def fit_ratio(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of each bucket from counts over all documents; `buckets` bounds what reaches the driver."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_id")).distinct().withColumn("_good", F.lit(1))
    rows = docs.select(F.col("doc_id").alias("_id"), words_of(F.col("text")).alias("_w"))
    rows = small_join(rows, good, "_id")
    following = _after(F.col("_w"), F.size("_w"), 1)
    grams = rows.select("_good", F.inline(F.arrays_zip(F.col("_w").alias("one"), following.alias("two"))))
    in_bucket = lambda h: F.pmod(h, F.lit(buckets)).cast("int")
    pair = F.when(F.col("two").isNotNull(), in_bucket(F.xxhash64("one", "two")))
    counts = (
        grams.select("_good", F.explode(F.array(in_bucket(F.xxhash64("one")), pair)).alias("b")).filter("b is not null")
        .groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.count("_good").alias("target"))
    )
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counts.collect():
        raw[b], target[b] = r, t
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets))


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> tuple[DataFrame, str]:
    """docs with one more struct column, and its name: the statistics, score, base_failed and kept."""
    ratio = literal_doubles(fit_ratio(docs, labels, buckets))
    names = [free_name(docs, x) for x in ("_quality", "_words", "_pairs", "_base", "_triples", "_again")]
    name, w, p, b, t, again = names
    rows = docs.withColumn(w, words_of(F.col("text")))
    rows = rows.withColumn(p, pair_hashes(F.col(w)))
    base = base_columns(F.col("text"), F.col(w), F.col(p))
    rows = rows.withColumns({b: F.struct(*[c.alias(k) for k, c in base.items() if k != "triples"]), t: base["triples"]})
    rows = rows.withColumn(again, repeated_hashes(F.col(t)))
    x = F.col(b)
    at = lambda h: F.get(ratio, F.pmod(h, F.lit(buckets)).cast("int"))
    total = F.aggregate(F.col(w), F.lit(0.0), lambda a, g: a + at(F.xxhash64(g))) + F.aggregate(F.col(p), F.lit(0.0), lambda a, h: a + at(h))
    n_grams = F.size(w) + F.size(p)
    stats = F.struct(
        x["n_words"].alias("n_words"), x["word_chars"].alias("word_chars"), x["n_symbols"].alias("n_symbols"),
        (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"]))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col(t), F.col(again)).alias("n_repeat_words"),
        F.coalesce(total / F.nullif(n_grams.cast("double"), F.lit(0.0)), F.lit(0.0)).alias("score"),
    )
    rows = rows.withColumn(b, stats)
    failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
    out = F.struct(x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], failed.alias("base_failed"), x["score"], (~failed & (x["score"] >= threshold)).alias("kept"))
    return settle(rows, name, out, names[1:]), name


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, q = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", f"{q}.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    rows, q = judge(docs, table(spark, sf_dir, "labels"))
    return rows.filter(F.col(q)["kept"]).drop(q)


__all__ = ["SEPARATORS", "fit_ratio", "judge", "keep_good", "op2_quality_rules"]
