"""Language identification by interpolated Kneser-Ney character models.

Every training text counts, and every 4-gram of characters (packed as four 16-bit codes) is kept: tasks count, Spark sums by key and
language, and continuation counts of the lower orders are sums over all distinct grams of the next order. Spark then works out,
order by order, the bits of every 4-gram that occurs in any document, in each language. These go to the tasks
as sorted arrays of keys, in parts of at most about `PART_GRAMS` keys, one pass over the documents for each part; a text's entropy is a sum
over its 4-grams, so parts add up; all parts together must fit the driver's and a worker's memory. A language wins by the lowest
cross-entropy per character; a text whose entropy exceeds the limit of its language, a quantile over all training texts,
gets a score below one half.

Defined cases: null text and text without letters give `und` with score 0; without any training row every
text gives `und`; ties go to the first language in order; a null doc_id gives a null held_out, and such a row is not learned from;
very long texts are scored whole, in pieces; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import chunks, cut_lineage, held_out, table

DISCOUNT = 0.75
#: Keys that a pass over the documents looks up; a part is 8 bytes and 4 for each language a key.
PART_GRAMS = 2_000_000
LIMIT_QUANTILE = 0.999
LIMIT_MARGIN = 0.3
UNKNOWN = "und"
#: Code of the two marks before a text, so that one letter already makes a 4-gram.
START = 1


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code of each UTF-16 unit: itself for letters (surrogates count as letters), else a blank."""
    return np.array([i if i == START or chr(i).isalpha() or 0xD800 <= i < 0xE000 else 32 for i in range(1 << 16)], np.uint16)


def encode_chars(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each folded to letters with single blanks around words after two start marks, and offsets (len + 1)."""
    units = [np.frombuffer((2 * chr(START) + "\n" + (t or "").lower() + "\n").encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    sizes = np.array([len(u) for u in units])
    codes = _letters()[np.concatenate(units)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    ends = np.cumsum(sizes)
    keep[np.concatenate(([0], ends[:-1]))] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return codes[keep], kept[np.concatenate(([0], ends))]


def keys4(codes: np.ndarray) -> np.ndarray:
    """Packed 4-grams; position i holds codes i .. i + 3."""
    c = codes.astype(np.uint64)
    if len(c) < 4:
        return np.zeros(0, np.uint64)
    return (c[:-3] << np.uint64(48)) | (c[1:-2] << np.uint64(32)) | (c[2:-1] << np.uint64(16)) | c[3:]


def inside(offsets: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """For 4-grams at 0 .. total - 4: whether one lies in a single text, and the text's number."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return doc[: max(0, total - 3)] == doc[3:], doc[: max(0, total - 3)]


def count_ngrams(docs: DataFrame) -> DataFrame:
    """label, key, n: 4-gram counts over all texts of (label, text); the label may be null."""

    def merged(parts):
        keys = np.concatenate([k for k, _ in parts])
        order = np.argsort(keys)
        at = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        return keys[order][at], np.add.reduceat(np.concatenate([n for _, n in parts])[order], at)

    def count(batches):
        held: dict[str | None, list] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(labels)), key=lambda i: (labels[i] is None, labels[i] or ""))
            for lo, hi in chunks(order, lambda i: len(texts[i] or ""), 1_000_000):
                for label in {labels[i] for i in order[lo:hi]}:
                    codes, offsets = encode_chars([texts[i] for i in order[lo:hi] if labels[i] == label])
                    ok, _ = inside(offsets, len(codes))
                    keys, n = np.unique(keys4(codes)[ok], return_counts=True)
                    if len(keys):
                        parts = held.setdefault(label, [])
                        parts.append((keys, n))
                        if sum(len(k) for k, _ in parts) > 2_000_000:
                            held[label] = [merged(parts)]
        for label, parts in held.items():
            keys, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["label", "key", "n"])

    return docs.select("label", "text").mapInArrow(count, "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))


def _each(langs: list[str], make) -> Column:
    return F.array(*(make(j).cast("double") for j in range(len(langs))))


def _tail(order: int) -> Column:
    """Key of a gram without its first character."""
    return F.col("key").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1))


def _head(order: int) -> Column:
    """Key of a gram without its last character."""
    return F.shiftrightunsigned("key", 16) if order > 1 else F.lit(0).cast("long")


def gram_bits(counts: DataFrame, langs: list[str]) -> DataFrame:
    """key, bits: for each 4-gram counted, under any label or none, its bits in each language; nothing is pruned."""
    at = lambda c, j: F.col(c)[j]
    grams = {4: cut_lineage(counts.groupBy("key").agg(_each(langs, lambda j: F.coalesce(F.sum(F.when(F.col("label") == langs[j], F.col("n"))), F.lit(0))).alias("c")))}
    for order in (4, 3, 2):  # continuation counts: in how many distinct grams of a language a gram is the end
        grams[order - 1] = grams[order].groupBy(_tail(order).alias("key")).agg(_each(langs, lambda j: F.count_if(at("c", j) > 0)).alias("c"))
    letters = max(2, grams[1].filter(F.exists("c", lambda x: x > 0)).count())
    lower = None
    for order in (1, 2, 3, 4):
        heads = grams[order].groupBy(_head(order).alias("head")).agg(_each(langs, lambda j: F.sum(at("c", j))).alias("total"), _each(langs, lambda j: F.count_if(at("c", j) > 0)).alias("types"))
        rows = grams[order].select("key", "c", _head(order).alias("head"), _tail(order).alias("tail")).join(heads, "head")
        rows = rows.withColumn("low", _each(langs, lambda j: F.lit(1.0 / letters))) if lower is None else rows.join(lower.select(F.col("key").alias("tail"), F.col("p").alias("low")), "tail")
        seen = lambda j: (F.greatest(at("c", j) - DISCOUNT, F.lit(0.0)) + DISCOUNT * at("types", j) * at("low", j)) / at("total", j)
        lower = rows.select("key", _each(langs, lambda j: F.when(at("total", j) > 0, seen(j)).otherwise(at("low", j))).alias("p"))
    return cut_lineage(lower.select("key", F.transform("p", lambda x: (-F.log2(x)).cast("float")).alias("bits")))


def languages(docs: DataFrame) -> list[str]:
    return sorted(r[0] for r in docs.select("label").filter("label is not null").distinct().collect())


def fit(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """Languages, and the bits of all 4-grams of (label, text); rows with a null label only say which grams are asked for."""
    counts = cut_lineage(count_ngrams(docs))
    langs = languages(counts)
    return langs, gram_bits(counts, langs) if langs else counts.select("key").withColumn("bits", F.array().cast("array<float>"))


def _part(bits: DataFrame, part: int, parts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of a part, and their bits (keys x languages)."""
    rows = bits.filter(F.pmod(F.xxhash64("key"), F.lit(parts)) == part).select("key", *(F.col("bits")[j].alias(f"b{j}") for j in range(width))).toArrow()
    keys = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.stack([rows.column(f"b{j}").to_numpy()[order] for j in range(width)], 1)


def sums_of(keys: np.ndarray, bits: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of bits in each language over the 4-grams of each text that are among the keys, and the number of all its 4-grams."""
    codes, offsets = encode_chars(texts)
    ok, doc = inside(offsets, len(codes))
    wanted, doc = keys4(codes)[ok], doc[ok]
    n = np.bincount(doc, minlength=len(texts))
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    hit = keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)
    return np.stack([np.bincount(doc[hit], bits[at[hit], j], len(texts)) for j in range(bits.shape[1])], 1), n


def entropies(docs: DataFrame, langs: list[str], bits: DataFrame, part_grams: int = PART_GRAMS) -> DataFrame:
    """doc_id, label, text, lettered, n, sums: characters of each text, and its bits in each language."""
    parts = max(1, -(-bits.count() // part_grams))
    rows = docs.select("doc_id", "label", "text", F.lit(False).alias("lettered"), F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0.0), len(langs)).alias("sums"))
    for k in range(parts):
        shared = docs.sparkSession.sparkContext.broadcast(_part(bits, k, parts, len(langs)))

        def add(batches, shared=shared):
            keys, own = shared.value
            for batch in batches:
                texts = batch.column(2).to_pylist()
                for lo, hi in chunks(texts, lambda t: len(t or ""), 1_000_000):
                    part = batch.slice(lo, hi - lo)
                    found, n = sums_of(keys, own, texts[lo:hi])
                    found = found + np.array(part.column(5).to_pylist(), float).reshape(found.shape)
                    lettered = [bool(t) and any(map(str.isalpha, t)) for t in texts[lo:hi]]
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(lettered), pa.array(n.astype(np.int64)), pa.array(found.tolist(), pa.list_(pa.float64()))], names=part.schema.names)

        rows = rows.mapInArrow(add, rows.schema)
    return rows


def guessed(docs: DataFrame, part_grams: int = PART_GRAMS) -> tuple[DataFrame, int]:
    """doc_id, text and the number of the guessed language of (doc_id, label, text), and how many languages there are, which is the number of none."""
    langs, grams = fit(docs)
    if not langs:
        return docs.select("doc_id", "text", F.lit(0).alias("lang")), 0
    rows = entropies(docs, langs, grams, part_grams)
    first = F.array_position("sums", F.array_min("sums")).cast("int") - 1
    return rows.select("doc_id", "text", F.when(F.col("lettered"), first).otherwise(len(langs)).alias("lang")), len(langs)


def score_all(docs: DataFrame, part_grams: int = PART_GRAMS) -> DataFrame:
    """doc_id, lang_pred, score, bits (a character, of the best language) of (doc_id, label, text); rows with a label train."""
    langs, grams = fit(docs)
    if not langs:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits"))
    rows = entropies(docs, langs, grams, part_grams)
    rows = rows.withColumn("own", F.transform("sums", lambda x: x / F.greatest(F.col("n"), F.lit(1)))).withColumn("bits", F.array_min("own"))
    names = F.array(*map(F.lit, langs))
    odds = F.aggregate(F.transform("own", lambda x: F.pow(F.lit(2.0), -F.least(F.col("n"), F.lit(64)) * (x - F.col("bits")))), F.lit(0.0), lambda a, x: a + x)
    rows = rows.select(
        "doc_id", F.col("label").isNotNull().alias("train"), F.when(F.col("lettered"), F.get(names, F.array_position("own", F.col("bits")).cast("int") - 1)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), 1 / odds).otherwise(0.0).alias("score"), F.when(F.col("lettered"), F.col("bits")).alias("bits"),
    )
    rows = cut_lineage(rows)
    limits = rows.filter("train and bits is not null").groupBy("lang_pred").agg((F.percentile_approx("bits", LIMIT_QUANTILE, 10_000) + LIMIT_MARGIN).alias("limit")).collect()
    limit = F.create_map(*(F.lit(x) for r in limits for x in r)) if limits else F.create_map().cast("map<string, double>")
    over = F.col("bits") > F.coalesce(F.try_element_at(limit, F.col("lang_pred")), F.lit(float("inf")))
    return rows.select("doc_id", "lang_pred", F.when(over, 0.49 * F.col("score")).otherwise(F.col("score")).alias("score"), "bits")


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, label, text: the language where a row may be learned from, else a null label."""
    return docs.select("doc_id", F.when(~held_out(F.col("doc_id")) & F.col("text").isNotNull(), F.col("lang")).alias("label"), "text")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_all(labelled(table(spark, sf_dir, "documents")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")
