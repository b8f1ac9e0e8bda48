"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every word triple of an item is a seed, however frequent it is in the corpus, so a widely copied item loses none. One pass
finds seeds in each text, forms windows around those of one item that lie close together, and aligns the item with the window
word by word; the score is the alignment's share of the score of a full copy. Windows whose words cannot reach the
threshold in any order are passed over (`reach`), which loses no match. Texts stay in their partitions; nothing is shuffled.
The benchmark is held by every task in blocks of at most `BLOCK_ITEMS` items, one pass for each.

Words are lower-cased, and ASCII punctuation parts them. Defined cases: null and empty texts match nothing; items of
under three words are matched by one seed of all their words; null items are skipped; equal items all match;
an empty benchmark matches nothing; very long texts are read whole; repeated rows are judged each; extra columns of
any name are carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import chunks, free_name, mix64, table, word_hashes

SEED_WORDS = 3
MIN_SEEDS = 2
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK_ITEMS = 50_000
_PUNCTUATION = {ord(c): " " for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"}


def text_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and offsets (len + 1)."""
    h, _, _, offsets, _ = word_hashes([(t or "").lower().translate(_PUNCTUATION).encode("utf-8", "replace") for t in texts])
    return h, offsets


def triples(words: np.ndarray, n: int = SEED_WORDS) -> np.ndarray:
    """Hash of the n words from each position."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return out


@dataclass
class Items:
    """Benchmark items, and an index from the sorted hashes of seeds to items."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    item: np.ndarray
    needed: np.ndarray


def index_items(ids: list, texts: list[str]) -> Items:
    h, offsets = text_words(texts)
    words = [h[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    hashes, item, needed = [], [], np.ones(len(ids), np.int64)
    for k, w in enumerate(words):
        t = np.unique(triples(w, min(SEED_WORDS, len(w)))) if len(w) else np.zeros(0, np.uint64)
        needed[k] = min(MIN_SEEDS, len(t))
        hashes.append(t)
        item.append(np.full(len(t), k))
    hashes, item = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hashes, item))
    order = np.argsort(hashes, kind="stable")
    seeds, first = np.unique(hashes[order], return_index=True)
    return Items(ids, words, seeds.astype(np.uint64), np.append(first, len(order)), item[order], needed)


def reach(words: np.ndarray, others: np.ndarray) -> int:
    """At least the score of any alignment of two word sequences: a word that the other has not costs one where it lies inside."""
    total = np.concatenate(([0], np.cumsum(np.where(np.isin(words, others), MATCH, GAP))))
    return int((total - np.minimum.accumulate(total)).max())


def align(item: np.ndarray, window: np.ndarray) -> int:
    """Best Smith-Waterman score of local alignments of two word sequences, row by row."""
    steps = np.arange(len(window) + 1) * -GAP
    above, best = np.zeros(len(window) + 1, np.int64), 0
    for w in item:
        here = np.zeros_like(above)
        np.maximum(above[:-1] + np.where(window == w, MATCH, MISMATCH), above[1:] + GAP, out=here[1:])
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + steps) - steps
        best = max(best, int(here.max()))
        above = here
    return best


def hits_of(items: Items, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of seeds in the words of several texts, the seeds' numbers, and the texts' numbers."""
    positions, seeds = [], []
    for n in {min(SEED_WORDS, len(w)) for w in items.words if len(w)}:
        t = triples(words, n)
        if not len(t) or not len(items.seeds):
            continue
        at = np.minimum(np.searchsorted(items.seeds, t), len(items.seeds) - 1)
        found = np.flatnonzero(items.seeds[at] == t)
        found = found[np.searchsorted(offsets, found, side="right") == np.searchsorted(offsets, found + n - 1, side="right")]
        positions.append(found)
        seeds.append(at[found])
    if not positions:
        return (np.zeros(0, np.int64),) * 3
    positions, seeds = np.concatenate(positions), np.concatenate(seeds)
    order = np.argsort(positions, kind="stable")
    return positions[order], seeds[order], np.searchsorted(offsets, positions[order], side="right") - 1


def matches(items: Items, words: np.ndarray, positions: np.ndarray, seeds: np.ndarray, memory: dict) -> list[tuple[int, float]]:
    """(item, score) of every item that aligns well enough with one text."""
    kinds, kind = np.unique(seeds, return_inverse=True)
    n = items.first[kinds + 1] - items.first[kinds]
    owner = items.item[np.arange(n.sum()) + np.repeat(items.first[kinds] - np.cumsum(n) + n, n)]
    own_kind = np.repeat(np.arange(len(kinds)), n)
    order = np.argsort(owner, kind="stable")
    owner, own_kind = owner[order], own_kind[order]
    ks, starts, counts = np.unique(owner, return_index=True, return_counts=True)
    found = []
    for at in np.flatnonzero(counts >= items.needed[ks]):
        k = int(ks[at])
        item = items.words[k]
        m, best = len(item), 0
        hits = np.flatnonzero(np.isin(kind, own_kind[starts[at] : starts[at] + counts[at]]))
        for group in np.split(hits, np.flatnonzero(np.diff(positions[hits]) > 2 * m) + 1):
            if len(group) < items.needed[k] or len(np.unique(kind[group])) < items.needed[k]:
                continue
            window = words[max(0, positions[group[0]] - m) : positions[group[-1]] + m + SEED_WORDS]
            if min(reach(item, window), reach(window, item)) < THRESHOLD * MATCH * m:
                continue
            key = (k, window.tobytes()) if len(window) < 2000 else None
            score = memory.get(key) if key else None
            if score is None:
                score = align(item, window)
                if key:
                    memory[key] = score
            best = max(best, score)
        if best >= THRESHOLD * MATCH * m:
            found.append((k, best / (MATCH * m)))
    return sorted(found, key=lambda x: (-x[1], x[0]))


def judge(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK_ITEMS) -> tuple[DataFrame, str]:
    """docs with one more array column, and its name: (item_id, score) of every benchmark item found, best first."""
    bench = benchmark.filter("text is not null").select("item_id", "text")
    blocks = max(1, -(-bench.count() // block))
    name = free_name(docs, "_items")
    id_type = bench.schema["item_id"].dataType
    rows = docs.withColumn(name, F.array().cast(T.ArrayType(T.StructType([T.StructField("item_id", id_type), T.StructField("score", T.DoubleType())]))))
    for b in range(blocks):
        own = bench.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        ids, texts = [r[0] for r in own], [r[1] for r in own]
        rows = _find(rows, index_items(ids, texts), name)
    return rows, name


def _find(docs: DataFrame, items: Items, name: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    place, text_at = docs.columns.index(name), docs.columns.index("text")

    def find(batches):
        items, memory = shared.value, {}
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            old = batch.column(place).to_pylist()
            for lo, hi in chunks(texts, lambda t: len(t or "")):
                h, offsets = text_words(texts[lo:hi])
                positions, seeds, doc = hits_of(items, h, offsets)
                if len(memory) > 20_000:
                    memory.clear()
                cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                for d in np.flatnonzero(np.diff(cut)):
                    own = slice(cut[d], cut[d + 1])
                    for k, score in matches(items, h[offsets[d] : offsets[d + 1]], positions[own] - offsets[d], seeds[own], memory):
                        old[lo + d].append({"item_id": items.ids[k], "score": score})
            for x in old:
                x.sort(key=lambda r: -r["score"])
            columns = list(batch.columns)
            columns[place] = pa.array(old, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(find, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the benchmark items that it copies, best first."""
    rows, x = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    x = F.col(x)
    return rows.select(
        "doc_id", (F.size(x) > 0).alias("contaminated"), F.size(x).cast("long").alias("n_items"), x["item_id"].alias("item_ids"),
        F.get(x, F.lit(0))["item_id"].alias("best_item"), F.coalesce(F.round(F.get(x, F.lit(0))["score"], 6), F.lit(0.0)).alias("best_score"),
    )


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that copy no benchmark item."""
    rows, x = judge(docs, table(spark, sf_dir, "benchmark"))
    return rows.filter(F.size(x) == 0).drop(x)
