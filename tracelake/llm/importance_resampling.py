"""Importance resampling towards a target: a dictionary of all n-gram strings, bucket gains, and a weighted draw.

The dictionary is counted globally. A task numbers the words of its texts, so that an n-gram is three numbers in one
long, and counts the distinct ones; each distinct string is hashed once there. Its key has 56 bits: bucket and quotient, which are the CRC-32
that the contract asks for, and 23 bits of another hash. Two strings with one key would fall into one bucket anyway, so no
bucket's sum depends on it. Sorted keys go out as gaps, in one blob for each part of the key range, which keeps the
dictionary at about twice the size of compressed input; a part merges the blobs of all tasks, counts
its strings and sums them by bucket. Keys begin with the bucket, so all parts together give few more rows than there are buckets.

The CRC of an n-gram comes from those of its words: appending L bytes is a linear map of 32 bits, kept as four tables of 256
for each L. N-grams with a longer word are hashed as bytes.

Gains (a row for each bucket) are joined back to the feature counts of documents in a second pass over the texts,
again through a dictionary of each piece, so no text and no feature of a document is shuffled.

The draw is a top-k over all documents: scores are cut into ranges at percentiles, ranges are ranked on their own, and ranks are
shifted by the rows in higher ranges.

Defined cases: a null text has no words, so weight 0, and is never drawn; a null doc_id reads as no characters in the hash and comes after
others of equal score; repeated ids are rows of their own, equal scores of one id by feature count; with an empty benchmark the gains are those of T = 0; with
fewer than 20 documents of 20 words nothing is drawn; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import cut_lineage, mix64, prefix_sums, slices, table

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 5
SEED = 42

#: Words whose n-grams are counted at once, and distinct keys that a task holds before it sends them.
PIECE, HELD = 1_000_000, 6_000_000
#: Parts of the key range for each shuffle partition; several, so that partitions are alike and a part is small.
PARTS_EACH = 8
#: Longest word for which n-gram hashes are put together from tables.
TABLED = 64
#: Rows in a range of scores, while there are at most RANGES ranges.
RANGE_ROWS, RANGES = 50_000, 1_000

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_ID = np.int64((1 << 21) - 1)


@functools.cache
def _appended() -> np.ndarray:
    """[L, k, byte]: what L further bytes make of a CRC-32 that has this byte at place k; by the reflected polynomial."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ np.where(one & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    every = np.empty((TABLED + 2, 4, 256), np.uint32)
    every[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(1, TABLED + 2):
        every[n] = (every[n - 1] >> np.uint32(8)) ^ one[every[n - 1] & np.uint32(255)]
    return every


@functools.cache
def _tables() -> list[np.ndarray]:
    """The same for each place k, at 256 * L + byte."""
    return [np.ascontiguousarray(_appended()[:, k]).ravel() for k in range(4)]


def _append(crc: np.ndarray, row: np.ndarray, more: np.ndarray) -> np.ndarray:
    """CRC-32 of joined byte strings, from theirs and 256 times the length of the second."""
    crc, out = crc.astype(np.int64), more.copy()
    for k, values in enumerate(_tables()):
        out ^= values.take(row + (crc >> 8 * k & 255))
    return out


class Words:
    """The words of some texts in order; first: index of the first word of each text, and the number of all."""

    def __init__(self, texts: list[bytes]) -> None:
        import pyarrow as pa

        data = np.frombuffer((b" ".join(texts) + b" ").lower(), np.uint8)  # of bytes, lower() changes A-Z alone
        inside = _WORD[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
        starts, ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        self.words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        self.end = np.repeat(self.first[1:], np.diff(self.first))  # of each word's text

    def pieces(self, size: int):
        """(lo, hi, the words from lo on) of runs of words whose n-grams begin in lo..hi."""
        for lo in range(0, len(self.words), size):
            hi = min(lo + size, len(self.words))
            yield lo, hi, Piece(self.words.slice(lo, hi - lo + 2).dictionary_encode(), self.end[lo:hi] - np.arange(lo, hi))


class Piece:
    """N-grams of a run of words as longs of three word numbers: one, two, then three words, each in the order of their starts."""

    def __init__(self, encoded, left: np.ndarray) -> None:
        """left: for each start, the number of words up to its text's end."""
        self.words, ids = encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        n = len(left)
        ids = np.concatenate((ids, np.zeros(max(n + 2 - len(ids), 0), np.int64)))
        one = ids[:n]
        two = one | ids[1 : n + 1] << 21
        self.valid = (np.ones(n, bool), left >= 2, left >= 3)
        self.every = np.concatenate((one, two[self.valid[1]], (two | ids[2 : n + 2] << 42)[self.valid[2]]))

    def counted(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams and how often each occurs; those of fewer words come first."""
        order = np.sort(self.every)
        new = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1])))
        return order[new], np.diff(new, append=len(order))

    def placed(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, those of fewer words first, and where each n-gram stands among them."""
        import pyarrow as pa

        found = pa.array(self.every).dictionary_encode()
        return found.dictionary.to_numpy(), found.indices.to_numpy(zero_copy_only=False)

    def _numbers(self, grams: np.ndarray) -> list[np.ndarray]:
        """Numbers of the first words of all, of the second words of those of two or more, of the third words of those of three."""
        some = [np.count_nonzero(grams < 1 << 21 * k) if k else 0 for k in range(3)]
        return [(grams[n:] >> 21 * k & _ID) - 1 for k, n in enumerate(some)]

    def crcs(self, grams: np.ndarray) -> np.ndarray:
        """CRC-32 of the string of each of some distinct n-grams, its words joined by one space."""
        words, at = self.words, self._numbers(grams)
        alone = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        behind = np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words))
        length = np.fromiter(map(len, words), np.int64, len(words))
        rows = (np.minimum(length, TABLED) + 1) * 256
        out = alone.take(at[0])
        for place in at[1:]:
            rest = out[len(out) - len(place) :]
            rest[:] = _append(rest, rows.take(place), behind.take(place))
        if length.max(initial=0) > TABLED:
            long = length > TABLED
            for place in at[1:]:
                for k in np.flatnonzero(long[place]) + len(grams) - len(place):
                    out[k] = zlib.crc32(b" ".join(words[p[k - len(grams)]] for p in at if len(p) >= len(grams) - k))
        return out

    def keys(self, grams: np.ndarray) -> np.ndarray:
        """56 bits for each of some distinct n-grams: its bucket, the quotient of its CRC-32, 23 bits of a hash of its words."""
        lengths = np.concatenate(([0], np.cumsum([len(w) for w in self.words]))).astype(np.int64)
        c, q = prefix_sums(np.frombuffer(b"".join(self.words), np.uint8))
        hashes = mix64((c[lengths[1:]] - c[lengths[:-1]]) * q[lengths[:-1]])
        mixed = np.zeros(len(grams), np.uint64)
        for k, place in enumerate(self._numbers(grams)):
            mixed[len(grams) - len(place) :] += (hashes * np.uint64(2 * k + 1) + np.uint64(k)).take(place)
        quotient, bucket = np.divmod(self.crcs(grams), np.uint32(BUCKETS))
        return bucket.astype(np.uint64) << np.uint64(42) | quotient.astype(np.uint64) << np.uint64(23) | mixed >> np.uint64(41)


def _with_counts(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Keys with counts of up to 255 in the last byte, several for a larger count, so that plain numbers can be sorted."""
    most = (counts - 1) // 255
    out = [keys << np.uint64(8) | (counts - most * 255).astype(np.uint64)]
    if most.any():
        out.append(np.repeat(keys[most > 0] << np.uint64(8) | np.uint64(255), most[most > 0]))
    return np.concatenate(out)


def _summed(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with the sums of their counts, from keys with counts."""
    pairs = np.sort(np.concatenate(pairs))
    keys, counts = pairs >> np.uint64(8), (pairs & np.uint64(255)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[new], np.add.reduceat(counts, new)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps of as many bytes as the largest needs, and their counts."""
    import pyarrow as pa

    gaps = np.diff(keys, prepend=np.uint64(0))
    first, gaps[0] = gaps[0], 0
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    wide = 1 if counts.max() < 1 << 8 else 8
    tally = pa.compress(counts.astype(f"<u{wide}").tobytes(), "zstd", asbytes=True)
    body = np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return np.array([len(keys), first, width, wide], "<u8").tobytes() + body + tally


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    import pyarrow as pa

    n, first, width, wide = (int(x) for x in np.frombuffer(blob, "<u8", 4))
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :width] = np.frombuffer(blob, np.uint8, n * width, 32).reshape(n, width)
    counts = np.frombuffer(pa.decompress(blob[32 + n * width :], n * wide, "zstd", asbytes=True), f"<u{wide}").astype(np.int64)
    return np.cumsum(gaps.view("<u8").ravel()) + np.uint64(first), counts


def dictionary(texts: DataFrame, piece: int = PIECE, held: int = HELD) -> DataFrame:
    """(bucket, features, strings): occurrences and distinct strings of all n-grams of the column text, for each bucket found."""
    parts = PARTS_EACH * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def send(keys, counts):
        import pyarrow as pa

        part = (keys >> np.uint64(24)) * np.uint64(parts) // np.uint64(BUCKETS << 18)
        cuts = np.flatnonzero(np.diff(part)) + 1
        edges = [0, *cuts.tolist(), len(keys)]
        for k in range(0, len(edges) - 1, 64):
            some = list(zip(edges[k : k + 64], edges[k + 1 : k + 65], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(part[lo]) for lo, _ in some], pa.int32()), pa.array([pack(keys[lo:hi], counts[lo:hi]) for lo, hi in some], pa.binary())], ["part", "blob"])

    def count(batches):
        pairs, total = [], 0
        for batch in slices(batches, 0, 4_000_000):
            for _, _, some in Words([x or b"" for x in batch.column(0).to_pylist()]).pieces(piece):
                grams, counts = some.counted()
                pairs.append(_with_counts(some.keys(grams), counts))
                total += len(pairs[-1])
                if total > held:
                    keys, counts = _summed(pairs)
                    pairs, total = [_with_counts(keys, counts)], len(keys)
                    if total > held // 2:
                        yield from send(keys, counts)
                        pairs, total = [], 0
        if total:
            yield from send(*_summed(pairs))

    def merge(group):
        import pyarrow as pa

        found = [unpack(b) for b in group.column("blob").to_pylist()]
        keys, counts = _summed([_with_counts(k, c) for k, c in found])
        bucket = (keys >> np.uint64(42)).astype(np.int64)
        strings = np.bincount(bucket, minlength=BUCKETS)
        features = np.zeros(BUCKETS, np.int64)
        np.add.at(features, bucket, counts)
        there = np.flatnonzero(strings)
        return pa.table({"bucket": pa.array(there, pa.int32()), "features": pa.array(features[there]), "strings": pa.array(strings[there], pa.int64())})

    blobs = texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "part int, blob binary")
    every = blobs.groupBy("part").applyInArrow(merge, "bucket int, features long, strings long")
    return every.groupBy("bucket").agg(F.sum("features").alias("features"), F.sum("strings").alias("strings"))


def gains(raw: DataFrame, target: DataFrame) -> np.ndarray:
    """Gain of each bucket from the dictionaries of all documents and of the target; BUCKETS rows reach the driver."""
    count = np.zeros((2, BUCKETS), np.int64)
    for k, df in enumerate((raw, target)):
        for bucket, features in df.select("bucket", "features").collect():
            count[k, bucket] = features
    (s, t), (whole, aim) = count.tolist(), count.sum(axis=1).tolist()
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(whole + BUCKETS) / (float(a + 1) * float(aim + BUCKETS)))) for a, b in zip(s, t, strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document: the gains of its features, each as often as it occurs."""

    def weigh(batches):
        import pyarrow as pa

        for batch in slices(batches, 1, 4_000_000):
            words = Words([x or b"" for x in batch.column(1).to_pylist()])
            sums = np.zeros(len(words.words) + 1, np.int64)
            for lo, hi, some in words.pieces(piece):
                grams, places = some.placed()
                each = gain[some.crcs(grams) % BUCKETS].take(places)
                for valid in some.valid:
                    n = int(valid.sum())
                    sums[lo + 1 : hi + 1][valid] += each[:n]
                    each = each[n:]
            np.cumsum(sums, out=sums)
            n = np.diff(words.first)
            features = n + np.maximum(n - 1, 0) + np.maximum(n - 2, 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(np.int64)) for x in (n, features, sums[words.first[1:]] - sums[words.first[:-1]]))], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(weigh, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(doc_id: Column) -> Column:
    """The Gumbel noise of a document, from the hash of its id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame) -> DataFrame:
    """scored, a written table, with the rank of the PERCENT % of documents of LEAST_WORDS words that score highest."""
    able = F.col("n_words") >= LEAST_WORDS
    n = scored.filter(able).count()
    draw, parts = PERCENT * n // 100, min(RANGES, n // RANGE_ROWS)
    none = F.lit(None).cast("long")
    cuts = []
    if parts > 1:
        cuts = scored.filter(able).agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 20 * parts)).first()[0]
    cuts = sorted(set(cuts), reverse=True)
    number = F.size(F.filter(F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), lambda c: F.col("score") <= c)) if cuts else F.lit(0)
    rows = scored.withColumn("range", F.when(able, number).otherwise(-1))
    above, before = 0, {}
    for k, size in sorted(rows.filter("range >= 0").groupBy("range").count().collect()):
        if above < draw:
            before[k] = above
        above += size
    if not before:
        return scored.withColumn("rank", none)
    shift = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("range").cast("long"))
    place = shift + F.row_number().over(Window.partitionBy("range").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features"))
    ranked = rows.filter(F.col("range").isin(list(before))).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return ranked.unionByName(rows.filter(~F.col("range").isin(list(before))).withColumn("rank", none)).drop("range")


def resample(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """n_words, n_features, weight, score and rank of every document."""
    gain = gains(dictionary(docs), dictionary(benchmark))
    return drawn(cut_lineage(weighed(docs, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id")))))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")
