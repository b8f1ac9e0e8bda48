"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of every operator: space and U+0009 to U+000D.
SEPARATORS = r"[\x20\x09-\x0D]+"

#: Most rows of a side that may be broadcast; beyond it the join shuffles. Such sides hold ids, fingerprints and numbers, under 100 bytes a row.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the input does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _own_folder
    _own_folder = _own_folder or tempfile.mkdtemp(prefix="shared-")
    return _own_folder


_own_folder: str | None = None


#: Spark's setting by which the shuffle files of a query go when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder. The shuffle files that led to it go, as nothing reads them again."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a query takes the setting of the time when it is made
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def settle(rows: DataFrame, name: str, value: Column, drop: list[str]) -> DataFrame:
    """rows without `drop` and with a struct column that filters above do not compute anew (they stay above the generator)."""
    return rows.select(*(F.col(f"`{c}`") for c in rows.columns if c not in drop), F.explode(F.array(value)).alias(name))


def small_join(left: DataFrame, right: DataFrame, on: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts the right side if it has at most `limit` rows, and shuffles otherwise."""
    few = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if few else right, on, how)


#: A key with more than this part of all rows is hot; there are fewer such keys.
SHARE = 64


def hot_keys(counts: DataFrame, key: str, size: str) -> list:
    """The keys of (key, size) that hold more than 1 / SHARE of all rows, so fewer than SHARE of them."""
    total = counts.agg(F.sum(size)).first()[0] or 0
    return [r[0] for r in counts.filter(F.col(size) > total / SHARE).select(key).collect() if r[0] is not None]


def join_spread(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """Join with a right side of one row for each key; the rows of hot keys stay where they are and meet a broadcast."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    rest = left.filter(~is_hot | F.col(key).isNull()).join(right, key, how)
    return left.filter(is_hot).join(F.broadcast(right.filter(is_hot)), key, how).unionByName(rest)


def literal_doubles(values: np.ndarray) -> Column:
    """A constant array<double> of bounded length, folded once by the optimizer."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def run_id() -> str:
    return uuid.uuid4().hex


def _large_arrays_by_page() -> None:
    """Have the C library map arrays of 2 MB or more by pages of their own, which go back to the machine when an array ends.

    It would else raise that limit with use and keep what tasks have freed, so that workers grow with the number of their tasks.
    """
    try:
        ctypes.CDLL("libc.so.6").mallopt(-3, 2_000_000)
    except (OSError, AttributeError):  # another C library
        pass


_large_arrays_by_page()

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_powers = {"p": np.ones(1, np.uint64), "q": np.ones(1, np.uint64)}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["p"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for key, base in (("p", _P), ("q", _PINV)):
            t = np.full(size, np.uint64(base), np.uint64)
            t[0] = 1
            _powers[key] = np.multiply.accumulate(t)
    return _powers["p"], _powers["q"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial sums of bytes and inverse powers: hash(i, j) = (c[j] - c[i]) * q[i]."""
    p, q = _power_table(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=c[1:])
    return c, q


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once: hash, start and end byte, and text offsets (len + 1) into them, and the bytes."""
    buf = b" ".join(texts) + b" "
    data = np.frombuffer(buf, np.uint8)
    sep = _SEP[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], sep)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    c, q = prefix_sums(data)
    h = mix64((c[ends] - c[starts]) * q[starts])
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    offsets = np.searchsorted(starts, first)
    return h, starts, ends, offsets, data


def chunks(values: list, size_of, most: int = 1_000_000):
    """Consecutive index ranges of at most `most` total size (one item at least)."""
    begin, total = 0, 0
    for i, v in enumerate(values):
        n = size_of(v)
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(values):
        yield begin, len(values)


def slices(batches, column: int, most: int = 1_000_000):
    """Arrow batches cut so that a text or binary column has at most `most` bytes in each (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        for lo, hi in chunks(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist(), int, most):
            yield batch.slice(lo, hi - lo)
