"""Near-duplicate classes by consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words; a shingle weighs its count in the text times its smoothed inverse document frequency
1 + log(n / df) / log(n), between 1 and 2, so that frequent boilerplate counts less, but an edit of a text with many copies does not
outweigh all that it shares with them. Document frequencies are counted over all documents in `COUNTERS` hashed counters, less what other
shingles add to a counter on average. Improved consistent weighted sampling draws `BANDS * ROWS` samples of a text; `ROWS` of them
make a band key. Two texts are linked if their weighted Jaccard similarity is at least `SIMILARITY`.

Texts that are equal are one node from the start. Within a bucket of a band, every node is compared with the
smallest one (a star, linear in the bucket); nodes joined so are one class. In buckets of which more than one class is
left, nodes are compared completely in pairs of blocks of about `BLOCK` nodes, among those whose total weights allow the similarity, so no link
between candidates is lost and no pairs are written but links. Keys that hold over 1 / SHARE of the rows are joined by broadcast.

Defined cases: a null text counts as empty; empty texts are equal; a text of under five words is one shingle; rows of
equal doc_id and text are one document of the result's class; rows of equal doc_id and different texts are different documents; null doc_ids
take part but never name a class unless alone; very long texts are read whole; extra columns are carried along by the pipeline stage.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import BROADCAST_ROWS, chunks, cut_lineage, hot_keys, join_spread, mix64, table, word_hashes
from tracelake.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 10
ROWS = 3
#: Hashed counters of document frequencies, and the pieces that they are summed in.
COUNTERS = 1 << 20
PIECES = 64
#: Level of the smallest weight; the largest is twice that.
LEVEL = 127
BLOCK = 300
#: A key with more than this part of the rows is hot; there are fewer such keys.
SHARE = 64

_A = np.uint64(0x9E3779B97F4A7C15)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at (k + 1/2) / n, by bisection."""
    want, lo, hi = (np.arange(n) + 0.5) / n, np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (lo + hi) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < want
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return lo.astype(np.float32)


_R = _gamma_quantiles(1 << 14)


class Weights:
    """Weights of shingles in steps of 1 / LEVEL, from counters of document frequencies."""

    def __init__(self, counters: np.ndarray, n_docs: int):
        noise = np.median(counters) if len(counters) else 0
        df = np.clip(counters - noise, 1, max(n_docs, 1))
        idf = np.log(max(n_docs, 1) / df) / math.log(max(n_docs, 2))
        self.levels = np.rint(LEVEL * (1 + idf)).astype(np.uint8)

    def of(self, key: np.ndarray) -> np.ndarray:
        return self.levels[(key % np.uint64(len(self.levels))).astype(np.int64)]


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in order, and offsets (len + 1)."""
    h, _, _, offsets, _ = word_hashes([(t or "").encode("utf-8", "replace") for t in texts])
    n = np.diff(offsets)
    count = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    out = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(out[-1]) - np.repeat(out[:-1] - offsets[:-1], count)
    hp = np.concatenate((h, np.zeros(SHINGLE, np.uint64)))
    key = hp[at]
    for k in range(1, SHINGLE):
        key = mix64(key * _A + hp[at + k])
    for d in np.flatnonzero((n < SHINGLE) & (n > 0)):
        x = h[offsets[d] : offsets[d] + 1]
        for w in h[offsets[d] + 1 : offsets[d + 1]]:
            x = mix64(x * _A + w)
        key[out[d]] = x[0]
    return key, out


def distinct(key: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: hashes, counts and offsets."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(k), 1), bool), (k[1:] != k[:-1]) | (d[1:] != d[:-1]))))
    return k[first], np.diff(np.append(first, len(k))), np.searchsorted(d[first], np.arange(len(offsets)))


def samples(key: np.ndarray, weight: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys (texts x bands) by improved consistent weighted sampling; every text must have a shingle."""
    log_w = np.log(weight.astype(np.float32))
    low32, out = np.uint64(0xFFFFFFFF), np.zeros((len(offsets) - 1, bands), np.uint64)
    for b in range(bands):
        for r in range(rows):
            z = mix64(key ^ np.uint64((b * rows + r + 1) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            spread = _R[(z & np.uint64(0x3FFF)).astype(np.int64)]
            beta = ((z >> np.uint64(14)) & np.uint64(0x3FFF)).astype(np.float32) / np.float32(1 << 14)
            u = (((z >> np.uint64(28)) & np.uint64(0x3FFFF)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 18)
            v = ((z >> np.uint64(46)).astype(np.float32) + np.float32(0.5)) / np.float32(1 << 18)
            t = np.floor(log_w / spread + beta)
            rank = np.log(-np.log(u * v)) - spread * (t - beta + np.float32(1))
            bits = rank.view(np.uint32)
            ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
            mark = mix64(key + t.astype(np.int64).astype(np.uint64) * _A) & low32
            least = np.minimum.reduceat((ordered << np.uint64(32)) | mark, offsets[:-1]) & low32
            out[:, b] = mix64(out[:, b] * _A + least + np.uint64(b + 1))
    return out


def pack_counts(counters: np.ndarray) -> bytes:
    """The counters that are not zero, with their places; few of a small task's are."""
    at = np.flatnonzero(counters)
    return zlib.compress(at.astype("<u4").tobytes() + counters[at].astype("<i8").tobytes(), 1)


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zlib.decompress(blob)
    n = len(data) // 12
    return np.frombuffer(data, "<u4", n).astype(np.int64), np.frombuffer(data, "<i8", n, 4 * n)


def shingle_weights(docs: DataFrame, counters: int = COUNTERS) -> Weights:
    """Weights from the counters of all documents; tasks count, and pieces of their counters are summed in two steps."""
    wide = -(-counters // PIECES)

    def count(batches):
        total, n = np.zeros(PIECES * wide, np.int64), 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            n += len(texts)
            for lo, hi in chunks(texts, lambda t: len(t or "")):
                key, _, _ = distinct(*shingles(texts[lo:hi]))
                np.add.at(total, (key % np.uint64(counters)).astype(np.int64), 1)
        if n:
            group = int(total.sum()) % PIECES
            some = [k for k in range(PIECES) if total[k * wide : (k + 1) * wide].any()]
            blobs = [pack_counts(total[k * wide : (k + 1) * wide]) for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([group] * len(some), pa.int32()), pa.array(blobs, pa.binary())], names=["piece", "grp", "blob"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(wide, np.int64)
        for blob in group.column("blob").to_pylist():
            at, n = unpack_counts(blob)
            total[at] += n
        return pa.table({"piece": group.column("piece")[:1], "grp": group.column("grp")[:1], "blob": pa.array([pack_counts(total)], pa.binary())})

    schema = "piece int, grp int, blob binary"
    rows = docs.select("text").mapInArrow(count, schema).groupBy("piece", "grp").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema).collect()
    total = np.zeros(PIECES * wide, np.int64)
    for r in rows:
        at, n = unpack_counts(r["blob"])
        total[r["piece"] * wide + at] = n
    return Weights(total[:counters], docs.count())


def fingerprint(text: str | None) -> bytes:
    return hashlib.md5((text or "").encode("utf-8", "replace")).digest()


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """doc_id, node (fingerprint of the text), total (weight of the text) and band keys (none for a text without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts, lambda t: len(t or ""), 1_000_000):
                part = texts[lo:hi]
                key, count, offsets = distinct(*shingles(part))
                weight = shared.value.of(key) * count.astype(np.float32)
                some = np.flatnonzero(np.diff(offsets))
                keys: list = [[]] * len(part)
                total = np.zeros(len(part))
                if len(some):
                    total[some] = np.add.reduceat(weight.astype(float), offsets[some])
                    found = samples(key, weight, np.append(offsets[some], offsets[-1]))
                    for d, row in zip(some.tolist(), found.view(np.int64).tolist(), strict=True):
                        keys[d] = row
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([fingerprint(t) for t in part], pa.binary()), pa.array(total), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "node", "total", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, node binary, total double, keys array<bigint>")


def contents(rows: DataFrame, weights: Weights) -> DataFrame:
    """node, body from (node, text): sorted 32-bit marks of (shingle, occurrence) and their levels; 5 bytes each."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def pack(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts, lambda t: len(t or "")):
                key, count, offsets = distinct(*shingles(texts[lo:hi]))
                level = shared.value.of(key)
                bodies = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    n = count[a:b]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    mark = (mix64(np.repeat(key[a:b], n) + nth.astype(np.uint64)) >> np.uint64(32)).astype("<u4")
                    order = np.argsort(mark, kind="stable")
                    bodies.append(mark[order].tobytes() + np.repeat(level[a:b], n)[order].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(bodies, pa.binary())], names=["node", "body"])

    return rows.select("node", "text").mapInArrow(pack, "node binary, body binary")


def unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Marks and levels."""
    n = len(body) // 5
    return np.frombuffer(body, "<u4", n), np.frombuffer(body, np.uint8, n, 4 * n)


def similarity(one: bytes, two: bytes) -> float:
    """Weighted Jaccard similarity."""
    (a, wa), (b, wb) = unpack(one), unpack(two)
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    shared = float(wa[b[at] == a].sum(dtype=np.int64))
    return shared / (wa.sum(dtype=np.int64) + wb.sum(dtype=np.int64) - shared)


def block_links(labels: list, bodies: list[bytes], sides: np.ndarray, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links that join the labels of a block, each pair of different sides (or of one block) compared."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    parts = [unpack(b) for b in bodies]
    m = len(parts)
    doc = np.repeat(np.arange(m), [len(p[0]) for p in parts])
    mark, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    w = np.concatenate([p[1] for p in parts]).astype(np.float32)
    order = np.argsort(at, kind="stable")
    at, doc, w = at[order], doc[order], w[order]
    shared = np.zeros((m, m), np.float32)
    wide = max(1, 2_000_000 // m)
    cuts = np.searchsorted(at, np.arange(0, len(mark) + wide, wide))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        x = np.zeros((m, wide), np.float32)
        x[doc[a:b], at[a:b] - k * wide] = np.sqrt(w[a:b])
        shared += x @ x.T
    total = np.bincount(doc, w, m)
    with np.errstate(invalid="ignore", divide="ignore"):
        sim = shared / (total[:, None] + total - shared)
    near = (sim >= least - 1e-4) & (sides[:, None] <= sides)
    if len(np.unique(sides)) > 1:
        near &= sides[:, None] != sides
    links = []
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = find(labels[i]), find(labels[j])
        if a != b and similarity(bodies[i], bodies[j]) >= least:
            parent[a] = b
            links.append((int(i), int(j)))
    return links


def bodies_of(docs: DataFrame, wanted: DataFrame, weights: Weights) -> DataFrame:
    """node, body of each wanted (node, doc_id); a row of that id and text is read where it lies, up to BROADCAST_ROWS of them."""
    wanted = wanted.select(F.col("node").alias("_node"), F.col("doc_id").alias("_id"))
    texts = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("node"))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    texts = texts.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node")), "left_semi")
    return contents(texts, weights).dropDuplicates(["node"])


def links_of(docs: DataFrame, nodes: DataFrame, weights: Weights) -> DataFrame:
    """node, label: classes of nodes linked to others."""
    bands = nodes.select("node", "total", F.explode("keys").alias("key"))
    leaders = bands.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("all")).filter("size > 1")
    leaders = cut_lineage(leaders)
    members = cut_lineage(join_spread(bands, leaders, "key", hot_keys(leaders, "key", "size")))
    pairs = members.filter("node <> leader").select("node", "leader").distinct()
    bodies = cut_lineage(bodies_of(docs, members.select("node").distinct().join(nodes.select("node", F.col("top")["doc_id"].alias("doc_id")), "node"), weights))

    def verify(batches):
        for batch in batches:
            ok = [similarity(a, b) >= SIMILARITY for a, b in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node").filter(mask), batch.column("leader").filter(mask)], names=["a", "b"])

    led = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    star = pairs.join(bodies.withColumnRenamed("body", "x"), "node")
    star = join_spread(star, bodies.select(F.col("node").alias("leader"), F.col("body").alias("y")), "leader", hot_keys(led, "leader", "size"))
    edges = cut_lineage(star.select("node", "leader", "x", "y").mapInArrow(verify, "a binary, b binary"))
    labels = connected_components(edges)

    placed = members.filter("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = cut_lineage(placed.select("key", "node", "total", "label", "size", "all"))
    open_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("all").alias("all"), F.first("size").alias("size")).filter("lo <> hi")
    open_keys = open_keys.groupBy("all", "size").agg(F.min("key").alias("key"))  # buckets of the same nodes are compared once
    if open_keys.isEmpty():
        return labels
    step = -math.log(SIMILARITY)
    rest = placed.drop("all", "size").join(open_keys.select("key", "size"), "key")
    rest = rest.withColumn("own", F.floor(F.log("total") / step)).withColumn("bin", F.explode(F.array("own", F.col("own") + 1)))  # alike texts share a bin
    rest = cut_lineage(rest)
    sizes = rest.groupBy("key", "bin").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("g"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    rest = rest.join(sizes.drop("lo", "hi"), ["key", "bin"]).withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("g")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rest = rest.select("key", "bin", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "label", "side").join(bodies, "node")

    def compare(key: tuple, group: pa.Table) -> pa.Table:
        found = block_links(group.column("label").to_pylist(), group.column("body").to_pylist(), group.column("side").to_numpy())
        nodes = group.column("node").to_pylist()
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.binary()), "b": pa.array([nodes[j] for _, j in found], pa.binary())})

    more = cut_lineage(rest.groupBy("key", "bin", "i", "j").applyInArrow(compare, "a binary, b binary"))
    if more.isEmpty():
        return labels
    return connected_components(edges.union(more))


def node_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """(doc_id, node) of every row; node, top (its smallest doc_id and how many rows have it), class_id, class_size, keeper (whether top is the class's
    first document) of each distinct text; and the hot nodes."""
    weights = shingle_weights(docs)
    signed = cut_lineage(signatures(docs, weights))
    by_id = signed.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("keys").alias("keys"), F.first("total").alias("total"))
    top = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("n").alias("rows")))
    nodes = cut_lineage(by_id.groupBy("node").agg(top.alias("top"), F.sum("n").alias("n"), F.first("keys").alias("keys"), F.first("total").alias("total")))
    labels = links_of(docs, nodes, weights)
    per = nodes.select("node", "top", "n").join(labels, "node", "left")
    linked = cut_lineage(per.filter("label is not null"))
    first = F.min(F.struct(F.col("top")["none"].alias("none"), F.col("top")["doc_id"].alias("doc_id"), F.col("node").alias("node")))
    named = cut_lineage(linked.groupBy("label").agg(first.alias("first"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("size")))
    found = join_spread(linked, named, "label", hot_keys(named, "label", "size"))
    found = found.select("node", "top", F.col("first")["doc_id"].alias("class_id"), "class_size", (F.col("node") == F.col("first")["node"]).alias("keeper"))
    alone = per.filter("label is null").select("node", "top", F.col("top")["doc_id"].alias("class_id"), F.col("n").alias("class_size"), F.lit(True).alias("keeper"))
    return signed.select("doc_id", "node"), cut_lineage(found.union(alone)), hot_keys(nodes, "node", "n")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id (the smallest doc_id of the class), class_size: one row per input row."""
    rows, nodes, hot = node_classes(docs)
    return join_spread(rows, nodes, "node", hot).select("doc_id", "node", "class_id", "class_size")


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every class the document with the smallest doc_id (of equal ids and texts, one row)."""
    _, nodes, _ = node_classes(docs)
    kept = cut_lineage(nodes.filter("keeper").select(F.col("top")["doc_id"].alias("_id"), F.col("node").alias("_node"), F.col("top")["rows"].alias("_n")))
    own = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit(""))))
    few = kept.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.join(F.broadcast(kept) if few else kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (own == F.col("_node")), "inner")
    if kept.filter("_n > 1").isEmpty():
        return rows.select(*docs.columns)
    once = rows.filter("_n > 1").dropDuplicates(["_id", "_node"]).select(*docs.columns)
    return rows.filter("_n = 1").select(*docs.columns).union(once)
