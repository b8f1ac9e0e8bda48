"""Toxicity by a convolutional text classifier written in numpy.

Words and their leading characters hash into one embedding table; filters of several widths slide over the
word vectors, max pooling keeps the strongest answer of each filter in the whole text, and a logistic layer
reads them. The network is fitted on the driver on at most `TRAIN_DOCS` labelled rows, the ones with the
smallest hashed ids, and on at most `TRAIN_BYTES` of text; every document is scored whole, in parallel. Thresholds are calibrated
by language, as far as texts alone tell it: the texts of the fit are clustered by their letter pairs, and the nearest cluster is a document's
kind; no column but the text has a part in that. The thresholds are set on all labelled rows outside the held-out fold and the fit, counted on
Spark in narrow bins of the score, and move each score so that 0.5 is the threshold. A kind with under `LEAST_LABELS` toxic or clean
ones of these takes the threshold of all kinds together. With under 500 labelled rows, the rows of the fit calibrate too.

Defined cases: null and empty texts are scored as texts without words; with labels of one kind or none,
every score is the share of toxic labels (0 without labels); a null doc_id gives a null held_out and is not learned from; very long
texts are scored whole, and one beyond `TRAIN_BYTES` is not fitted; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import chunks, cut_lineage, held_out, mix64, table, word_hashes

TRAIN_DOCS = 8000
TRAIN_BYTES = 64_000_000
TABLE = 1 << 16
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
EPOCHS = 6
BATCH = 16
RATE = 0.02
HEAD_BYTES = (4, 7)
SEED = 7
#: How many false alarms a missed toxic text weighs in the calibration.
MISS_COST = 3
LEAST_LABELS = 20
#: Clusters of letter pairs, slots that the pairs are hashed to, and rounds of the clustering.
KINDS, PAIRS, ROUNDS = 12, 1024, 15
#: Bins of a unit of the score before the logistic function, within -LIMIT to LIMIT.
BINS, LIMIT = 64, 30

_PUNCTUATION = {ord(c): " " for c in "!\"#$%&()*+,./:;<=>?@[\\]^`{|}~"}


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (words x 3), and text offsets (len + 1) with blank words between texts."""
    raw = [(t or "").lower().translate(_PUNCTUATION).encode("utf-8", "replace") for t in texts]
    h, starts, ends, offsets, data = word_hashes(raw)
    rows = np.zeros((len(h), 1 + len(HEAD_BYTES)), np.int64)
    rows[:, 0] = h % np.uint64(TABLE - 1) + np.uint64(1)
    for k, n in enumerate(HEAD_BYTES, 1):
        at = np.minimum(starts[:, None] + np.arange(n), len(data) - 1)
        code = np.where(np.arange(n) < (ends - starts)[:, None], data[at], 0).astype(np.uint64)
        key = (code << (np.uint64(8) * np.arange(n, dtype=np.uint64))).sum(1, dtype=np.uint64) + (np.uint64(n) << np.uint64(60))
        rows[:, k] = mix64(key) % np.uint64(TABLE - 1) + np.uint64(1)
    pad = max(WIDTHS)
    shift = np.repeat(np.arange(len(texts)) * pad, np.diff(offsets))
    out = np.zeros((len(h) + pad * len(texts), rows.shape[1]), np.int32)
    out[np.arange(len(h)) + shift] = rows
    return out, offsets + pad * np.arange(len(offsets))


def all_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """features() of many texts, a bounded part at a time."""
    parts = [features(texts[a:b]) for a, b in chunks(texts, lambda t: len(t or ""), 500_000)]
    ends = np.cumsum([0] + [len(p[0]) for p in parts])
    offsets = np.concatenate([[0], *(p[1][1:] + e for p, e in zip(parts, ends, strict=False))])
    return np.concatenate([p[0] for p in parts]), offsets


_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def profiles(texts: list[str | None]) -> np.ndarray:
    """Shares of the letter pairs of each text, as square roots, so of length 1; zeros if it has none. A blank before a word counts as a letter."""
    raw = [b" " + (t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"".join(raw) + b" ", np.uint8)
    letter = _LETTER[data]
    folded = np.where(letter, data, 32).astype(np.uint64)
    slot = (mix64(folded[:-1] << np.uint64(8) | folded[1:]) % np.uint64(PAIRS)).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), [len(t) for t in raw])
    counts = np.bincount((owner * PAIRS + slot)[letter[1:]], minlength=len(raw) * PAIRS).reshape(len(raw), PAIRS)
    return np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


def clustered(points: np.ndarray) -> np.ndarray:
    """Centers of at most KINDS clusters, by cosine; the first centers are the mean and, one after the other, what is farthest from those before."""
    points = points[points.any(1)]
    centers = points.mean(0, keepdims=True) if len(points) else np.zeros((0, PAIRS), np.float32)
    while 0 < len(centers) < min(KINDS, len(points)):
        centers = np.vstack([centers, points[np.argmin((points @ centers.T).max(1))]])
    for _ in range(ROUNDS):
        own = np.argmax(points @ centers.T, 1) if len(points) else points
        for k in range(len(centers)):
            if (own == k).any():
                mean = points[own == k].mean(0)
                centers[k] = mean / np.linalg.norm(mean)
    return centers


class TextCnn:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.table = (rng.standard_normal((TABLE, DIM)) * 0.1).astype(np.float32)
        self.table[0] = 0
        self.filters = [(rng.standard_normal((w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.start = np.float32(0)
        self.fitted: list = []
        self.centers = np.zeros((0, PAIRS), np.float32)

    def _maps(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.table[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            x = x + self.table[rows[:, k]]
        found = np.full((len(x), FILTERS * len(WIDTHS)), 0, np.float32)
        for j, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            part = found[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(w):
                part[: len(x) - k] += x[k:] @ f[k]
        found[rows[:, 0] == 0] = 0  # windows that begin in the blanks between texts
        return x, found

    def logits(self, rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 1:
            return np.zeros(0, np.float32)
        _, found = self._maps(rows)
        pooled = np.maximum(np.maximum.reduceat(found, offsets[:-1]) + self.bias, 0)
        return pooled @ self.out + self.start

    def gradients(self, part: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """Gradients of the mean weighted logistic loss over the texts part[at[i] : at[i + 1]]; only the winning windows have one."""
        x, found = self._maps(part)
        top = np.stack([found[a:b].argmax(0) + a for a, b in zip(at[:-1], at[1:], strict=True)])
        pooled = found[top, np.arange(found.shape[1])] + self.bias
        active = np.maximum(pooled, 0)
        z = active @ self.out + self.start
        d = ((1 / (1 + np.exp(-z)) - y) * weight).astype(np.float32) / len(y)
        back = d[:, None] * self.out * (pooled > 0)
        live = back * (part[:, 0] != 0)[top]
        filters, gx = [np.zeros_like(f) for f in self.filters], np.zeros_like(x)
        for j, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            b, t = live[:, j * FILTERS : (j + 1) * FILTERS], top[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(w):
                place = np.minimum(t + k, len(x) - 1)
                b_in = b * (t + k < len(x))
                filters[j][k] = np.einsum("nf,nfd->df", b_in, x[place])
                np.add.at(gx, place.ravel(), (b_in[:, :, None] * f[k].T[None]).reshape(-1, DIM))
        used = np.flatnonzero(np.abs(gx).sum(1))
        slots, where = np.unique(part[used].ravel(), return_inverse=True)
        table = np.zeros((len(slots), DIM), np.float32)
        np.add.at(table, where, np.repeat(gx[used], part.shape[1], 0))
        table[slots == 0] = 0
        return {"out": active.T @ d, "bias": back.sum(0), "filters": filters, "start": d.sum(), "slots": slots, "table": table}

    def fit(self, rows: np.ndarray, offsets: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Adagrad on the logistic loss, positives weighted up to balance."""
        rng = np.random.default_rng(seed)
        weight = np.where(y == 1, min(5.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0).astype(np.float32)
        state = {id(p): np.full(p.shape, 1e-3, np.float32) for p in (self.table, *self.filters, self.bias, self.out)}

        def step(p, g, at=slice(None)):
            s = state[id(p)]
            s[at] += g * g
            p[at] -= RATE * g / np.sqrt(s[at])

        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(order), BATCH):
                ids = order[lo : lo + BATCH]
                part = np.concatenate([rows[offsets[i] : offsets[i + 1]] for i in ids])
                g = self.gradients(part, np.concatenate(([0], np.cumsum(np.diff(offsets)[ids]))), y[ids], weight[ids])
                step(self.out, g["out"])
                step(self.bias, g["bias"])
                for f, own in zip(self.filters, g["filters"], strict=True):
                    step(f, own)
                self.start -= np.float32(RATE) * g["start"]
                step(self.table, g["table"], g["slots"])

    def kinds(self, texts: list[str | None]) -> np.ndarray:
        """The nearest cluster of each text; len(centers) for texts without letters."""
        points = profiles(texts)
        near = np.argmax(points @ self.centers.T, 1) if len(self.centers) else np.zeros(len(texts), int)
        return np.where(points.any(1), near, len(self.centers))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores before calibration."""
        z = self.logits(*features(texts))
        return 1 / (1 + np.exp(-np.clip(z.astype(float), -LIMIT, LIMIT)))


def threshold(bins: list[tuple[float, float, int, int]]) -> float:
    """The threshold of least cost, from (lowest score, highest score, toxic rows, clean rows) of bins in order of score."""
    low, high, toxic, clean = (np.array(x) for x in zip(*bins, strict=True))
    errors = MISS_COST * np.concatenate(([0], np.cumsum(toxic))) + np.concatenate((np.cumsum(clean[::-1])[::-1], [0]))
    ties = np.flatnonzero(errors == errors.min())
    cut = ties[len(ties) // 2]
    if cut in (0, len(bins)):
        return float(low[0] if cut == 0 else high[-1])
    return float((high[cut - 1] + low[cut]) / 2)


def thresholds(counts: list[tuple[int, int, float, float, int, int]], langs: int) -> np.ndarray:
    """Of each of the kinds and of none, from (kind, bin, lowest score, highest score, toxic rows, clean rows) of all labelled rows."""
    def merged(rows):
        bins: dict[int, tuple] = {}
        for _, b, low, high, toxic, clean in rows:
            old = bins.get(b, (low, high, 0, 0))
            bins[b] = (min(low, old[0]), max(high, old[1]), old[2] + toxic, old[3] + clean)
        return [bins[b] for b in sorted(bins)]

    common = threshold(merged(counts)) if counts else 0.0
    moves = np.full(langs + 1, common)
    for k in range(langs + 1):
        own = merged([r for r in counts if r[0] == k])
        if min(sum(r[2] for r in own), sum(r[3] for r in own)) >= LEAST_LABELS:
            moves[k] = threshold(own)
    return moves


def known_labels(labels: DataFrame) -> DataFrame:
    known = labels.filter("toxic is not null").select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y")).groupBy("_id").agg(F.max("_y").alias("_y"))
    return known.filter(~held_out(F.col("_id")))


def chosen_ids(docs: DataFrame, labels: DataFrame, most: int, most_bytes: int) -> list:
    """Ids of the fit: the labelled ones with the smallest hashes, within both bounds."""
    first = known_labels(labels).orderBy(F.xxhash64("_id"), "_id").limit(most)
    sizes = docs.select(F.col("doc_id").alias("_id"), F.octet_length(F.coalesce("text", F.lit(""))).alias("_n")).join(F.broadcast(first), "_id").groupBy("_id").agg(F.sum("_n").alias("_n"))
    ids, total = [], 0
    for r in sizes.orderBy(F.xxhash64("_id"), "_id").collect():
        if total + r["_n"] <= most_bytes:
            ids.append(r["_id"])
            total += r["_n"]
    return ids


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_bytes: int = TRAIN_BYTES) -> TextCnn | float:
    """The fitted classifier before its calibration, or the share of toxic labels where there is nothing to tell apart."""
    ids = chosen_ids(docs, labels, most, most_bytes)
    chosen = known_labels(labels).join(F.broadcast(_id_frame(docs, ids)), "_id")
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(chosen), "_id").orderBy(F.xxhash64("_id"), "_id", "text").limit(most).toPandas()
    y = rows["_y"].to_numpy()
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.0
    model = TextCnn()
    fitted = np.arange(len(y)) % 5 != 4 if len(y) >= 500 else np.ones(len(y), bool)
    texts = rows["text"].tolist()
    grams, offsets = all_features([t for t, ok in zip(texts, fitted, strict=True) if ok])
    model.fit(grams, offsets, y[fitted])
    model.centers = clustered(np.vstack([profiles(texts[lo:hi]) for lo, hi in chunks(texts, lambda t: len(t or ""), 1_000_000)]))
    model.fitted = sorted(set(rows["_id"][fitted].tolist())) if len(y) >= 500 else []
    return model


def _id_frame(docs: DataFrame, ids: list) -> DataFrame:
    return docs.sparkSession.createDataFrame([(k,) for k in ids], docs.select(F.col("doc_id").alias("_id")).schema)


def label_counts(raw: DataFrame, labels: DataFrame, fitted: list) -> list[tuple]:
    """What thresholds() reads, of all labelled rows but the held-out fold and the fitted ids; bounded by kinds and bins."""
    known = known_labels(labels)
    if fitted:
        known = known.join(F.broadcast(_id_frame(raw, fitted)), "_id", "left_anti")
    rows = raw.select(F.col("doc_id").alias("_id"), "z", "kind").join(known, "_id")
    toxic = F.col("_y") == 1
    bins = rows.groupBy("kind", F.floor(F.col("z") * BINS).alias("bin")).agg(F.min("z"), F.max("z"), F.count_if(toxic), F.count_if(~toxic))
    return [tuple(r) for r in bins.collect()]


def raw_scores(rows: DataFrame, model: TextCnn) -> DataFrame:
    """One row for each of (doc_id, text): the score before calibration and the logistic function, and the number of the text's kind."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts, lambda t: len(t or ""), 1_000_000):
                z = np.clip(model.logits(*features(texts[lo:hi])).astype(float), -LIMIT, LIMIT)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(z), pa.array(model.kinds(texts[lo:hi]).astype(np.int32))], names=["doc_id", "z", "kind"])

    return rows.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, z double, kind int")


def moved(raw: DataFrame, moves: np.ndarray) -> DataFrame:
    z = F.col("z") - F.get(F.array(*[F.lit(float(m)) for m in moves]), F.col("kind"))
    return raw.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), z))))).alias("score"))


def score_all(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id and score of each of (doc_id, text); texts are scored once, and only ids, scores and kinds meet the labels."""
    model = train(docs, labels, most)
    if isinstance(model, float):
        return docs.select("doc_id", F.lit(model).alias("score"))
    raw = cut_lineage(raw_scores(docs, model))
    return moved(raw, thresholds(label_counts(raw, labels, model.fitted), len(model.centers)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
