import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd

from tracelake.llm import importance_resampling as ir
from tracelake.llm.importance_resampling import Words, dictionary, drawn, op13_importance_resampling, pack, resample, unpack

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features_of(text):
    w = words_of(text)
    return [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]


def bucket(x):
    return zlib.crc32(x.encode()) % 10_000


def plain(docs, items):
    s, t = (collections.Counter(bucket(x) for text in texts for x in features_of(text)) for texts in ([d[1] for d in docs], items))
    whole, aim = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (whole + 10000.0) / ((s[b] + 1.0) * (aim + 10000.0)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        x = features_of(text)
        weight = sum(gain[bucket(f)] for f in x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text))])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_whole_table(spark, sf):
    docs, items = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/benchmark.parquet")
    assert found(op13_importance_resampling(spark, sf)) == plain(list(zip(docs.doc_id, docs.text, strict=True)), list(items.text))


def test_odd_texts(spark, odd_texts):
    rng = random.Random(2)
    texts = [*odd_texts, "Ä Ö ÅNGSTRÖM İ ß K", "a-b_c\x00d\x7fe 9lives", "Z" * 63 + " " + "y" * 64 + " " + "x" * 65 + " b " + "w" * 900, "a\nb", *(" ".join(rng.choices("abcdeé", k=rng.randint(0, 60))) for _ in range(120))]
    docs = [*enumerate(texts), (None, texts[-1] + " q" * 30), (3, "again " * 25), (3, "again " * 25)]
    items = ["a b c", None, "", "again again"]
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in docs], DOCS + ", range int, weight string")
    assert found(resample(df, spark.createDataFrame([(k, t) for k, t in enumerate(items)], ITEMS))) == plain(docs, items)


def test_empty_tables(spark):
    none, no_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert resample(none, no_items).count() == 0
    docs = [(k, f"word{k} " * 25) for k in range(40)]
    assert found(resample(spark.createDataFrame(docs, DOCS), no_items)) == plain(docs, [])


def test_small_pieces_and_memory_make_no_difference(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted(map(tuple, df.collect()))
    whole = rows(dictionary(docs))
    assert whole == rows(dictionary(docs, piece=777, held=5_000))
    every = collections.Counter(f for (text,) in docs.select("text").collect() for f in features_of(text))
    assert sum(r[1] for r in whole) == every.total() and sum(r[2] for r in whole) == len(every)


def test_weights_do_not_depend_on_pieces(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gain = np.arange(10_000) - 5_000
    assert sorted(map(tuple, ir.weighed(docs, gain).collect())) == sorted(map(tuple, ir.weighed(docs, gain, piece=501).collect()))


def test_hashes_of_ngrams():
    rng = random.Random(4)
    text = " ".join("".join(rng.choices("abcé9", k=rng.choice([1, 3, 8, 63, 64, 65, 66, 200]))) for _ in range(400))
    for _, _, some in Words([text.encode(), b"", b"x"]).pieces(100):
        for grams in (some.counted()[0], some.placed()[0]):
            names = [b" ".join(some.words[at] for k in range(3) if (at := (int(g) >> 21 * k & (1 << 21) - 1) - 1) >= 0) for g in grams]
            crcs = [zlib.crc32(x) for x in names]
            assert some.crcs(grams).tolist() == crcs and len(set(names)) == len(names)
            assert [k >> 42 for k in some.keys(grams).tolist()] == [c % 10_000 for c in crcs]


def test_blobs_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 255), (1000, 300), (1000, 1 << 40)):
        keys, counts = np.unique(rng.integers(0, 1 << 56, n, dtype=np.uint64)), rng.integers(1, top + 1, n)
        got = unpack(pack(keys, counts[: len(keys)]))
        assert np.array_equal(got[0], keys) and np.array_equal(got[1], counts[: len(keys)])


def test_ranks_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(ir, "RANGE_ROWS", 40)
    rng = random.Random(6)
    rows = [(k, rng.choice([5, 20, 50]), 1, 0, rng.randint(0, 60) * rng.choice([1, 1, 1000])) for k in range(3_000)]
    ranks = {r.doc_id: r["rank"] for r in drawn(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")).collect()}
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    want = {r[0]: k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    assert len(ranks) == 3_000 and {k: v for k, v in ranks.items() if v} == want
