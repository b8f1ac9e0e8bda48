import hashlib
import random

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tracelake.llm import winnowing
from tracelake.llm.winnowing import GRAM, SPAN, WINDOW, edited, fingerprints, hash_of, op12_winnowing, position_of, winnowed


def plain(text):
    """(hash, position) of the least gram of each window, the rightmost of equal ones, by position."""
    data = (text or "").encode()
    if not data:
        return []
    hashes = [xxhash.xxh64_intdigest(data[k : k + GRAM], 42) >> 32 & 0x7FFFFFFF for k in range(max(len(data) - GRAM, 0) + 1)]
    chosen = set()
    for s in range(max(len(hashes) - WINDOW, 0) + 1):
        window = hashes[s : s + WINDOW]
        least = min(window)
        chosen.add(s + max(k for k, h in enumerate(window) if h == least))
    return [(hashes[p], p) for p in sorted(chosen)]


def shown(entries):
    return " ".join(f"{(h << 32) - p & (1 << 64) - 1:X}" for h, p in entries)


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a or b else 1.0


def check(found, docs):
    """docs: (doc_id, text) in the order of the contract."""
    assert len(found) == len(docs)
    want = []
    for k, (i, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        a, b, c = plain(text), plain(new), plain(after)
        want.append((i, len(text), hashlib.sha256(new.encode()).hexdigest(), shown(a), shown(b), round(alike(a, b), 12), round(alike(a, c), 12)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    have = [tuple(round(r[n], 12) if n.startswith("near") else r[n] for n in names) for r in found]
    assert sorted(have, key=repr) == sorted(want, key=repr)


def test_whole_table(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id", ascending=False)
    check(op12_winnowing(spark, sf).collect(), list(zip(docs.doc_id, docs.text, strict=True)))


def test_ranges_make_no_difference(spark, sf, monkeypatch):
    """With ranges of a few rows, the next document is often in another range."""
    monkeypatch.setattr(winnowing, "RANGE_ROWS", 3)
    docs = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id", ascending=False)
    order = list(docs.doc_id)
    found = fingerprints(spark.read.parquet(f"{sf}/documents.parquet"))
    texts = dict(zip(docs.doc_id, docs.text, strict=True))
    rows = found.select("doc_id", "next_text", "next_entries", "entries").collect()
    assert sorted(r.doc_id for r in rows) == sorted(order)
    after = dict(zip(order, [*order[1:], order[0]], strict=True))
    own = {r.doc_id: r.entries for r in rows}
    assert all(r.next_text == texts[after[r.doc_id]] and r.next_entries == own[after[r.doc_id]] for r in rows)


def result(docs):
    return edited(fingerprints(docs)).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), winnowing.shown(F.col("entries")).alias("fingerprint"),
        winnowing.shown(F.col("edited_entries")).alias("edited_fingerprint"), winnowing.likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        winnowing.likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    ).collect()


def test_odd_texts(spark, odd_texts):
    rng = random.Random(3)
    texts = [*odd_texts, "", None, *("".join(rng.choice("ab é漢😀") for _ in range(n)) for n in (1, 15, 16, 17, 46, 47, 48, 60, 93, 94, 95, 120, 200, 300, 31, 3)), "ab" * 90, "a" * 47]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    data = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, entries int, next_text string")
    check(result(data), docs[::-1])


def test_null_and_equal_ids(spark):
    rows = [(None, "b" * 80), (None, "c" * 80), (4, "z" * 50), (4, "a" * 50), (4, "a" * 50), (9, None)]
    found = result(spark.createDataFrame(rows, "doc_id long, text string"))
    check(found, [(9, None), (4, "a" * 50), (4, "a" * 50), (4, "z" * 50), (None, "b" * 80), (None, "c" * 80)])


def test_one_row_and_empty_table(spark):
    (r,) = result(spark.createDataFrame([(1, "Hello there. " * 9)], "doc_id long, text string"))
    assert r.near_next == 1.0
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_match_guarantee(spark):
    """Texts that share SPAN bytes share an entry, and its positions lie in the shared bytes."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    pairs = []
    for k in range(60):
        common = word(SPAN)
        pairs.append((k, word(rng.randint(0, 90)) + common + word(rng.randint(0, 90)), word(rng.randint(0, 90)) + common + word(rng.randint(0, 90)), common))
    data = spark.createDataFrame(pairs, "k int, a string, b string, c string")
    spots = lambda c: F.transform(winnowed(F.col(c).cast("binary")), lambda e: F.struct(hash_of(e).alias("h"), position_of(e).alias("p")))
    for r in data.select("*", spots("a").alias("x"), spots("b").alias("y")).collect():
        at_a, at_b = r.a.index(r.c), r.b.index(r.c)
        assert {(h, p - at_a) for h, p in r.x} & {(h, p - at_b) for h, p in r.y}


def test_no_python_in_the_plan(spark, sf):
    plan = op12_winnowing(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
