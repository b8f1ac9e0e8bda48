import random

import numpy as np
import pandas as pd

from tracelake.llm.decontamination import align, drop_leaks, judge, op5_decontamination, reach, text_words


def plain_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(1, 15))] for _ in range(2))
        assert align(np.array(a, np.uint64), np.array(b, np.uint64)) == plain_align(a, b)


def test_whole_table_finds_every_copy(spark, sf):
    docs, bench = (pd.read_parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = {r.doc_id: r for r in op5_decontamination(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, text in zip(docs.doc_id, docs.text, strict=True):
        for k, item in zip(bench.item_id, bench.text, strict=True):
            if item in text:
                assert k in rows[i].item_ids and rows[i].contaminated


def test_recall_against_all_pairs(spark, sf, make_docs):
    """Alignment of every item with every whole text: of what reaches the threshold at least 0.95 is found, and nothing else."""
    rng = random.Random(8)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:25]
    words = [w for _, t in items for w in t.split()]
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and len(r.text) < 3000][:60]
    for _, text in items:
        for rate in (0.05, 0.15, 0.25, 0.35):  # copies with words changed, left out and put in
            out = []
            for w in text.split():
                x = rng.random()
                out += [w] if x > rate else [rng.choice(words)] if x > 0.6 * rate else [] if x > 0.3 * rate else [w, rng.choice(words)]
            texts.append(" ".join([*rng.choices(words, k=20), *out, *rng.choices(words, k=20)]))
    h, offsets = text_words(texts)
    b, cuts = text_words([t for _, t in items])
    want = set()
    for d in range(len(texts)):
        for k, (i, _) in enumerate(items):
            item = b[cuts[k] : cuts[k + 1]]
            if len(item) and align(item, h[offsets[d] : offsets[d + 1]]) >= 0.5 * 2 * len(item):
                want.add((d, i))
    rows, x = judge(make_docs(texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, m.item_id) for r in rows.collect() for m in r[x]}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) > 60


def test_edited_copies_and_clean_texts(spark, make_docs):
    rng = random.Random(5)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    item = words(40)
    edited = [w if rng.random() > 0.15 else "changed" for w in item]
    shorter = item[:10] + item[14:]
    texts = [" ".join(words(50) + x + words(50)) for x in (item, edited, shorter, words(40))] + [" ".join(item).upper().replace(" ", ", "), None, ""]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "two words"), (4, "")], "item_id long, text string")
    rows, x = judge(make_docs(texts), bench)
    got = {r.doc_id: [m.item_id for m in r[x]] for r in rows.collect()}
    assert got == {0: [1], 1: [1], 2: [1], 3: [], 4: [1], 5: [], 6: []}
    blocks, x = judge(make_docs(texts), bench, block=1)
    assert {r.doc_id: [m.item_id for m in r[x]] for r in blocks.collect()} == got


def test_widely_copied_item_keeps_all_seeds(spark, make_docs):
    """Full copies make every triple frequent; a copy of the tail alone, and one with an edited head, are found all the same."""
    rng = random.Random(11)
    words = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]
    item = words(40)
    edited = ["changed" if i < 20 and i % 3 == 2 else w for i, w in enumerate(item)]
    texts = [" ".join(words(30) + x + words(30)) for x in (item[19:], edited, item[:8], words(40))] + [" ".join(words(9) + item) for _ in range(6)]
    rows, x = judge(make_docs(texts), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id for r in rows.collect() if r[x]} == {0, 1, *range(4, 10)}


def test_passed_over_windows_cannot_align():
    rng = random.Random(3)
    for _ in range(300):
        a, b = (np.array([rng.randint(0, 9) for _ in range(rng.randint(1, 25))], np.uint64) for _ in range(2))
        assert align(a, b) <= min(reach(a, b), reach(b, a))


def test_stage_drops_only_leaks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r.doc_id for r in op5_decontamination(spark, sf).filter("contaminated").collect()}
    kept = drop_leaks(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad and kept.columns == docs.columns
    empty = judge(docs.limit(0), spark.read.parquet(f"{sf}/benchmark.parquet"))[0]
    assert empty.count() == 0
