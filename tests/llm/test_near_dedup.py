import collections
import math
import random

import numpy as np

from tracelake.llm.components import connected_components
from tracelake.llm import near_dedup
from tracelake.llm.near_dedup import LEVEL, Weights, block_links, classes, contents, distinct, keep_one, op9_near_dedup, samples, shingle_weights, shingles, similarity


def shingle_set(t):
    w = (t or "").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else {()}


def shingle_counts(t):
    w = (t or "").split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter([()])


def plain_classes(rows):
    """Union of all pairs with a weighted Jaccard similarity of 0.8 or more, weights from exact document frequencies of shingles."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    counts = [shingle_counts(t) for _, t in rows]
    df = collections.Counter(h for c in counts for h in c)
    level = {h: round(LEVEL * (1 + math.log(len(rows) / n) / math.log(max(2, len(rows))))) for h, n in df.items()}
    total = [sum(level[h] * n for h, n in c.items()) for c in counts]
    index = collections.defaultdict(list)
    for k, c in enumerate(counts):
        for h in c:
            index[h].append(k)
    for k, c in enumerate(counts):
        shared = collections.Counter()
        for h, n in c.items():
            for j in index[h]:
                if j < k:
                    shared[j] += level[h] * min(n, counts[j][h])
        for j, x in shared.items():
            if x >= 0.8 * (total[k] + total[j] - x):
                parent[find(k)] = find(j)
    groups = collections.defaultdict(set)
    for k, (i, _) in enumerate(rows):
        groups[find(k)].add(i)
    return {frozenset(g) for g in groups.values()}


def found_classes(rows):
    groups = collections.defaultdict(set)
    for r in rows:
        groups[r.class_id].add(r.doc_id)
    return {frozenset(g) for g in groups.values()}


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found_classes(op9_near_dedup(spark, sf).collect()) == plain_classes(rows)


def test_chain_of_near_copies_is_one_class(spark, make_docs):
    """Neighbours are alike, ends are not; a star around one text would lose links."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    texts = []
    for k in range(30):
        texts.append(" ".join(words))
        words = [*words]
        words[7 * k + 3] = f"edit{k}"
        words[399 - 5 * k] = f"tide{k}"
    texts += [" ".join(rng.choice(words) for _ in range(300)) for _ in range(5)]
    got = found_classes(classes(make_docs(texts)).collect())
    assert got == plain_classes(list(enumerate(texts)))


def test_odd_texts(spark, make_docs, odd_texts):
    rows = {r.doc_id: r for r in classes(make_docs(odd_texts).withColumnRenamed("source", "node")).collect()}
    assert rows[0].class_id == rows[1].class_id == 0 and rows[2].class_id == 2
    assert rows[4].class_id == 3 and rows[7].class_id == 6 and rows[4].class_size == 2
    assert classes(make_docs(["x"]).limit(0)).count() == 0


def test_sampling_agrees_with_weighted_similarity():
    rng = np.random.default_rng(1)
    key = rng.integers(1, 2**63, 400).astype(np.uint64)
    level = rng.uniform(100, 255, 400).astype(np.float32)
    a, b = np.arange(0, 320), np.arange(60, 400)
    out = samples(np.concatenate((key[a], key[b])), np.concatenate((level[a], level[b])), np.array([0, len(a), len(a) + len(b)]), bands=1500, rows=1)
    want = level[60:320].sum() / level.sum()
    assert abs((out[0] == out[1]).mean() - want) < 0.05


def test_similarity_and_blocks_equal_plain(spark, make_docs):
    texts = ["a b c d e f g h", "a b c d e f g h i", "a b c d e f a b c d e f", "z", ""]
    df = make_docs(texts).selectExpr("cast(cast(doc_id as string) as binary) as node", "text")
    bodies = {int(r.node): bytes(r.body) for r in contents(df, Weights(np.zeros(1, np.int64), 5)).collect()}
    assert abs(similarity(bodies[0], bodies[1]) - 4 / 5) < 1e-9
    assert similarity(bodies[0], bodies[3]) == 0 and similarity(bodies[4], bodies[4]) == 1
    assert abs(similarity(bodies[0], bodies[2]) - 2 / 10) < 1e-9  # an occurrence counts
    assert block_links([0, 1, 2], [bodies[0], bodies[1], bodies[2]], np.zeros(3)) == [(0, 1)]


def test_document_frequencies(spark, make_docs):
    """Every document adds one to the counter of each of its shingles, whatever the partitions."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abc") for _ in range(8)) for _ in range(300)] + [None, ""]
    w = shingle_weights(make_docs(texts).repartition(7))
    df = collections.Counter(h for t in texts for h in set(shingle_counts(t)) if h)
    for h, n in df.items():
        key, _ = shingles([" ".join(h)])
        assert abs(int(w.of(key)[0]) - LEVEL * (1 + math.log(len(texts) / n) / math.log(len(texts)))) <= 1


def test_null_and_equal_ids(spark):
    """Near copies without ids are linked, to each other and to a row with one; texts that share an id are told apart."""
    rng = random.Random(5)
    words = [f"w{rng.randint(0, 9**6)}" for _ in range(200)]
    near = " ".join(words)
    nearer = " ".join([*words[:-1], "edit"])
    other, third = (" ".join(f"v{rng.randint(0, 9**6)}" for _ in range(100)) for _ in range(2))
    docs = spark.createDataFrame([(None, near), (7, nearer), (5, other), (5, near + " end"), (None, third), (None, None)], "doc_id long, text string")
    got = {r.text: (r.class_id, r.class_size) for r in classes(docs).join(docs.selectExpr("text", "unhex(md5(coalesce(text, ''))) as node"), "node").collect()}
    assert got[near] == got[nearer] == got[near + " end"] == (5, 3) and got[other] == (5, 1) and got[third] == (None, 1) and got[None] == (None, 1)
    kept = sorted(str(r.text) for r in keep_one(spark, docs, "").collect())
    assert kept == sorted([near + " end", other, third, "None"])


def test_joins_beyond_the_broadcast_limit(spark, make_docs, monkeypatch):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 9**6)}" for _ in range(80)]
    texts = [" ".join(base[:k] + [f"edit{k}"] + base[k + 1 :]) if k % 2 else f"text {k} " * 9 for k in range(30)] + [None, " ".join(base), " ".join(base)]
    docs = make_docs(texts)
    few, kept = found_classes(classes(docs).collect()), sorted(r.doc_id for r in keep_one(spark, docs, "").collect())
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    assert found_classes(classes(docs).collect()) == few and sorted(r.doc_id for r in keep_one(spark, docs, "").collect()) == kept


def test_one_large_bucket(spark, make_docs, monkeypatch):
    """Hundreds of near copies of a text, and of another that is 0.6 alike to it, in small blocks: two classes, whatever is hot."""
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 9**6)}" for _ in range(150)]
    half = base[:110] + [f"u{rng.randint(0, 9**6)}" for _ in range(40)]
    texts = []
    for k in range(260):
        own = list(base if k % 2 else half)
        own[rng.randrange(150)] = f"edit{k}"
        texts.append(" ".join(own))
    monkeypatch.setattr(near_dedup, "BLOCK", 20)
    assert found_classes(classes(make_docs(texts)).collect()) == plain_classes(list(enumerate(texts)))


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(30)] + [(7, 7)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[k] == 0 for k in range(41))
    for a, b in edges:
        if a != b:
            assert got[a] == got[b] <= min(a, b)


def test_distinct_counts():
    key, offsets = shingles(["a b c d e a b c d e a b c d e", "", "x"])
    k, n, o = distinct(key, offsets)
    assert n.sum() == len(key) and o.tolist() == [0, 5, 5, 6]


def test_stage_keeps_one_of_each(spark, make_docs):
    docs = make_docs(["p q r s t u v w"] * 3 + ["other words are in this text"])
    docs = docs.union(docs.filter("doc_id = 0"))  # a repeated row
    kept = keep_one(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3] and kept.columns == docs.columns
