import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import suffix_dedup
from tracelake.llm.deep_shallow import BlindTrie, order_windows
from tracelake.llm.suffix_dedup import SPAN, drop_repeats, op7_suffix_dedup, reduced


def plain(rows):
    """(n_bytes, n_removed, n_spans, sha) of each (doc_id, text) from all strings of all texts."""
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - SPAN + 1):
            w = b[s : s + SPAN]
            if i is not None:
                least[w] = min(least.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - SPAN + 1):
            if i is not None and least[b[s : s + SPAN]] < i:
                gone[s : s + SPAN] = [True] * SPAN
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def run(docs):
    rows, x = reduced(docs)
    return sorted(((r.doc_id, r[x].n_bytes, r[x].n_removed, r[x].n_spans, hashlib.sha256(bytes(r[x].kept)).hexdigest()) for r in rows.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in op7_suffix_dedup(spark, sf).collect()) == sorted(plain(rows))


def adversarial():
    rng = random.Random(9)
    letters = lambda n, of="abcdefghijklmnop": "".join(rng.choice(of) for _ in range(n))
    shared = letters(130)
    texts = [letters(rng.randint(0, 80)) + shared[rng.randint(0, 40) : rng.randint(80, 130)] + letters(rng.randint(0, 80)) for _ in range(40)]
    texts += [shared, shared, shared[:49], shared[:50], shared[:51], "a" * 300, "a" * 120 + "b", "ab" * 100, letters(300, "ab"), letters(300, "ab"), "é" * 60, "xé" + "é" * 60, None, "", " "]
    return texts


def test_planted_strings(spark, make_docs):
    texts = adversarial()
    assert run(make_docs(texts)) == sorted(plain(list(enumerate(texts))), key=str)


def test_crowded_anchors_give_the_same(spark, make_docs, monkeypatch):
    texts = adversarial()
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    import pyspark.cloudpickle as cp

    cp.register_pickle_by_value(suffix_dedup)
    try:
        assert run(make_docs(texts)) == sorted(plain(list(enumerate(texts))), key=str)
    finally:
        cp.unregister_pickle_by_value(suffix_dedup)


def by_value(monkeypatch, **changed):
    """suffix_dedup with other globals, in tasks too."""
    import pyspark.cloudpickle as cp

    for k, v in changed.items():
        monkeypatch.setattr(suffix_dedup, k, v)
    cp.register_pickle_by_value(suffix_dedup)
    return lambda: cp.unregister_pickle_by_value(suffix_dedup)


def test_small_pieces_and_many_parts_give_the_same(spark, make_docs, monkeypatch):
    texts = adversarial() * 2
    done = by_value(monkeypatch, AT_ONCE=700, HASHED_AT_ONCE=300, PART_BYTES=400, BUCKET_PARTS=3)
    try:
        assert run(make_docs(texts)) == sorted(plain(list(enumerate(texts))), key=str)
    finally:
        done()


def test_colliding_hashes_give_the_same(spark, make_docs, monkeypatch):
    texts = adversarial()
    done = by_value(monkeypatch, mix64=lambda x: x & np.uint64(7))
    try:
        assert run(make_docs(texts)) == sorted(plain(list(enumerate(texts))), key=str)
    finally:
        done()


def test_a_piece_of_text_sends_one_blob_to_a_part(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(x) for x in rng.choice(list("abcdefgh"), (1500, 2000))]
    rows = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, mark long, text string").coalesce(1)
    found = suffix_dedup.find_anchors(rows, 64).select("part").collect()
    assert len({r.part for r in found}) == 64 and len(found) == 64  # for 3 MB it was one each 0.6 MB


def test_only_strings_of_several_documents_are_ordered():
    sig, own = np.array([5, 7, 5, 9, 7, 5], np.uint64), np.array([1, 2, 3, 4, 2, 1])
    assert suffix_dedup.shared(sig, own).tolist() == [0, 2, 5]
    assert suffix_dedup.shared(sig[:0], own[:0]).tolist() == []


def test_joins_beyond_the_broadcast_limit(spark, make_docs, monkeypatch):
    texts = adversarial()
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    assert run(make_docs(texts)) == sorted(plain(list(enumerate(texts))), key=str)


def test_null_and_repeated_ids(spark):
    t = "the quick brown fox jumps over the lazy dog again and again until night falls"
    rows = [(None, t), (1, t), (1, t), (2, t + "!"), (None, t)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == sorted(plain(rows), key=str)
    assert reduced(docs.limit(0))[0].count() == 0


def test_ids_of_other_types(spark):
    t = "the quick brown fox jumps over the lazy dog again and again until night falls"
    rows = [("b", t), ("a", t + " x"), (None, t), ("10", t + "!"), ("9", "short")]
    assert run(spark.createDataFrame(rows, "doc_id string, text string")) == sorted(plain([(i, t) for i, t in rows]), key=str)


def test_stage(spark, make_docs):
    texts = ["é" * 60 + " first", "x" + "é" * 60 + " second text", "é" * 60 + " first", None]
    docs = make_docs(texts).withColumnRenamed("source", "_kept")
    out = {r.doc_id: r for r in drop_repeats(spark, docs, "").collect()}
    assert set(out) == {0, 1, 3} and out[0].text == texts[0] and out[1].text == "xsecond text" and out[3].text is None
    assert out[1].n_chars == len(out[1].text)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=45, max_size=45), min_size=1, max_size=40))
def test_deep_shallow_order(strings):
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    starts = np.arange(len(data) - 44)
    order, rank = order_windows(data, starts, 45)
    raw = data.tobytes()
    got = [raw[s : s + 45] for s in starts[order]]
    assert got == sorted(got)
    assert rank.tolist() == np.unique(np.array(got), return_inverse=True)[1].tolist()


@given(st.lists(st.binary(min_size=6, max_size=6), max_size=60))
def test_blind_trie(strings):
    trie = BlindTrie()
    for k, s in enumerate(strings):
        trie.add(s, k)
    assert [strings[g[0]] for g in trie.groups()] == sorted(set(strings))
    assert all(len({strings[k] for k in g}) == 1 for g in trie.groups())
