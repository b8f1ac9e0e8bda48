import functools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm.packing import CAPACITY, CapacityTree, RunEncoder, best_fit, op6_best_fit_packing, pack, vocabulary_path


def plain_best_fit(lengths, capacity):
    bins, where = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(b, k) for k, b in enumerate(bins) if b >= lengths[i]]
        if fits:
            _, k = min(fits)
        else:
            bins.append(capacity)
            k = len(bins) - 1
        bins[k] -= lengths[i]
        where[i] = k
    return len(bins), bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_best_fit_decreasing(lengths):
    bins, offsets = best_fit(np.array(lengths, np.int64), 40)
    n, left = plain_best_fit(lengths, 40)
    assert len(set(bins.tolist())) == n
    for b in set(bins.tolist()):
        own = sorted((o, x) for o, x, c in zip(offsets.tolist(), lengths, bins.tolist(), strict=True) if c == b)
        at = 0
        for o, x in own:
            assert o == at
            at += x
        assert at <= 40


def test_capacity_tree():
    tree, marked, rng = CapacityTree(64), set(), random.Random(1)
    for _ in range(3000):
        at = rng.randint(0, 64)
        tree.set(at, 1) if rng.random() < 0.5 else tree.set(at, 0)
        marked.add(at) if tree.some[at + tree.size] else marked.discard(at)
        least = rng.randint(0, 64)
        assert tree.tightest(least) == min((m for m in marked if m >= least), default=-1)


@functools.cache
def encoder():
    return RunEncoder(vocabulary_path())


@pytest.mark.parametrize("text", ["", "don't I'Ve it's 'sun 12ab3 a.b,,c", "ΑΣ Σ İstanbul Straße ﬁ e\u0301", "中文 😀👍🏽 x\u200by a\x1cb", "<|endoftext|> hi", "\u00a0a\u3000b Ⅷ²½_a_", "a" * 3000, "\u1f25\u0130\u0317", "\u0130\u0317"])
def test_runs_equal_tokenizer(text):
    enc = RunEncoder(vocabulary_path())
    assert enc.encode([text]) == enc._ids([text])


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aIiZ\u0130\u0131\u0307\u0317\u0345\u0301\u030a\u212b\u03a3\u03c2\u03b9\u1fb3\u1fbc\u00c5\u1e9e\ufb01\u0958\u1100\u1161\uac00 .'\u2126\u00a0\u3000\u200b9²😀漢"), max_size=24))
def test_any_text_equals_tokenizer(text):
    assert encoder().encode([text, text + " x"]) == encoder()._ids([text, text + " x"])


def test_every_plain_character_equals_tokenizer():
    plain = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not encoder().other(c)]
    texts = [f"a{c}b {c}{c} 1{c}'s{c}, {c}" for c in plain] + [f"{a}{b}" for a, b in zip(plain, plain[7:])]
    assert len(plain) > 700 and encoder().encode(texts) == encoder()._ids(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_unicode_equals_tokenizer(text):
    assert encoder().encode([text]) == encoder()._ids([text])


def test_whole_table(spark, sf):
    from tokenizers import Tokenizer

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op6_best_fit_packing(spark, sf).collect()
    tok = Tokenizer.from_file(vocabulary_path())
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for i, own in by_doc.items():
        ids = np.array([*tok.encode(docs[i], add_special_tokens=False).ids, 0], "<u4")
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            part = ids[CAPACITY * k : CAPACITY * (k + 1)]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (k, CAPACITY * k, len(part), zlib.crc32(part.tobytes()))
        assert sum(r.length for r in own) == len(ids)
    for own in by_seq.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
    assert len(by_seq) <= 1.02 * sum(r.length for r in rows) / CAPACITY + 1


def test_odd_texts(spark, make_docs, odd_texts):
    rows = pack(make_docs(odd_texts).withColumnRenamed("source", "_shard")).collect()
    assert {r.doc_id for r in rows} == set(range(len(odd_texts)))
    assert all(r.length == 1 for r in rows if r.doc_id < 3)
    assert pack(make_docs(["x"]).limit(0)).count() == 0
