import collections
import math
import re

import pandas as pd
import pytest
import xxhash

from tracelake.llm.quality_rules import BUCKETS, SMOOTHING, THRESHOLD, fit_ratio, judge, keep_good, op2_quality_rules


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = collections.Counter(triples)
    covered = {k + j for k, t in enumerate(triples) if n[t] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_base_of_whole_table(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    rows = op2_quality_rules(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_base_of_odd_texts(spark, make_docs, odd_texts):
    texts = [*odd_texts, "a b c a b c x", "l1\nl2\nl1\n\nl2\nl1", "q w e " * 40, "#$ | <>"]
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows, q = judge(make_docs(texts), labels)
    for r in rows.collect():
        x = r[q]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == base(texts[r.doc_id])
        assert x.score == 0 and x.kept != x.base_failed


def test_ratio_against_plain_counts(spark, make_docs):
    texts = ["good fine good", "bad awful", "good"]
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = fit_ratio(make_docs(texts), labels, buckets=64)
    hashed = lambda *w: spark.sql(f"select pmod(xxhash64({', '.join(repr(x) for x in w)}), 64) as b").first().b
    raw, target = collections.Counter(), collections.Counter()
    for k, t in enumerate(texts):
        w = t.split()
        grams = [hashed(x) for x in w] + [hashed(a, b) for a, b in zip(w, w[1:], strict=False)]
        raw.update(grams)
        target.update(grams if k == 0 else [])
    for b in range(64):
        want = math.log((target[b] + SMOOTHING) / (target.total() + 64 * SMOOTHING)) - math.log((raw[b] + SMOOTHING) / (raw.total() + 64 * SMOOTHING))
        assert abs(got[b] - want) < 1e-12


def plain_grams(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    one = [xxhash.xxh64_intdigest(w, seed=42) for w in words]
    return [h % BUCKETS for h in one + [xxhash.xxh64_intdigest(b, seed=h) for h, b in zip(one, words[1:], strict=False)]]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_scores_and_verdicts_of_whole_tables(spark, sf, size):
    folder = sf.replace("sf0.001", size)
    docs = pd.read_parquet(f"{folder}/documents.parquet")
    good = set(pd.read_parquet(f"{folder}/labels.parquet").query("quality == 1").doc_id)
    grams = [plain_grams(t) for t in docs.text]
    raw, target = collections.Counter(), collections.Counter()
    for d, g in zip(docs.doc_id, grams, strict=True):
        raw.update(g)
        target.update(g if d in good else [])
    sums = (target.total(), raw.total())
    share = lambda n, total: math.log((n + SMOOTHING) / (total + SMOOTHING * BUCKETS))
    ratio = {b: share(target[b], sums[0]) - share(raw[b], sums[1]) for b in raw}
    found = {r.doc_id: r for r in op2_quality_rules(spark, folder).collect()}
    assert len(found) == len(docs) == docs.doc_id.nunique()
    for d, g, t in zip(docs.doc_id, grams, docs.text, strict=True):
        score = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert found[d].score == pytest.approx(score, abs=1e-9)
        if abs(score - THRESHOLD) > 1e-9:
            assert found[d].kept == (not base(t)[5] and score >= THRESHOLD)
    assert len({r.kept for r in found.values()}) == 2


def test_clashing_columns_and_empty_table(spark, make_docs):
    docs = make_docs(["w " * 60 + "end"]).withColumnRenamed("source", "_quality").withColumnRenamed("lang", "n_words")
    rows, q = judge(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert q == "_quality_" and set(docs.columns) < set(rows.columns)
    assert judge(make_docs([]).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))[0].count() == 0


def test_stage_keeps_labelled_good_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in keep_good(spark, docs, sf).collect()}
    good = {r.doc_id for r in op2_quality_rules(spark, sf).filter("not base_failed").collect()} & set(pd.read_parquet(f"{sf}/labels.parquet").query("quality == 1").doc_id)
    assert len(good & kept) >= 0.98 * len(good)
    assert keep_good(spark, docs, sf).columns == docs.columns
