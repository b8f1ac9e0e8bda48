"""Language identification and toxicity."""

import collections
import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tracelake.llm import toxicity
from tracelake.llm.language_id import PART_GRAMS, count_ngrams, fit, labelled, op8_language_id, score_all


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = op8_language_id(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/documents.parquet"), on="doc_id")
    assert len(rows) == 1000
    out = rows[rows.held_out & (rows.n_chars > 20)]
    assert (out.lang == out.lang_pred).mean() > 0.98
    assert rows.score.between(0, 1).all()


def plain_model(rows):
    """Bits of a 4-gram in each language by interpolated Kneser-Ney over plain dictionaries, from (label, text)."""
    counts = {}
    for label, text in rows:
        if label is not None:
            grams = counts.setdefault(label, collections.Counter())
            s = plain_codes(text)
            grams.update(s[k : k + 4] for k in range(len(s) - 3))
    langs = sorted(counts)
    by_order = {x: {4: counts[x]} for x in langs}
    for x in langs:
        for order in (3, 2, 1):
            by_order[x][order] = collections.Counter(g[1:] for g in by_order[x][order + 1])
    heads = {x: {order: collections.defaultdict(lambda: [0, 0]) for order in (1, 2, 3, 4)} for x in langs}
    for x in langs:
        for order, grams in by_order[x].items():
            for g, n in grams.items():
                heads[x][order][g[:-1]][0] += n
                heads[x][order][g[:-1]][1] += 1
    letters = max(2, len(set().union(*(by_order[x][1] for x in langs))))

    def prob(x, gram):
        if not gram:
            return 1 / letters
        total, types = heads[x][len(gram)].get(gram[:-1], (0, 0))
        if not total:
            return prob(x, gram[1:])
        return (max(by_order[x][len(gram)][gram] - 0.75, 0) + 0.75 * types * prob(x, gram[1:])) / total

    return langs, functools.cache(lambda x, gram: -math.log2(prob(x, gram)))


def plain_codes(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    return "\x01\x01 " + " ".join(words) + (" " if words else "")


def test_counts_are_whole(spark, make_docs):
    texts = ["abcd abcd", "Abc", None, ""]
    got = {(r.label, r.key): r.n for r in count_ngrams(make_docs(texts).withColumnRenamed("lang", "label")).collect()}
    want = collections.Counter()
    for s in map(plain_codes, texts):
        for k in range(len(s) - 3):
            want["en", int(np.int64(np.uint64(sum(ord(c) << (16 * (3 - j)) for j, c in enumerate(s[k : k + 4])))))] += 1
    assert got == want


def test_whole_query_equals_plain_model(spark, sf):
    """Every document of the smallest table, its bits and language, by dictionaries and recursion; in one part and in several."""
    docs = labelled(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = docs.collect()
    langs, bits = plain_model([(r.label, r.text) for r in rows])
    one, many = ({r.doc_id: r for r in score_all(docs, n).collect()} for n in (PART_GRAMS, 5000))
    for r in rows:
        s = plain_codes(r.text)
        sums = [sum(bits(x, s[k : k + 4]) for k in range(len(s) - 3)) / max(1, len(s) - 3) for x in langs]
        if any(c.isalpha() for c in r.text or ""):
            assert abs(one[r.doc_id].bits - min(sums)) < 1e-3 and abs(many[r.doc_id].bits - min(sums)) < 1e-3
            assert one[r.doc_id].lang_pred == many[r.doc_id].lang_pred
            assert sums[langs.index(one[r.doc_id].lang_pred)] < min(sums) + 1e-3
        else:
            assert one[r.doc_id].lang_pred == "und" and one[r.doc_id].score == 0


def test_probabilities_sum_to_one(spark):
    texts = ["abab abba baab", "aabb"]
    ends = sorted(set("".join(map(plain_codes, texts))) - {"\x01"})
    asked = ["\x01\x01 a", "a", "b"]
    docs = spark.createDataFrame([(k, "x", t) for k, t in enumerate(texts)], "doc_id int, label string, text string")
    langs, table = fit(docs)
    bits = {r.key: r.bits[0] for r in table.collect()}
    _, plain = plain_model([("x", t) for t in texts])
    assert langs == ["x"] and asked
    for head in {plain_codes(t)[k : k + 3] for t in texts for k in range(len(plain_codes(t)) - 3)}:
        assert abs(sum(2 ** -plain("x", head + c) for c in ends) - 1) < 1e-9
    for key, b in bits.items():
        gram = "".join(chr(key >> (16 * k) & 0xFFFF) for k in (3, 2, 1, 0))
        assert abs(plain("x", gram) - b) < 1e-4


def test_language_odd_texts(spark, make_docs, odd_texts):
    docs = make_docs([*odd_texts, "q", "123 !!", "日本"]).withColumns({"label": F.col("lang"), "bits": F.lit(1), "key": F.lit("x")})
    docs = docs.union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = score_all(docs).collect()
    got = {r.doc_id: r for r in rows}
    assert [got[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and got[len(odd_texts) + 1].lang_pred == "und"
    assert got[len(odd_texts)].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows)
    assert len(rows) == docs.count() and len({(r.lang_pred, r.score) for r in rows if r.doc_id in (3, None)}) == 1
    untrained = docs.withColumn("label", F.lit(None).cast("string"))
    assert {r.lang_pred for r in score_all(untrained).collect()} == {"und"}
    assert score_all(docs.limit(0)).count() == 0
    assert labelled(docs).filter("doc_id is null and label is not null").count() == 0


def test_toxicity_learns_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op4_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    out = rows[rows.held_out]
    assert (out.predicted == out.toxic).mean() > 0.95
    assert ((rows.score >= 0.5) == (rows.predicted == 1)).all() and rows.score.between(0, 1).all()


def test_thresholds_count_every_labelled_row(spark, make_docs):
    """A rare language is calibrated by rows beyond the sample of the fit, as a kind of its own that texts alone tell."""
    en, es = "the of and to in is that it", "el los las y por una del para"
    texts = [f"{en if k % 10 else es} {'idiot' if k % 3 == 0 else 'garden'} w{k}" for k in range(3000)]
    docs = make_docs(texts).withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "es").otherwise("en"))
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(3000)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, 600)
    counts = toxicity.label_counts(toxicity.raw_scores(docs, model), labels, model.fitted)
    pool = {r.doc_id for r in docs.select("doc_id").filter(~toxicity.held_out(F.col("doc_id"))).collect()} - set(model.fitted)
    kind = model.kinds(texts)
    assert not set(kind[::10]) & set(kind[[i for i in range(3000) if i % 10]])
    for k in set(kind):
        own = [i for i in pool if kind[i] == k]
        assert sum(r[4] for r in counts if r[0] == k) == sum(i % 3 == 0 for i in own)
        assert sum(r[5] for r in counts if r[0] == k) == sum(i % 3 != 0 for i in own)
    got = {r.doc_id: r.score for r in toxicity.score_all(docs, labels, 600).collect()}
    assert np.mean([(got[k] >= 0.5) == (k % 3 == 0) for k in range(0, 3000, 10)]) > 0.95


def test_scores_do_not_depend_on_lang_source_or_ids_order(spark):
    """lang, source and n_chars may be missing, null or shuffled."""
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = lambda d: sorted((r.doc_id, r.score) for r in toxicity.score_all(d, labels).collect())
    whole = scores(docs)
    assert whole == scores(docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.col("lang")}))
    assert whole == scores(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x").otherwise("y")).drop("n_chars"))


def test_kinds_tell_languages_of_the_documents(spark):
    """Clusters of letter pairs hold one language nearly alone, and most languages' labels calibrate clusters of their own."""
    sf = "/root/testdata/sf0.1"
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    docs = docs[docs.n_chars > 100]
    docs = docs.assign(kind=model.kinds(docs.text.tolist())).merge(labels, on="doc_id", how="left")
    mixed = docs.groupby("kind").lang.agg(lambda x: x.value_counts(normalize=True, dropna=False).iloc[0])
    sizes = docs.groupby("kind").size()
    assert (mixed * sizes).sum() / sizes.sum() > 0.95
    enough = docs.groupby(["kind", "lang"]).toxic.agg([lambda x: (x == 1).sum(), lambda x: (x == 0).sum()]).min(axis=1)
    assert len(set(enough[enough >= toxicity.LEAST_LABELS].reset_index().lang)) >= 2


def test_each_language_has_its_own_threshold():
    row = lambda lang, b, toxic, clean: (lang, b, b / 64, b / 64, toxic, clean)
    moves = toxicity.thresholds([row(0, 0, 0, 500), row(0, 64, 500, 0), row(3, 128, 0, 30), row(3, 192, 30, 0), row(1, 0, 5, 0), row(1, 64, 0, 5)], 4)
    assert moves[0] == 0.5 and moves[3] == 2.5 and moves[1] == moves[2] == moves[4] == 0.5


def test_threshold_equals_trying_all():
    rng = np.random.default_rng(2)
    for _ in range(50):
        edges = np.sort(rng.normal(size=12))
        bins = [(x, x, int(a), int(b)) for x, a, b in zip(edges, rng.integers(0, 4, 12), rng.integers(0, 9, 12), strict=True)]
        cost = lambda t: sum(toxicity.MISS_COST * a * (x < t) + b * (x >= t) for x, _, a, b in bins)  # noqa: E731, B023
        assert cost(toxicity.threshold(bins) + 1e-12) <= min(cost(t) for t in [*edges, edges[-1] + 1]) or cost(toxicity.threshold(bins)) <= min(cost(t) for t in [*edges, edges[-1] + 1])


def test_toxicity_odd_texts(spark, make_docs, odd_texts):
    docs = make_docs(odd_texts).withColumns({"_id": F.lit("x"), "z": F.lit(1), "label": F.lit(2)})
    docs = docs.union(docs.filter("doc_id = 3")).union(docs.filter("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_all(docs, labels([])).collect()} == {0.0}
    assert {r.score for r in toxicity.score_all(docs, labels([(k, 1, 1) for k in range(10)])).collect()} == {1.0}
    both = toxicity.score_all(docs, labels([*((k, 1, k % 2) for k in range(10)), (None, 1, 1), (4, 1, None)])).collect()
    assert len(both) == docs.count() and all(0 <= r.score <= 1 for r in both) and len({round(r.score, 6) for r in both if r.doc_id in (3, None)}) == 1
    assert toxicity.score_all(docs.limit(0), labels([(1, 1, 0), (2, 1, 1)])).count() == 0


def test_bounds_of_the_fit(spark, make_docs):
    docs = make_docs(["word " * (10 + k) for k in range(60)])
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    ids = toxicity.chosen_ids(docs, labels, 20, 2000)
    assert 0 < len(ids) <= 20 and sum(5 * (10 + k) for k in ids) <= 2000


def test_pooling_equals_plain_loops():
    """Scores by loops over filters and windows of one text at a time, whatever texts lie beside it."""
    m = toxicity.TextCnn()
    texts = ["a b c", "", "idiot word", "x " * 500, "one"]
    for text, got in zip(texts, m.scores(texts), strict=True):
        rows, offsets = toxicity.features([text])
        x = m.table[rows].sum(1)
        z = float(m.start)
        for j, (w, f) in enumerate(zip(toxicity.WIDTHS, m.filters, strict=True)):
            for c in range(toxicity.FILTERS):
                best = max(sum(float(x[i + k] @ f[k, :, c]) for k in range(w) if i + k < len(x)) if rows[i, 0] else 0.0 for i in range(offsets[1]))
                z += max(best + float(m.bias[j * toxicity.FILTERS + c]), 0.0) * float(m.out[j * toxicity.FILTERS + c])
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-4


def test_gradients_equal_differences():
    m = toxicity.TextCnn(3)
    rows, offsets = toxicity.features(["a bad idiot here", "a fine garden", "idiot", "the end of it all"])
    y, weight = np.array([1, 0, 1, 0]), np.array([2, 1, 2, 1], np.float32)
    for name in ("table", "bias", "out"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    m.filters = [f.astype(np.float64) for f in m.filters]
    m.bias += 0.3

    def loss():
        x = m.table[rows].sum(1)
        z = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            tops = [max((sum(x[i + k] @ f[k, :, c] for k in range(w) if i + k < len(x)) if rows[i, 0] else 0.0) for i in range(a, b)) for w, f in zip(toxicity.WIDTHS, m.filters, strict=True) for c in range(toxicity.FILTERS)]
            z.append(np.maximum(np.array(tops) + m.bias, 0) @ m.out + m.start)
        p = 1 / (1 + np.exp(-np.array(z)))
        return float((weight * -(y * np.log(p) + (1 - y) * np.log(1 - p))).mean())

    g, rng = m.gradients(rows, offsets, y, weight), np.random.default_rng(1)
    checks = [(m.out, k, g["out"][k]) for k in rng.integers(0, 48, 6)] + [(m.bias, k, g["bias"][k]) for k in rng.integers(0, 48, 6)]
    checks += [(f, at, own[at]) for f, own in zip(m.filters, g["filters"], strict=True) for at in [tuple(rng.integers(0, n) for n in f.shape) for _ in range(6)]]
    checks += [(m.table, (s, d), g["table"][i, d]) for i, s in enumerate(g["slots"][:8]) if s for d in (0, 5)]
    for array, at, want in checks:
        old = array[at]
        array[at] = old + 1e-5
        up = loss()
        array[at] = old - 1e-5
        down = loss()
        array[at] = old
        assert abs((up - down) / 2e-5 - want) < 2e-3 * max(1, abs(want)), (array.shape, at)
