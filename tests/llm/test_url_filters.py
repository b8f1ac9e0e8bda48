import collections
import itertools
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from tracelake.llm.url_filters import LISTED, MIN_CONFIDENCE, MIN_KNOWN, MIN_LIFT, MIN_SUPPORT, SLOTS, host_and_path, judge, mine, mined_verdict, op3_url_filters, tokens_of


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def listed(url):
    host, path = parts(url)
    fits = [r for r in LISTED if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2])) if fits else None


def test_listed_rules_on_whole_table(spark, sf):
    urls = pd.read_parquet(f"{sf}/pages.parquet").set_index("page_id").url
    for r in op3_url_filters(spark, sf).collect():
        rule = listed(urls[r.page_id])
        assert (r.host, r.path) == parts(urls[r.page_id])
        assert r.rule == (rule and rule[1] + rule[2]) and r.verdict in ("allow", "block")
        assert rule is None or r.verdict == rule[0]


def test_odd_urls(spark):
    urls = [None, "", "no-scheme/com/en/", "http://", "HTTP://EXAMPLE.COM/en/7?x", "x://com/en/1", "x://notcom/en/1", "x://a.com?q=/en/", "x://a.com#f", "ftp://B.İ.org/es/", "a://b://c/d", "x://" + "a" * 50_000 + ".net/de/"]
    df = spark.createDataFrame([(k, u, "r") for k, u in enumerate(urls)], "page_id long, url string, _url string")
    rows, name = judge(df)
    assert name == "_url_"
    for r in rows.collect():
        rule = listed(urls[r.page_id])
        assert (r[name].host, r[name].path) == parts(urls[r.page_id]) and r[name].rule == (rule and rule[1] + rule[2])
    assert judge(df.limit(0))[0].count() == 0


def plain_rules(rows, support, confidence, lift, known):
    """All rules by counting every combination of every row."""
    have, labelled, hit = (collections.Counter() for _ in range(3))
    shares = collections.Counter(v for _, v in rows if v)
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                have[c] += 1
                if verdict:
                    labelled[c] += 1
                    hit[c, verdict] += 1
    out = {}
    for (c, v), n in hit.items():
        sure = n / labelled[c]
        if n >= support * len(rows) and sure >= confidence and sure >= lift * shares[v] / sum(shares.values()) and labelled[c] >= known * have[c]:
            out[c, v] = sure
    return out


def plain_verdict(tokens, rules):
    fits = [(round(c, 9), v) for (t, v), c in rules.items() if set(t) <= set(tokens)]
    return max(fits)[1] if fits else None


def random_rows(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        tokens = [f"{slot}:{rng.choice('xyz')}" for slot in "abcde" if rng.random() < 0.8]
        bad = "a:x" in tokens and "b:y" in tokens
        verdict = None if rng.random() < 0.5 else "block" if bad or rng.random() < 0.2 else "allow"
        rows.append((tokens, verdict))
    return rows


def test_mined_rules_and_verdicts_equal_counting(spark):
    for seed in range(3):
        rows = random_rows(seed)
        want = plain_rules(rows, 0.02, 0.8, 1.1, 0.3)
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, tokens array<string>, verdict string")
        found = mine(df.select("tokens", "verdict"), 0.02, 0.8, 1.1, 0.3)
        assert all(abs(want[tuple(r["tokens"]), r["verdict"]] - r["confidence"]) < 1e-8 for r in found) and any(len(r["tokens"]) > 1 for r in found)
        got = {r.k: r.m for r in df.select("k", mined_verdict(spark, F.col("tokens"), found).alias("m")).collect()}
        assert got == {k: plain_verdict(t, want) for k, (t, _) in enumerate(rows)}


def test_unlabelled_rows_are_no_evidence(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 6 + [(["b", "d"], None)] * 8 + [(["e", "b"], None)] * 3
    found = mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.9, 1.1, 0.3)
    assert {(tuple(r["tokens"]), r["verdict"], r["confidence"]) for r in found} == {(("b",), "block", 1.0), (("c",), "allow", 1.0)}
    assert mine(spark.createDataFrame([(["a"], None)], "tokens array<string>, verdict string")) == []


def test_mined_rules_decide(spark):
    """URLs that no listed rule fits, but that look like blocked ones, are blocked; the whole table equals a match by counting."""
    sf = "/root/testdata/sf0.1"
    rows = op3_url_filters(spark, sf).collect()
    free = [r for r in rows if r.rule is None and r.host]
    assert sum(r.verdict == "block" for r in free) > 50 and sum(r.verdict == "allow" for r in free) > 50
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    host, path = host_and_path(F.col("url"))
    tokens = {r.page_id: r.t for r in pages.select("page_id", tokens_of(F.col("url"), host, path).alias("t")).collect()}
    urls = {r.page_id: r.url for r in pages.collect()}
    rules = plain_rules([(tokens[k], (listed(u) or [None])[0]) for k, u in urls.items()], MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT, MIN_KNOWN)
    assert {r.page_id: r.verdict for r in free} == {r.page_id: plain_verdict(tokens[r.page_id], rules) or "allow" for r in free}
    assert max(map(len, tokens.values())) <= SLOTS
