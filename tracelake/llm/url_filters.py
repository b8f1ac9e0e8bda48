"""URL filters: listed rules first, then association rules mined by FP-growth.

Every URL becomes a set of at most `SLOTS` tokens: its top domain, registered domain, labels before it (all, and the nearest one), first path
part, shape of the last path part, extension and query names. The verdict of a listed rule that fits is the label of
its URL; all other URLs are unlabelled and count for neither verdict. FP-growth mines token combinations over all URLs;
a combination becomes a rule for a verdict if, of the labelled URLs that have it, at least `MIN_CONFIDENCE` bear the verdict and
`MIN_LIFT` times its share of all labelled ones, and if at least `MIN_KNOWN` of all URLs that have it are labelled, since a verdict seen on
a sliver says little about the rest. More special rules that are no surer are pruned. An inverted index (rarest
token of a rule -> rules) finds the rules that fit a URL, in the row and without a shuffle. URLs without a listed rule take
the verdict of the surest mined rule that fits, and are allowed if none does.

A URL has at most 2^SLOTS combinations, so at most 2^SLOTS / MIN_SUPPORT of them are frequent and reach the driver as rules,
however many URLs there are.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule and is allowed; ties between
mined rules go to `block`; with no labelled URL nothing is mined; repeated rows are judged each; extra columns
of any name are carried along by `judge`, whose result is one struct column with a free name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import cut_lineage, free_name, table

#: The listed rules as (verdict, host, path).
LISTED = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Least share of all URLs that have a combination and its verdict.
MIN_SUPPORT = 0.005
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.1
MIN_KNOWN = 0.5
SLOTS = 8
#: Items that tell a labelled URL, and its verdict.
KNOWN, VERDICT = "=known", "=verdict:"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def listed_rule(host: Column, path: Column, rules=LISTED) -> tuple[Column, Column]:
    """Name and verdict of the longest listed rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a longer rule overrides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, at most `SLOTS`; a part that the URL lacks gives none."""
    labels = F.split(host, r"\.")
    before = F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0)))
    parts = F.array_remove(F.split(path, "/"), "")
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1))))
    slots = {
        "top": F.try_element_at(labels, F.lit(-1)),
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), "."),
        "sub": F.array_join(before, "."),
        "near": F.coalesce(F.try_element_at(before, F.lit(-1)), F.lit("")),
        "part": F.coalesce(F.get(parts, F.lit(0)), F.lit("")),
        "shape": F.regexp_replace(F.regexp_replace(last, r"\.\w+$", ""), r"^(\d)\d*$", "$1N"),
        "ext": F.regexp_extract(last, r"\.(\w+)$", 1),
        "query": F.array_join(names, "&"),
    }
    return F.array_compact(F.array(*(F.when(c != "", F.concat(F.lit(n + ":"), c)) for n, c in slots.items())))


def mine(pages: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, min_known: float = MIN_KNOWN) -> list[dict]:
    """Pruned rules from rows (tokens, verdict or null); their number is bounded by the support."""
    said = F.concat(F.lit(VERDICT), "verdict")
    items = pages.select(F.when(F.col("verdict").isNull(), F.col("tokens")).otherwise(F.concat("tokens", F.array(F.lit(KNOWN), said))).alias("items"))
    shares = {r["verdict"]: r["n"] for r in pages.filter("verdict is not null").groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return []
    found = FPGrowth(itemsCol="items", minSupport=min_support).fit(items).freqItemsets
    marks = F.array_sort(F.filter("items", lambda x: x.startswith("=")))
    sets = cut_lineage(found.select(F.array_sort(F.filter("items", lambda x: ~x.startswith("="))).alias("tokens"), F.array_join(marks, " ").alias("mark"), F.col("freq").cast("double").alias("freq")))
    of = lambda mark, name: sets.filter(F.col("mark") == mark).select("tokens", F.col("freq").alias(name))
    total = sum(shares.values())
    rules = None
    for verdict, n in sorted(shares.items()):
        own = of(VERDICT + verdict, "hit").join(of(KNOWN, "known"), "tokens").join(of("", "all"), "tokens").filter(F.size("tokens") > 0)
        own = own.select("tokens", F.lit(verdict).alias("verdict"), F.round(F.col("hit") / F.col("known"), 9).alias("confidence"), F.lit(n / total).alias("share"), (F.col("known") / F.col("all")).alias("labelled"))
        rules = own if rules is None else rules.union(own)
    rules = cut_lineage(rules.filter((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * F.col("share")) & (F.col("labelled") >= min_known)))
    wider = rules.select("tokens", "verdict", "confidence", F.explode(F.transform("tokens", lambda t: F.array_except("tokens", F.array(t)))).alias("w"))
    as_sure = rules.select(F.col("tokens").alias("w"), "verdict", F.col("confidence").alias("c"))
    pruned = wider.join(as_sure, ["w", "verdict"]).filter("c >= confidence").select("tokens", "verdict").distinct()
    kept = rules.join(pruned, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence").collect()
    alone = {r["tokens"][0]: r["freq"] for r in sets.filter((F.col("mark") == "") & (F.size("tokens") == 1)).collect()}
    return [{"tokens": list(r["tokens"]), "verdict": r["verdict"], "confidence": r["confidence"], "key": min(r["tokens"], key=lambda t: (alone[t], t))} for r in sorted(kept)]


def surest(tokens: list[str], index: dict[str, list[tuple[float, str, frozenset]]]) -> str | None:
    """Verdict of the surest rule all of whose tokens are given; the index lists rules by one token of each."""
    own, best = set(tokens), None
    for t in tokens:
        for c, v, needed in index.get(t, ()):
            if (best is None or (c, v) > best) and needed <= own:
                best = (c, v)
    return best and best[1]


def mined_verdict(spark: SparkSession, tokens: Column, rules: list[dict]) -> Column:
    """Verdict of the surest rule all of whose tokens the URL has; null if none."""
    if not rules:
        return F.lit(None).cast("string")
    index: dict[str, list[tuple[float, str, frozenset]]] = {}
    for r in rules:
        index.setdefault(r["key"], []).append((r["confidence"], r["verdict"], frozenset(r["tokens"])))
    shared = spark.sparkContext.broadcast(index)

    @F.pandas_udf("string")
    def match(column: pd.Series) -> pd.Series:
        return pd.Series([surest(list(t), shared.value) for t in column], dtype=object)

    return match(tokens)


def judge(pages: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, str]:
    """pages with one more struct column, and its name: host, path, rule and verdict."""
    host, path = host_and_path(F.col("url"))
    short = pages.select(F.col("url").alias("u"), host.alias("h"), path.alias("p"))
    _, said = listed_rule(F.col("h"), F.col("p"))
    usable = short.filter("h <> ''").select(tokens_of(F.col("u"), F.col("h"), F.col("p")).alias("tokens"), said.alias("verdict"))
    rules = mine(cut_lineage(usable), min_support, min_confidence)
    name, at, tk, mv = (free_name(pages, x) for x in ("_url", "_parts", "_tokens", "_mined"))
    rows = pages.withColumn(at, F.struct(host.alias("host"), path.alias("path")))
    rows = rows.withColumn(tk, tokens_of(F.col("url"), F.col(at)["host"], F.col(at)["path"]))
    rows = rows.withColumn(mv, mined_verdict(pages.sparkSession, F.col(tk), rules))
    rule, said = listed_rule(F.col(at)["host"], F.col(at)["path"])
    verdict = F.coalesce(said, F.when(F.col(at)["host"] != "", F.col(mv)), F.lit("allow"))
    return rows.withColumn(name, F.struct(F.col(at)["host"], F.col(at)["path"], rule.alias("rule"), verdict.alias("verdict"))).drop(at, tk, mv), name


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, u = judge(table(spark, sf_dir, "pages"))
    return rows.select("page_id", f"{u}.*")
