"""Inverted index and BM25 search.

Postings are made only for the terms asked for; document lengths need no explosion; ranking runs on narrow rows, and
texts are joined to the winners alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.text import compact, term_is_indexed, tokens

K1, B = 1.2, 0.75
MAX_QUERY_TERMS = 32


def build_postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", terms: list[str] | None = None) -> DataFrame:
    """doc_id, term, tf, doc_len; doc_len counts all tokens, terms have 2 to 64 characters."""
    rows = docs.select(doc_id, tokens(F.col(text)).alias("_t")).withColumn("doc_len", F.size("_t").cast("long"))
    if terms is not None:
        rows = rows.withColumn("_t", F.filter("_t", lambda t: t.isin(*terms)))
    rows = rows.select(doc_id, "doc_len", F.explode("_t").alias("term")).filter(term_is_indexed(F.col("term")))
    return rows.groupBy(doc_id, "term", "doc_len").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of documents with tokens, and their total length."""
    n = F.size(tokens(F.col(text))).cast("long")
    return docs.select(n.alias("n")).filter("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("total_doc_len"))


def term_df(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.ln(1 + (F.greatest(n, df) - df + 0.5) / (df + 0.5)), F.lit(0.0))


def bm25(tf: Column, doc_len: Column, avg_len: Column, k1: float = K1, b: float = B) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_len / F.greatest(avg_len, F.lit(1.0))))


def query_terms(query: str) -> list[str]:
    """Distinct indexed terms of a query, at most MAX_QUERY_TERMS."""
    import re

    found = dict.fromkeys(t for t in re.findall("[a-z0-9_]+", query.lower()) if 2 <= len(t) <= 64)
    return list(found)[:MAX_QUERY_TERMS]


def score_postings(postings: DataFrame, stats: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, score (6 decimals), matched_terms from stored postings of at most MAX_QUERY_TERMS terms, whose df are counted first and broadcast."""
    rows = postings.join(F.broadcast(term_df(postings)), "term").crossJoin(F.broadcast(stats))
    part = idf(F.col("docs"), F.col("df")) * bm25(F.col("tf"), F.col("doc_len"), F.col("total_doc_len") / F.col("docs"))
    return rows.groupBy(doc_id).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched_terms"))


def live(postings: DataFrame, locator: DataFrame, keys: tuple[str, ...] = ("doc_id", "version")) -> DataFrame:
    """Postings of the versions that the locator names; those of older versions are stale."""
    return postings.join(locator.select(*keys).distinct(), list(keys), "left_semi")


def query_stats(docs: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
    """One row for a query: docs, total_doc_len, and df (an array in the terms' order)."""
    rows = term_counts(docs.select(text), terms, text)
    df = F.array(*(F.count_if(F.get("_n", F.lit(k)) > 0) for k in range(len(terms))))
    return rows.agg(F.count_if(F.col("_len") > 0).alias("docs"), F.sum("_len").cast("long").alias("total_doc_len"), df.alias("df"))


def term_counts(docs: DataFrame, terms: list[str], text: str) -> DataFrame:
    """docs with _len, the number of tokens, and _n, how often each term is among them.

    Counts are made above a generator of one row, which filters and sums cannot be pushed through: below it, each of them would
    take the text apart again for every term.
    """
    once = lambda x, body: F.get(F.transform(F.array(x), body), F.lit(0))
    of = lambda t, term: F.size(F.filter(t, lambda x: x == term))
    counts = once(tokens(F.col(text)), lambda t: F.struct(F.size(t).alias("_len"), F.array(*(of(t, x) for x in terms)).alias("_n")))
    return docs.withColumn("_c", F.explode(F.array(counts))).select(*(F.col(f"`{c}`") for c in docs.columns), "_c._len", "_c._n")


def score_documents(docs: DataFrame, terms: list[str], text: str = "text", stats: DataFrame | None = None) -> DataFrame:
    """docs with score and matched_terms, those that match; nothing is shuffled but the one row of the query's statistics."""
    rows = term_counts(docs, terms, text).filter(F.exists("_n", lambda n: n > 0)).crossJoin(F.broadcast(stats if stats is not None else query_stats(docs, terms, text)))
    part = lambda n, d: idf(F.col("docs"), d) * bm25(n, F.col("_len"), F.col("total_doc_len") / F.col("docs"))
    parts = F.zip_with("_n", "df", lambda n, d: F.when(n > 0, part(n, d)).otherwise(0.0))
    score = F.round(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), 6)
    return rows.withColumns({"score": score, "matched_terms": F.size(F.filter("_n", lambda n: n > 0)).cast("long")}).drop("_n", "_len", "docs", "total_doc_len", "df")


def search_events(docs: DataFrame, query: str, doc_id: str = "doc_id", text: str = "text", limit: int = 25, min_match: int = 1, min_score: float = 0.0) -> DataFrame:
    """Best documents with their text: score descending, then doc_id."""
    terms = query_terms(query)
    if not terms:
        return docs.select(doc_id, F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("matched_terms"), text).limit(0)
    scored = score_documents(docs.select(doc_id, text), terms, text).select(doc_id, "score", "matched_terms")
    top = scored.filter((F.col("matched_terms") >= min_match) & (F.col("score") >= min_score)).orderBy(F.desc("score"), doc_id).limit(limit)
    return docs.select(doc_id, text).join(F.broadcast(top), doc_id)  # at most `limit` rows


def search_scoped(events: DataFrame, query: str, scope: DataFrame | None = None, on: tuple[str, ...] = ("session_id",), page: int = 1, size: int = 25, min_match: int = 1, text: str = "text_content") -> DataFrame:
    """A page of hits within a scope (sessions, or sessions and turns): frequencies of the scope, equal scores newest first, ranks counted on over pages."""
    terms = query_terms(query)
    rows = events.join(scope.select(*on).distinct(), list(on), "left_semi") if scope is not None else events
    scored = score_documents(rows.select("session_id", "event_uid", "event_ts", text), terms, text) if terms else rows.limit(0).withColumns({"score": F.lit(0.0), "matched_terms": F.lit(0).cast("long")})
    order = [F.desc("score"), F.desc("event_ts"), F.col("event_uid")]
    first = (page - 1) * size
    top = scored.filter(F.col("matched_terms") >= min_match).orderBy(*order).limit(first + size)
    ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))  # at most the pages so far
    return ranked.filter(F.col("rank") > first).select("rank", "session_id", "event_uid", "event_ts", "score", "matched_terms", text)


def in_given_order(df: DataFrame, key: str, wanted: list) -> DataFrame:
    """The rows whose key is in a list, with their place in it (from 1), in its order."""
    place = F.array_position(F.array(*map(F.lit, wanted)), F.col(key)).cast("long")
    return df.filter(F.col(key).isin(*wanted)).withColumn("place", place).orderBy("place")


def telemetry(query: str, hits: DataFrame, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """What a search leaves behind: one row of the query, and one of each hit with its rank; hits are a page."""
    qid = F.sha2(F.lit(query), 256)
    summary = hits.agg(F.count(F.lit(1)).alias("n_hits"), F.max("score").alias("best_score")).select(qid.alias("query_id"), F.lit(query).alias("query"), F.lit(len(query_terms(query))).cast("long").alias("n_terms"), "n_hits", "best_score")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), doc_id)).cast("long")
    return summary, hits.select(qid.alias("query_id"), rank.alias("rank"), doc_id, "score", "matched_terms")


def search_sessions(docs: DataFrame, query: str, session: str, doc_id: str = "doc_id", text: str = "text", limit: int = 25, min_match: int = 1) -> DataFrame:
    """Sessions by summed event scores, with distinct terms matched and the best event."""
    terms = query_terms(query)
    postings = build_postings(docs, doc_id, text, terms)
    scored = score_postings(postings, corpus_stats(docs, text), doc_id)
    owner = docs.select(doc_id, session)
    per = scored.join(owner, doc_id).groupBy(session).agg(F.round(F.sum("score"), 6).alias("score"), F.count(F.lit(1)).alias("event_count"), F.max_by(doc_id, F.struct("score", F.col(doc_id))).alias("best_event"))
    mask = F.lit(0)
    for k, t in enumerate(terms[:63]):
        mask = F.when(F.col("term") == t, F.lit(1 << k).cast("long")).otherwise(mask)
    seen = postings.join(owner, doc_id).groupBy(session).agg(F.bit_count(F.bit_or(mask.cast("long"))).cast("long").alias("matched_terms"))
    return per.join(seen, session).filter(F.col("matched_terms") >= min_match).orderBy(F.desc("score"), session).limit(limit)


def search_metadata(meta: DataFrame, query: str, weights: dict[str, float], key: str) -> DataFrame:
    """Substring search: each term adds a column's weight if the column has it."""
    parts = F.lit(0.0)
    for t in query_terms(query):
        for column, w in weights.items():
            parts = parts + F.when(F.locate(t, F.lower(F.coalesce(F.col(column), F.lit("")))) > 0, w).otherwise(0.0)
    return meta.select(key, parts.alias("score")).filter("score > 0")


def mirror_dedup(hits: DataFrame, kind: str = "event_kind", keep_first: tuple[str, ...] = ("message", "reasoning")) -> DataFrame:
    """Of hits that say the same (session, actor, terms, score, compacted preview) in two kinds, the preferred kind, then the smaller uid."""
    prefer = F.when(F.col(kind).isin(*keep_first), 0).otherwise(1)
    w = Window.partitionBy("session_id", "actor_kind", "matched_terms", F.round("score", 9), compact(F.col("preview"))).orderBy(prefer, "event_uid")
    both = Window.partitionBy("session_id", "actor_kind", "matched_terms", F.round("score", 9), compact(F.col("preview")))
    mixed = F.min(prefer).over(both) != F.max(prefer).over(both)
    return hits.withColumns({"_rn": F.row_number().over(w), "_mixed": mixed}).filter("_rn = 1 OR NOT _mixed").drop("_rn", "_mixed")


def equivalent_dedup(trace: DataFrame) -> DataFrame:
    """First of the events with one session, turn, kind, content digest and millisecond."""
    ms = F.unix_millis(F.col("event_ts").cast("timestamp"))
    w = Window.partitionBy("session_id", "turn_seq", "event_kind", F.sha2(F.coalesce("text_content", F.lit("")), 256), ms).orderBy("event_order")
    return trace.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
