"""Document fingerprints by winnowing, with built-in functions alone.

Every run of GRAM bytes of a UTF-8 text is hashed, and of every WINDOW consecutive hashes the least is chosen, of equal ones the
rightmost. Two texts that share SPAN = GRAM + WINDOW - 1 bytes therefore share a chosen hash, and its positions tell where. The
chosen hashes with their byte positions are the fingerprint. A gram is hashed by one call instead of rolled on from the
gram before: the choice works alike with any hash, and a rolled sum would take several functions a byte.
Minima are built by doubling, over 2, 4, 8 ... hashes.

An entry is one long, hash * 2^32 - position with a hash of 31 bits, so the least entry is the least hash and, of equal ones,
the rightmost. Which entries a text's first m bytes have follows from the entries of the whole text, so an edited
text's fingerprint is put together from those of both documents and the few windows across the seam; no gram is hashed twice.

The next document by descending id comes from windows within ranges of ids, cut at percentiles; the first row of each range is also
sent to the range before it. So texts are shuffled once, and no task gets more than a range.

Defined cases: a null text is empty; an empty text has an empty fingerprint, a text shorter than a gram the hash of all
its bytes, one that fills no window the least of its grams; likeness is the share of common hashes among all hashes of both (two
empty fingerprints: 1); null ids come last, equal ids are taken by text; an only row follows itself; further columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import table

GRAM = 16
#: A power of two.
WINDOW = 32
#: Bytes under a window; texts that share so many have a common entry.
SPAN = GRAM + WINDOW - 1

#: Rows in a range of ids, while there are at most RANGES ranges; larger ones are sorted with spilling.
RANGE_ROWS, RANGES = 250, 10_000

_HASH_BITS, _UNIT, _MOST = 0x7FFFFFFF00000000, 1 << 32, (1 << 63) - 1


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _first(a: Column, n: Column | int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))


def _after(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(F.size(a) - by, F.lit(0)))


def grams(data: Column) -> Column:
    """The entry of each gram of binary data; that of all bytes if they fill no gram."""
    entry = lambda b, i: F.xxhash64(F.substring(b, i + 1, F.lit(GRAM))).bitwiseAND(F.lit(_HASH_BITS)) - i
    every = let(data, lambda b: F.transform(F.sequence(F.lit(0), F.greatest(F.length(b) - GRAM, F.lit(0))), lambda i: entry(b, i)))
    return F.when(F.length(data) == 0, F.array().cast("array<bigint>")).otherwise(every)


def winnowed(data: Column) -> Column:
    """The chosen entries of binary data, by position."""
    few = lambda g: F.when(F.size(g).between(1, WINDOW - 1), F.concat(g, F.array_repeat(F.lit(_MOST), WINDOW - F.size(g)))).otherwise(g)

    def pairs(by: int):
        return lambda m: F.zip_with(_first(m, F.size(m) - by), _after(m, by), lambda x, y: F.least(x, y))

    least, by = let(grams(data), few), 1
    while by < WINDOW:
        least = let(least, pairs(by))
        by *= 2
    return F.array_distinct(least)


def hash_of(entry: Column) -> Column:
    return F.shiftright(entry + (_UNIT - 1), 32)


def position_of(entry: Column) -> Column:
    return F.shiftleft(hash_of(entry), 32) - entry


def _beginning(entries: Column, m: Column) -> Column:
    """Those entries that the first m bytes of the text have.

    An entry is first chosen when it comes in from the right, if it is less than the one before it, else when that one has gone.
    """
    since = lambda e, before: F.when(before.isNull(), 0).when(e < before, position_of(e) - (WINDOW - 1)).otherwise(position_of(before) + 1)
    previous = F.concat(F.array(F.lit(None).cast("bigint")), _first(entries, F.size(entries) - 1))
    there = F.array_compact(F.zip_with(entries, previous, lambda e, before: F.when(e.isNotNull() & (since(e, before) <= m - SPAN), e)))
    return F.when((m < SPAN) | (F.size(entries) == 0), F.array().cast("array<bigint>")).otherwise(there)


def joined(head: Column, tail: Column, of_head: Column, of_tail: Column) -> Column:
    """Entries of the bytes head || tail, which begin the texts with the entries of_head and of_tail."""
    none = F.array().cast("array<bigint>")
    moved = lambda entries, by: F.transform(entries, lambda e: e - by)

    def across(h: Column, t: Column, b: Column, left: Column) -> Column:
        seam = F.concat(F.substring(h, b - left + 1, left), F.substring(t, F.lit(1), F.lit(SPAN - 1)))
        return F.when(F.length(seam) >= SPAN, moved(winnowed(seam), b - left)).otherwise(none)

    def parts(h: Column, t: Column, b: Column, c: Column) -> Column:
        left = F.least(b, F.lit(SPAN - 1))
        every = F.concat(_beginning(of_head, b), across(h, t, b, left), moved(_beginning(of_tail, c), b))
        return F.when(b + c <= 2 * SPAN, winnowed(F.concat(h, t))).otherwise(F.array_distinct(every))

    # lengths are bound, as the functions of entries would work them out again for each
    return let(head, lambda h: let(tail, lambda t: let(F.length(h), lambda b: let(F.length(t), lambda c: parts(h, t, b, c)))))


def likeness(one: Column, other: Column) -> Column:
    """Common hashes of two lists of entries among all their hashes."""
    hashes = lambda entries: F.array_distinct(F.transform(entries, hash_of))

    def share(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a, b))
        return both / (F.size(a) + F.size(b) - both)

    alike = let(hashes(one), lambda a: let(hashes(other), lambda b: share(a, b)))
    return F.when((F.size(one) == 0) & (F.size(other) == 0), 1.0).otherwise(alike).cast("double")


def _ranges(docs: DataFrame) -> tuple[Column, Column]:
    """Number of a row's range by descending id, and whether the row also ends the range before.

    Ranges begin at ids of the table: percentiles, and the greatest id, with which the last range ends.
    """
    n, top = docs.agg(F.count("doc_id"), F.max("doc_id")).first()
    parts = min(RANGES, n // RANGE_ROWS)
    cuts: list = []
    if parts > 1:
        shares = [k / parts for k in range(1, parts)]
        cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * parts)).first()[0]
    cuts = sorted({c for c in cuts if c < top}, reverse=True)
    if not cuts:
        return F.lit(0), F.lit(-1)
    some = int(len(cuts) ** 0.5) + 1
    groups = [cuts[k : k + some] for k in range(0, len(cuts), some)]
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    nested = F.transform(F.split(F.lit(";".join(",".join(map(str, g)) for g in groups)), ";"), lambda g: F.split(g, ",").cast("array<bigint>"))
    at_most = lambda a: F.size(F.filter(a, lambda c: F.col("doc_id") <= c))
    number = let(at_most(literal([g[-1] for g in groups])), lambda g: g * some + F.coalesce(at_most(F.get(nested, g)), F.lit(0)))
    number = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.least(number, F.lit(len(cuts))))
    begins = F.when(F.col("doc_id") == top, len(cuts)).when(F.array_contains(literal(cuts), F.col("doc_id")), number - 1).otherwise(-1)
    return number, begins


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars and entries of each row, and next_text and next_entries of the next one by descending id."""
    number, begins = _ranges(docs)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = let(number, lambda r: F.when(begins >= 0, F.array(F.struct(r.alias("range"), F.lit(False).alias("ends")), F.struct(begins.cast("int").alias("range"), F.lit(True).alias("ends")))).otherwise(F.array(F.struct(r.alias("range"), F.lit(False).alias("ends")))))
    rows = rows.select("doc_id", "text", F.inline(place))
    order = Window.partitionBy("range").orderBy("ends", F.col("doc_id").desc_nulls_last(), "text")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    following = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    rows = rows.withColumn("next_text", following("text")).withColumn("entries", winnowed(F.col("text").cast("binary")))
    rows = rows.withColumn("next_entries", following("entries")).filter(~F.col("ends"))
    return rows.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "entries", "next_text", "next_entries")


def edited(rows: DataFrame) -> DataFrame:
    """rows of fingerprints with edited_text, whose second half is the next text's beginning, and edited_entries."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half)
    rows = rows.withColumns({"_head": kept, "_tail": F.substring("next_text", F.lit(1), half)})
    entries = joined(F.col("_head").cast("binary"), F.col("_tail").cast("binary"), F.col("entries"), F.col("next_entries"))
    return rows.withColumns({"edited_text": F.concat("_head", "_tail"), "edited_entries": entries}).drop("_head", "_tail")


def shown(entries: Column) -> Column:
    """Entries as hexadecimal numbers, by position."""
    return F.array_join(F.transform(entries, F.hex), " ")


def op12_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(fingerprints(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), shown(F.col("entries")).alias("fingerprint"),
        shown(F.col("edited_entries")).alias("edited_fingerprint"), likeness(F.col("entries"), F.col("edited_entries")).alias("near_edited"),
        likeness(F.col("entries"), F.col("next_entries")).alias("near_next"),
    )
