"""JSON lines and JSON documents: records, line limits, dead letters.

A file is read as lines with its path; the line number and byte offset come from a window over the file's lines
in the order of their position in the file, which the reader keeps within a partition. Files are read whole in one
task each (`wholetext`) only for JSON documents, never for line files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_LINE_BYTES = 8 * 1024 * 1024
MAX_ROW_BYTES = 10 * 1024 * 1024
FRAGMENT_CHARS = 20_000
EPOCH = "1970-01-01 00:00:00"


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source_file, source_line_no (from 1), source_offset (bytes before, for \\n line ends), value."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    w = Window.partitionBy("source_file").orderBy("_block", "_id")
    size = F.octet_length("value").cast("long") + 1
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("source_file", F.row_number().over(w).cast("long").alias("source_line_no"), before.alias("source_offset"), "value")


def is_object(value: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(value)).startswith("OBJECT"), F.lit(False))


def split_records(lines: DataFrame, limit: int = MAX_LINE_BYTES) -> tuple[DataFrame, DataFrame]:
    """Lines that hold a JSON object, and errors: too large, or not an object. Blank lines are neither."""
    lines = lines.filter(F.trim("value") != "")
    long = F.octet_length("value") > limit
    kind = F.when(long, "jsonl_source_line_too_large").when(~is_object(F.col("value")), "json_parse_error")
    marked = lines.withColumn("error_kind", kind)
    errors = marked.filter("error_kind is not null").select("source_file", "source_line_no", "error_kind", F.col("error_kind").alias("error_text"), F.left(F.col("value"), F.lit(FRAGMENT_CHARS)).alias("fragment"))
    return marked.filter("error_kind is null").drop("error_kind"), errors


def raw_rows(lines: DataFrame) -> DataFrame:
    return lines.withColumn("sha256", F.sha2("value", 256))


def read_documents(spark: SparkSession, path: str, items: str = "messages") -> DataFrame:
    """Whole JSON documents: one row for the header (position 0) and one for each item."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("doc"))
    found = F.from_json(F.get_json_object("doc", f"$.{items}"), "array<string>")
    head = docs.select("source_file", F.lit(0).cast("long").alias("source_line_no"), F.lit(0).cast("long").alias("source_offset"), F.col("doc").alias("value"))
    each = docs.select("source_file", F.posexplode(found).alias("p", "value")).select("source_file", (F.col("p") + 1).cast("long").alias("source_line_no"), F.lit(0).cast("long").alias("source_offset"), "value")
    return head.unionByName(each)


def parse_time(text: Column) -> tuple[Column, Column]:
    """Time of a record (ISO text, or Unix seconds or milliseconds), the epoch if it has none, and whether it had one."""
    n = F.when(text.rlike(r"^\d+(\.\d+)?$"), text.cast("double"))
    seconds = F.when(n > 1e11, n / 1000).otherwise(n)
    found = F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.try_to_timestamp(text))
    return F.coalesce(found, F.lit(EPOCH).cast("timestamp")), found.isNotNull()


def exclude_paths(lines: DataFrame, patterns: list[str]) -> DataFrame:
    for p in patterns:
        lines = lines.filter(~F.col("source_file").rlike(p))
    return lines


def quarantine(rows: DataFrame, limit: int = MAX_ROW_BYTES) -> tuple[DataFrame, DataFrame]:
    """Rows whose JSON fits, and those that are too large for a sink."""
    big = F.octet_length(F.to_json(F.struct(*rows.columns))) > limit
    return rows.filter(~big), rows.filter(big)
