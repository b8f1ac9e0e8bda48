"""Incremental ingest of trace files.

A stream follows growing files by byte offset (`sources.growing`); every micro-batch writes raw rows, events, links, errors and
cursors in that order and only then does the stream commit, so delivery is at least once. Uids do not depend on the batch, and
readers collapse versions (`operators.trace.latest`), so a replay changes nothing. A cursor row says, of a file up to a byte, how many lines it
had and which session, model and working directory its records named last, for the lines that come later.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracelake.functions.redaction import redact
from tracelake.operators.trace import latest
from tracelake.sources import growing
from tracelake.sources.adapters import links, normalize
from tracelake.sources.jsonl import FRAGMENT_CHARS, exclude_paths, quarantine, raw_rows, split_records
from tracelake.sources.sinks import append

TABLES = ("raw", "events", "links", "errors", "cursors")


def line_stream(spark: SparkSession, path: str, state: str, part_bytes: int = growing.PART_BYTES) -> DataFrame:
    """Lines appended to the files under a path; `state` is the folder of its snapshots."""
    spark.dataSource.register(growing.GrowingLines)
    return spark.readStream.format("growing_lines").options(path=path, state=state, part_bytes=part_bytes).load()


def number_lines(batch: DataFrame) -> DataFrame:
    rows = batch.withColumn("_id", F.monotonically_increasing_id())
    w = Window.partitionBy("source_file").orderBy("source_offset", "_id")
    return rows.withColumn("source_line_no", F.row_number().over(w).cast("long")).drop("_id")


HINTS = ("session", "model", "cwd")
COUNTED = "source_file string, source_generation int, start long, n_lines long, session_hint string, model_hint string, cwd_hint string"


def known_cursors(spark: SparkSession, base: str) -> DataFrame:
    """(COUNTED) for every file and byte that a batch ended at; a batch that was written twice counts once."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/cursors")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], COUNTED)
    rows = spark.read.schema(COUNTED).parquet(f"{base}/cursors")
    return rows.groupBy("source_file", "source_generation", "start").agg(*(F.max(c).alias(c) for c in rows.columns[3:]))


def latest_cursors(spark: SparkSession, base: str) -> DataFrame:
    """Of each file the cursor of the highest generation and then the furthest byte."""
    rows = known_cursors(spark, base)
    return rows.groupBy("source_file").agg(F.max(F.struct(*rows.columns[1:])).alias("_c")).select("source_file", "_c.*")


def _cursors(lines: DataFrame, events: DataFrame) -> DataFrame:
    """Cursors behind the lines of a batch; where they made no events, hints stay as they were."""
    before = lines.groupBy("source_file").agg(*(F.max(f"{h}_hint").alias(f"_{h}") for h in HINTS))
    at = F.struct("source_line_no", "emission_index")
    last = events.groupBy("source_file").agg(*(F.max_by(F.nullif(F.col(c), F.lit("")), at).alias(f"{h}_hint") for h, c in zip(HINTS, ("session_id", "model", "cwd"), strict=True)))
    rows = growing.line_counts(lines).join(before, "source_file").join(last, "source_file", "left")
    return rows.select("source_file", "source_generation", "start", "n_lines", *(F.coalesce(f"{h}_hint", f"_{h}").alias(f"{h}_hint") for h in HINTS))


def write_batch(batch: DataFrame, harness: str, base: str, excluded: tuple[str, ...] = ()) -> None:
    """Raw rows, events, links, errors and, of followed files, cursors of a batch, in this order; files of excluded paths are passed over, and rows too large for a sink are errors."""
    batch, followed = exclude_paths(batch, list(excluded)), "part_line" in batch.columns
    lines = (growing.numbered(batch, known_cursors(batch.sparkSession, base)) if followed else number_lines(batch)).persist()
    records, errors = split_records(lines)
    events, large = quarantine(normalize(records.withColumn("value", redact(F.col("value"))), harness))
    events = events.persist()
    kept = [c for c in ("source_file", "source_generation", "source_line_no", "source_offset", "value") if c in lines.columns]
    append(raw_rows(lines.select(*kept).withColumn("value", redact(F.col("value")))), f"{base}/raw")
    append(events, f"{base}/events")
    append(links(events), f"{base}/links")
    big = large.select("source_file", "source_line_no", F.lit("row_too_large").alias("error_kind"), F.lit("row_too_large").alias("error_text"), F.left("payload_json", F.lit(FRAGMENT_CHARS)).alias("fragment"))
    append(errors.withColumn("fragment", redact(F.col("fragment"))).unionByName(big), f"{base}/errors")
    if followed:
        append(_cursors(lines, events), f"{base}/cursors")
    events.unpersist()
    lines.unpersist()


def progress(raw: DataFrame, events: DataFrame, errors: DataFrame) -> DataFrame:
    """Counters of each source file: lines, bytes, events and errors so far."""
    lines = raw.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.octet_length("value").cast("long")).alias("n_bytes"))
    of = lambda df, name: df.groupBy("source_file").agg(F.count(F.lit(1)).alias(name))
    rows = lines.join(of(events, "n_events"), "source_file", "left").join(of(errors, "n_errors"), "source_file", "left")
    return rows.na.fill(0, ["n_events", "n_errors"])


CURSOR = growing.CURSOR


def tail(spark: SparkSession, path: str, cursors: DataFrame | None = None, part_bytes: int = growing.PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Lines appended to the files under a path since the cursors, numbered on, and the new cursors (CURSOR)."""
    lines, now = growing.appended(spark, path, cursors, part_bytes)
    return lines.select("source_file", "source_line_no", "source_offset", "value", F.col("source_generation").alias("generation")), now


def stream_latency(events: DataFrame) -> DataFrame:
    """Streaming `operators.trace.latency`: the delay of an assistant event right after a tool result, the last event of each session held as state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kind, at = state.get if state.exists else ("", 0)
        rows = pd.concat(list(frames)).sort_values(["event_ts", "event_uid"], kind="stable")
        ms = (rows["event_ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
        delays = []
        for k, actor, t in zip(rows["event_kind"], rows["actor_kind"], ms, strict=True):
            delays.append(float(max(t - at, 0)) if kind == "tool_result" and actor == "assistant" else None)
            kind, at = k, t
        state.update((kind, at))
        yield pd.DataFrame({"session_id": key[0], "event_uid": rows["event_uid"], "latency_ms": delays})

    own = events.filter(F.lower("actor_kind").isin("user", "assistant", "tool")).select("session_id", "event_uid", "event_ts", "event_kind", "actor_kind")
    return own.groupBy("session_id").applyInPandasWithState(step, "session_id string, event_uid string, latency_ms double", "kind string, at long", "append", GroupStateTimeout.NoTimeout)


def start(spark: SparkSession, path: str, harness: str, base: str, checkpoint: str, once: bool = True, interval: str = "1 second", excluded: tuple[str, ...] = ()) -> StreamingQuery:
    """Start the ingest of a directory; once: take what is there and stop. Started again with the same checkpoint, it takes what has been appended."""
    writer = line_stream(spark, path, f"{checkpoint}/snapshots").writeStream.foreachBatch(lambda df, _: write_batch(df, harness, base, excluded)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def current_events(spark: SparkSession, base: str) -> DataFrame:
    """The latest version of every event."""
    return latest(spark.read.parquet(f"{base}/events"), ["session_id", "event_uid"], "event_version", ["source_file", "source_line_no"])


def activity_counts(events: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Streaming counts by tumbling window and kind."""
    return events.withWatermark("event_ts", late).groupBy(F.window("event_ts", f"{seconds} seconds"), "event_kind").agg(F.count(F.lit(1)).alias("n"))
