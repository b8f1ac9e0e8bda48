"""Transcripts with a metadata document beside each: a.jsonl and a.json.

The document names session, directory and model of the transcript's records and sums up its turns. Two versioned inputs meet
here: lines are followed by byte offset, documents by fingerprint. A document that changes gives its own record again; one whose session, directory
or model changes, or that becomes readable, has its transcript's lines given again from the first, in a higher version, so that readers
(`operators.trace.latest`) take the new events. Transcripts of other documents are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources.growing import appended
from tracelake.sources.jsonl import is_object

#: What is known of a document after a pass over it.
STATE = "stem string, fingerprint string, transcript_fingerprint string, valid boolean, revision long"
_TURNS = "array<struct<input_token_count:string,output_token_count:string,metering_usage:array<struct<unit:string,unitPlural:string,value:double>>>>"


def stem_of(path: Column) -> Column:
    """A path without its extension."""
    return F.regexp_replace(path, r"\.[^./]+$", "")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """stem and doc of the metadata documents below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(path)
    return files.select(stem_of(F.regexp_replace("path", "^file:/+", "file:///")).alias("stem"), F.decode("content", "UTF-8").alias("doc"))


def _credits(turn: Column) -> Column:
    paid = F.filter(F.coalesce(turn["metering_usage"], F.array().cast("array<struct<unit:string,unitPlural:string,value:double>>")), lambda u: F.coalesce(u["unit"] == "credit", F.lit(False)) | F.coalesce(u["unitPlural"] == "credits", F.lit(False)))
    return F.aggregate(paid, F.lit(0.0), lambda a, u: a + F.coalesce(u["value"], F.lit(0.0)))


def metadata(docs: DataFrame) -> DataFrame:
    """(stem, doc) with what the documents say; one that is no JSON object is not valid, names its session by its file alone and has an error."""
    text = lambda p: F.coalesce(F.get_json_object("doc", f"$.{p}"), F.lit(""))
    turns = F.from_json(F.get_json_object("doc", "$.session_state.conversation_metadata.user_turn_metadatas"), _TURNS)
    whole = lambda c: F.greatest(F.coalesce(c.try_cast("long"), F.lit(0)), F.lit(0))
    summed = lambda field: F.aggregate(F.coalesce("_t", F.array().cast(_TURNS)), F.lit(0).cast("long"), lambda a, t: a + whole(t[field]))
    name = F.regexp_extract("stem", "[^/]+$", 0)
    rows = docs.select("stem", "doc").withColumns({"valid": is_object(F.col("doc")), "_t": turns}).withColumns({
        "session_id": F.when(F.trim(text("session_id")) != "", text("session_id")).otherwise(name), "cwd": text("cwd"), "model": text("session_state.rts_model_state.model_info.model_id"),
        "created_at": text("created_at"), "title": text("title"), "agent_name": text("session_state.agent_name"), "turn_count": F.coalesce(F.size("_t"), F.lit(0)).cast("long"),
        "input_tokens": summed("input_token_count"), "output_tokens": summed("output_token_count"), "credits": F.aggregate(F.coalesce("_t", F.array().cast(_TURNS)), F.lit(0.0), lambda a, t: a + _credits(t)),
    })
    seen = F.sha2(F.to_json(F.struct("session_id", "cwd", "model")), 256)
    return rows.withColumns({"fingerprint": F.sha2("doc", 256), "transcript_fingerprint": F.when(F.col("valid"), seen).otherwise(""), "error_kind": F.when(~F.col("valid"), "sidecar_parse_error")}).drop("_t")


def replays(now: DataFrame, before: DataFrame) -> DataFrame:
    """STATE of documents after this pass, with changed (its record is due) and rewrite (its transcript is due from the first line).

    now: metadata; before: STATE. A document that is gone leaves its state without a fingerprint.
    """
    old = before.select("stem", *(F.col(c).alias(f"_{c}") for c in ("fingerprint", "transcript_fingerprint", "valid", "revision")))
    rows = now.select("stem", "fingerprint", "transcript_fingerprint", "valid").join(old, "stem", "full")
    rows = rows.na.fill({"fingerprint": "", "transcript_fingerprint": "", "valid": False})
    known = F.col("_revision").isNotNull()
    rewrite = known & F.col("valid") & (~F.col("_valid") | (F.col("transcript_fingerprint") != F.col("_transcript_fingerprint")))
    changed = F.col("valid") & (~known | (F.col("fingerprint") != F.col("_fingerprint")))
    revision = F.when(known, F.col("_revision") + (rewrite | changed).cast("long")).otherwise(0)
    return rows.select("stem", "fingerprint", "transcript_fingerprint", "valid", revision.alias("revision"), changed.alias("changed"), rewrite.alias("rewrite"))


def paired(lines: DataFrame, meta: DataFrame, turned: DataFrame) -> DataFrame:
    """lines with the session, model and directory of their document, and its revision, for `adapters.normalize`."""
    hints = meta.filter("valid").select("stem", *(F.nullif(F.col(c), F.lit("")).alias(h) for c, h in (("session_id", "session_hint"), ("model", "model_hint"), ("cwd", "cwd_hint"))))
    return lines.withColumn("stem", stem_of(F.col("source_file"))).join(hints, "stem", "left").join(turned.select("stem", (F.col("revision") + 1).alias("record_version")), "stem", "left").drop("stem")


def meta_records(meta: DataFrame, turned: DataFrame) -> DataFrame:
    """Records (line 0 of the transcript) of the documents that changed."""
    data = F.struct("session_id", "cwd", "created_at", "title", "agent_name", "model", "turn_count", "input_tokens", "output_tokens", "credits")
    due = meta.join(turned.filter("changed").select("stem"), "stem", "left_semi")
    zero = F.lit(0).cast("long")
    return due.select(F.concat("stem", F.lit(".jsonl")).alias("source_file"), zero.alias("source_line_no"), zero.alias("source_offset"), F.to_json(F.struct(F.lit("SessionMeta").alias("kind"), data.alias("data"))).alias("value"))


def follow(spark: SparkSession, path: str, cursors: DataFrame | None = None, state: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records due below a folder (for `adapters.normalize`), errors of documents, and the cursors and STATE for the next pass."""
    meta = metadata(read_sidecars(spark, path))
    turned = replays(meta, state if state is not None else spark.createDataFrame([], STATE))
    if cursors is not None:
        again = turned.filter("rewrite").select("stem", F.lit(True).alias("_again"))
        rows = cursors.withColumn("stem", stem_of(F.col("source_file"))).join(again, "stem", "left")
        reset = {"size": -1, "byte": 0, "head": "", "mark": "", "n_lines": 0}
        cursors = rows.select(*(F.when(F.col("_again"), F.lit(reset[c]).cast(rows.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in reset else F.col(c) for c in cursors.columns))
    lines, after = appended(spark, f"{path}/*.jsonl", cursors)
    due = lines.select("source_file", "source_line_no", "source_offset", "value").unionByName(meta_records(meta, turned))
    errors = meta.filter("not valid").select(F.concat("stem", F.lit(".json")).alias("source_file"), F.lit(0).cast("long").alias("source_line_no"), "error_kind", F.col("error_kind").alias("error_text"), F.left("doc", F.lit(20_000)).alias("fragment"))
    return paired(due, meta, turned), errors, after, turned.drop("changed", "rewrite")
