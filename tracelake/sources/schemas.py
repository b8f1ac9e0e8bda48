"""Explicit schemas: nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_FIELDS = (
    ("source_name", "string"), ("source_file", "string"), ("source_generation", "int"), ("source_line_no", "long"), ("source_offset", "long"), ("emission_index", "int"),
    ("event_uid", "string"), ("event_version", "long"), ("session_id", "string"), ("event_ts", "timestamp"), ("record_ts", "string"),
    ("harness", "string"), ("inference_provider", "string"), ("event_kind", "string"), ("payload_type", "string"), ("actor_kind", "string"), ("turn_index", "int"),
    ("request_id", "string"), ("item_id", "string"), ("tool_call_id", "string"), ("tool_name", "string"), ("tool_phase", "string"), ("tool_error", "int"), ("op_status", "string"),
    ("model", "string"), ("latency_ms", "long"), ("retry_count", "int"), ("parent_uid", "string"), ("cwd", "string"), ("author", "string"),
    ("text_content", "string"), ("payload_json", "string"), ("token_usage_json", "string"),
)
_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "timestamp": T.TimestampType()}


def struct(fields) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[t]) for n, t in fields])


EVENTS = struct(EVENT_FIELDS)
RAW = struct((("source_file", "string"), ("source_line_no", "long"), ("source_offset", "long"), ("value", "string"), ("sha256", "string")))
ERRORS = struct((("source_file", "string"), ("source_line_no", "long"), ("error_kind", "string"), ("error_text", "string"), ("fragment", "string")))
LINKS = struct((("session_id", "string"), ("event_uid", "string"), ("linked_uid", "string"), ("external_id", "string"), ("link_type", "string")))
TOOL_IO = struct((("session_id", "string"), ("event_uid", "string"), ("tool_call_id", "string"), ("tool_name", "string"), ("tool_phase", "string"), ("input_json", "string"), ("output_text", "string"), ("tool_error", "int")))


def conform(df: DataFrame, schema: T.StructType = EVENTS) -> DataFrame:
    """All columns of a schema in its order; missing strings are '', missing numbers 0, missing times null."""
    def of(f: T.StructField):
        if f.name in df.columns:
            return F.col(f.name).cast(f.dataType).alias(f.name)
        empty = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0) if isinstance(f.dataType, T.NumericType) else F.lit(None)
        return empty.cast(f.dataType).alias(f.name)

    return df.select(*map(of, schema.fields))
