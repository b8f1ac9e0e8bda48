"""What built-in functions cannot express: text found at any depth of a JSON value."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys whose strings are text, and keys that are looked into, in this order.
SPOKEN = ("text", "message", "output", "thinking", "summary")
NESTED = ("content", "text_elements", "input")
LIMIT = 200_000


def _texts(value) -> Iterator[str]:
    pending = [value]
    while pending:
        v = pending.pop()
        if isinstance(v, str):
            if v.strip():
                yield v
        elif isinstance(v, list):
            pending.extend(reversed(v))
        elif isinstance(v, dict):
            yield from (v[k] for k in SPOKEN if isinstance(v.get(k), str) and v[k].strip())
            pending.extend(v[k] for k in reversed(NESTED) if k in v)


def text_of(value: str | None) -> str:
    """Texts of a JSON document, one a line, at most LIMIT characters; a document that is no JSON is its own text."""
    if value is None:
        return ""
    try:
        found = json.loads(value)
    except ValueError:
        found = value
    return "\n".join(_texts(found))[:LIMIT]


def message_text(value: Column) -> Column:
    def walk(values: pd.Series) -> pd.Series:
        return values.map(text_of)

    return F.pandas_udf(walk, T.StringType())(value)


def content_types(content: Column) -> Column:
    """Distinct types of the blocks of a JSON content array, in first-seen order; `text` for a plain text, none for a null."""
    blocks = F.from_json(content, "array<string>")
    types = F.array_distinct(F.array_compact(F.transform(blocks, lambda b: F.get_json_object(b, "$.type"))))
    return F.when(content.isNull(), F.array().cast("array<string>")).when(F.trim(content).startswith("["), F.coalesce(types, F.array().cast("array<string>"))).otherwise(F.array(F.lit("text")))
