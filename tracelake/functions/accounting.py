"""Token accounting: provider usage objects to exclusive buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: JSON paths of each count, in order of preference, by provider family.
PATHS = {
    "openai": {"input": ("$.input_tokens", "$.prompt_tokens"), "cached": ("$.cached_input_tokens", "$.input_tokens_details.cached_tokens"), "output": ("$.output_tokens", "$.completion_tokens"), "reasoning": ("$.reasoning_output_tokens", "$.output_tokens_details.reasoning_tokens")},
    "google": {"input": ("$.promptTokenCount",), "cached": ("$.cachedContentTokenCount",), "output": ("$.candidatesTokenCount",), "reasoning": ("$.thoughtsTokenCount",)},
    "generic": {"input": ("$.input", "$.input_tokens"), "cached": ("$.cache_read", "$.cacheRead"), "output": ("$.output", "$.output_tokens"), "reasoning": ("$.reasoning",)},
}


def count_at(usage: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.get_json_object(usage, p).cast("long") for p in paths), F.lit(0).cast("long"))


def buckets(usage: Column, family: str) -> Column:
    """map of exclusive buckets: cached input leaves plain input, reasoning leaves plain output, never below zero."""
    c = {k: count_at(usage, p) for k, p in PATHS[family].items()}
    zero = F.lit(0).cast("long")
    return F.create_map(
        F.lit("input_text"), F.greatest(c["input"] - c["cached"], zero), F.lit("cache_read"), c["cached"],
        F.lit("output_text"), F.greatest(c["output"] - c["reasoning"], zero), F.lit("reasoning"), c["reasoning"],
    )
