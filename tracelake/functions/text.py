"""Tokens, snippets, paths and entropy of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "([a-z0-9_]+)"
MIN_TERM, MAX_TERM = 2, 64
#: JSON keys whose string values are paths.
PATH_KEYS = ("file_path", "notebook_path", "path", "target_file", "relativeWorkspacePath", "relative_workspace_path", "filepath", "file", "filename")


def tokens(text: Column) -> Column:
    """All runs of a-z, 0-9 and _ of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def term_is_indexed(term: Column) -> Column:
    return F.length(term).between(MIN_TERM, MAX_TERM)


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def compact(text: Column) -> Column:
    """White space runs become one space."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def snippet(text: Column, terms: list[str], radius: int = 40) -> Column:
    """Text around the first term found (by the terms' order), or the beginning."""
    low = F.lower(F.coalesce(text, F.lit("")))
    at = F.coalesce(*(F.nullif(F.locate(t.lower(), low), F.lit(0)) for t in terms), F.lit(1))
    return F.substring(F.coalesce(text, F.lit("")), F.greatest(at - radius, F.lit(1)), F.lit(2 * radius))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))


#: What ends a word of a shell command: blanks, quotes, brackets, and signs of redirection, lists and assignments.
SHELL_BREAKS = r"""[\s'"`=(),;|&<>]+"""


def names_a_file(word: Column) -> Column:
    """Whether a word of a command looks like a path: plain signs in every part, and parts under a folder or a name with an extension."""
    parts = F.split(word, "/")
    body = F.when(F.get(parts, F.lit(0)).isin("", ".", ".."), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    plain = (F.size(body) > 0) & F.forall(body, lambda p: p.rlike("^[-.0-9A-Z_a-z]+$"))
    dotted = word.rlike("^[-0-9A-Z_a-z]") & (F.locate(".", word) > 1) & ~word.endswith(".")
    return plain & F.when(F.size(parts) == 1, dotted | word.rlike("^[-0-9A-Z_a-z]+[.]+[.]$")).otherwise(F.size(body) > 1)


def path_tokens(tool_input: Column) -> Column:
    """Distinct paths named by known keys of a JSON text, by its shell command, or nested in it."""
    keys = "|".join(PATH_KEYS)
    nested = F.regexp_extract_all(tool_input, F.lit(rf'"(?:{keys})"\s*:\s*"((?:[^"\\]|\\.)*)"'), F.lit(1))
    command = F.coalesce(null_if_empty(F.get_json_object(tool_input, "$.command")), F.get_json_object(tool_input, "$.cmd"), F.lit(""))
    shell = F.filter(F.split(command, SHELL_BREAKS), names_a_file)
    direct = F.array(*(F.coalesce(F.get_json_object(tool_input, f"$.{k}"), F.lit("")) for k in PATH_KEYS))
    found = F.concat(F.coalesce(nested, F.array().cast("array<string>")), F.coalesce(shell, F.array().cast("array<string>")), direct)
    return F.filter(F.array_distinct(found), lambda p: p != "")


def under_root(path: Column, root: str) -> Column:
    return (path == root) | path.startswith(root.rstrip("/") + "/")


def ends_with_path(path: Column, relative: str) -> Column:
    return (path == relative) | path.endswith("/" + relative)
