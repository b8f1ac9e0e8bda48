"""Classes of events, and predicates over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds and payload types of each class.
MESSAGE_PAYLOADS = ("user_message", "agent_message", "message", "text", "event_msg")
REASONING_PAYLOADS = ("agent_reasoning", "reasoning", "thinking")
CALL_PAYLOADS = ("tool_use", "function_call", "custom_tool_call", "web_search_call")
RESULT_PAYLOADS = ("tool_result", "function_call_output", "custom_tool_call_output", "search_results_received")
COMPACTION_KINDS, COMPACTION_PAYLOADS = ("compacted_raw", "summary"), ("compacted", "summary")
RUNTIME_PAYLOADS = ("task_started", "task_complete", "turn_aborted", "item_completed", "queue-operation")
SYSTEM_KINDS = ("system", "progress", "file_history_snapshot")
SYSTEM_PAYLOADS = ("system", "progress", "file-history-snapshot", "file_history_snapshot")
WEB_PAYLOADS, WEB_TOOLS = ("web_search_call", "search_results_received"), ("WebSearch", "WebFetch")
DOMAINS = {
    "event_kind": (
        "session_meta", "turn_context", "message", "tool_call", "tool_result", "reasoning", "event_msg", "compacted_raw", "progress", "system", "summary",
        "queue_operation", "file_history_snapshot", "unknown",
    ),
    "link_type": ("parent_event", "compacted_parent", "parent_uuid", "tool_use_id", "source_tool_assistant", "subagent_parent", "unknown"),
}


def predicates(kind: Column, payload: Column, actor: Column) -> dict[str, Column]:
    """Whether an event is of each class; the classes overlap, and order is precedence."""
    who = F.lower(actor)
    message = (kind == "message") | ((kind == "event_msg") & payload.isin(*MESSAGE_PAYLOADS))
    other = who != "system"
    return {
        "user_input": (who == "user") & message,
        "assistant_response": (who == "assistant") & message,
        "reasoning": other & ((kind == "reasoning") | payload.isin(*REASONING_PAYLOADS)),
        "tool_call": other & ((kind == "tool_call") | payload.isin(*CALL_PAYLOADS)),
        "tool_response": other & ((kind == "tool_result") | payload.isin(*RESULT_PAYLOADS)),
        "compaction": kind.isin(*COMPACTION_KINDS) | payload.isin(*COMPACTION_PAYLOADS),
        "runtime": (kind == "queue_operation") | payload.isin(*RUNTIME_PAYLOADS),
        "system": (who == "system") | kind.isin(*SYSTEM_KINDS) | payload.isin(*SYSTEM_PAYLOADS),
    }


def event_type(kind: Column, payload: Column, actor: Column) -> Column:
    """The first class that fits, else `unknown`."""
    out = F.lit("unknown")
    for name, fits in reversed(predicates(kind, payload, actor).items()):
        out = F.when(fits, name).otherwise(out)
    return out


def any_type(kind: Column, payload: Column, actor: Column, wanted: tuple[str, ...]) -> Column:
    """Non-exclusive filter: fits any wanted class; `unknown` means none of the classes."""
    all_of = predicates(kind, payload, actor)
    out = F.lit(False)
    for name in wanted:
        out = out | (~_any(all_of.values()) if name == "unknown" else all_of[name])
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def internal_tool(name: Column, tools: tuple[str, ...], server: str) -> Column:
    """A tool of our own server, bare or as mcp__<server>__<tool>."""
    low = F.lower(F.trim(name))
    parts = F.split(low, "__")
    return low.isin(*tools) | ((F.size(parts) == 3) & (F.get(parts, F.lit(0)) == "mcp") & (F.get(parts, F.lit(1)) == server) & F.get(parts, F.lit(2)).isin(*tools))


def session_mode(kind: Column, payload: Column, tool: Column, internal: Column) -> Column:
    """Aggregate: web_search over mcp_internal over tool_calling over chat."""
    web = payload.isin(*WEB_PAYLOADS) | ((payload == "tool_use") & tool.isin(*WEB_TOOLS))
    calls = kind.isin("tool_call", "tool_result") | (payload == "tool_use")
    return F.when(F.count_if(web) > 0, "web_search").when(F.count_if(internal) > 0, "mcp_internal").when(F.count_if(calls) > 0, "tool_calling").otherwise("chat")


def in_domain(c: Column, domain: str) -> Column:
    """Values outside the domain become `unknown`."""
    return F.when(c.isin(*DOMAINS[domain]), c).otherwise("unknown")


def canonical_model(model: Column) -> Column:
    """Lower case, trimmed, blanks to dashes."""
    return F.replace(F.lower(F.trim(model)), F.lit(" "), F.lit("-"))


#: Payload types of a record log that belong to each kind of search.
LOGGED = {"message": ("user_message", "agent_message", "message", "text"), "reasoning": ("agent_reasoning",), "tool_call": CALL_PAYLOADS, "tool_result": RESULT_PAYLOADS}
SEARCHED_KINDS = ("message", "reasoning", "event_msg")
UNSEARCHED_PAYLOADS = ("token_count", "task_started", "task_complete", "turn_aborted", "item_completed")


def of_kinds(kind: Column, payload: Column, wanted: tuple[str, ...]) -> Column:
    """Events of any wanted kind, or logged as such."""
    return _any((kind == k) | ((kind == "event_msg") & payload.isin(*LOGGED[k])) for k in wanted)


def searched_by_default(kind: Column, payload: Column, with_tools: bool = False) -> Column:
    """What a search without kinds sees."""
    return payload != "token_count" if with_tools else kind.isin(*SEARCHED_KINDS) & ~payload.isin(*UNSEARCHED_PAYLOADS)


def says_little(actor: Column, payload: Column) -> Column:
    """System notes that a context view leaves out."""
    return (F.lower(actor) == "system") & F.lower(payload).isin("progress", "file_history_snapshot", "system")
