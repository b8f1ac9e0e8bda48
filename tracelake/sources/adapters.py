"""Adapters: records of several trace formats to canonical events, each a projection.

An adapter lists the items of a record (content blocks, or the record itself) as an array of structs and explodes it, so a
record gives zero or more events with their emission_index. Session, model and cwd that only some records
name are carried forward over the file's order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.functions.classify import DOMAINS, canonical_model
from tracelake.operators.trace import number_siblings, semantic_uid
from tracelake.sources.jsonl import parse_time
from tracelake.sources.schemas import conform

TEXT_LIMIT = 200_000
ITEM = "event_kind string, payload_type string, actor_kind string, text_content string, tool_name string, tool_call_id string, tool_phase string, tool_error int, item_id string, op_status string, usage string, turn_index int"


def j(path: str, source: str = "value") -> Column:
    return F.get_json_object(source, f"$.{path}")


def js(c: Column, path: str) -> Column:
    return F.get_json_object(c, f"$.{path}")


def elements(c: Column) -> Column:
    """Elements of a JSON array as JSON texts (empty if it is none)."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def item(kind, payload, actor, text=None, tool=None, call=None, phase=None, error=None, item_id=None, status=None, usage=None, turn=None) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    values = (kind, payload, actor, text, tool, call, phase, error, item_id, status, usage, turn)
    return F.struct(*(as_col(v).cast(t).alias(n) for v, (n, t) in zip(values, (f.split(" ") for f in ITEM.split(", ")), strict=True)))


def block_text(c: Column) -> Column:
    """Text of a content value: a string itself, or the texts of its blocks, one a line."""
    parts = F.transform(elements(c), lambda b: F.coalesce(js(b, "text"), js(b, "thinking"), js(b, "content"), js(b, "output"), F.lit("")))
    return F.when(F.trim(c).startswith("["), F.array_join(F.filter(parts, lambda x: x != ""), "\n")).otherwise(F.coalesce(c, F.lit("")))


def codex_items() -> Column:
    top, sub, body = j("type"), j("payload.type"), j("payload")
    role = F.coalesce(j("payload.role"), F.lit("assistant"))
    name, call = j("payload.name"), j("payload.call_id")
    output = F.coalesce(j("payload.output"), F.lit(""))
    said = F.when(sub == "user_message", "user").when(sub.isin("agent_message", "agent_reasoning"), "assistant").otherwise("system")
    one = (
        F.when(top == "session_meta", item("session_meta", "session_meta", "system", item_id=j("payload.id")))
        .when(top == "turn_context", item("turn_context", "turn_context", "system", turn=F.coalesce(F.expr("try_cast(get_json_object(value, '$.payload.turn_id') AS int)"), F.lit(0))))
        .when((top == "response_item") & (sub == "message"), item("message", "message", role, block_text(j("payload.content")), item_id=j("payload.id"), status=j("payload.phase")))
        .when((top == "response_item") & sub.isin("function_call", "custom_tool_call"), item("tool_call", sub, "assistant", F.coalesce(j("payload.arguments"), j("payload.input")), name, call, "request"))
        .when((top == "response_item") & sub.isin("function_call_output", "custom_tool_call_output"), item("tool_result", sub, "tool", output, None, call, "response"))
        .when((top == "response_item") & (sub == "web_search_call"), item("tool_call", sub, "assistant", j("payload.action.query"), "web_search", call, "request", status=j("payload.action.type")))
        .when((top == "response_item") & (sub == "reasoning"), item("reasoning", "reasoning", "assistant", block_text(j("payload.summary"))))
        .when(top == "event_msg", item("event_msg", sub, said, F.coalesce(j("payload.message"), j("payload.text"), F.lit("")), usage=j("payload.info.last_token_usage")))
        .when(top == "compacted", item("compacted_raw", "compacted", "system", j("payload.message")))
    )
    history = F.when(top == "compacted", F.transform(elements(j("payload.replacement_history")), lambda h: item("message", "message", F.coalesce(js(h, "role"), F.lit("assistant")), block_text(js(h, "content")))))
    return F.concat(F.when(one.isNotNull(), F.array(one)).otherwise(F.array(item("unknown", "unknown", "system", body))), F.coalesce(history, F.array().cast(f"array<struct<{ITEM.replace(' ', ':')}>>".replace(",:", ","))))


def blocks_items() -> Column:
    """One event of each content block of user and assistant messages; operational records by their type."""
    top, content = j("type"), j("message.content")
    actor = F.coalesce(j("message.role"), top)
    usage = j("message.usage")

    def block(b: Column) -> Column:
        t = js(b, "type")
        return (
            F.when(t == "thinking", item("reasoning", "reasoning", "assistant", js(b, "thinking"), usage=usage))
            .when(t == "tool_use", item("tool_call", "tool_use", "assistant", js(b, "input"), js(b, "name"), js(b, "id"), "request", usage=usage))
            .when(t == "tool_result", item("tool_result", "tool_result", "tool", block_text(js(b, "content")), None, js(b, "tool_use_id"), "response", (js(b, "is_error") == "true").cast("int")))
            .otherwise(item("message", F.coalesce(t, F.lit("text")), actor, js(b, "text"), usage=usage))
        )

    operational = F.when(top == "progress", "progress").when(top == "system", "system").when(top == "summary", "summary").when(top == "queue-operation", "queue_operation").when(top == "file-history-snapshot", "file_history_snapshot")
    other = F.array(item(operational, F.coalesce(j("data.type"), j("subtype"), top), "system", F.coalesce(j("summary"), j("content"), j("data.query"), F.lit("")), status=j("status")))
    spoken = F.when(F.trim(content).startswith("["), F.transform(elements(content), block)).otherwise(F.array(item("message", "message", actor, F.coalesce(content, F.lit("")), usage=usage)))
    return F.when(top.isin("user", "assistant"), spoken).when(operational.isNotNull(), other)


def wire_items() -> Column:
    """Messages {type, payload} of a wire log with Unix times."""
    t, p = j("message.type"), j("message.payload")
    kind = js(p, "type")
    one = (
        F.when(t.isin("TurnBegin", "SteerInput"), item("message", "user_message", "user", F.coalesce(js(p, "user_input"), js(p, "text"))))
        .when(t == "StepBegin", item("progress", "progress", "system", turn=js(p, "n").cast("int")))
        .when((t == "ContentPart") & (kind == "think"), item("reasoning", "reasoning", "assistant", js(p, "think")))
        .when(t == "ContentPart", item("message", "agent_message", "assistant", js(p, "text")))
        .when(t == "ToolCall", item("tool_call", "tool_use", "assistant", js(p, "function.arguments"), js(p, "function.name"), js(p, "id"), "request"))
        .when(t == "ToolCallPart", item("progress", "tool_use", "assistant", js(p, "arguments_part")))
        .when(t == "ToolResult", item("tool_result", "tool_result", "tool", F.coalesce(js(p, "return_value.output"), js(p, "return_value")), None, js(p, "tool_call_id"), "response", (js(p, "return_value.is_error") == "true").cast("int")))
        .when(t == "StatusUpdate", item("event_msg", "token_count", "system", usage=js(p, "token_usage")))
        .when(t.isin("TurnEnd", "CompactionBegin", "CompactionEnd"), item("summary", "summary", "system"))
        .when(t == "SubagentEvent", F.lit(None)).when(t.isNotNull(), item("unknown", "unknown", "system", p))
    )
    return F.when(one.isNotNull(), F.array(one))


def parts_items() -> Column:
    """Messages of parts: text, thoughts, function calls and their responses."""
    top, parts = j("type"), elements(j("message.parts"))

    def part(b: Column) -> Column:
        return (
            F.when(js(b, "functionCall").isNotNull(), item("tool_call", "tool_use", "assistant", js(b, "functionCall.args"), js(b, "functionCall.name"), js(b, "functionCall.id"), "request"))
            .when(js(b, "functionResponse").isNotNull(), item("tool_result", "tool_result", "tool", F.coalesce(js(b, "functionResponse.response.output"), js(b, "functionResponse.response.error"), js(b, "functionResponse.response")), js(b, "functionResponse.name"), js(b, "functionResponse.id"), "response", js(b, "functionResponse.response.error").isNotNull().cast("int")))
            .when(js(b, "thought") == "true", item("reasoning", "thinking", "assistant", js(b, "text")))
            .when(js(b, "text").isNotNull(), item("message", "agent_message", "assistant", js(b, "text"), usage=j("usageMetadata")))
        )

    asked = F.array_join(F.filter(F.transform(parts, lambda b: js(b, "text")), lambda x: x.isNotNull()), "\n")
    sub = j("subtype")
    told = F.when(sub == "custom_title", item("session_meta", "session_meta", "system", j("systemPayload.title"))).when(sub == "chat_compression", item("summary", "compacted", "system", j("systemPayload.summary"))).otherwise(item("system", "system", "system"))
    return (
        F.when(top == "user", F.array(F.when(sub.isin("notification", "cron"), item("system", "system", "system", asked)).otherwise(item("message", "user_message", "user", asked))))
        .when(top.isin("assistant", "tool_result"), F.array_compact(F.transform(parts, part)))
        .when(top == "system", F.array(told)).otherwise(F.array(item("unknown", "unknown", "system")))
    )


def kinds_items() -> Column:
    """Records {kind, data} with content blocks of kinds."""
    k, blocks = j("kind"), elements(j("data.content"))

    def block(b: Column) -> Column:
        t = js(b, "kind")
        status = js(b, "data.status")
        return (
            F.when(t == "text", F.when(k == "Prompt", item("message", "user_message", "user", js(b, "data"))).otherwise(item("message", "agent_message", "assistant", js(b, "data"))))
            .when(t == "thinking", item("reasoning", "reasoning", "assistant", js(b, "data.text")))
            .when(t == "toolUse", item("tool_call", "tool_use", "assistant", js(b, "data.input"), js(b, "data.name"), js(b, "data.toolUseId"), "request"))
            .when(t == "toolResult", item("tool_result", "tool_result", "tool", js(b, "data.content[0].data"), None, js(b, "data.toolUseId"), "response", (~F.coalesce(status, F.lit("")).isin("", "success", "ok")).cast("int")))
            .otherwise(item("unknown", "unknown", "system", js(b, "data")))
        )

    used = F.to_json(F.struct(*(j(f"data.{c}").cast("double").alias(c) for c in ("input_tokens", "output_tokens", "credits"))))
    meta = item("session_meta", "session_meta", "system", j("data.title"), item_id=j("data.session_id"), usage=used)
    return F.when(k == "SessionMeta", F.array(meta)).when(k.isin("Prompt", "AssistantMessage", "ToolResults"), F.transform(blocks, block)).when(k == "Compaction", F.array(item("summary", "compacted", "system", j("data.summary")))).otherwise(F.array(item("unknown", "unknown", "system", j("data.message"))))


def trajectory_items() -> Column:
    """conversations[] of a trajectory: think and tool_call tags part an answer into segments."""
    def turn(c: Column) -> Column:
        who, value = js(c, "from"), F.coalesce(js(c, "value"), F.lit(""))
        inner = lambda tag: F.transform(F.regexp_extract_all(value, F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.trim)
        think = F.transform(inner("think"), lambda t: item("reasoning", "thinking", "assistant", t))
        calls = F.transform(inner("tool_call"), lambda t: item("tool_call", "tool_use", "assistant", js(t, "arguments"), js(t, "name"), None, "request"))
        plain = F.regexp_replace(F.regexp_replace(value, r"(?s)<(think|tool_call)>.*?</\1>", ""), r"^\s+|\s+$", "")
        text = F.filter(F.array(item("message", "agent_message", "assistant", plain)), lambda x: x["text_content"] != "")
        answers = F.transform(inner("tool_response"), lambda t: item("tool_result", "tool_result", "tool", F.coalesce(js(t, "content"), t), js(t, "name"), js(t, "tool_call_id"), "response"))
        return (
            F.when(who == "gpt", F.concat(think, text, calls)).when(who == "tool", answers)
            .when(who == "human", F.array(item("message", "user_message", "user", value))).otherwise(F.array(item("system", "system", "system", value)))
        )

    return F.concat(F.array(item("session_meta", "session_meta", "system")), F.flatten(F.transform(elements(j("conversations")), turn)))


def store_items() -> Column:
    """Records of session stores: session, message, part and tool rows of one type each."""
    t, role = j("type"), j("role")
    part, state = j("data.type"), j("data.state.status")
    done = state.isin("completed", "error") | j("data.state.output").isNotNull()
    request = item("tool_call", "tool_use", "assistant", j("data.state.input"), j("data.tool"), j("data.callID"), "request")
    response = item("tool_result", "tool_result", "tool", F.coalesce(j("data.state.output"), j("data.state.error")), j("data.tool"), j("data.callID"), "response", (state == "error").cast("int"))
    speaker = F.coalesce(j("message_role"), F.lit("assistant"))
    return (
        F.when(t.isin("session_meta", "opencode_session"), F.array(item("session_meta", "session_meta", "system", j("title"))))
        .when((t == "opencode_part") & (part == "text"), F.array(item("message", F.when(speaker == "user", "user_message").otherwise("agent_message"), speaker, j("data.text"))))
        .when((t == "opencode_part") & (part == "reasoning"), F.array(item("reasoning", "reasoning", "assistant", j("data.text"))))
        .when((t == "opencode_part") & (part == "tool"), F.when(done, F.array(request, response)).otherwise(F.array(request)))
        .when(t == "message", F.array(item("message", F.when(j("reasoning") == "true", "reasoning").when(role == "user", "user_message").otherwise("agent_message"), role, j("content"))))
        .when(t == "tool_request", F.array(item("tool_call", "tool_use", "assistant", j("input"), j("tool_name"), j("tool_call_id"), "request")))
        .when(t == "tool_response", F.array(item("tool_result", "tool_result", "tool", F.coalesce(j("output"), j("result"), j("content")), j("tool_name"), j("tool_call_id"), "response")))
    )


def entries_items() -> Column:
    """Typed session entries with messages of roles and blocks."""
    t, role, content = j("type"), j("message.role"), j("message.content")

    def block(b: Column) -> Column:
        k = js(b, "type")
        return (
            F.when(k == "thinking", item("reasoning", "thinking", "assistant", js(b, "thinking")))
            .when(k == "toolCall", item("tool_call", "tool_use", "assistant", js(b, "arguments"), js(b, "name"), js(b, "id"), "request"))
            .otherwise(item("message", "agent_message", "assistant", js(b, "text"), usage=j("message.usage")))
        )

    spoken = (
        F.when(role == "user", F.array(item("message", "user_message", "user", block_text(content)))).when(role == "assistant", F.transform(elements(content), block))
        .when(role == "toolResult", F.array(item("tool_result", "tool_result", "tool", block_text(content), j("message.toolName"), j("message.toolCallId"), "response", (j("message.isError") == "true").cast("int"))))
        .when(role == "bashExecution", F.array(item("tool_result", "tool_result", "tool", j("message.output"), "bash", None, "response")))
        .when(role == "branchSummary", F.array(item("summary", "summary", "system", j("message.summary")))).when(role == "compactionSummary", F.array(item("summary", "compacted", "system", j("message.summary"))))
        .otherwise(F.array(item("system", "system", "system", block_text(content))))
    )
    return (
        F.when(t == "message", spoken).when(t.isin("session", "session_info", "title"), F.array(item("session_meta", "session_meta", "system", F.coalesce(j("name"), j("title")))))
        .when(t == "compaction", F.array(item("summary", "compacted", "system", j("summary")))).when(t == "branch_summary", F.array(item("summary", "summary", "system", j("summary"))))
        .when(t.isin("model_change", "thinking_level_change"), F.array(item("system", "system", "system", F.coalesce(j("modelId"), j("thinkingLevel"))))).otherwise(F.array(item("unknown", "unknown", "system")))
    )


def bubbles_items() -> Column:
    """Key-value rows of a composer database."""
    key, v = j("key"), j("value")
    tool = js(v, "toolFormerData.name")
    call = js(v, "toolFormerData.toolCallId")
    ended = js(v, "toolFormerData.status").isin("completed", "error", "cancelled")
    request = item("tool_call", "tool_use", "assistant", F.coalesce(js(v, "toolFormerData.params"), js(v, "toolFormerData.rawArgs")), tool, call, "request")
    response = item("tool_result", "tool_result", "tool", js(v, "toolFormerData.result"), tool, call, "response", (js(v, "toolFormerData.status") == "error").cast("int"))
    said = F.when(js(v, "type") == "1", item("message", "user_message", "user", js(v, "text"))).otherwise(item("message", "agent_message", "assistant", js(v, "text")))
    return (
        F.when(key.startswith("composerData:"), F.array(item("session_meta", "session_meta", "system", js(v, "name"))))
        .when(key.startswith("bubbleId:") & tool.isNotNull(), F.when(ended, F.array(request, response)).otherwise(F.array(request)))
        .when(key.startswith("bubbleId:") & (js(v, "thinking.text") != ""), F.array(item("reasoning", "reasoning", "assistant", js(v, "thinking.text"))))
        .when(key.startswith("bubbleId:"), F.array(said))
    )


#: Format name -> (items, session id, time, model, cwd).
FORMATS: dict[str, tuple[Callable[[], Column], tuple[str, ...], tuple[str, ...], tuple[str, ...], tuple[str, ...]]] = {
    "codex": (codex_items, ("payload.id",), ("timestamp",), ("payload.model",), ("payload.cwd",)),
    "claude-code": (blocks_items, ("sessionId",), ("timestamp",), ("message.model",), ("cwd",)),
    "kimi-cli": (wire_items, (), ("timestamp",), (), ()),
    "qwen-code": (parts_items, ("sessionId",), ("timestamp",), ("model",), ("cwd",)),
    "kiro-cli": (kinds_items, (), ("data.meta.timestamp",), (), ()),
    "hermes": (trajectory_items, (), ("timestamp",), ("model",), ()),
    "opencode": (store_items, ("session_id", "id"), ("time_created",), ("message_model_id", "model.id"), ("directory",)),
    "nac": (store_items, ("session_id",), ("timestamp",), ("model",), ("cwd",)),
    "pi-coding-agent": (entries_items, (), ("timestamp",), ("message.model", "modelId"), ("cwd",)),
    "prime-agent": (entries_items, (), ("timestamp",), ("message.model", "modelId"), ("cwd",)),
    "cursor": (bubbles_items, ("value.composerId",), ("value.createdAt",), (), ()),
}


def normalize(records: DataFrame, harness: str, source_name: str | None = None, author: str = "") -> DataFrame:
    """Canonical events of records (source_file, source_line_no, source_offset, value).

    What earlier records of a file name for later ones is carried over its records here; columns session_hint, model_hint and cwd_hint, if
    there are     are any, stand for the records that were read before; record_version is the version of the events.
    """
    hint = lambda c: F.col(f"{c}_hint") if f"{c}_hint" in records.columns else F.lit(None).cast("string")
    generation = ["source_generation"] if "source_generation" in records.columns else []
    items, session, time, model, cwd = FORMATS[harness]
    version = F.coalesce(F.col("record_version") if "record_version" in records.columns else F.lit(None), F.lit(1)).cast("long")
    first = lambda paths: F.coalesce(*(F.nullif(j(p), F.lit("")) for p in paths), F.lit(None).cast("string")) if paths else F.lit(None).cast("string")
    w = Window.partitionBy("source_file").orderBy("source_line_no")
    before = w.rowsBetween(Window.unboundedPreceding, 0)
    own_id = first(session)
    if harness == "codex":  # only the header's id names the session
        own_id = F.when(j("type") == "session_meta", own_id)
    if harness == "cursor":
        own_id = F.coalesce(own_id, F.nullif(F.regexp_extract(j("key"), r"^bubbleId:([^:]+)", 1), F.lit("")))
    in_path = F.regexp_extract("source_file", r"([0-9a-fA-F]{8}-[0-9a-fA-F-]{27})", 1)
    stem = F.regexp_extract("source_file", r"([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)
    ts, known = parse_time(first(time))
    rows = records.select(
        "source_file", "source_line_no", "source_offset", *generation, version.alias("event_version"), "value", ts.alias("event_ts"), known.alias("_timed"), first(time).alias("record_ts"),
        F.coalesce(F.last(own_id, ignorenulls=True).over(before), hint("session"), F.nullif(in_path, F.lit("")), stem).alias("session_id"),
        canonical_model(F.coalesce(F.last(first(model), ignorenulls=True).over(before), hint("model"))).alias("model"), F.coalesce(F.last(first(cwd), ignorenulls=True).over(before), hint("cwd")).alias("cwd"),
        F.coalesce(j("requestId"), j("payload.turn_id")).alias("request_id"), F.coalesce(j("parentUuid"), j("parent_id"), j("parentId")).alias("parent_uid"),
        j("durationMs").cast("long").alias("latency_ms"), j("retryAttempt").cast("int").alias("retry_count"), items().alias("_items"),
    )
    rows = rows.select("*", F.posexplode("_items").alias("emission_index", "_i")).select("*", "_i.*").drop("_items", "_i")
    rows = rows.withColumns({
        "event_kind": F.when(F.col("event_kind").isin(*DOMAINS["event_kind"]), F.col("event_kind")).otherwise("unknown"), "text_content": F.left(F.coalesce("text_content", F.lit("")), F.lit(TEXT_LIMIT)),
        "harness": F.lit(harness), "source_name": F.lit(source_name or harness), "author": F.lit(author), "payload_json": F.col("value"), "token_usage_json": F.coalesce("usage", F.lit(""))
    })
    keys = ["session_id", "harness", "record_ts", "event_kind", "payload_type", "actor_kind", "tool_call_id", "tool_phase", "text_content", "payload_json"]
    rows = rows.withColumn("event_uid", semantic_uid([F.col(k) for k in keys]))
    rows = number_siblings(rows, "event_uid", ["source_file", "source_line_no", "emission_index"])
    return conform(rows)


def time_errors(records: DataFrame, harness: str) -> DataFrame:
    """Dead letters for records that name a time which cannot be read."""
    first = F.coalesce(*(j(p) for p in FORMATS[harness][2]))
    _, known = parse_time(first)
    return records.filter(first.isNotNull() & ~known).select("source_file", "source_line_no", F.lit("timestamp_parse_error").alias("error_kind"), F.lit("timestamp_parse_error").alias("error_text"), F.left(first, F.lit(200)).alias("fragment"))


def links(events: DataFrame) -> DataFrame:
    """Edges: to parents named by records, and from tool results to their calls."""
    parent = events.filter("parent_uid <> ''").select("session_id", "event_uid", F.lit("").alias("linked_uid"), F.col("parent_uid").alias("external_id"), F.lit("parent_uuid").alias("link_type"))
    answer = events.filter("event_kind = 'tool_result' and tool_call_id <> ''").select("session_id", "event_uid", F.lit("").alias("linked_uid"), F.col("tool_call_id").alias("external_id"), F.lit("tool_use_id").alias("link_type"))
    return parent.unionByName(answer)


def tool_rows(events: DataFrame) -> DataFrame:
    call = F.col("tool_phase") == "request"
    return events.filter("tool_phase in ('request', 'response')").select("session_id", "event_uid", "tool_call_id", "tool_name", "tool_phase", F.when(call, F.col("text_content")).otherwise("").alias("input_json"), F.when(call, "").otherwise(F.col("text_content")).alias("output_text"), "tool_error")
