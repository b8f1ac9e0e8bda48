import random

from pyspark.sql import functions as F

from tracelake.functions import classify, cursor
from tracelake.functions.accounting import buckets
from tracelake.functions.redaction import placeholder_count, redact
from tracelake.functions.text import path_tokens
from tracelake.operators import analytics, sessions, trace
from tracelake.operators.search import search_events


def test_explicit_turn_wins_and_floor_is_one(spark):
    rows = [("s", "a", 1, "assistant", "message", None), ("s", "b", 2, "user", "message", None), ("s", "c", 3, "assistant", "message", 7)]
    df = spark.createDataFrame(rows, "session_id string, event_uid string, event_ts int, actor_kind string, event_kind string, turn_index int")
    got = {r.event_uid: (r.event_order, r.turn_seq, r.event_ordinal) for r in trace.conversation_trace(df).collect()}
    assert got == {"a": (1, 1, 1), "b": (2, 1, 2), "c": (3, 7, 1)}


def test_latest_takes_highest_version(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("k", 2, "mid"), ("z", 1, "only")], "k string, v int, x string")
    assert {r.k: r.x for r in trace.latest(df, ["k"], "v").collect()} == {"k": "new", "z": "only"}


def test_tool_pairing_is_a_stack(spark):
    rng, rows, want = random.Random(3), [], {}
    for g in range(60):
        stack = []
        for k in range(rng.randint(1, 14)):
            uid, kind = f"{g}-{k}", rng.choice(["tool_call", "tool_result"])
            rows.append((str(g), 1, "c", k, uid, kind))
            if kind == "tool_call":
                stack.append(uid)
            else:
                want[uid] = stack.pop() if stack else None
    df = spark.createDataFrame(rows, "session_id string, turn_seq int, tool_call_id string, event_order int, event_uid string, event_kind string")
    assert {r.result_uid: r.call_uid for r in trace.pair_tools(df).collect()} == want


def test_semantic_uid_tells_field_borders_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string")
    a, b = df.select(trace.semantic_uid([F.col("x"), F.col("y")]).alias("u")).collect()
    assert a.u != b.u


def test_redaction_is_idempotent_and_counts(spark):
    secret = "ghp_" + "a1B2" * 10
    df = spark.createDataFrame([(f"x {secret} y token = \"{'0123456789abcdef' * 2}\"",), ("nothing here",), (None,)], "t string")
    once = df.select(redact(F.col("t")).alias("t"))
    twice = once.select(redact(F.col("t")).alias("t"))
    assert once.collect() == twice.collect()
    assert [r.n for r in once.select(placeholder_count(F.col("t")).alias("n")).collect()] == [2, 0, None]
    assert secret not in once.first().t


def test_each_assigned_value_is_judged_on_its_own(spark):
    low, secret, git = "ab" * 15, "q8Zr3LmX7vTn1KcW5yHd9BpF2sGj6", "1111222233334444aaaabbbb1234567800000000"
    rows = [
        (f"a token = '{low}', password: {secret} end", f"a token = '{low}', password: [REDACTED:generic-api-key] end"),
        (f"secret={secret}\npassword={low}", f"secret=[REDACTED:generic-api-key]\npassword={low}"),
        (f"token={git}", "token=[REDACTED:generic-api-key]"),
        (f"API_KEY={secret} {secret}", f"API_KEY=[REDACTED:generic-api-key] {secret}"),
        ("token=abcdefghijabcdefghijklm", "token=abcdefghijabcdefghijklm"),
        ("token=my.example.q8Zr3LmX7vTn1KcW5yHd", "token=my.example.q8Zr3LmX7vTn1KcW5yHd"),
        ("token=a1b2.c3d4.e5f6.g7h8.i9", "token=[REDACTED:generic-api-key]"),
        ("token=" + "0" * 24, "token=" + "0" * 24), ("", ""), (None, None),
    ]
    df = spark.createDataFrame(rows, "t string, want string")
    assert [(r.got, r.want) for r in df.select(redact(F.col("t")).alias("got"), "want").collect()] == [(w, w) for _, w in rows]


def test_cursor_round_trip_and_filters():
    c = cursor.encode({"t": 5, "id": "x"}, {"mode": "chat"})
    assert cursor.decode(c, {"mode": "chat"}) == {"t": 5, "id": "x"}
    for bad, f in ((c, {"mode": "web"}), ("!!", {"mode": "chat"})):
        try:
            cursor.decode(bad, f)
            raise AssertionError
        except ValueError:
            pass
    assert cursor.clamp(None, 25, 1, 50) == 25 and cursor.clamp(900, 25, 1, 50) == 50
    assert cursor.safe("a/b-1") == "a/b-1"


def test_paths_from_keys_commands_and_nesting(spark):
    df = spark.createDataFrame([('{"file_path": "src/a.rs", "n": {"path": "b/c.txt"}}',), ('{"command": "cat ./x/y.md | wc"}',), ("no json",)], "t string")
    assert [r.p for r in df.select(path_tokens(F.col("t")).alias("p")).collect()] == [["src/a.rs", "b/c.txt"], ["./x/y.md"], []]


def test_token_buckets_are_exclusive(spark):
    df = spark.createDataFrame([('{"input_tokens": 10, "input_tokens_details": {"cached_tokens": 4}, "output_tokens": 6, "output_tokens_details": {"reasoning_tokens": 9}}',)], "u string")
    assert df.select(buckets(F.col("u"), "openai").alias("b")).first().b == {"input_text": 6, "cache_read": 4, "output_text": 0, "reasoning": 9}


def test_search_ranks_ties_by_id_and_empty_query(spark):
    df = spark.createDataFrame([(3, "alpha beta"), (1, "alpha beta"), (2, "gamma"), (4, None)], "doc_id int, text string")
    assert [r.doc_id for r in search_events(df, "alpha").orderBy(F.desc("score"), "doc_id").collect()] == [1, 3]
    assert search_events(df, "!").count() == 0


def test_internal_tools_and_modes(spark):
    df = spark.createDataFrame([("open",), ("mcp__own__open",), ("mcp__other__open",), ("x",)], "n string")
    assert [r.i for r in df.select(classify.internal_tool(F.col("n"), ("open",), "own").alias("i")).collect()] == [True, True, False, False]


def test_label_precedence(spark):
    df = spark.createDataFrame([(None, "  first line\nsecond", "wire"), ("Title", "x", "wire"), (None, None, "wire")], "a string, b string, c string")
    none = F.lit(None).cast("string")
    assert [r.x for r in df.select(sessions.display_label(F.col("a"), F.col("b"), F.col("c"), none, none, F.lit("?")).alias("x")).collect()] == ["first line", "Title", "wire"]


def test_status_is_three_valued():
    assert analytics.ingest_status(1000, None, None, 0)["health"] == "unknown"
    assert analytics.ingest_status(1000, 900, 0, 0) == {"health": "healthy", "freshness": "fresh", "readiness": "ready"}
    assert analytics.ingest_status(99_000, 900, 0, 0)["freshness"] == "stale"


def test_text_at_any_depth(spark):
    from tracelake.functions.json_text import message_text

    rows = ['{"content": [{"text": "a"}, {"content": {"thinking": "b", "input": "c"}}, 5, " "]}', "plain", None, '["x", ["y"]]', '{"other": "z"}']
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    assert [r.t for r in df.select(message_text(F.col("t")).alias("t")).collect()] == ["a\nb\nc", "plain", "", "x\ny", ""]


def test_paths_and_windows(spark):
    from tracelake.functions.paths import analytics_window, normal_path

    df = spark.createDataFrame([("/a/../../b/./c",), ("../x/..//y",), ("",), ("/",)], "p string")
    assert [r.p for r in df.select(normal_path(F.col("p")).alias("p")).collect()] == ["/b/c", "../y", "", "/"]
    e = spark.createDataFrame([("2024-01-01 10:00:00",), ("2024-01-02 11:00:00",)], "event_ts string").withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    row = analytics_window(e, "2024-01-01 12:00:00", "6h").first()
    assert str(row.display_end) == "2024-01-01 10:00:00" and row.bucket_seconds == 300


def test_json_api(spark, sf):
    import json

    from tracelake.api import Conversations
    from tracelake.plans.canonical import conversation_events

    c = Conversations(conversation_events(spark, sf))
    first = json.loads(c.list_conversations_json(3))
    second = json.loads(c.list_conversations_json(3, first["next_cursor"]))
    seen = [x["session_id"] for x in first["items"] + second["items"]]
    assert len(seen) == 6 == len(set(seen))
    one = json.loads(c.get_conversation_json(seen[0], include_turns=True))
    assert one["total_turns"] == max(t["turn_seq"] for t in one["turns"]) and c.get_conversation_json("nobody") == "null"
    hits = json.loads(c.search_events_json("the", 5))
    assert 0 < len(hits) <= 5 and hits == sorted(hits, key=lambda h: (-h["score"], h["event_uid"]))
    assert json.loads(c.search_conversations_json("the and", 5, 2))
