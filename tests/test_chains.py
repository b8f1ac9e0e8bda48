import collections
import random

from tracelake.operators.trace import pair_in_order, root_sessions


def test_results_take_calls_in_line(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for s in range(60):
        waiting = collections.deque()
        for k in range(rng.randint(0, 30)):
            kind = rng.choice(["tool_call", "tool_result", "message"])
            uid, own, name = f"{s}-{k}", rng.choice(["", None, f"id{k}"]), rng.choice(["", f"n{k}"])
            rows.append((f"s{s}", uid, k, kind, own, name))
            if kind == "tool_call":
                waiting.append((uid, own, name))
            elif kind == "tool_result":
                call = waiting.popleft() if waiting else (None, None, None)
                want[uid] = (call[0], own or call[1] or f"result-{uid}", name or call[2] or "")
    df = spark.createDataFrame(rows, "session_id string, event_uid string, event_order int, event_kind string, tool_call_id string, tool_name string")
    assert {r.result_uid: (r.call_uid, r.tool_call_id, r.tool_name) for r in pair_in_order(df).collect()} == want
    assert any(v[0] for v in want.values()) and any(not v[0] for v in want.values())


def roots(parents):
    out = {}
    for s in parents:
        path = [s]
        while parents.get(path[-1]) is not None and parents[path[-1]] not in path:
            path.append(parents[path[-1]])
        last = parents.get(path[-1])
        out[s] = (path[-1], len(path) - 1) if last is None else (min(path[path.index(last) :]), None)
    return out


def test_chains_circles_and_strangers(spark):
    rng = random.Random(1)
    for n in (1, 7, 60):
        parents = {k: rng.choice([None, rng.randrange(n + 3), k - 1 if k else None]) for k in range(n)}
        rows = [(k, None if p == k else p) for k, p in parents.items()]
        got = {r.session_id: (r.root_id, r.depth) for r in root_sessions(spark.createDataFrame(rows, "session_id int, parent_id int")).collect()}
        assert got == roots(dict(rows))


def test_long_chain_and_odd_rows(spark):
    chain = [(k, k - 1 if k else None) for k in range(200)]
    got = {r.session_id: (r.root_id, r.depth) for r in root_sessions(spark.createDataFrame([*chain, (None, 4), (500, 500), (600, None), (600, 199), (600, 300)], "session_id int, parent_id int")).collect()}
    assert all(got[k] == (0, k) for k in range(200)) and got[500] == (500, 0) and got[600] == (0, 200) and len(got) == 202
    assert root_sessions(spark.createDataFrame([], "session_id int, parent_id int")).count() == 0
