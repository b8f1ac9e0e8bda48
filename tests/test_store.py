import json
import sqlite3

import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In

from tracelake.sources.adapters import normalize
from tracelake.sources.keyvalue import PushingReader, affected, sqlite_table, store_records


@pytest.fixture
def store(spark, tmp_path):
    path = tmp_path / "s.db"
    with sqlite3.connect(path) as db:
        db.executescript("""create table session (id text primary key, title text, directory text, time_created integer, time_updated integer);
          create table message (id text, session_id text, time_created integer, time_updated integer, data text);
          create table part (id text, message_id text, time_created integer, time_updated integer, data text)""")
        for s in range(3):
            db.execute("insert into session values (?, ?, ?, ?, ?)", (f"s{s}", f"title {s}", f"/w{s}", 1_714_557_600_000, 1))
            for m in range(4):
                db.execute("insert into message values (?, ?, ?, ?, ?)", (f"m{s}{m}", f"s{s}", 1_714_557_600_000 + m, 1, json.dumps({"role": "user" if m % 2 == 0 else "assistant", "modelID": f"model-{m}"})))
                kinds = [{"type": "text", "text": f"t{s}{m}"}, {"type": "tool", "tool": "sh", "callID": f"c{s}{m}", "state": {"status": "completed", "input": {"a": 1}, "output": "done"}}][: 1 + m % 2]
                for k, data in enumerate(kinds):
                    db.execute("insert into part values (?, ?, ?, ?, ?)", (f"p{s}{m}{k}", f"m{s}{m}", 1_714_557_601_000 + 10 * m + k, 1, json.dumps(data)))

    def tables(**options):
        return [sqlite_table(spark, str(path), t, **options) for t in ("session", "message", "part")]

    return path, tables


def flat(path):
    """The same store as flat records."""
    db = sqlite3.connect(path)
    out = []
    for s, title, where, at in db.execute("select id, title, directory, time_created from session"):
        rows = [{"type": "opencode_session", "id": s, "title": title, "directory": where, "time_created": at}]
        for p, m, t, data, about in db.execute("select p.id, m.id, p.time_created, p.data, m.data from part p join message m on m.id = p.message_id where m.session_id = ? order by p.time_created, p.id", (s,)):
            about = json.loads(about)
            rows.append({"type": "opencode_part", "session_id": s, "id": p, "message_id": m, "time_created": t, "message_role": about["role"], "message_model_id": about["modelID"], "directory": where, "data": json.loads(data)})
        out += [(f"{path}#{s}", k + 1, 0, json.dumps(r)) for k, r in enumerate(rows)]
    return out


SAME = ["session_id", "event_ts", "event_kind", "payload_type", "actor_kind", "tool_call_id", "tool_name", "tool_phase", "text_content", "model", "cwd", "source_line_no", "emission_index"]


def test_tables_give_the_events_of_flat_records(spark, store):
    path, tables = store
    rows = lambda df: sorted(map(tuple, normalize(df, "opencode").select(*SAME).collect()), key=repr)
    got = rows(store_records(*tables(part_rows=3)))
    assert got == rows(spark.createDataFrame(flat(path), "source_file string, source_line_no long, source_offset long, value string"))
    assert len(got) == 3 + 3 * (4 + 2 * 2)


def test_only_touched_sessions_are_given_again(spark, store):
    path, tables = store
    with sqlite3.connect(path) as db:
        db.execute("update part set time_updated = 7 where id = 'p110'")
        db.execute("update session set time_updated = 8 where id = 's2'")
        db.execute("insert into part values ('loose', 'nowhere', 5, 9, '{\"type\": \"text\", \"text\": \"x\"}')")
    again = store_records(*affected(*tables(), 5))
    assert {r.source_file.split("#")[1] for r in again.collect()} == {"s1", "s2", "nowhere"}
    whole = {(r.source_file, r.source_line_no): r.value for r in store_records(*tables()).collect()}
    assert all(whole[r.source_file, r.source_line_no] == r.value for r in again.collect())
    assert store_records(*affected(*tables(), 9)).count() == 0


def test_ranges_of_rows_and_filters(spark, store):
    path, tables = store
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        part = tables(part_rows=4)[2]
        assert part.rdd.getNumPartitions() == 5 and part.count() == 18
        for where in ("source_rowid > 10 and time_created < 1714557601030", "time_updated in (1, 3) and source_rowid <= 2", "id = 'p000'", "time_created = 5"):
            assert part.filter(where).count() == part.toPandas().query(where.replace(" = ", " == ")).shape[0]
        reader = PushingReader({"path": str(path), "table": "part"}, part.schema)
        kept = list(reader.pushFilters([GreaterThan(("source_rowid",), 10), In(("time_updated",), (1, 3)), EqualTo(("id",), "p000"), EqualTo(("source_file",), "x")]))
        assert [f.attribute for f in kept] == [("id",), ("source_file",)]  # texts are compared by Spark
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert [r[1] for r in rows] == list(range(11, 19))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_values_of_other_kinds_and_empty_table(spark, tmp_path):
    with sqlite3.connect(tmp_path / "o.db") as db:
        db.executescript("create table t (n integer, x real, s text); create table e (n integer)")
        db.executemany("insert into t values (?, ?, ?)", [(1, 2.5, "a"), ("many", "none", b"\xff"), (None, None, None)])
    load = lambda t: sqlite_table(spark, str(tmp_path / "*.db"), t)
    assert [tuple(r)[1:] for r in load("t").orderBy("source_rowid").collect()] == [(1, 1, 2.5, "a"), (2, None, None, "�"), (3, None, None, None)]
    assert load("e").count() == 0


def test_tasks_follow_the_rows(spark, store, monkeypatch):
    """The session's shuffle partitions, four here, took all rows of any store before."""
    from tracelake.sources import keyvalue

    monkeypatch.setattr(keyvalue, "TASK_ROWS", 2)
    s, m, p = store[1]()
    want = sorted(map(tuple, store_records(s, m, p).collect()))
    assert store_records(s, m, p).rdd.getNumPartitions() == -(-len(want) // 2) > 8
    monkeypatch.setattr(keyvalue, "TASK_ROWS", 10**9)
    assert sorted(map(tuple, store_records(s, m, p).collect())) == want
