import json
import os

from tracelake.operators.trace import latest
from tracelake.sources import sidecar
from tracelake.sources.adapters import normalize
from tracelake.sources.growing import CURSOR
from tracelake.sources.schemas import EVENTS


def line(kind, text):
    return json.dumps({"kind": kind, "data": {"content": [{"kind": "text", "data": text}]}}) + "\n"


def document(session, cwd, title="t", paid=(1.5, 2)):
    turns = [{"input_token_count": 10, "output_token_count": 3, "metering_usage": [{"unit": "credit", "value": p}, {"unit": "second", "value": 7}]} for p in paid]
    return json.dumps({"session_id": session, "cwd": cwd, "title": title, "session_state": {"rts_model_state": {"model_info": {"model_id": "m-1"}}, "conversation_metadata": {"user_turn_metadatas": turns}}})


class Folder:
    def __init__(self, spark, path):
        self.spark, self.path, self.cursors, self.state = spark, path, None, None

    def go(self):
        """Events due, by file and line, and errors by file."""
        records, errors, cursors, state = sidecar.follow(self.spark, str(self.path), self.cursors, self.state)
        events = normalize(records, "kiro-cli").collect()
        errors = sorted(os.path.basename(r.source_file) for r in errors.collect())
        self.cursors, self.state = self.spark.createDataFrame(cursors.collect(), CURSOR), self.spark.createDataFrame(state.collect(), sidecar.STATE)
        return sorted((os.path.basename(r.source_file), r.source_line_no, r.session_id, r.cwd, r.event_version) for r in events), errors, events


def test_an_edit_replays_its_transcript_alone(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.jsonl").write_text(line("Prompt", f"{name}1") + line("AssistantMessage", f"{name}2"))
        (tmp_path / f"{name}.json").write_text(document(f"s-{name}", "/w"))
    folder = Folder(spark, tmp_path)
    due, errors, events = folder.go()
    assert due == [(f"{n}.jsonl", k, f"s-{n}", "/w", 1) for n in "ab" for k in (0, 1, 2)] and errors == []
    meta = json.loads(next(r for r in events if r.event_kind == "session_meta").token_usage_json)
    assert meta == {"input_tokens": 20.0, "output_tokens": 6.0, "credits": 3.5}
    assert folder.go()[:2] == ([], [])
    (tmp_path / "a.json").write_text(document("s-a", "/moved"))
    assert folder.go()[0] == [("a.jsonl", k, "s-a", "/moved", 2) for k in (0, 1, 2)]
    (tmp_path / "a.json").write_text(document("s-a", "/moved", title="other"))  # nothing that the lines carry
    with open(tmp_path / "b.jsonl", "a") as f:
        f.write(line("Prompt", "b3"))
    assert folder.go()[0] == [("a.jsonl", 0, "s-a", "/moved", 3), ("b.jsonl", 3, "s-b", "/w", 1)]


def test_broken_and_missing_documents(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(line("Prompt", "a1"))
    (tmp_path / "a.json").write_text("{broken")
    (tmp_path / "lone.jsonl").write_text(line("Prompt", "x"))
    folder = Folder(spark, tmp_path)
    assert folder.go()[:2] == ([("a.jsonl", 1, "a", None, 1), ("lone.jsonl", 1, "lone", None, 1)], ["a.json"])
    (tmp_path / "a.json").write_text(document("s-a", "/w"))  # mended
    assert folder.go()[:2] == ([("a.jsonl", 0, "s-a", "/w", 2), ("a.jsonl", 1, "s-a", "/w", 2)], [])
    (tmp_path / "a.json").unlink()
    assert folder.go()[:2] == ([], [])
    (tmp_path / "a.json").write_text(document("", "/w"))  # back, without a session: named by its file
    assert [x[:3] for x in folder.go()[0]] == [("a.jsonl", 0, "a"), ("a.jsonl", 1, "a")]


def test_readers_take_the_replayed_events(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(line("Prompt", "a1") * 2)
    (tmp_path / "a.json").write_text(document("s-a", "/w"))
    folder = Folder(spark, tmp_path)
    first = folder.go()[2]
    (tmp_path / "a.json").write_text(document("s-a", "/moved"))
    both = spark.createDataFrame([*first, *folder.go()[2]], EVENTS)
    rows = latest(both.filter("event_kind = 'message'"), ["session_id", "event_uid"], "event_version").collect()
    assert [(r.cwd, r.event_version) for r in rows] == [("/moved", 2)] * 2
