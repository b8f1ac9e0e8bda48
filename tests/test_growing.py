"""Growing files: only appended bytes are read, replaced files start again, parts and batches number lines on."""

import io
import json
import os
import random

import pyarrow.fs as fs
import pytest

from tracelake.sources import growing
from tracelake.streaming import ingest


class Counted(io.BytesIO):
    """A file that counts the bytes read from it."""

    total = 0

    def read_at(self, n, at):
        self.seek(at)
        data = self.read(n)
        Counted.total += len(data)
        return data


def lines_of(data, at, stop, end, inside, limit=growing.LINE_LIMIT):
    return list(growing.read_lines(Counted(data), at, stop, end, inside, limit))


def test_only_appended_bytes_are_read():
    old, new = b'{"n": 1}\n' * 50_000, b'{"n": 2}\n' * 1_000
    Counted.total = 0
    found = lines_of(old + new, len(old), len(old) + len(new), len(old) + len(new), False)
    assert len(found) == 1_000 and Counted.total == len(new)


def test_a_file_that_did_not_change_is_not_opened(tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("1\n2\n")
    first = growing.advance(str(tmp_path), {})
    again = growing.advance(str(tmp_path), first)
    assert all(again[k] is first[k] for k in first)

    class Closed:
        type_name = "local"

        def open_input_file(self, path):
            raise AssertionError("opened")

    ((name, (where, size, modified)),) = growing.find_files(str(tmp_path)).items()
    assert growing.look(Closed(), where, size, modified, first[name]) is first[name]


def test_look_reads_a_few_bytes(tmp_path):
    """The cursor of a large file that has grown costs its end and two digests."""
    path = tmp_path / "a.jsonl"
    path.write_bytes(b"x" * 99 + b"\n" + b"some line\n" * 200_000)
    ((name, (where, size, modified)),) = growing.find_files(str(tmp_path)).items()
    first = growing.look(fs.LocalFileSystem(), where, size, modified, None)
    with open(path, "ab") as f:
        f.write(b"another\n")
    data = path.read_bytes()

    class System:
        type_name = "local"

        def open_input_file(self, path):
            return Counted(data)

    Counted.total = 0
    now = growing.look(System(), where, len(data), modified + 1, first)
    assert (now["byte"], now["generation"]) == (len(data), 0) and Counted.total < 70_000


@pytest.mark.parametrize("seed", range(4))
def test_parts_cover_each_line_once(seed):
    rng = random.Random(seed)
    data = b"".join(bytes(rng.choices(b"ab\r", k=rng.choice([0, 1, 5, 40]))) + b"\n" for _ in range(300))
    begins = [0]
    for line in data.split(b"\n")[:-1]:
        begins.append(begins[-1] + len(line) + 1)
    start, end = begins[17], begins[280]
    for size in (1, 2, 7, 64, 5_000):
        cut = growing.parts({"f": {"generation": 0, "byte": start}}, {"f": {"generation": 0, "byte": end}}, size)
        found = [x for p in cut for x in lines_of(data, p["part"], p["stop"], p["end"], p["part"] > p["start"])]
        assert [x[0] for x in found] == begins[17:280]
        assert all(data[o : o + n].removesuffix(b"\n").removesuffix(b"\r") == v for o, n, v in found)


def test_long_lines_are_cut_not_held():
    data = b"a" * 3_000_000 + b"\nshort\n"
    (o, n, v), second = lines_of(data, 0, len(data), len(data), False, limit=100)
    assert (o, n, len(v)) == (0, 3_000_001, 101) and second == (3_000_001, 6, b"short")


def said(rows):
    return sorted((os.path.basename(r.source_file), r.source_line_no, r.value, r.generation) for r in rows.collect())


def kept(spark, cursors):
    return spark.createDataFrame(cursors.collect(), ingest.CURSOR)


def test_replaced_files_start_again(spark, tmp_path):
    a, b, c, d = (tmp_path / f"{x}.jsonl" for x in "abcd")
    for f in (a, b, c, d):
        f.write_text("one\ntwo\n")
    _, at = ingest.tail(spark, str(tmp_path))
    at = kept(spark, at)
    a.write_text("uno\ndue\ntre\n")  # longer, other content
    b.write_text("six\nten\n")  # of equal size
    os.utime(b, ns=(1, 1))
    c.write_text("one\n")  # shorter
    with open(d, "a") as f:
        f.write("three\nopen")
    new, at = ingest.tail(spark, str(tmp_path), at)
    assert said(new) == [
        ("a.jsonl", 1, "uno", 1), ("a.jsonl", 2, "due", 1), ("a.jsonl", 3, "tre", 1), ("b.jsonl", 1, "six", 1), ("b.jsonl", 2, "ten", 1), ("c.jsonl", 1, "one", 1), ("d.jsonl", 3, "three", 0),
    ]
    at = kept(spark, at)
    (tmp_path / "new").write_text("one\ntwo\nthree\n")
    os.replace(tmp_path / "new", d)  # another inode with the same beginning
    a.unlink()
    new, at = ingest.tail(spark, str(tmp_path), at)
    assert [r[:2] for r in said(new)] == [("d.jsonl", 1), ("d.jsonl", 2), ("d.jsonl", 3)]
    a.write_text("back\n")  # a file of that name again
    new, at = ingest.tail(spark, str(tmp_path), kept(spark, at))
    assert said(new) == [("a.jsonl", 1, "back", 2)]
    assert {os.path.basename(r.source_file): r.n_lines for r in at.collect()} == {"a.jsonl": 1, "b.jsonl": 2, "c.jsonl": 1, "d.jsonl": 3}


def test_open_end_waits_and_broken_line_does_not(spark, tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_text('{"n": 1}\n{"n": ')
    new, at = ingest.tail(spark, str(tmp_path))
    assert said(new) == [("a.jsonl", 1, '{"n": 1}', 0)]
    at = kept(spark, at)
    a.write_text('{"n": 1}\n{"n": \n')
    new, at = ingest.tail(spark, str(tmp_path), at)
    assert said(new) == [("a.jsonl", 2, '{"n": ', 0)]


def test_many_parts_number_lines_on(spark, tmp_path):
    a = tmp_path / "a.jsonl"
    a.write_text("".join(f"line {k}\n" for k in range(100)))
    _, at = ingest.tail(spark, str(tmp_path), part_bytes=37)
    with open(a, "a") as f:
        f.write("".join(f"line {k}\n" for k in range(100, 250)))
    new, at = ingest.tail(spark, str(tmp_path), kept(spark, at), part_bytes=37)
    rows = new.collect()
    assert sorted((r.source_line_no, r.value) for r in rows) == [(k + 1, f"line {k}") for k in range(100, 250)]
    data = a.read_bytes()
    assert all(data[r.source_offset :].startswith(r.value.encode() + b"\n") for r in rows)
    assert at.first().n_lines == 250


def record(kind, text, **more):
    return json.dumps({"type": kind, "timestamp": "2024-05-01T00:00:00Z", "message": {"role": kind, "content": text, **more}})


def test_stream_follows_files(spark, tmp_path):
    """Each start with one checkpoint takes what came since; line numbers and hints go on; a replaced file is read again, and readers see no event twice."""
    folder, base, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    folder.mkdir()
    a, b = folder / "a.jsonl", folder / "b.jsonl"

    def go():
        ingest.start(spark, str(folder), "claude-code", base, state).awaitTermination()
        return sorted((os.path.basename(r.source_file), r.source_generation, r.source_line_no) for r in spark.read.parquet(f"{base}/raw").collect())

    first = json.dumps({"sessionId": "s-1", "cwd": "/w", **json.loads(record("user", "hello", model="m-1"))})
    a.write_text(first + "\n" + record("assistant", "well")[:20])
    b.write_text(record("user", "other") + "\n")
    assert go() == [("a.jsonl", 0, 1), ("b.jsonl", 0, 1)]
    a.write_text(first + "\n" + record("assistant", "well") + "\n{broken\n")
    assert go() == [("a.jsonl", 0, 1), ("a.jsonl", 0, 2), ("a.jsonl", 0, 3), ("b.jsonl", 0, 1)]
    assert go()[-1] == ("b.jsonl", 0, 1)  # nothing new
    events = {r.text_content: r for r in ingest.current_events(spark, base).collect()}
    assert (events["well"].session_id, events["well"].cwd, events["well"].model) == ("s-1", "/w", "m-1")
    assert [(r.source_line_no, r.error_kind) for r in spark.read.parquet(f"{base}/errors").collect()] == [(3, "json_parse_error")]
    b.write_text(record("user", "other") + "\n" + record("user", "again") + "\n")
    (folder / "c").write_text(record("user", "other") + "\n" + record("user", "again") + "\n" + record("user", "third") + "\n")
    os.replace(folder / "c", b)
    assert [x for x in go() if x[0] == "b.jsonl"] == [("b.jsonl", 0, 1), ("b.jsonl", 1, 1), ("b.jsonl", 1, 2), ("b.jsonl", 1, 3)]
    assert sorted(r.text_content for r in ingest.current_events(spark, base).collect()) == ["again", "hello", "other", "third", "well"]
    ends = {os.path.basename(r.source_file): (r.source_generation, r.n_lines) for r in ingest.latest_cursors(spark, base).collect()}
    assert ends == {"a.jsonl": (0, 3), "b.jsonl": (1, 3)}


def test_snapshots_are_read_again_after_a_restart(tmp_path):
    """A new reader goes on from the state folder, and old offsets give the same ranges."""
    (tmp_path / "in").mkdir()
    a = tmp_path / "in" / "a.jsonl"
    options = {"path": str(tmp_path / "in"), "state": str(tmp_path / "state")}
    a.write_text("1\n")
    one = growing.StreamLines(options).latestOffset()
    a.write_text("1\n2\n")
    two = growing.StreamLines(options).latestOffset()
    third = growing.StreamLines(options)
    assert third.latestOffset() == two and one != two
    cut = [(p.value["part"], p.value["stop"]) for p in third.partitions(one, two)]
    assert cut == [(2, 4)] and [(p.value["part"], p.value["stop"]) for p in third.partitions(third.initialOffset(), two)] == [(0, 4)]
    third.commit(two)
    assert growing.StreamLines(options).latestOffset() == two
