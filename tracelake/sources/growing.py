"""Lines of growing files by byte offset, as a batch and a streaming data source.

What has been read of the files is a snapshot: of each file its generation, the byte behind the last whole line that was taken, and
what tells a file that only grew from one that was replaced: inode (where the file system has one), digests of its first
bytes and of those before the cursor. A replaced or shortened file is read from its start in its next generation. A last line that has no
end yet waits for it; a finished line is taken whether it is JSON or not.

The stream's offsets are numbers of snapshots, which are files of their own in a state folder, written once. So the offset
log stays small, a batch that is run again reads the same bytes, and a restart goes on from the last snapshot.
Only appended bytes are read, in parts of some MB, so that a large file is many tasks' work; a line belongs to the
part that it begins in.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import posixpath
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PART_BYTES = 64 * 1024 * 1024
BLOCK = 1 << 20
#: Bytes at the start of a file and before the cursor whose digests tell a replaced file.
SEEN_BYTES = 256
LINE_LIMIT = 8 * 1024 * 1024

SCHEMA = "source_file string, source_generation int, start long, part long, part_line long, source_offset long, source_bytes long, value string"
FIELDS = ("generation", "inode", "size", "modified", "byte", "head", "mark")
#: A row of a snapshot kept as a table, with the number of lines so far.
CURSOR = "source_file string, generation int, inode string, size long, modified long, byte long, head string, mark string, n_lines long"


def _system(path: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def _name(system, path: str) -> str:
    kind = system.type_name
    return f"{'file' if kind == 'local' else kind}://{path}"


def find_files(path: str) -> dict[str, tuple[str, int, int]]:
    """source_file -> (path, size, time of change) of the files below a folder, or of those that a pattern names; hidden ones are passed over."""
    import pyarrow.fs as fs

    system, where = _system(path)
    folder = where
    while any(c in folder for c in "*?["):
        folder = posixpath.dirname(folder)
    info = system.get_file_info(folder)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    kept = (f for f in found if f.type == fs.FileType.File and f.base_name[:1] not in "._" and (folder == where or fnmatch.fnmatch(f.path, where)))
    return {_name(system, f.path): (f.path, f.size, f.mtime_ns or 0) for f in kept}


def _digest(file, at: int, to: int) -> str:
    return hashlib.sha256(file.read_at(to - at, at)).hexdigest()[:32] if to > at else ""


def _last_end(file, start: int, size: int) -> int:
    """The byte behind the last line end in start..size, or start."""
    end = size
    while end > start:
        at = max(start, end - BLOCK // 16)
        found = file.read_at(end - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        end = at
    return start


def look(system, path: str, size: int, modified: int, before: dict | None) -> dict:
    """A file's new cursor. Of a file that looks as before nothing is read, of another a few hundred bytes and its end."""
    inode = str(os.stat(path).st_ino) if system.type_name == "local" else ""
    if before and (before["inode"], before["size"], before["modified"]) == (inode, size, modified):
        return before
    with system.open_input_file(path) as file:
        start, generation = 0, 0
        if before:
            same = before["inode"] == inode and size >= before["byte"]
            seen = min(SEEN_BYTES, before["byte"])
            same = same and before["head"] == _digest(file, 0, seen) and before["mark"] == _digest(file, before["byte"] - seen, before["byte"])
            start, generation = (before["byte"], before["generation"]) if same else (0, before["generation"] + 1)
        byte = _last_end(file, start, size)
        seen = min(SEEN_BYTES, byte)
        return dict(zip(FIELDS, (generation, inode, size, modified, byte, _digest(file, 0, seen), _digest(file, byte - seen, byte)), strict=True))


def advance(path: str, before: dict[str, dict]) -> dict[str, dict]:
    """The next snapshot; files that are gone keep their cursor, so that a file of the same name is a further generation."""
    system, _ = _system(path)
    found = find_files(path)
    with ThreadPoolExecutor(16) as pool:
        cursors = pool.map(lambda kv: look(system, *kv[1], before.get(kv[0])), found.items())
        return {**before, **dict(zip(found, cursors, strict=True))}


def parts(before: dict[str, dict], after: dict[str, dict], part_bytes: int = PART_BYTES) -> list[dict]:
    """What to read between two snapshots."""
    out = []
    for name, now in sorted(after.items()):
        old = before.get(name)
        start = old["byte"] if old and old["generation"] == now["generation"] else 0
        for at in range(start, now["byte"], part_bytes):
            out.append({"file": name, "generation": now["generation"], "start": start, "part": at, "stop": min(at + part_bytes, now["byte"]), "end": now["byte"]})
    return out


def read_lines(file, at: int, stop: int, end: int, inside: bool, limit: int = LINE_LIMIT) -> Iterator[tuple[int, int, bytes]]:
    """(offset, bytes with the end, at most limit + 1 bytes without it) of the lines that begin in at..stop.

    inside: a line may lie across `at`; it is another part's.
    """
    place, block, used = (at - 1 if inside else at), b"", 0
    skip, line, length = inside, [], 0
    begin = place
    while begin < stop:
        if used == len(block):
            if place >= end:
                return
            block, used = file.read_at(min(BLOCK, end - place), place), 0
            place += len(block)
            if not block:
                return
        found = block.find(b"\n", used)
        to = found + 1 if found >= 0 else len(block)
        kept = sum(map(len, line))
        if not skip and kept <= limit:
            line.append(block[used : min(to, used + limit + 2 - kept)])
        length += to - used
        used = to
        if found >= 0:
            if not skip:
                value = b"".join(line)
                yield begin, length, (value[:-1] if value.endswith(b"\n") else value).removesuffix(b"\r")[: limit + 1]
            begin, skip, line, length = begin + length, False, [], 0


class GrowingLines(DataSource):
    """format("growing_lines"): options path, state (a stream's folder), or ranges (JSON of parts) in a batch; part_bytes, line_limit."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BatchLines:
        return BatchLines(self.options)

    def streamReader(self, schema) -> StreamLines:
        return StreamLines(self.options)


class _Reads:
    def __init__(self, options) -> None:
        self.path, self.state, self.ranges = options.get("path", ""), options.get("state", ""), options.get("ranges", "[]")
        self.part_bytes, self.limit = int(options.get("part_bytes", PART_BYTES)), int(options.get("line_limit", LINE_LIMIT))

    def read(self, partition):
        import pyarrow as pa

        if partition is None:  # of no ranges, Spark makes one empty partition
            return
        p = partition.value
        system, path = _system(p["file"])
        rows, total = [], 0

        def flush():
            offsets, lengths, values = zip(*rows, strict=True)
            n, first = len(rows), self._line + 1
            self._line += n
            same = lambda v, kind: pa.array([v] * n, kind)
            return pa.RecordBatch.from_arrays(
                [same(p["file"], pa.string()), same(p["generation"], pa.int32()), same(p["start"], pa.int64()), same(p["part"], pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64()), pa.array([v.decode("utf-8", "replace") for v in values], pa.string())],
                [c.split()[0] for c in SCHEMA.split(", ")],
            )

        self._line = 0
        with system.open_input_file(path) as file:
            for row in read_lines(file, p["part"], p["stop"], p["end"], p["part"] > p["start"], self.limit):
                rows.append(row)
                total += len(row[2])
                if total > 4 * BLOCK or len(rows) >= 10_000:
                    yield flush()
                    rows, total = [], 0
        if rows:
            yield flush()


class BatchLines(_Reads, DataSourceReader):
    def partitions(self):
        return [InputPartition(p) for p in json.loads(self.ranges)]


class StreamLines(_Reads, DataSourceStreamReader):
    def _file(self, number: int):
        system, folder = _system(self.state)
        return system, folder, f"{folder}/{number:012d}.json"

    def _load(self, number: int) -> dict[str, dict]:
        if not number:
            return {}
        system, _, name = self._file(number)
        with system.open_input_stream(name) as f:
            return json.loads(f.read())

    def _newest(self) -> int:
        import pyarrow.fs as fs

        system, folder, _ = self._file(0)
        found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return max((int(f.base_name[:12]) for f in found if f.base_name.endswith(".json")), default=0)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        number = self._newest()
        before = self._load(number)
        after = advance(self.path, before)
        if any(after[k] is not before.get(k) for k in after):
            number += 1
            system, folder, name = self._file(number)
            system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{name}.new") as f:
                f.write(json.dumps(after).encode())
            system.move(f"{name}.new", name)  # whole or not there
        return {"snapshot": number}

    def partitions(self, start: dict, end: dict):
        found = parts(self._load(start["snapshot"]), self._load(end["snapshot"]), self.part_bytes)
        return [InputPartition(p) for p in found]

    def commit(self, end: dict) -> None:
        import pyarrow.fs as fs

        system, folder, _ = self._file(0)
        for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.endswith(".json") and int(f.base_name[:12]) < end["snapshot"]:
                system.delete_file(f.path)


#: Most parts whose line counts are broadcast to their lines; more are joined by a shuffle.
BROADCAST_PARTS = 100_000


def numbered(lines: DataFrame, counted: DataFrame) -> DataFrame:
    """lines with source_line_no. counted: (source_file, source_generation, start, n_lines), the lines of a file before `start`, with further columns to be put beside them; none if it is new.

    Parts are counted first and shifted by the parts before them, so no file's lines are gathered.
    """
    more = [c for c in counted.columns if c not in ("source_file", "source_generation", "start", "n_lines")]
    key = ["source_file", "source_generation", "part"]
    found = lines.groupBy(*key).agg(F.max("part_line").alias("_n"), F.first("start").alias("start"))
    earlier = Window.partitionBy("source_file", "source_generation").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = found.join(counted, ["source_file", "source_generation", "start"], "left")
    found = found.select(*key, *more, (F.coalesce("n_lines", F.lit(0)) + F.coalesce(F.sum("_n").over(earlier), F.lit(0))).alias("_before"))
    few = found.limit(BROADCAST_PARTS + 1).count() <= BROADCAST_PARTS
    rows = lines.join(F.broadcast(found) if few else found, key)
    return rows.withColumn("source_line_no", F.col("_before") + F.col("part_line")).drop("_before")


def line_counts(numbered_lines: DataFrame) -> DataFrame:
    """(source_file, source_generation, start, n_lines) for what comes behind these lines."""
    end = F.max(F.col("source_offset") + F.col("source_bytes")).alias("start")
    return numbered_lines.groupBy("source_file", "source_generation").agg(end, F.max("source_line_no").alias("n_lines"))


def appended(spark: SparkSession, path: str, cursors: DataFrame | None = None, part_bytes: int = PART_BYTES) -> tuple[DataFrame, DataFrame]:
    """Numbered lines appended to files since the cursors (CURSOR), and the new cursors. One cursor a file reaches the driver, as a listing does."""
    old = {r.source_file: r.asDict() for r in cursors.toLocalIterator()} if cursors is not None else {}
    before = {k: {f: r[f] for f in FIELDS} for k, r in old.items()}
    after = advance(path, before)
    spark.dataSource.register(GrowingLines)
    ranges = parts(before, after, part_bytes)
    lines = spark.read.format("growing_lines").option("ranges", json.dumps(ranges)).load()
    known = {k: old[k]["n_lines"] if k in old and old[k]["generation"] == c["generation"] else 0 for k, c in after.items()}
    starts = {p["file"]: p for p in ranges}
    counted = spark.createDataFrame([(k, p["generation"], p["start"], known[k]) for k, p in starts.items()], "source_file string, source_generation int, start long, n_lines long")
    lines = numbered(lines, counted)
    state = spark.createDataFrame([(k, *(c[f] for f in FIELDS), known[k]) for k, c in after.items()], CURSOR)
    if not ranges:
        return lines, state
    ends = line_counts(lines).select("source_file", F.col("n_lines").alias("_n"))
    return lines, state.join(ends, "source_file", "left").withColumn("n_lines", F.coalesce("_n", "n_lines")).drop("_n")
