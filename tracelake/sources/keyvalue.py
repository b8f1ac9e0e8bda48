"""SQLite stores as Spark data sources: rows of a query, and key-value rows by prefix in pages.

A partition is one database file; a task copies nothing to the driver and reads its file in pages.
"""

from __future__ import annotations

import glob
import sqlite3

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE_ROWS = 512


class SqliteSource(DataSource):
    """format("sqlite_rows"): options path (glob), query (column 1 key, column 2 value)."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def schema(self) -> str:
        return "source_file string, key string, value string"

    def reader(self, schema) -> SqliteReader:
        return SqliteReader(self.options)


class SqliteReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.query = options["path"], options["query"]

    def partitions(self):
        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with sqlite3.connect(f"file:{partition.value}?mode=ro", uri=True) as db:
            rows = db.execute(self.query)
            while page := rows.fetchmany(PAGE_ROWS):
                for key, value in page:
                    yield partition.value, str(key), value.decode("utf-8", "replace") if isinstance(value, bytes) else value


def changed(now: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows whose (file, key, hash) was not seen before."""
    from pyspark.sql import functions as F

    return now.withColumn("sha256", F.sha2("value", 256)).join(seen.select("source_file", "key", "sha256"), ["source_file", "key", "sha256"], "left_anti")


#: Rows of a table that one task reads.
PART_ROWS = 100_000
_KINDS = {"INT": "bigint", "REA": "double", "FLO": "double", "DOU": "double"}


class SqliteTable(DataSource):
    """format("sqlite_table"): options path (glob), table, part_rows. Columns of the table, with source_file and source_rowid.

    Each file is cut into ranges of rowids. With the option pushdown, which needs Spark's setting spark.sql.python.filterPushdown.enabled,
    filters on whole numbers and on source_rowid go to SQLite, where its indexes serve them; `sqlite_table` looks at the setting.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        files = sorted(glob.glob(self.options["path"]))
        if not files:
            raise FileNotFoundError(self.options["path"])
        with _opened(files[0]) as db:
            found = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"no table {self.options['table']} in {files[0]}")
        return ", ".join(["source_file string", "source_rowid bigint", *(f"`{c[1]}` {_KINDS.get(c[2].upper()[:3], 'string')}" for c in found)])

    def reader(self, schema) -> SqliteTableReader:
        kind = PushingReader if str(self.options.get("pushdown", "")).lower() == "true" else SqliteTableReader
        return kind(self.options, schema)


def sqlite_table(spark, path: str, table: str, part_rows: int = PART_ROWS) -> DataFrame:
    spark.dataSource.register(SqliteTable)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("sqlite_table").options(path=path, table=table, part_rows=part_rows, pushdown=pushed).load()


def _opened(path: str):
    import contextlib

    return contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class SqliteTableReader(DataSourceReader):
    def __init__(self, options, schema):
        self.path, self.table, self.rows = options["path"], options["table"], int(options.get("part_rows", PART_ROWS))
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        self.where: list[tuple[str, list]] = []

    def partitions(self):
        out = []
        for path in sorted(glob.glob(self.path)):
            with _opened(path) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
            if low is not None:
                out += [InputPartition((path, at, min(at + self.rows - 1, high))) for at in range(low, high + 1, self.rows)]
        return out

    def read(self, partition):
        if partition is None:
            return
        path, low, high = partition.value
        names = [n for n, _ in self.columns if n not in ("source_file", "source_rowid")]
        tests = "".join(f" AND {t}" for t, _ in self.where)
        values = [low, high, *(v for _, some in self.where for v in some)]
        with _opened(path) as db:
            rows = db.execute(f"SELECT {', '.join(['rowid', *map(quoted, names)])} FROM {quoted(self.table)} WHERE rowid BETWEEN ? AND ?{tests}", values)
            while page := rows.fetchmany(PAGE_ROWS):
                for row in page:
                    found = dict(zip(["source_rowid", *names], row, strict=True), source_file=path)
                    yield tuple(_as(found[n], kind) for n, kind in self.columns)


class PushingReader(SqliteTableReader):
    def pushFilters(self, filters):
        from pyspark.sql import datasource as ds

        signs = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
        kinds = {"bigint": int, "double": (int, float), "string": str}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            kind = dict(self.columns).get(name)
            fits = lambda v, kind=kind: isinstance(v, kinds.get(kind, ())) and not isinstance(v, bool)
            column = None if name in (None, "source_file") else "rowid" if name == "source_rowid" else quoted(name)
            # a text column may hold numbers in SQLite, which Spark sees as texts, so only whole numbers are compared there
            if column and kind == "bigint" and type(f) in signs and fits(f.value):
                self.where.append((f"typeof({column}) = 'integer' AND {column} {signs[type(f)]} ?", [f.value]))
            elif column and kind == "bigint" and isinstance(f, ds.In) and f.value and all(map(fits, f.value)):
                self.where.append((f"typeof({column}) = 'integer' AND {column} IN ({', '.join('?' * len(f.value))})", list(f.value)))
            else:
                yield f


def _as(value, kind: str):
    """A value as its column's kind; SQLite holds any kind in any column."""
    if value is None:
        return None
    if kind == "bigint":
        return value if isinstance(value, int) else None
    if kind == "double":
        return float(value) if isinstance(value, (int, float)) else None
    return value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)


#: Rows of a store that one task joins or orders, some hundred bytes each.
TASK_ROWS = 100_000


def _tasks(rows: DataFrame) -> int:
    """Tasks for rows that are joined or ordered: their number follows the rows, so that no task grows with the store, whatever the session's number of shuffle partitions is."""
    return max(1, -(-rows.count() // TASK_ROWS))


def store_records(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """Flat records (source_file, source_line_no, source_offset, value) of a store's tables, for `adapters.normalize(.., "opencode")`.

    sessions: source_file, id, title, directory, time_created; messages: source_file, id, session_id, time_created, data (JSON);
    parts: source_file, id, message_id, time_created, data (JSON). A session gives a header, each part a record with its message's role and model, in the order of
    session, time and id. Parts without a message and messages without a session are kept, under their own ids.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    m = messages.select("source_file", F.col("id").alias("message_id"), "session_id", F.get_json_object("data", "$.role").alias("message_role"), F.coalesce(F.get_json_object("data", "$.modelID"), F.get_json_object("data", "$.model.modelID")).alias("message_model_id"))
    d = sessions.select("source_file", F.col("id").alias("session_id"), "directory")
    n = _tasks(parts.select("source_file").unionByName(sessions.select("source_file")))
    rows = parts.select("source_file", "id", "message_id", "time_created", "data").repartition(n, "source_file", "message_id").join(m, ["source_file", "message_id"], "left").withColumn("session_id", F.coalesce("session_id", "message_id"))
    rows = rows.repartition(n, "source_file", "session_id").join(d, ["source_file", "session_id"], "left")
    fields = F.struct(F.lit("opencode_part").alias("type"), "session_id", "id", "message_id", "time_created", "message_role", "message_model_id", "directory", F.parse_json("data").alias("data"))
    each = rows.select("source_file", "session_id", "time_created", "id", F.lit(1).alias("_rank"), F.to_json(fields).alias("value"))
    head = F.struct(F.lit("opencode_session").alias("type"), "id", "title", "directory", "time_created")
    heads = sessions.select("source_file", F.col("id").alias("session_id"), "time_created", "id", F.lit(0).alias("_rank"), F.to_json(head).alias("value"))
    # every session is a file of records of its own, so that one store's sessions are numbered apart
    w = Window.partitionBy("source_file").orderBy("_rank", "time_created", "id")
    every = heads.unionByName(each).withColumn("source_file", F.concat("source_file", F.lit("#"), "session_id")).repartition(n, "source_file")
    return every.select("source_file", F.row_number().over(w).cast("long").alias("source_line_no"), F.lit(0).cast("long").alias("source_offset"), "value")


def affected(sessions: DataFrame, messages: DataFrame, parts: DataFrame, since: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows whose records may differ after changes since a time (time_updated): those of every session that a change of any of the three tables touches."""
    from pyspark.sql import functions as F

    new = F.col("time_updated") > since
    of_parts = parts.filter(new).select("source_file", F.col("message_id").alias("id")).distinct()
    touched = sessions.filter(new).select("source_file", F.col("id").alias("session_id"))
    touched = touched.unionByName(messages.filter(new).select("source_file", "session_id"))
    touched = touched.unionByName(messages.join(of_parts, ["source_file", "id"], "left_semi").select("source_file", "session_id")).distinct()
    m = messages.join(touched, ["source_file", "session_id"], "left_semi")
    s = sessions.join(touched.withColumnRenamed("session_id", "id"), ["source_file", "id"], "left_semi")
    loose = of_parts.join(messages.select("source_file", "id"), ["source_file", "id"], "left_anti")
    keys = m.select("source_file", F.col("id").alias("message_id")).unionByName(loose.withColumnRenamed("id", "message_id"))
    return s, m, parts.repartition(_tasks(parts), "source_file", "message_id").join(keys, ["source_file", "message_id"], "left_semi")
