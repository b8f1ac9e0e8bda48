"""Conversation structure repair: cheapest edits that make the roles of a conversation alternate, by a trie-shared DP.

Every row becomes one symbol of its role and fault, every conversation a signature of symbols. The signatures are dealt
out by range and sorted, so that a task meets those of a common prefix in a row, as a walk through their prefix trie does.
It holds the DP layers on the way from the root to the present node, works out one layer for each new node, and
reads the answers of all conversations that end there. A signature that very many conversations share is split by their ids.

A layer has, for each of four states of the role pattern `(s?(ua)+)?`, the least cost and, among edits of that cost, the one
least in ASCII. Edit strings are never compared as a whole: a layer ranks its strings, and those of the next layer differ
in the rank or in the few characters put behind it. So a layer takes constant room, also in conversations of very many rows.

Rows of a conversation are read in a stream from an external sort, twice: narrow ones for the signature, then those with text
for the hash of the repaired conversation. That hash is sequential by definition, so one task hashes one conversation,
without ever holding it.

Defined cases: nulls in conv_id, turn, role and text read as one space (a null conv_id is a conversation, null turns come first and
are no turn for gaps); rows of equal turn are taken by role, then by the digest of their text; an empty role has no initial, so
it cannot be kept; a conversation without rows after damage has zeros, an empty audit and the hash of no bytes; an
empty table gives no rows; further columns are not read; gaps beyond a long are cut to it.
"""

from __future__ import annotations

import hashlib
from array import array

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import cut_lineage, table

#: Costs of the contract.
REROLE, DELETE, INSERT, CUT_SHORT = 3, 4, 3, 3

#: States of the role pattern: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a kept row of a role leads; a user row cannot follow a user row, and so on.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state that an inserted or reroled row leads to; such rows are users and assistants alone.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
FINAL = (START, ASSISTANT)

_BLANK = r"[^\x20\x09-\x0D]"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_LONG = (1 << 63) - 1


def damage(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, gone) after damage; dropped ones stay with `gone`, so that no conversation is lost."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    copies = F.when(kind == 0, F.array(F.lit(True))).when(kind == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(F.lit(False)))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.explode(copies).alias("gone"))


def _digest() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))


class _Faults:
    """What the narrow rows of one conversation say, one row after the other."""

    def __init__(self) -> None:
        self.signature, self.counts = bytearray(), dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.initial = None
        self.turns = 0

    def row(self, turn: int | None, initial: str, fault: str, again: bool) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        fault = fault if fault == "blank" or not again else "duplicate"
        if fault:
            self.counts[fault] += 1
        self.signature += symbol(initial, fault).encode()

    def result(self) -> tuple:
        if self.turns:
            self.counts["gaps"] = min(self.last - self.first + 1 - self.turns, _LONG)
        return (self.signature.decode(), *self.counts.values())


def symbol(initial: str, fault: str) -> str:
    """d: must be deleted; else the role's initial, x for other roles, in upper case if the text is truncated."""
    if fault in ("blank", "duplicate"):
        return "d"
    role = initial if initial in KEPT else "x"
    return role.upper() if fault == "truncated" else role


def _folded(batches, names, make, take, result, most: int = 10_000):
    """Rows of sorted batches folded by conv_id: one output row (conv_id, *result) for each run of equal ids."""
    import pyarrow as pa

    own, out = None, []

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), names.values(), strict=True)], list(names))

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns, strict=True):
            if own is None or own[0] != row[0]:
                if own is not None:
                    out.append((own[0], *result(own[1])))
                    if len(out) >= most:
                        yield flush()
                        out = []
                own = (row[0], make())
            take(own[1], row)
    if own is not None:
        out.append((own[0], *result(own[1])))
    if out:
        yield flush()


def signatures(rows: DataFrame) -> DataFrame:
    """(conv_id, signature and counts) of damaged rows, from one exchange of narrow rows."""
    text = F.col("text")
    fault = F.when(~text.rlike(_BLANK), "blank").when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    narrow = rows.select("conv_id", "turn", "role", "gone", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), F.when(~F.col("gone"), _digest()).alias("digest"))
    same = Window.partitionBy("conv_id", "digest").orderBy(F.col("turn").asc_nulls_first())
    # rows of a conversation lie in one partition, so this window needs no exchange of its own
    narrow = narrow.repartition("conv_id").withColumn("again", F.row_number().over(same) > 1)
    order = narrow.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "again")
    schema = T.StructType([rows.schema["conv_id"], T.StructField("signature", T.StringType()), *(T.StructField(c, T.LongType()) for c in _COUNTS)])

    def fold(batches):
        def take(state, row):
            if not row[2]:
                state.row(row[1], *row[3:])

        return _folded(batches, arrow_types(schema), _Faults, take, _Faults.result)

    return order.select("conv_id", "turn", "gone", "initial", "fault", "again").mapInArrow(fold, schema)


def arrow_types(schema: T.StructType) -> dict:
    from pyspark.sql.pandas.types import to_arrow_type

    return {f.name: to_arrow_type(f.dataType) for f in schema}


class _Layer:
    """Costs and edit strings of the four states at a node, less the node's least cost.

    at: state -> (cost, rank, inserts): the string of that rank with so many I behind it. pieces: for each rank, the rank in
    the parent's layer and the characters behind that string. Costs differ by a few inserts at most, so there are few
    different layers; equal ones are one object, which keeps its children.
    """

    __slots__ = ("at", "pieces", "children")
    known: dict = {}

    def __init__(self, at: dict, pieces: list) -> None:
        self.at, self.pieces, self.children = at, pieces, {}

    @classmethod
    def of(cls, at: dict, pieces: list) -> tuple[int, _Layer]:
        """Least cost and layer of the strings that end with a row, with those that go on with inserted rows; three hops reach every state."""
        for _ in range(3):
            for state, (cost, rank, inserts) in list(at.items()):
                found = (cost + INSERT, rank, inserts + 1)
                if NEXT[state] not in at or found < at[NEXT[state]]:
                    at[NEXT[state]] = found
        least = min(cost for cost, _, _ in at.values())
        at = {state: (cost - least, rank, inserts) for state, (cost, rank, inserts) in at.items()}
        return least, cls.known.setdefault((*sorted(at.items()), *pieces), cls(at, pieces))

    def child(self, letter: str) -> tuple[int, _Layer]:
        """Added cost and layer after one more row. Of equal cost, the lesser string is that of lesser rank, then of lesser characters behind it."""
        if letter in self.children:
            return self.children[letter]
        best: dict[int, tuple] = {}
        role, more = letter.lower(), CUT_SHORT if letter.isupper() else 0
        for state, (cost, rank, inserts) in self.at.items():
            edits = [("D", state, DELETE)]
            if letter != "d":
                edits.append(("R", NEXT[state], REROLE + more))
                if state in KEPT.get(role, ()):
                    edits.append(("K", KEPT[role][state], more))
            for name, to, price in edits:
                found = (cost + price, rank, "I" * inserts + name)
                if to not in best or found < best[to]:
                    best[to] = found
        pieces = sorted({x[1:] for x in best.values()})
        self.children[letter] = _Layer.of({state: (x[0], pieces.index(x[1:]), 0) for state, x in best.items()}, pieces)
        return self.children[letter]


class Trie:
    """Answers of signatures that come in order: the layers of the prefix shared with the one before stay, each new node adds one."""

    def __init__(self) -> None:
        cost, layer = _Layer.of({START: (0, 0, 0)}, [(0, "")])
        self.layers, self.costs = [layer], array("q", [cost])
        self.signature, self.answer = "", self._read()

    def find(self, signature: str) -> tuple[int, str]:
        """Least cost and its edits; a signature equal to the one before ends at the same node, whose answer is there."""
        if signature != self.signature:
            shared, most = 0, min(len(signature), len(self.signature))
            while shared < most and signature[shared] == self.signature[shared]:
                shared += 1
            del self.layers[shared + 1 :], self.costs[shared + 1 :]
            for letter in signature[shared:]:
                added, layer = self.layers[-1].child(letter)
                self.layers.append(layer)
                self.costs.append(self.costs[-1] + added)
            self.signature, self.answer = signature, self._read()
        return self.answer

    def _read(self) -> tuple[int, str]:
        at = self.layers[-1].at
        cost, rank, inserts = min(at[s] for s in FINAL if s in at)
        parts = ["I" * inserts]
        for layer in reversed(self.layers):
            rank, piece = layer.pieces[rank]
            parts.append(piece)
        return self.costs[-1] + cost, "".join(reversed(parts))


def cheapest_edits(conversations: DataFrame) -> DataFrame:
    """cost and audit in place of signatures; equal and neighbouring signatures lie in one partition, hot ones in several."""
    rows = cut_lineage(conversations)  # the sampling of ranges reads it once more
    schema = T.StructType([*(f for f in rows.schema if f.name != "signature"), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])

    def run(batches):
        import pyarrow as pa

        trie = Trie()
        for batch in batches:
            found = [trie.find(s) for s in batch.column("signature").to_pylist()]
            kept = [batch.column(c) for c in batch.schema.names if c != "signature"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], schema.names)

    return rows.repartitionByRange("signature", "conv_id").sortWithinPartitions("signature").mapInArrow(run, schema)


class _Repair:
    """Repaired rows of one conversation, hashed one after the other."""

    def __init__(self) -> None:
        self.sha, self.state, self.place, self.first = hashlib.sha256(), START, 0, True

    def take(self, row: tuple) -> None:
        _, head, role, text = row
        if head is not None:
            self.head, self.audit = head, head["audit"]
            return
        self.inserts()
        edit = self.audit[self.place]
        self.place += 1
        if edit == "K":
            self.state = KEPT[role[:1].decode()][self.state]
            self.write(role, text)
        elif edit == "R":
            self.new(text)

    def inserts(self) -> None:
        while self.place < len(self.audit) and self.audit[self.place] == "I":
            self.place += 1
            self.new(b"")

    def new(self, text: bytes) -> None:
        self.state = NEXT[self.state]
        self.write(b"user" if self.state == USER else b"assistant", text)

    def write(self, role: bytes, text: bytes) -> None:
        self.sha.update(b"" if self.first else b"\n")
        for part in (role, b":", text):
            self.sha.update(part)
        self.first = False

    def result(self) -> tuple:
        self.inserts()
        return (*self.head.values(), self.sha.hexdigest())


def repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired rows of each conversation, after damage."""
    rows = damage(conversations.select("conv_id", "turn", "role", "text"))
    edits = cheapest_edits(signatures(rows))
    answers = [f for f in edits.schema if f.name != "conv_id"]
    none = lambda kind: F.lit(None).cast(kind)
    heads = edits.select("conv_id", F.struct(*(f.name for f in answers)).alias("head"), none("long").alias("turn"), none("binary").alias("role"), none("binary").alias("text"), none("binary").alias("digest"))
    body = rows.filter(~F.col("gone")).select("conv_id", none(heads.schema["head"].dataType).alias("head"), "turn", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), _digest().alias("digest"))
    order = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), F.col("turn").asc_nulls_first(), "role", "digest")
    schema = T.StructType([rows.schema["conv_id"], *answers, T.StructField("repaired_sha256", T.StringType())])

    def fold(batches):
        return _folded(batches, arrow_types(schema), _Repair, _Repair.take, _Repair.result)

    return order.select("conv_id", "head", "role", "text").mapInArrow(fold, schema)


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
