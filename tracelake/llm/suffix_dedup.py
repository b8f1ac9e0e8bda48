"""Removal of byte strings that earlier documents hold, by ordering suffixes around shared anchors.

A byte goes if a string of `SPAN` bytes over it also starts in a document with a smaller doc_id. Suffixes of all
texts are too many to deal out, so anchors choose among them: a run of `GRAM` bytes is an anchor where its hash is the
least of some `SPAN`-byte string. Equal strings have equal anchors, so each shared string meets its copy at one.

1. Tasks find anchors and send (hash, hash of the context) to the hash's part. The context, all `SPAN`-byte strings
   over the anchor, reaches `SPAN - GRAM` bytes before and `SPAN` after its start. Copies within `AT_ONCE` bytes of a task meet there already, compared byte by byte.
2. A part finds the anchors that several documents have; hashes decide nothing else.
3. Each string goes to the anchor that is the leftmost least one in it. The strings of shared anchors are cut from their texts, and equal stretches of
   them are brought to one by comparing bytes, in the task and again in their part. Of the rest, strings whose hash several documents have are ordered by deep-shallow sorting
   (deep_shallow.py): equal strings become neighbours, and those of larger documents go. Strings of anchors with more than `CROWD` contexts are dealt
   one by one to the strings' own parts instead, so a passage in very many documents does not meet in one task.
4. Texts with something to remove are joined with their spans; the others are only hashed. Of texts, only those with contexts to be cut or
   spans to be removed are shuffled, compressed (all of them beyond `BROADCAST_ROWS` such texts).

Defined cases: a null text is empty; a null doc_id is neither smaller nor larger than any, so such rows are kept
whole; rows of equal doc_id do not remove from each other; texts under `SPAN` bytes are kept whole; very long texts
are read whole; ids of any type that Spark can order will do; extra columns are carried along by the pipeline stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import BROADCAST_ROWS, chunks, cut_lineage, free_name, mix64, prefix_sums, slices, table
from tracelake.llm.deep_shallow import order_windows

SPAN = 50
GRAM = 20
BEFORE = SPAN - GRAM
#: Contexts of one anchor beyond which its strings are dealt out one by one.
CROWD = 2000
#: Bytes of text for one part of anchors.
PART_BYTES = 16_000_000
#: Parts of contexts for one of anchors.
CONTEXT_PARTS = 2
#: Parts of anchors for one bucket of marks, which are few bytes.
BUCKET_PARTS = 8
#: Shares that the contexts of a part are ordered in, one after the other.
SHARES = 16
#: Bytes of text that a task works on at once. A part gets one blob of them, so blobs are few beside bytes.
AT_ONCE = 8_000_000
#: Bytes of whole texts that are hashed at once, so that their arrays stay in the cache.
HASHED_AT_ONCE = 200_000
DECIDED, CONTEXT, CROWDED, RUNS = 0, 1, 2, 3

#: Columns of marks: document, hash of its text, kind, and a place or a run of starts as its first and the number that follow.
Marks = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pack_columns(*columns: np.ndarray) -> bytes:
    return b"".join(len(x := np.ascontiguousarray(c).tobytes()).to_bytes(8, "little") + x for c in columns)


def unpack_columns(blob: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def planes(numbers: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bytes of numbers, one plane after the other, so that planes of small numbers compress."""
    return np.ascontiguousarray(np.ascontiguousarray(numbers.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T)


def unplanes(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def steps_of(numbers: np.ndarray) -> np.ndarray:
    """Differences of neighbours with the sign in the lowest bit; small for numbers in near order."""
    d = np.diff(numbers.astype(np.int64), prepend=0)
    return ((d << 1) ^ (d >> 63)).view(np.uint64)


def from_steps(steps: np.ndarray) -> np.ndarray:
    z = steps.astype(np.uint64)
    return np.cumsum(((z >> np.uint64(1)) ^ (np.uint64(0) - (z & np.uint64(1)))).view(np.int64))


def sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of `width` values from each position."""
    out, have = values, 1
    while 2 * have <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: len(values) - width + 1], out[width - have : len(values) - have + 1]) if width > have else out


def gram_ranks(hashes: np.ndarray) -> np.ndarray:
    """Upper halves of hashes, by which anchors are chosen; never zero."""
    return np.maximum((hashes >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of all anchors in texts laid end to end, their texts, hashes, hashes of their contexts, and where these begin and end."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none.astype(np.uint64), none.astype(np.uint64), none, none
    c, q = prefix_sums(data)
    span = lambda a, b: (c[b] - c[a]) * q[a]
    g = mix64((c[GRAM:] - c[:-GRAM]) * q[: n - GRAM + 1])
    rank = gram_ranks(g)
    low = np.zeros(n - SPAN + 1 + 2 * BEFORE, np.uint32)
    own = low[BEFORE : len(low) - BEFORE]
    own[:] = sliding(rank, BEFORE + 1, np.minimum)  # of the string from each place
    for end in offsets[1:-1].tolist():
        own[max(0, end - SPAN + 1) : end] = 0  # it would cross texts
    at = np.flatnonzero(sliding(low, BEFORE + 1, np.maximum)[: len(g)] == rank)
    doc = np.searchsorted(offsets, at, side="right") - 1
    lo, hi = np.maximum(offsets[doc], at - BEFORE), np.minimum(offsets[doc + 1], at + SPAN)
    around = mix64(mix64(span(lo, hi)) + (at - lo).astype(np.uint64) * np.uint64(64) + (hi - at).astype(np.uint64))
    return at, doc, g[at], around, lo, hi


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the `size` bytes (eight or more) from a equal those from b, each."""
    out = np.ones(len(a), bool)
    if len(a):
        words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))  # the eight bytes from each place
        for k in range(0, int(size.max()), 8):
            step = np.minimum(k, size - 8)
            out &= words[a + step] == words[b + step]
    return out


def laid(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts laid end to end (null: none), and where each begins, with the end of the last."""
    texts = pa.compute.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def regrouped(batches, column: int, most: int, sizes_of):
    """Tables of consecutive rows with about `most` bytes in a column, by the sizes of its values; a larger value is a table of its own."""
    held, total = [], 0
    for batch in batches:
        sizes = sizes_of(batch.column(column))
        for lo, hi in chunks(sizes, int, most):
            n = sum(sizes[lo:hi])
            if held and total + n > most:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
            held.append(batch.slice(lo, hi - lo))
            total += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def plain_sizes(column: pa.Array) -> list[int]:
    return pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()


def expanded_sizes(column: pa.Array) -> list[int]:
    """Sizes of compressed values once they are expanded."""
    import zstandard

    return [0 if x is None else zstandard.frame_content_size(x) for x in column.to_pylist()]


def _equal_earlier(data: np.ndarray, own: np.ndarray, sig: np.ndarray, lo: np.ndarray, size: np.ndarray, at: np.ndarray | int) -> np.ndarray:
    """Which strings (from lo, size bytes, anchor at byte `at`) equal one of a smaller document; sig only brings candidates together."""
    at = np.broadcast_to(at, len(own))
    order = np.argsort(sig)
    twin = np.concatenate(([False], np.diff(sig[order]) == 0, [False]))
    order = order[twin[1:] | twin[:-1]] if len(order) else order
    order = order[np.lexsort((own[order], sig[order]))]
    new = np.concatenate((np.ones(min(1, len(order)), bool), np.diff(sig[order]) != 0))
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    some = own[order] > own[first]
    x, y = order[some], first[some]
    out = np.zeros(len(own), bool)
    out[x] = (size[x] == size[y]) & (at[x] == at[y]) & same_bytes(data, lo[x], lo[y], np.minimum(size[x], size[y]))
    return out


def own_starts(g: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings in which the anchor at each place is the leftmost least one (none if last < first).

    g: ranks of the grams; begin, end: the anchors' texts. Every string has one such anchor, equal ones at the same byte.
    """
    padded = np.concatenate((np.zeros(BEFORE, g.dtype), g, np.zeros(BEFORE + GRAM, g.dtype)))
    here = padded[at + BEFORE]
    first, last = np.maximum(begin, at - BEFORE), np.minimum(end - SPAN, at)
    left, right = np.arange(len(at)), np.arange(len(at))
    for k in range(1, BEFORE + 1):
        stop = padded[at[left] - k + BEFORE] <= here[left]
        first[left[stop]] = np.maximum(first[left[stop]], at[left[stop]] - k + 1)
        left = left[~stop]
        stop = padded[at[right] + k + BEFORE] < here[right]
        last[right[stop]] = np.minimum(last[right[stop]], at[right[stop]] + k - BEFORE - 1)
        right = right[~stop]
    return first, last


_MARKS = "bucket int, blob binary"


def deal(found: Marks, parts: int) -> tuple[list[int], list[bytes]]:
    """Numbers of buckets and a blob of marks for each, documents and their kinds together; a document's marks meet in its bucket."""
    ids, marks, kinds, first, more = found
    h = mix64(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + marks.view(np.uint64))
    buckets = max(8, parts // BUCKET_PARTS)
    bucket = ((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24)
    order = np.argsort((h & ~np.uint64(3)) | kinds.astype(np.uint64))  # buckets are ranges of h
    ids, marks, kinds, first, more, bucket = (x[order] for x in (ids, marks, kinds, first.astype("<u4"), more.astype("u1"), bucket))
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(ids)), bool), (np.diff(ids) != 0) | (np.diff(marks) != 0) | (np.diff(kinds) != 0))))
    times = np.diff(np.append(begin, len(ids))).astype("<u4")
    ids, marks, kinds = ids[begin], marks[begin].astype("<u4"), kinds[begin].astype("u1")
    rows, entries = (np.searchsorted(x, np.arange(buckets + 1)) for x in (bucket, bucket[begin]))
    numbers = np.flatnonzero(np.diff(rows)).tolist()
    blobs = []
    for k in numbers:
        e, r = slice(entries[k], entries[k + 1]), slice(rows[k], rows[k + 1])
        blobs.append(shrunk(pack_columns(ids[e], marks[e], kinds[e], times[e], first[r], more[r])))
    return numbers, blobs


def shrunk(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of so many bytes each, one after the other in data."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])


def gather(marks: DataFrame, name: str, kinds: tuple[int, ...]) -> DataFrame:
    """doc_id, mark and a binary column, from the marks (bucket, blob) of the wanted kinds, for documents that have any.

    Of places it holds each times two, plus one for those of crowded anchors, in order; of what goes, where each piece begins and ends (it may end
    beyond the text). All are unsigned 32-bit numbers.
    """

    def collect(group: pa.Table) -> pa.Table:
        cols = [unpack_columns(expand(b), "<i8", "<u4", "u1", "<u4", "<u4", "u1") for b in group.column("blob").to_pylist()]
        ids, own, kind, times, first, more = (np.concatenate([c[k] for c in cols]) for k in range(6))
        wanted = np.isin(kind, kinds)
        rows = np.repeat(wanted, times)
        ids, own, kind, times, first, more = ids[wanted], own[wanted], kind[wanted], times[wanted], first[rows].astype(np.int64), more[rows].astype(np.int64)
        order = np.lexsort((own, ids))
        new = np.concatenate((np.ones(min(1, len(ids)), bool), (np.diff(ids[order]) != 0) | (np.diff(own[order]) != 0)))
        number = np.zeros(len(ids), np.int64)
        number[order] = np.cumsum(new) - 1
        docs, kind = np.repeat(number, times), np.repeat(kind, times)
        if RUNS in kinds:
            a = np.where(kind == DECIDED, np.maximum(first - BEFORE, 0), first)
            key = np.argsort((docs << 32) | a)
            docs, a, b = docs[key], a[key], (first + more + SPAN)[key]
            reach = np.maximum.accumulate((docs << 32) | b)
            fresh = np.flatnonzero(np.concatenate((np.ones(min(1, len(a)), bool), ((docs[1:] << 32) | a[1:]) > reach[:-1])))
            ends = reach[np.append(fresh[1:], len(a))[: len(fresh)] - 1] & 0xFFFFFFFF
            docs, data = docs[fresh], np.stack((a[fresh], ends), 1).astype("<u4")
        else:
            key = np.sort((docs << 33) | (first << 1) | (kind == CROWDED))
            key = key[np.concatenate((np.ones(min(1, len(key)), bool), np.diff(key) != 0))]
            docs, data = key >> 33, (key & 0xFFFFFFFF).astype("<u4")
        sizes = np.bincount(docs, minlength=int(new.sum())) * data.itemsize * (data.size // max(1, len(data)))
        some = order[new]
        return pa.table({"doc_id": pa.array(ids[some], pa.int64()), "mark": pa.array(own[some].astype(np.int64), pa.int64()), name: binaries(data, sizes)})

    return marks.groupBy("bucket").applyInArrow(collect, f"doc_id long, mark long, {name} binary")


#: Blobs for a part, or for a bucket of marks (which passes with a part).
_OUT = "part int, bucket int, blob binary"


def _batch(part: list[int], bucket: list[int] | None, blob: list[bytes]) -> pa.RecordBatch:
    bucket = pa.array(bucket, pa.int32()) if bucket is not None else pa.nulls(len(part), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), bucket, pa.array(blob, pa.binary())], names=["part", "bucket", "blob"])


def _known(found: Marks, parts: int) -> pa.RecordBatch:
    numbers, blobs = deal(found, parts)
    return _batch([k % parts for k in numbers], numbers, blobs)


def _with_marks(known: pa.Table, found: Marks | None, parts: int) -> pa.Table:
    """Rows (bucket, blob) of the marks that came to a part and of those found there."""
    known = known.select(["bucket", "blob"])
    if found is None or not len(found[0]):
        return known
    numbers, blobs = deal(found, parts)
    return pa.concat_tables([known, pa.table({"bucket": pa.array(numbers, pa.int32()), "blob": pa.array(blobs, pa.binary())})])


def squeeze(rows: DataFrame, column: str) -> DataFrame:
    """rows with a text column compressed (binary), for a shuffle of whole texts."""
    at = rows.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == column else f.dataType) for f in rows.schema])

    def shrink(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, at, AT_ONCE):
            columns = list(batch.columns)
            columns[at] = pa.array([None if t is None else press.compress(t) for t in columns[at].cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(shrink, schema)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def find_anchors(rows: DataFrame, parts: int) -> DataFrame:
    """From (doc_id, mark, text): blobs of anchors for each part, and marks of those decided within the task."""

    def find(batches):
        for rows in regrouped(batches, 2, AT_ONCE, plain_sizes):
            ids, marks = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            data, offsets = laid(rows.column(2).chunk(0))
            found = []
            for a, b in chunks(np.diff(offsets).tolist(), int, HASHED_AT_ONCE):
                x = anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                found.append((x[0] + offsets[a], x[1] + a, x[2], x[3], x[4] + offsets[a], x[5] + offsets[a]))
            at, doc, h, around, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(at):
                continue
            late = _equal_earlier(data, ids[doc], mix64(h ^ (around * np.uint64(0x9E3779B97F4A7C15))), lo, hi - lo, at - lo)
            place = at - offsets[doc]
            if late.any():
                own = doc[late]
                yield _known((ids[own], marks[own], np.full(len(own), DECIDED), place[late], np.zeros(len(own), np.int64)), parts)
            left = np.flatnonzero(~late)
            part = (h[left] % np.uint64(parts)).astype(np.min_scalar_type(parts))
            order = np.argsort(part, kind="stable")
            left, part = left[order], part[order]
            doc, h, around, place = doc[left], h[left] // np.uint64(parts), around[left] >> np.uint64(48), place[left]
            begin = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(part) != 0)))) if len(left) else left
            times, docs = np.diff(np.append(begin, len(left))), doc[begin]
            cuts, entries = (np.searchsorted(x, np.arange(parts + 1)) for x in (part, part[begin]))
            numbers = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = []
            for p in numbers:
                e, r = slice(entries[p], entries[p + 1]), slice(cuts[p], cuts[p + 1])
                blobs.append(pack_columns(planes(steps_of(ids[docs[e]]), 8), planes(marks[docs[e]], 4), planes(times[e], 4), planes(h[r], 4), planes(around[r], 2), planes(steps_of(place[r]), 5)))
            yield _batch(numbers, None, blobs)

    return rows.select("doc_id", "mark", "text").mapInArrow(find, _OUT)


def meet(found: DataFrame, parts: int) -> DataFrame:
    """Marks (bucket, blob): what each part decides of its anchors, and what tasks have decided."""

    def judge(group: pa.Table) -> pa.Table:
        sent = pa.compute.is_null(group.column("bucket"))
        rows, known = group.filter(sent), group.filter(pa.compute.invert(sent))
        if not rows.num_rows:
            return _with_marks(known, None, parts)
        cols = [unpack_columns(b, *["u1"] * 6) for b in rows.column("blob").to_pylist()]
        times = [unplanes(c[2], 4).astype(np.int64) for c in cols]
        entry = np.repeat(np.arange(sum(len(x) for x in times)), np.concatenate(times))
        ids, marks = np.concatenate([from_steps(unplanes(c[0], 8)) for c in cols]), np.concatenate([unplanes(c[1], 4) for c in cols])
        h, around = (np.concatenate([unplanes(c[k], n) for c in cols]) for k, n in ((3, 4), (4, 2)))
        place = np.concatenate([from_steps(unplanes(c[5], 5)) for c in cols])
        del cols, times
        key = (h << np.uint64(16)) | around
        order = np.argsort(key)
        key, own = key[order], ids[entry[order]]
        at_c = np.flatnonzero(np.concatenate(([True], np.diff(key) != 0)))
        at_h = np.flatnonzero(np.concatenate(([True], np.diff(key >> np.uint64(16)) != 0)))
        several = np.minimum.reduceat(own, at_h) != np.maximum.reduceat(own, at_h)
        crowded = np.diff(np.append(np.searchsorted(at_c, at_h), len(at_c))) > CROWD
        sizes = np.diff(np.append(at_h, len(key)))
        keep = order[np.repeat(several, sizes)]
        kind = np.where(np.repeat(crowded[several], sizes[several]), CROWDED, CONTEXT)
        own = entry[keep]
        return _with_marks(known, (ids[own], marks[own].astype(np.int64), kind, place[keep], np.zeros(len(keep), np.int64)), parts)

    return found.groupBy("part").applyInArrow(judge, _MARKS)


def _stretches(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, at: np.ndarray, crowded: np.ndarray) -> tuple[np.ndarray, ...]:
    """Strings of the anchors at the given places: text, first start, bytes, anchor's byte in them, hash of where they meet, and of all of them."""
    c, q = prefix_sums(data)
    span = lambda a, b: mix64((c[b] - c[a]) * q[a])
    g = mix64((c[GRAM:] - c[:-GRAM]) * q[: len(data) - GRAM + 1])
    first, last = own_starts(gram_ranks(g), at, offsets[doc], offsets[doc + 1])
    some = last >= first
    doc, crowded, at, first, last = doc[some], crowded[some], at[some], first[some], last[some]
    key = g[at]
    if crowded.any():
        times = np.where(crowded, last - first + 1, 1)
        nth = ranges(np.zeros(len(times), np.int64), times)
        doc, crowded, key, at, first, last = (np.repeat(x, times) for x in (doc, crowded, key, at, first, last))
        first = first + nth
        last, at = np.where(crowded, first, last), np.where(crowded, first, at)
        key = np.where(crowded, span(first, first + SPAN), key)
    size, within = last - first + SPAN, at - first
    sig = mix64(span(first, first + size) + within.astype(np.uint64) * np.uint64(128) + size.astype(np.uint64))
    return doc, first, size, within, key, sig


def cut_contexts(rows: DataFrame, parts: int) -> DataFrame:
    """From (doc_id, mark, text compressed, open: places): blobs of strings for each of the parts of contexts.

    An anchor takes the strings in which it is the leftmost least one, so each string is sent once; those of crowded anchors go one by one.
    """
    deals = CONTEXT_PARTS * parts

    def cut(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for rows in regrouped(batches, 2, AT_ONCE, expanded_sizes):
            ids, marks = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            data = b"".join([expand(t) for t in rows.column(2).to_pylist()])
            offsets = np.cumsum([0, *expanded_sizes(rows.column(2))])
            data = np.frombuffer(data, np.uint8)
            opened, ends = laid(rows.column(3).chunk(0))
            opened, ends = np.frombuffer(opened.tobytes(), "<u4").astype(np.int64), ends // 4
            doc = np.repeat(np.arange(len(ids)), np.diff(ends))
            at, crowded = (opened >> 1) + offsets[doc], (opened & 1).astype(bool)
            found = []
            for a, b in chunks(np.diff(offsets).tolist(), int, HASHED_AT_ONCE):
                own = slice(ends[a], ends[b])
                x = _stretches(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], doc[own] - a, at[own] - offsets[a], crowded[own])
                found.append((x[0] + a, x[1] + offsets[a], *x[2:]))
            doc, lo, size, within, key, sig = (np.concatenate(x) for x in zip(*found, strict=True))
            late = _equal_earlier(data, ids[doc], sig, lo, size, within)
            place = lo - offsets[doc]
            if late.any():
                own = doc[late]
                yield _known((ids[own], marks[own], np.full(len(own), RUNS), place[late], size[late] - SPAN), parts)
            left = np.flatnonzero(~late)
            left = left[np.argsort(key[left])]
            part = (key[left] % np.uint64(deals)).astype(np.min_scalar_type(deals))
            order = np.argsort(part, kind="stable")
            left, part = left[order], part[order]
            doc, lo, size, place = doc[left], lo[left], size[left], place[left].astype("<u4")
            share = (key[left] // np.uint64(deals) % np.uint64(SHARES)).astype("u1")
            own, mark, short = ids[doc].astype("<i8"), marks[doc].astype("<u4"), size.astype("u1")
            cuts = np.searchsorted(part, np.arange(deals + 1))
            numbers = np.flatnonzero(np.diff(cuts)).tolist()
            blobs = []
            for p in numbers:
                x = slice(cuts[p], cuts[p + 1])
                blobs.append(press.compress(pack_columns(own[x], mark[x], place[x], short[x], share[x], data[ranges(lo[x], size[x])])))
            yield _batch(numbers, None, blobs)

    return rows.select("doc_id", "mark", "text", "open").mapInArrow(cut, _OUT)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges (begin, size), one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def shared(sig: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Numbers of the rows whose sig several of own have, in order."""
    order = np.argsort(sig)
    begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(sig)), bool), np.diff(sig[order]) != 0)))
    if not len(begin):
        return order
    own = own[order]
    several = np.minimum.reduceat(own, begin) != np.maximum.reduceat(own, begin)
    return np.sort(order[np.repeat(several, np.diff(np.append(begin, len(order))))])


def sort_contexts(cut: DataFrame, parts: int) -> DataFrame:
    """Marks (bucket, blob): runs of starts of strings that a smaller document has too."""

    def compare(group: pa.Table) -> pa.Table:
        sent = pa.compute.is_null(group.column("bucket"))
        rows, known = group.filter(sent), group.filter(pa.compute.invert(sent))
        if not rows.num_rows:
            return _with_marks(known, None, parts)
        cols = [unpack_columns(expand(b), "<i8", "<u4", "<u4", "u1", "u1", "u1") for b in rows.column("blob").to_pylist()]
        own, mark, start, size, share, data = (np.concatenate([c[k] for c in cols]) for k in range(6))
        del cols
        begin = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        late: list[tuple] = []
        for k in range(SHARES):
            some = np.flatnonzero(share == k)
            if not len(some):
                continue
            sizes, ids = size[some].astype(np.int64), own[some]
            part, lo = data[ranges(begin[some], sizes)], np.cumsum(sizes) - sizes
            c, q = prefix_sums(part)
            whole = _equal_earlier(part, ids, mix64((c[lo + sizes] - c[lo]) * q[lo]) + sizes.astype(np.uint64), lo, sizes, 0)
            late.append((some[whole], start[some[whole]], sizes[whole] - SPAN))
            rest = np.flatnonzero(~whole)
            count = sizes[rest] - SPAN + 1
            entry, within = np.repeat(rest, count), ranges(np.zeros(len(rest), np.int64), count)
            at = lo[entry] + within
            asked = shared((c[at + SPAN] - c[at]) * q[at], ids[entry])
            if not len(asked):
                continue
            entry, within = entry[asked], within[asked]
            order, rank = order_windows(part, at[asked], SPAN)
            sorted_ids = ids[entry[order]]
            new = np.flatnonzero(np.concatenate(([True], np.diff(rank) != 0)))
            gone = np.sort(order[sorted_ids > np.minimum.reduceat(sorted_ids, new)[rank]])
            entry, within = entry[gone], within[gone]
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(gone)), bool), (np.diff(entry) != 0) | (np.diff(within) != 1))))
            e = some[entry[first]]
            late.append((e, start[e] + within[first], np.diff(np.append(first, len(gone))) - 1))
        e, first, more = (np.concatenate([x[k] for x in late]) for k in range(3))
        return _with_marks(known, (own[e], mark[e].astype(np.int64), np.full(len(e), RUNS), first, more), parts)

    return cut.groupBy("part").applyInArrow(compare, _MARKS)


def without(raw: bytes, gone: bytes | None) -> tuple[bytes, int]:
    """raw without pieces (where each begins and ends), and how many these are."""
    if not gone:
        return raw, 0
    edges = np.frombuffer(gone, "<u4").tolist()
    return b"".join([raw[a:b] for a, b in zip([0, *edges[1::2]], [*edges[0::2], len(raw)], strict=True)]), len(edges) // 2


def text_mark() -> Column:
    """Tells texts of one doc_id apart: 32 bits of a hash."""
    return F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))


def with_number(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column in the order of doc_id, null for null ids; ids that are no integers are numbered by a range sort."""
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    ids = docs.select(F.col("doc_id").alias("_id")).filter("_id is not null").distinct()
    ids = cut_lineage(ids.repartitionByRange("_id").sortWithinPartitions("_id").withColumn(name, F.monotonically_increasing_id()))
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("_id"), "left").drop("_id")


def only(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The rows with the given keys, found before anything is shuffled where the keys are few."""
    few = keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(keys), on, "left_semi") if few else rows


def spans(rows: DataFrame) -> DataFrame:
    """doc_id, mark (hash of the text), spans: what to remove, for each document (doc_id long, text) with something to remove."""
    rows = rows.filter("doc_id is not null").select("doc_id", text_mark().alias("mark"), "text")
    parts = max(8, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    met = cut_lineage(meet(find_anchors(rows, parts), parts))
    opened = cut_lineage(gather(met, "open", (CONTEXT, CROWDED)))
    asked = only(rows, opened.select("doc_id", "mark"), ["doc_id", "mark"])
    cut = cut_contexts(squeeze(asked, "text").join(opened, ["doc_id", "mark"]), parts)
    return cut_lineage(gather(met.union(sort_contexts(cut, parts)), "spans", (DECIDED, RUNS)))


def reduced(docs: DataFrame, as_text: bool = False, keep_texts: bool = True) -> tuple[DataFrame, str]:
    """docs with one more struct column, and its name: n_bytes, n_removed, n_spans and kept (the bytes that stay).

    as_text: kept is text instead, without what is left of characters that were cut in two. Without keep_texts, docs come without text.
    """
    name, mark, sp, num = (free_name(docs, x) for x in ("_kept", "_mark", "_spans", "_number"))
    rows = with_number(docs, num)
    found = spans(rows.select(F.col(num).alias("doc_id"), "text")).select(F.col("doc_id").alias("_id"), F.col("mark").alias(mark), F.col("spans").alias(sp))
    rows = rows.withColumn(mark, text_mark())
    same = F.col(num) == F.col("_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    whole = F.struct(F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), (text if as_text else text.cast("binary")).alias("kept"))
    keys = found.select("_id").distinct()
    if keys.count() <= BROADCAST_ROWS:
        untouched = rows.join(F.broadcast(keys), same, "left_anti")
        rows = rows.join(F.broadcast(keys), same, "left_semi")
    else:
        untouched = None
    joined = squeeze(rows, "text").join(found.withColumnRenamed(mark, mark + "2"), same & (F.col(mark) == F.col(mark + "2")), "left").drop("_id", mark + "2")
    shape = lambda x: x.withColumn(name, whole) if keep_texts else x.withColumn(name, whole).drop("text")
    schema = shape(rows).schema
    text_at = docs.columns.index("text")

    def remove(batches):
        for batch in regrouped(batches, text_at, AT_ONCE, expanded_sizes):
            out, texts = [], []
            for t, found in zip(batch.column(text_at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                raw = b"" if t is None else expand(t)
                if keep_texts:
                    texts.append(None if t is None else raw)
                left, pieces = without(raw, found)
                out.append((len(raw), len(raw) - len(left), pieces, left.decode("utf-8", "ignore") if as_text else left))
            n_bytes, n_removed, n_spans, kept = zip(*out, strict=True)
            kept = pa.StructArray.from_arrays([pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.string() if as_text else pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])
            columns = [x.combine_chunks() for x in batch.columns[:-1]]
            columns[text_at : text_at + 1] = [pa.array(texts, pa.binary()).cast(pa.string())] if keep_texts else []
            yield pa.RecordBatch.from_arrays([*(x.chunk(0) if isinstance(x, pa.ChunkedArray) else x for x in columns), kept], names=schema.names)

    out = joined.mapInArrow(remove, schema)
    if untouched is not None:
        out = out.union(shape(untouched))
    return out.drop(mark, num), name


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, x = reduced(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_texts=False)
    x = F.col(x)
    return rows.select("doc_id", x["n_bytes"].alias("n_bytes"), x["n_removed"].alias("n_removed"), x["n_spans"].alias("n_spans"), F.sha2(x["kept"], 256).alias("kept_sha256"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated strings (a character cut in two goes too); texts with nothing left go."""
    rows, x = reduced(docs, as_text=True)
    k = F.col(x)
    rows = rows.filter((k["n_removed"] == 0) | (F.length(k["kept"]) > 0))
    text = F.when(k["n_removed"] > 0, k["kept"]).otherwise(F.col("text"))
    return rows.select(*(text.alias(c) if c == "text" else F.length(text).cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes))


#: DuckDB SQL of op7_suffix_dedup: every 50-byte string as 100 hexadecimal digits, its least doc_id, and the spans between.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
x AS (SELECT doc_id, c, substr(h, 2 * c + 1, {2 * (500 + SPAN - 1)}) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - {SPAN - 1}, 500)) AS c FROM d)),
w AS (SELECT doc_id, c + j AS i, substr(x, 2 * j + 1, {2 * SPAN}) AS s FROM (SELECT doc_id, c, x, unnest(range(0, len(x) // 2 - {SPAN - 1})) AS j FROM x)),
r AS (SELECT doc_id, i FROM w JOIN (SELECT s, min(doc_id) AS least FROM w GROUP BY s) USING (s) WHERE least < doc_id),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {SPAN} THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM (SELECT doc_id, span, min(i) AS a, max(i) + {SPAN} AS b FROM k GROUP BY doc_id, span)),
q AS (SELECT p.doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head, max(b) AS tail, count(*) AS n_spans, sum(b - a) AS n_removed FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(tail, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN q USING (doc_id)"""
