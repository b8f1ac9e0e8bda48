"""Best-fit packing of tokenized documents into fixed-length sequences.

Documents are tokenized where they lie; only lengths and checksums are shuffled. Pieces are dealt by
hash into shards of about `SHARD_DOCS` documents, and each shard is packed on its own by best-fit
decreasing with a segment tree over remaining capacities, so no task grows with the corpus.

Defined cases: a null or empty text is the single id 0; documents with equal ids are separate pieces of
the same doc_id; only documents longer than a sequence are cut; ties in length keep (doc_id, piece) order;
extra columns are ignored; an empty table packs into nothing.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import chunks, table

CAPACITY = 2048
END_ID = 0
SHARD_DOCS = 8_000
VOCABULARY = "word_bpe_49k.json"
#: Runs whose ids a worker remembers; beyond it the memory starts anew.
CACHED_RUNS = 250_000
#: The runs that the vocabulary's tokens stay in, and the end mark of a run's last token.
RUN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
RUN_END = "</w>"
#: Latin, Greek and Cyrillic letters and common signs, without marks that combine, the capital I with a dot and the capital sigma,
#: whose lower case needs more than the letter itself. Texts of these alone are split here, others by the tokenizer.
PLAIN = r"\t-\r -~\u00a0-\u012f\u0131-\u024f\u0391-\u03a1\u03a4-\u03a9\u03b1-\u03c9\u0400-\u045f\u2010-\u2027\u2030-\u203a\u20ac\u2122"
#: The start of special tokens.
SPECIAL = "<|"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RunEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    No token crosses white space, nor the runs of letters, digits and signs that the vocabulary is made for. Runs not seen before go to the tokenizer in groups and are
    told apart by the mark that ends a run's last token.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.other = re.compile(f"[^{PLAIN}]").search
        self.runs_of = regex.compile(RUN).findall
        self.ascii_runs = re.compile(RUN.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")).findall
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith(RUN_END)]] = True
        self.runs: dict[str, bytes] = {}
        self.most = CACHED_RUNS

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _learn_runs(self, fresh: list[str]) -> None:
        groups = [" ".join(fresh[k : k + 200]) for k in range(0, len(fresh), 200)]
        found = self.tokenizer.encode_batch(groups, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found]) if found else np.zeros(0, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(fresh):
            self.runs.update(zip(fresh, self._ids(fresh), strict=True))
            return
        data, begin = ids.tobytes(), 0
        for run, end in zip(fresh, (4 * ends).tolist(), strict=True):
            self.runs[run] = data[begin:end]
            begin = end

    def _runs(self, text: str) -> list[str] | None:
        """Runs of a text; None if only the tokenizer can tell them."""
        if SPECIAL in text or self.other(text):
            return None
        return self.ascii_runs(text.lower()) if text.isascii() else self.runs_of(text.lower())

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self._runs(t) for t in texts]
        if len(self.runs) > self.most:
            self.runs.clear()
        self._learn_runs(list(set().union(*(runs for runs in split if runs)) - self.runs.keys()))
        get = self.runs.__getitem__
        return [self._ids([t])[0] if runs is None else b"".join(map(get, runs)) for t, runs in zip(texts, split, strict=True)]


@lru_cache(1)
def encoder_for(path: str) -> RunEncoder:
    """One encoder for all tasks of a worker, so that what it has learnt serves them all."""
    return RunEncoder(path)


class CapacityTree:
    """Segment tree over capacities 0..n: which of them some open bin has left."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1).bit_length()
        self.some = bytearray(2 * self.size)

    def set(self, at: int, value: int) -> None:
        i = at + self.size
        self.some[i] = value
        while i > 1:
            i >>= 1
            value = self.some[2 * i] | self.some[2 * i + 1]
            if self.some[i] == value:
                return
            self.some[i] = value

    def tightest(self, least: int) -> int:
        """The smallest marked capacity >= least, or -1."""
        i, some = least + self.size, self.some
        if some[i]:
            return least
        while i > 1:
            if not i & 1 and some[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if some[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return -1


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; longest first, each into the open bin that it leaves the least room in."""
    tree, open_bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        room = tree.tightest(n)
        if room < 0:
            b, room = count, capacity
            count += 1
        else:
            b = open_bins[room].pop()
            if not open_bins[room]:
                tree.set(room, 0)
        bins[i], offsets[i] = b, capacity - room
        if left := room - n:
            open_bins[left].append(b)
            tree.set(left, 1)
    return bins, offsets


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length and the checksum of its ids."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"

    def encode(batches):
        encoder = encoder_for(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, lambda t: len(t or "")):
                rows = []
                for at, found in enumerate(encoder.encode([t or "" for t in texts[lo:hi]]), lo):
                    data = memoryview(found + end)
                    for k, begin in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[begin : begin + 4 * capacity]
                        rows.append((at, k, begin // 4, len(part) // 4, zlib.crc32(part)))
                at, k, start, length, crc = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )
    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    shards = max(1, -(-docs.count() // shard_docs))
    cut = pieces(docs, path or vocabulary_path(), capacity)
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int")
    schema = ", ".join(f"{n} {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "start", "ids_crc32"], kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns="_shard").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)

    return cut.withColumn("_shard", shard).groupBy("_shard").applyInPandas(place, schema)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: where every piece of every document goes."""
    return pack(docs)
