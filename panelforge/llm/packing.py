"""Packing of tokenised documents into windows by best-fit decreasing.

Every document becomes the ids of its whole text, then one end id. Overlong documents are first cut into full windows,
which are sequences of their own; the rests are packed, longest first, each into the open window with the least room
that still holds it. A segment tree indexed by remaining room finds that window in logarithmic time.

The pieces are dealt by a hash of (doc_id, start, length) to the session's shuffle partitions and packed there without
their ids, a batch at a time into one tree per partition: a task holds the numbers of its open windows, not its rows.

Defined results: a null text is empty and gives the end id alone; null or repeated doc_ids are packed like any other;
ties are packed by doc_id, then start; empty tables give empty results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import read, small_batches, text_of

WINDOW, END = 2048, 1
SPECIAL = "<|endoftext|>"


def default_vocabulary() -> tuple[str, str]:
    """(tokenizer file, the same vocabulary as ranks) of the public byte-level vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoders(full: str, ranks: str):
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return Tokenizer.from_file(full), fast


def encode(text: str, vocabulary: tuple[str, str]) -> list[int]:
    """Ids of the tokenizer file; the faster twin has the same ids for texts without a special token."""
    exact, fast = _encoders(*vocabulary)
    return exact.encode(text, add_special_tokens=False).ids if SPECIAL in text else fast.encode_ordinary(text)


PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary"
_KINDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])


def tokenized_pieces(docs: DataFrame, vocabulary: tuple[str, str] | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit): full windows, then the rest."""
    vocabulary = vocabulary or default_vocabulary()
    small_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*encode(text, vocabulary), END], dtype="<u4").tobytes()
                n = len(ids) // 4
                rows += [(doc, i, min(window, n - i), n, ids[4 * i : 4 * (i + window)]) for i in range(0, n, window)]
            yield pa.RecordBatch.from_arrays([pa.array(x, k.type) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)] if rows else [pa.array([], k.type) for k in _KINDS], schema=_KINDS)

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(cut, PIECES)


class RoomTree:
    """A segment tree over remaining room 0..size: how many open windows have each room, and the least room that fits."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open = [array("q") for _ in range(size + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, window) of a tightest open window with room for `need`, taken out; None if there is none."""
        i = need + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                i += not self.count[i]
        room = i - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


class BestFit:
    """Best-fit decreasing over batches: lengths come in decreasing order, at most `window`; open windows stay open."""

    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.used, self.tree = window, 0, RoomTree(window)

    def place(self, lengths: list[int]) -> tuple[list[int], list[int]]:
        """(window, offset) of each length of the next batch."""
        tree, at, offset = self.tree, [], []
        for n in lengths:
            # a full window shares with nothing
            room, w = (n < self.window and tree.take(n)) or (self.window, self.used)
            self.used += w == self.used
            at.append(w)
            offset.append(self.window - room)
            if room > n:
                tree.put(room - n, w)
        return at, offset


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, start and length; all other columns stay."""
    spark = pieces.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    dealt = pieces.select(*kept).withColumn("__deal", F.xxhash64("doc_id", "start", "length"))
    # a partition's number is in the high bits of its sequence ids: unique without any exchange of counts
    dealt = dealt.repartition(parts, "__deal").sortWithinPartitions(F.col("length").desc(), "doc_id", "start", "__deal").drop("__deal")
    schema = dealt.withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, fit = TaskContext.get().partitionId() << 40, BestFit(window)
        for batch in batches:
            at, offset = fit.place(batch.column("length").to_pylist())
            columns = [*batch.columns, pa.array(np.array(at, dtype=np.int64) + base), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(place, schema)


def op5_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = tokenized_pieces(read(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
