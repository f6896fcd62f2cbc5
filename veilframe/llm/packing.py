"""Cost-balanced packing of token sequences.

A document is cut into full pieces of ``capacity`` tokens and a remainder. Each full piece fills a sequence of its own.
The remainders are spread over partitions and packed there in windows of bounded size: a window with W tokens gets
ceil(W / capacity) sequences; a piece costs ``linear * n + quadratic * n * n``; pieces go, in descending order of cost, to
the lowest-cost sequence that still has room for all of them, and where none has, a piece is cut over the sequences with
the most room. So every sequence of a window but the last is full: a window wastes less than one sequence.

Memory is bounded by the window. Pieces are spread by a hash of doc_id, place and text, so neither null ids nor copies under
several ids meet in one task, and neither the split of the input nor a lost executor moves a piece.
Defined results: a null text is empty and gives the closing id alone; every row is packed, repeated rows each on their own;
a null doc_id stays null; an empty table gives no pieces. Sequence ids are the partition, then a counter, so they are
unique; partitions are sorted first, so that reruns agree.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.tables import partitions, table
from veilframe.llm.tokens import default_path, encoder

CAPACITY, WINDOW, LINEAR, QUADRATIC, CLOSING = 1024, 4096, 1.0, 1.0 / 512, 0
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
COLUMNS = [f.split()[0] for f in PIECE.split(", ")]


def balanced(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(piece, from, length, sequence, offset) for pieces of the given lengths, none above ``capacity``."""
    n_seq = -(-int(lengths.sum()) // capacity)
    room, cost = np.full(n_seq, capacity, np.int64), np.zeros(n_seq)
    out = []

    def put(piece: int, start: int, length: int, s: int) -> None:
        out.append((piece, start, length, s, capacity - int(room[s])))
        room[s] -= length
        cost[s] += linear * length + quadratic * length * length

    for piece in np.argsort(-lengths, kind="stable"):
        left = int(lengths[piece])
        masked = np.where(room >= left, cost, np.inf)
        s = int(masked.argmin()) if n_seq else 0
        if np.isfinite(masked[s]):
            put(int(piece), 0, left, s)
            continue
        start = 0
        while left:
            s = int(room.argmax())
            part = min(left, int(room[s]))
            put(int(piece), start, part, s)
            start, left = start + part, left - part
    return out


def encoded(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: full ones as their checksum alone, remainders with their ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            held = 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(CLOSING)).astype("<u4")
                salt = zlib.crc32(ids.tobytes())
                for start in range(0, len(ids), capacity):
                    raw = ids[start : start + capacity].tobytes()
                    full = len(raw) == 4 * capacity
                    for column, value in zip(out, (doc, start, len(raw) // 4, zlib.crc32(raw) if full else None, len(ids), None if full else raw, salt)):
                        column.append(value)
                    held += 0 if full else len(raw)
                if held > 8 << 20 or len(out[0]) > 20_000:
                    yield _pieces(out)
                    out, held = [[] for _ in range(7)], 0
            if out[0]:
                yield _pieces(out)

    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return raw.mapInArrow(cut, "doc_id long, start long, length long, crc long, doc_tokens long, ids binary, salt long")


def _pieces(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "start", "length", "crc", "doc_tokens", "ids", "salt"])


def pack(docs: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, one row a piece."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = TaskContext.get().partitionId() << 40, 0
        waiting: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal used
            rows, last = [], -1
            for piece, start, length, s, offset in balanced(np.array([w[2] for w in waiting], np.int64), capacity):
                doc, at, _, total, raw = waiting[piece]
                rows.append((doc, at + start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), total, base + used + s, offset))
                last = max(last, s)
            used += last + 1
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], COLUMNS)

        for b in batches:
            doc, start, length, crc, total, ids = (b.column(i) for i in range(6))
            full = np.flatnonzero(length.to_numpy() == capacity)
            if len(full):
                at = pa.array(full)
                seq = pa.array(base + used + np.arange(len(full)), pa.int64())
                used += len(full)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in (doc, start, length, crc, total)), seq, pa.array(np.zeros(len(full), np.int64))], COLUMNS)
            at = pa.array(np.flatnonzero(length.to_numpy() < capacity))
            for row in zip(*(c.take(at).to_pylist() for c in (doc, start, length, total, ids))):
                waiting.append(row)
                if len(waiting) >= window:
                    yield packed()
        if waiting:
            yield packed()

    pieces = encoded(docs, path or default_path(), capacity)
    spread = pieces.repartition(partitions(docs.sparkSession), F.xxhash64("doc_id", "start", "salt"))
    ordered = spread.sortWithinPartitions(F.xxhash64("doc_id", "start", "salt"), "doc_id", "start", "doc_tokens", "ids")
    return ordered.select("doc_id", "start", "length", "crc", "doc_tokens", "ids").mapInArrow(fill, PIECE)


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
