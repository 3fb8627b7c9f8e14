"""Packing into fixed windows: best-fit decreasing over a segment tree indexed by remaining capacity.

Each document's token ids (with the end mark) are cut into full windows, which are sequences of their own, and a
remainder.  A task packs the remainders it has met, longest first: a segment tree over the possible remaining
capacities tells the tightest open window that still fits.  Only identifiers and lengths are held, never ids,
and nothing is shuffled: a task's windows hold its own documents, so padding is about half a window a task.

Defined results: a null text counts as empty and yields one piece with the end mark alone.  Equal lengths pack in
the order of the input; repeated rows are documents of their own.  Sequence numbers are the task's number times
2**40 plus a count within the task; offsets have no gaps.  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, shared_folder, tokenizer_file
from .tokens import OWNER, bpe

WINDOW, END = 4096, 2
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """How many open windows have each remaining capacity, as a segment tree of counts."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        at = capacity + self.size
        while at:
            self.count[at] += by
            at >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open window has; -1 if none."""
        at, count = need + self.size, self.count
        if count[at]:
            return need
        while at > 1:
            if not at & 1 and count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: Iterable[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length."""
    lengths = np.asarray(lengths, np.int64)
    tree, open_windows = CapacityTree(window), [[] for _ in range(window + 1)]
    where, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        left = tree.tightest(need)
        if left < 0:
            left, w, n = window, n, n + 1
        else:
            w = open_windows[left].pop()
            tree.add(left, -1)
        where[i], offset[i] = w, window - left
        if left > need:
            open_windows[left - need].append(w)
            tree.add(left - need, 1)
    return where, offset


def pack_partition(documents: Iterator[tuple[object, bytes]], first: int, window: int) -> Iterator[dict[str, list]]:
    """documents: (doc_id, ids as little-endian unsigned 32-bit numbers).  Yields columns of PIECE."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    rest: list[tuple] = []
    out: list[tuple] = []
    for doc_id, ids in documents:
        n = len(ids) // 4
        for start in range(0, n - n % window, window):
            out.append((doc_id, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), n, first, 0))
            first += 1
        if n % window:
            start = n - n % window
            rest.append((doc_id, start, n - start, zlib.crc32(ids[4 * start :]), n))
        if len(out) >= 20_000:
            yield dict(zip(names, map(list, zip(*out))))
            out = []
    where, offset = best_fit_decreasing([r[2] for r in rest], window)
    out += [(*r, first + w, o) for r, w, o in zip(rest, where.tolist(), offset.tolist())]
    if out:
        yield dict(zip(names, map(list, zip(*out))))


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces (see PIECE) of all documents; the ids of a piece are those of its document from ``start`` on."""
    shared_folder(docs.sparkSession)
    path, tail = tokenizer or tokenizer_file(), np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bytes]]:
        model = bpe(path)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                part = ids[at : at + 256]
                for doc_id, chunks in zip(part, model.encode(texts.slice(at, 256).to_pylist())):
                    yield doc_id, b"".join(map(model.table.__getitem__, chunks)) + tail

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for columns in pack_partition(encode(batches), first, window):
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, PIECE, OWNER)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
