"""Encoding and decoding whole texts with the word-end BPE of ``tokens``.

A null text counts as empty: no tokens, and the digests of the empty string.  Very long texts, special tokens
inside a text, repeated rows and extra columns need nothing special; an empty table gives none.  The decoded text
is that of the tokenizer file, which names no decoder: the tokens' strings joined by single spaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, tokenizer_file
from .tokens import OWNER, WordBpe, bpe

#: Spelled chunks kept per task, and as many again of those before them.
SPELLED = 250_000


def encode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of each text."""
    path = tokenizer or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(b"".join(map(model.table.__getitem__, c)), "<u4").astype(np.int32) for c in model.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, ids array<int>", OWNER)


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, text of each row's ids; null ids count as none."""
    path = tokenizer or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = [model.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, "doc_id long, text string", OWNER)


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


class Spelled(dict):
    """For each chunk's ids, as bytes: how many, the decimal ids and the tokens' strings, each joined by one space."""

    def __init__(self, model: WordBpe) -> None:
        super().__init__()
        self.model, self.decimals = model, list(map(str, range(len(model.text))))
        self.older: dict[bytes, tuple[str, str]] = {}

    def __missing__(self, ids: bytes) -> tuple[str, str]:
        if len(self) >= SPELLED:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(ids)) is None:
            numbers = np.frombuffer(ids, "<u4").tolist()
            out = " ".join(map(self.decimals.__getitem__, numbers)), self.model.decode(numbers)
        self[ids] = out
        return out


def digests(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each text, by ``encode`` and then ``decode`` within one task."""
    path = tokenizer or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        spelled = Spelled(model)
        for batch in batches:
            for part in slices(batch):
                counts, ids_sums, text_sums = [], [], []
                for chunks in model.encode(part.column(1).to_pylist()):
                    coded = [ids for c in chunks if (ids := model.table[c])]
                    counts.append(sum(map(len, coded)) // 4)
                    both = list(map(spelled.__getitem__, coded))
                    ids_sums.append(hashlib.sha256(" ".join([x[0] for x in both]).encode()).hexdigest())
                    text_sums.append(hashlib.sha256(" ".join([x[1] for x in both]).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums), pa.array(text_sums)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema, OWNER)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
