"""Small helpers that the operators share: scratch tables, row locators, Bloom filters and Python workers' memory."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary import scratch
from tributary.scratch import keep

#: Rows of an Arrow batch: texts may be long.
BATCH_ROWS = 1000
#: Bits for each key of a Bloom filter, its hash functions, and the most bytes it is given (beyond, it passes more).
BLOOM_BITS, BLOOM_HASHES, BLOOM_BYTES = 10, 4, 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; Arrow batches are kept small from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return scratch.shared_folder(spark)


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Delete tables of ``keep`` that nothing reads any more."""
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


PLACE = "struct<file: string, row: long>"


def located(docs: DataFrame, folder: str) -> DataFrame:
    """``docs``, or a written copy of it, of which every row has a ``locator``."""
    try:
        docs.select(locator())
    except AnalysisException:
        return keep(docs, folder, "located")
    return docs


def row_key() -> Column:
    """A locator in 128 bits."""
    return F.struct(F.xxhash64(F.lit(1), locator()).alias("a"), F.xxhash64(F.lit(2), locator()).alias("b"))


def locator() -> Column:
    """File and row of a row, the same in every scan."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def probably_in(key: Column, keys: DataFrame, folder: str, name: str) -> Column:
    """Whether ``key`` (a long) is in ``keys`` (one column of distinct longs); true for a few others too.

    A Bloom filter, held once by each task, tells most other rows apart before an exact join shuffles them.
    Of bounded size: with very many keys it is true for more.
    """
    return Bloom(keys, min(keys.count() * BLOOM_BITS, 8 * BLOOM_BYTES), BLOOM_HASHES, folder, name).passes(key)


class Bloom:
    """A Bloom filter of the values of ``keys`` (one column), as a one-row table in the shared folder."""

    def __init__(self, keys: DataFrame, bits: int, hashes: int, folder: str, name: str, seed: int = 0) -> None:
        words = max(1, -(-bits // 64))
        self.bits, self.hashes, self.seed = words * 64, hashes, seed
        ones = keys.select(F.explode(F.array(*[self.bit(F.col(keys.columns[0]), i) for i in range(hashes)])).alias("b"))
        rows = ones.groupBy(F.expr("b div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int))) as w"))
        every = rows.unionByName(keys.sparkSession.range(words).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))).groupBy("i").agg(F.bit_or("w").alias("w"))
        self.table = keep(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words")), folder, name)

    def bit(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed + i), key), F.lit(self.bits))

    def passes(self, key: Column) -> Column:
        """For rows, not inside functions of arrays: there, each row would get a copy of the filter."""
        out = F.lit(True)
        for i in range(self.hashes):
            b = self.bit(key, i)
            out = out & (F.getbit(F.get(self.table.scalar(), (b / 64).cast("int")), (b % 64).cast("int")) == 1)
        return out


_memory: dict[str, object] = {}


def remembered(owner: str, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker from task to task; another operator's goes first."""
    if owner not in _memory:
        _memory.clear()
        _memory[owner] = make()
    return _memory[owner]


def release(owner: str | None = None) -> None:
    """Give a Python worker's freed memory back to the system, with all that other operators remember."""
    for k in [k for k in _memory if k != owner]:
        del _memory[k]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str | None = None) -> DataFrame:
    """``df.mapInArrow`` by workers that hold nothing of earlier tasks (but what ``owner`` remembers)."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        yield from run(batches)
        release(owner)

    return df.mapInArrow(tidy, schema)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
