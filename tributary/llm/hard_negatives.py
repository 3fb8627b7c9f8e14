"""Hard-negative mining by coordinate pruning in length buckets (after LEMP).

The table is indexed once: rows are put in buckets by their vectors' length (at quantiles) and dealt by hash into blocks of some ROWS rows;
a block holds, for each coordinate, the list of its rows sorted by that coordinate of their unit vectors.

Anchors come in rounds of bounded bytes, sent to all tasks; no row of the table is shuffled for them.  For an anchor that looks for
scores of ``floor`` and more, a block whose longest vector is too short is passed by.  Else the cosine must be t = floor / (anchor's length *
longest) at least, so each of the anchor's FOCUS largest coordinates allows a range of values only; the ranges are looked up in the sorted lists,
the candidates of the narrowest list are intersected with the other ranges, and what is left is verified by exact inner products.
Where no list is shorter than half of the block, all its rows are verified by one matrix product.  A task keeps the best k of each anchor,
whose last raises the floor for its next blocks.  Floors start from a pass over one of SHARE blocks: a bound that only ever saves work.

Positives (largest scores of the anchor's own label) are searched first, then for each positive the best negatives (of other labels)
between two shares of its score.  All scores are integers and exact: products are in double precision while these are below 2^53, else in
64-bit integers; a table whose scores could pass 64 bits is refused by an error.

Rows with a null vec_id, label, vector or component, or one that is not finite, take no part; nor do vectors of another length than most (ties: the
shortest).  Ties go to the smaller vec_id.  Rows are told apart by row, not by vec_id: rows that repeat a vec_id can be each other's positives, and each of several anchors
with one vec_id gives its own rows.  A zero vector scores 0 with everything.  A negative positive score allows no negatives.  Empty tables give none; extra columns are ignored.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, discard, keep, shared_folder

#: Rows of a block, in expectation; length buckets; coordinates of an anchor that prune.
ROWS, BUCKETS, FOCUS = 2048, 32, 4
#: Bytes of the anchors of a round; anchors of one product; one of so many blocks gives the first floors; blocks of an Arrow batch.
ROUND_BYTES, STRIP, SHARE, BATCH_BLOCKS = 8 << 20, 1024, 16, 16
LOWEST = np.iinfo(np.int64).min
HIGHEST = np.iinfo(np.int64).max
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
FOUND = "anchor long, slot int, anchor_id long, positive_id long, positive_score long, vec_id long, score long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@contextlib.contextmanager
def block_batches(spark: SparkSession) -> Iterator[None]:
    """A row of the index is a whole block: few of them fill a batch."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(BATCH_BLOCKS))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


@dataclass
class Anchors:
    """Anchors that look for scores from floor to ceiling; one column of both for each slot (a positive; or one slot only)."""

    number: np.ndarray  # the row's number
    vec_id: np.ndarray
    label: np.ndarray
    v: np.ndarray
    floor: np.ndarray
    ceiling: np.ndarray
    positive: np.ndarray  # of each slot: vec_id and score
    positive_score: np.ndarray
    same_label: bool

    def __post_init__(self) -> None:
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(axis=1))
        unit = self.v / np.maximum(self.length, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :FOCUS]
        self.at_focus = np.take_along_axis(unit, self.focus, axis=1)


class Block:
    """Rows of one length bucket with their sorted coordinate lists."""

    def __init__(self, r: dict, d: int) -> None:
        self.number, self.vec_id, self.label = (np.frombuffer(r[c], np.int64) for c in ("number", "vec_id", "label"))
        self.v = np.frombuffer(r["v"], np.int64 if r["wide"] else np.int32).reshape(-1, d)
        self.order = np.frombuffer(r["sorted"], np.int32).reshape(d, -1)
        self.longest = r["longest"]
        self.unit = unit(self.v)
        self.lists = np.take_along_axis(self.unit.T, self.order, axis=1)


def unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    return x / np.maximum(np.sqrt((x**2).sum(axis=1)), 1e-300)[:, None]


def ranges(q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What values a unit vector's coordinate can have if its cosine with a unit vector that has ``q`` there is ``t`` (above 0) or more."""
    w = np.sqrt(np.maximum((1 - q**2) * (1 - t**2), 0))
    return np.where(-q >= t, -1, q * t - w) - 1e-9, np.where(q >= t, 1, q * t + w) + 1e-9


def products(a: np.ndarray, b: np.ndarray, exact_floats: bool) -> np.ndarray:
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if exact_floats else a.astype(np.int64) @ b.T.astype(np.int64)


def meet(block: Block, a: Anchors, floor: np.ndarray, lo: int, hi: int, exact_floats: bool) -> list[np.ndarray]:
    """anchor (place), slot, place in the block, score: all pairs of the anchors lo to hi with the block that count."""
    least = floor[lo:hi].min(axis=1, initial=HIGHEST).astype(np.float64)
    reach = a.length[lo:hi] * block.longest
    live = least <= reach * (1 + 1e-9)
    at = np.flatnonzero(live)
    whole, out = at[least[at] <= 0], []
    if len(at := at[least[at] > 0]):
        t = np.minimum(least[at] / reach[at], 1)
        low, high = ranges(a.at_focus[lo:hi][at], t[:, None])
        focus = a.focus[lo:hi][at]
        first, last = np.zeros(focus.shape, np.int64), np.zeros(focus.shape, np.int64)
        for f in np.unique(focus):
            own = focus == f
            first[own], last[own] = np.searchsorted(block.lists[f], low[own], "left"), np.searchsorted(block.lists[f], high[own], "right")
        narrow = (last - first).argmin(axis=1)
        width = (last - first)[np.arange(len(at)), narrow]
        whole = np.concatenate([whole, at[2 * width >= len(block.v)]])
        for i in np.flatnonzero((width > 0) & (2 * width < len(block.v))):
            some = block.order[focus[i, narrow[i]], first[i, narrow[i]] : last[i, narrow[i]]]
            for j in range(focus.shape[1]):
                if j != narrow[i] and len(some):
                    x = block.unit[some, focus[i, j]]
                    some = some[(x >= low[i, j]) & (x <= high[i, j])]
            if len(some):
                out.append(counting(block, a, floor, np.array([lo + at[i]]), some, products(a.v[lo + at[i]][None], block.v[some], exact_floats)))
    if len(whole):
        out.append(counting(block, a, floor, lo + whole, np.arange(len(block.v)), products(a.v[lo + whole], block.v, exact_floats)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def counting(block: Block, a: Anchors, floor: np.ndarray, who: np.ndarray, rows: np.ndarray, scores: np.ndarray) -> list[np.ndarray]:
    fits = block.label[rows][None] == a.label[who][:, None]
    fits = fits & (block.number[rows][None] != a.number[who][:, None]) if a.same_label else ~fits
    found = []
    for slot in range(floor.shape[1]):
        i, j = np.nonzero(fits & (scores >= floor[who, slot][:, None]) & (scores <= a.ceiling[who, slot][:, None]))
        found.append((who[i], np.full(len(i), slot), rows[j], scores[i, j]))
    return [np.concatenate(c) for c in zip(*found)]


def best(columns: list[np.ndarray], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The best k rows of each key, and which of them are the k-th.  columns: key, vec_id, score."""
    order = np.lexsort((columns[1], -columns[2], columns[0]))
    columns = [c[order] for c in columns]
    start = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1])) if len(order) else np.zeros(0, np.int64)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return [c[rank < k] for c in columns], (rank == k - 1)[rank < k]


class Index:
    def __init__(self, rows: DataFrame, d: int, n: int, peak: int, folder: str) -> None:
        self.d, self.exact_floats, wide = d, d * peak * peak < 1 << 53, peak >= 1 << 31
        cuts = rows.agg(F.percentile_approx("length", [i / BUCKETS for i in range(1, BUCKETS)], 1000)).first()[0]
        bucket = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("length")))
        dealt = rows.withColumn("bucket", bucket)
        parts = {r["bucket"]: -(-r["n"] // ROWS) for r in dealt.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # BUCKETS at most
        part = F.pmod(F.xxhash64("number"), F.create_map(*[F.lit(x) for b in sorted(parts) for x in (b, parts[b])])[F.col("bucket")]).cast("int")

        def pack(table: pa.Table) -> pa.Table:
            v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            order = np.argsort(unit(v), axis=0, kind="stable").T.astype(np.int32)
            columns = {c: [table.column(c).to_numpy().astype(np.int64).tobytes()] for c in ("number", "vec_id", "label")}
            columns |= {"v": [v.astype(np.int64 if wide else np.int32).tobytes()], "sorted": [np.ascontiguousarray(order).tobytes()]}
            return pa.table(columns | {"wide": [wide], "longest": [float(table.column("length").to_numpy().max())]})

        packed = dealt.withColumn("part", part).groupBy("bucket", "part").applyInArrow(pack, "number binary, vec_id binary, label binary, v binary, sorted binary, wide boolean, longest double")
        self.blocks = keep(packed.withColumn("share", F.pmod(F.xxhash64("number"), F.lit(SHARE)).cast("int")), folder, "index")

    def search(self, a: Anchors, k: int, first: bool = False) -> DataFrame:
        """FOUND and rank: the best k of each anchor and slot; first: of one of SHARE blocks."""
        d, exact_floats, slots = self.d, self.exact_floats, a.floor.shape[1]
        sent = self.blocks.sparkSession.sparkContext.broadcast(a)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = sent.value
            floor, held = a.floor.copy(), [np.zeros(0, np.int64)] * 3
            for batch in batches:
                for r in sorted(batch.to_pylist(), key=lambda r: -r["longest"]):
                    block, new = Block(r, d), [held]
                    for lo in range(0, len(a.v), STRIP):
                        who, slot, place, score = meet(block, a, floor, lo, min(lo + STRIP, len(a.v)), exact_floats)
                        new.append([who * slots + slot, block.vec_id[place], score])
                    held, last = best([np.concatenate(c) for c in zip(*new)], k)
                    full = held[0][last]
                    floor[full // slots, full % slots] = np.maximum(floor[full // slots, full % slots], held[2][last])
            who, slot = held[0] // slots, held[0] % slots
            columns = [a.number[who], slot.astype(np.int32), a.vec_id[who], a.positive[who, slot], a.positive_score[who, slot], held[1], held[2]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[c.split()[0] for c in FOUND.split(", ")])

        blocks = self.blocks.filter("share = 0") if first else self.blocks
        rank = F.row_number().over(W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
        return arrow_map(blocks.drop("share"), run, FOUND).withColumn("rank", rank).filter(F.col("rank") <= k)

    def with_floors(self, a: Anchors, k: int) -> Anchors:
        """The anchors with the floors that one of SHARE blocks gives."""
        at = {n: i for i, n in enumerate(a.number.tolist())}
        floor = a.floor.copy()
        for r in self.search(a, k, first=True).filter(F.col("rank") == k).collect():  # a row of an anchor and slot
            floor[at[r["anchor"]], r["slot"]] = max(r["score"], floor[at[r["anchor"]], r["slot"]])
        return replace(a, floor=floor)


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * 256))


def usable(vectors: DataFrame, label: Column) -> DataFrame:
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole_numbers(F.col("embedding")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.withColumns({"length": length, "number": F.monotonically_increasing_id()})


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, k: int = 10, shares: tuple[int, int] = (30, 90), round_bytes: int = ROUND_BYTES) -> DataFrame:
    """RESULT: for each anchor and each of its positives the first k negatives with a score between the ``shares`` (per cent) of the positive's.

    vectors: vec_id, embedding, label; is_anchor: of vec_id; label: what stands for the label.
    """
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    rows = keep(usable(vectors, F.col("label") if label is None else label), folder, "rows")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda m, x: F.greatest(m, x, -1 - x))).alias("peak")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], RESULT)
    d, n, peak = sizes[0]["d"], sizes[0]["n"], sizes[0]["peak"] + 1
    if d * peak * peak >= 1 << 63:
        raise ValueError("inner products of these vectors could pass 64 bits")
    rows = rows.filter(F.size("v") == d)
    index = Index(rows, d, n, peak, folder)
    asked = keep(rows.filter(is_anchor).select("number", "vec_id", "label", "v"), folder, "anchors")
    rounds = max(1, -(-asked.count() * (8 * d + 256) // round_bytes))
    paths = []
    with block_batches(spark):
        for i in range(rounds):
            # a round is of bounded size, whatever the table's
            some = asked.filter(F.pmod(F.xxhash64(F.lit(7), "number"), F.lit(rounds)) == i).collect()
            if some:
                keep(negatives(index, some, d, positives, k, shares), folder, f"found{i}")
                paths.append(f"{folder}/found{i}")
    discard(spark, folder, "rows", "index", "anchors")
    return spark.read.schema(RESULT).parquet(*paths) if paths else spark.createDataFrame([], RESULT)


def negatives(index: Index, some: list, d: int, positives: int, k: int, shares: tuple[int, int]) -> DataFrame:
    """RESULT of a round of anchors."""
    column = lambda c: np.array([r[c] for r in some], np.int64)
    fill = lambda value, slots: np.full((len(some), slots), value, np.int64)
    v = np.array([r["v"] for r in some], np.int64).reshape(-1, d)
    a = Anchors(column("number"), column("vec_id"), column("label"), v, fill(LOWEST, 1), fill(HIGHEST, 1), fill(0, 1), fill(0, 1), True)
    near = index.search(index.with_floors(a, positives), positives).collect()  # so many rows of each anchor of the round
    at = {n: i for i, n in enumerate(a.number.tolist())}
    floor, ceiling, ids, scores = fill(HIGHEST, positives), fill(LOWEST, positives), fill(0, positives), fill(0, positives)
    for r in near:
        place, s = (at[r["anchor"]], r["rank"] - 1), r["score"]
        ids[place], scores[place] = r["vec_id"], s
        if s >= 0:
            floor[place], ceiling[place] = -(-shares[0] * s // 100), shares[1] * s // 100
    b = Anchors(a.number, a.vec_id, a.label, v, floor, ceiling, ids, scores, False)
    out = index.search(index.with_floors(b, k), k)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % 100 == 0, label)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""
