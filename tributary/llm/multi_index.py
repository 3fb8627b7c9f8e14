"""Approximate nearest neighbours by an inverted multi-index.

Both halves of a vector are quantised separately (k-means on a bounded hash sample, with centroids in proportion to the root of the
number of vectors); a vector's cell is its pair of centroids, and every usable vector is indexed.  A query walks the centroid pairs in
the order of the summed inner products of its halves with the centroids, by a heap, until the cells it has met hold ``need`` vectors.

``need`` is learned, not set: PROBES vectors, chosen by hash, are compared with all vectors; their walks tell how many vectors
must be met before each true neighbour's cell comes, and ``need`` is the number that is enough for the share RECALL of all true
neighbours.  So vectors in clusters need few cells, vectors without any structure need many, and the share falls as the
table grows (the nearest stand out more, and cells get finer).

Queries and index meet by groups of cells that share a few first-half centroids: a group is dealt in blocks, both of its vectors and of the
queries that visit it.  Each pair of blocks is a matrix product in single precision, masked to the cells that each query visits; entries that
could be among the best k, given that product's rounding error, are reranked in double precision on the original vectors.

Nearness is the largest inner product; ties go to the smaller vec_id.  Vectors that are null, zero, of another length than most,
or hold null or non-finite components take no part, neither as query nor as candidate.  A query's own row is left out by vec_id, so
rows that repeat a vec_id never find each other, and each of several queries with one vec_id is searched.  With fewer than k candidates all are returned (a walk
only ends when its cells hold enough).  Extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, keep, shared_folder

#: Vectors that the centroids are fitted on, at most (in expectation); vectors of a cell, on average; centroids per half, at most.
SAMPLE, PER_CELL, CENTROIDS = 8000, 8, 1024
#: Vectors, in expectation, whose true neighbours tell how far to walk, and the share of these that must be met.
PROBES, RECALL = 200, 0.94
#: First-half centroids whose cells form a group, in which queries and vectors meet.
TOGETHER = 4
#: Vectors, and queries, of a group that meet in one task, and queries of one product.
ROWS, QUERIES, STRIP = 16384, 8192, 256


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of the rows of x; the start and every step are the same for the same rows."""
    if not len(x):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 0))
    rng = np.random.default_rng(0)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, centroids)
        order = np.argsort(near, kind="stable")
        own, first = np.unique(near[order], return_index=True)
        centroids[own] = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centroids


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1)[None, :] - 2 * x @ centroids.T).argmin(axis=1)


def walk(first: np.ndarray, second: np.ndarray, held: dict[int, int], need: int) -> Iterator[int]:
    """Cells by falling first[i] + second[j], until they hold ``need`` vectors; a cell's number is i * len(second) + j, empty cells are passed by."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    x, y, width = (-first[a]).tolist(), (-second[b]).tolist(), len(b)
    heap, found = [(x[0] + y[0], 0, 0)], 0
    while heap and found < need:
        _, i, j = heapq.heappop(heap)
        if n := held.get(a[i] * width + b[j]):
            found += n
            yield a[i] * width + b[j]
        if j + 1 < width:
            heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):  # a row starts after the one before it
            heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def stacked(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of ``b`` with ``a``, in double precision, summed in one order whatever the shapes (so that ties stay ties)."""
    out = np.zeros(len(b))
    for i in range(len(a)):
        out += a[i] * b[:, i]
    return out


def rerank(query: np.ndarray, rough: np.ndarray, places: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best by exact score; ``rough``: scores of ``places`` that are off by ``slack`` at most."""
    if len(places) > k:
        edge = np.partition(rough, len(rough) - k)[len(rough) - k]
        places = places[rough >= edge - 2 * slack]
    exact = inner(query, vectors[places])
    order = np.lexsort((ids[places], -exact))[:k]
    return places[order], exact[order]


def best_of(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, met=None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:  # noqa: ANN001
    """(number of the query, places, scores): the k best of ``vectors`` for each query but its own; met(lo, hi): which vectors each of these queries meets."""
    scale = max(1e-300, float(np.abs(vectors).max(initial=0)))  # single precision holds the scaled values
    small, norms = (vectors / scale).astype(np.float32), np.sqrt(((vectors / scale) ** 2).sum(axis=1)).max(initial=0)
    for lo in range(0, len(queries), STRIP):
        strip = queries[lo : lo + STRIP]
        sizes = np.maximum(np.sqrt((strip**2).sum(axis=1)), 1e-300)
        rough = (strip / sizes[:, None]).astype(np.float32) @ small.T
        slack = 4 * (vectors.shape[1] + 2) * float(np.finfo(np.float32).eps) * norms
        live = ids[None, :] != query_ids[lo : lo + STRIP, None]
        if met is not None:
            live &= met(lo, lo + len(strip))
        for r in range(len(strip)):
            places = np.flatnonzero(live[r])
            if len(places):
                yield lo + r, *rerank(strip[r], rough[r, places], places, vectors, ids, k, slack)


def first_of_each(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The k best rows of each query; columns: query, score, vec_id and others."""
    order = np.lexsort((columns[2], -columns[1], columns[0]))
    columns = [c[order] for c in columns]
    first = np.flatnonzero(np.append(True, columns[0][1:] != columns[0][:-1]))
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return [c[rank < k] for c in columns]


def frame(found: list[tuple[int, np.ndarray, np.ndarray]], query_ids: np.ndarray, numbers: np.ndarray, ids: np.ndarray) -> dict[str, np.ndarray]:
    """Columns query, query_id, vec_id, score."""
    n = [len(p) for _, p, _ in found]
    q = np.repeat(np.fromiter((q for q, _, _ in found), np.int64, len(found)), n)
    places, scores = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, t) for c, t in ((1, np.int64), (2, np.float64)))
    return {"query": numbers[q], "query_id": query_ids[q], "vec_id": ids[places], "score": scores}


MET = "query long, query_id long, vec_id long, score double"


class Index:
    """The vectors by cell: a table in the shared folder (vec_id, v, cell) and two bounded codebooks."""

    def __init__(self, rows: DataFrame, d: int, n: int, folder: str, centroids: int | None = None) -> None:
        self.rows, self.d, self.n, self.half = rows, d, n, d // 2
        k = centroids or max(1, min(CENTROIDS, math.isqrt(n // PER_CELL)))
        dice = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
        sample = np.array([r["v"] for r in rows.filter(dice < min(1.0, SAMPLE / n)).select("v").toLocalIterator()]).reshape(-1, d)
        one, two = k_means(sample[:, : self.half], k), k_means(sample[:, self.half :], k)
        books = self.books = rows.sparkSession.sparkContext.broadcast((one, two))
        self.width, half = len(two), self.half

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two = books.value
            for batch in batches:
                v = stacked(batch.column(1))
                cell = nearest(v[:, :half], one) * len(two) + nearest(v[:, half:], two) if len(v) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["vec_id", "v", "cell"])

        self.table = keep(arrow_map(rows, place, "vec_id long, v array<double>, cell int"), folder, "index")
        self.held = {r["cell"]: r["n"] for r in self.table.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # centroids squared at most

    def need(self, k: int, probes: int, recall: float, folder: str) -> int:
        """Vectors that a walk must meet for ``recall`` of the true k nearest, as ``probes`` vectors tell."""
        dice = F.pmod(F.xxhash64("vec_id", F.lit(4)), F.lit(1 << 20)) / float(1 << 20)
        chosen = self.rows.filter(dice < min(1.0, probes / self.n)).select("vec_id", "v").limit(2 * probes).collect()
        if not chosen:
            return self.n
        ids, vectors = np.array([r["vec_id"] for r in chosen], np.int64), np.array([r["v"] for r in chosen]).reshape(-1, self.d)
        asked = self.rows.sparkSession.sparkContext.broadcast((ids, vectors))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, q = asked.value
            best, names = None, ("query", "score", "vec_id", "cell")
            for batch in batches:
                own, cell = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
                for number, places, scores in best_of(q, qids, stacked(batch.column(1)), own, k) if len(own) else ():
                    new = np.full(len(places), number), scores, own[places], cell[places]
                    best = [[c] for c in new] if best is None else [[*old, c] for old, c in zip(best, new)]
                if best is not None:
                    best = [[c] for c in first_of_each([np.concatenate(c) for c in best], k)]
            if best is not None:
                yield pa.RecordBatch.from_pydict({name: pa.array(c[0]) for name, c in zip(names, best)}, pa.schema([("query", pa.int64()), ("score", pa.float64()), ("vec_id", pa.int64()), ("cell", pa.int32())]))

        near = arrow_map(self.table, compare, "query long, score double, vec_id long, cell int")
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "cell"))), 1, k)
        part = near.groupBy("query", F.pmod(F.spark_partition_id(), F.lit(64)).alias("p")).agg(best.alias("b")).groupBy("query").agg(F.flatten(F.collect_list("b")).alias("b"))
        one, two = self.books.value
        sizes = np.zeros(len(one) * len(two), np.int64)
        sizes[list(self.held)] = list(self.held.values())
        reached: list[int] = []
        for r in part.select("query", F.slice(F.array_sort("b"), 1, k).alias("b")).collect():  # k of each probe
            v = vectors[r["query"]]
            order = np.argsort(-((one @ v[: self.half])[:, None] + (two @ v[self.half :])[None, :]).ravel(), kind="stable")
            met = np.empty(len(order), np.int64)
            met[order] = np.cumsum(sizes[order])
            reached += met[[x["cell"] for x in r["b"]]].tolist()
        asked.unpersist()
        return int(np.quantile(reached, recall, method="higher")) if reached else self.n


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, probes: int = PROBES, centroids: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest.  vectors: vec_id, embedding."""
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = sizes[0]["d"], sizes[0]["n"]
    index = Index(rows.filter(F.size("v") == d), d, n, folder, centroids)
    need = max(k + 1, index.need(k, probes, recall, folder))
    books, half, held, width = index.books, index.half, index.held, TOGETHER * index.width
    in_group: dict[int, int] = {}
    for cell, m in held.items():
        in_group[cell // width] = in_group.get(cell // width, 0) + m
    blocks = F.create_map(*[F.lit(x) for g, m in sorted(in_group.items()) for x in (g, -(-m // ROWS))])
    queries = keep(index.rows.filter(is_query).select("vec_id", "v").withColumn("query", F.monotonically_increasing_id()), folder, "queries")
    parts = max(1, -(-queries.count() // QUERIES))
    theirs = index.table.withColumn("grp", F.floor(F.col("cell") / width).cast("int")).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), blocks[F.col("grp")]).cast("int"))
    theirs = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = books.value
        for batch in batches:
            v = stacked(batch.column(1))
            at, groups, cells = [], [], []
            for i in range(len(v)):
                met: dict[int, list[int]] = {}
                for cell in walk(one @ v[i, :half], two @ v[i, half:], held, need):
                    met.setdefault(cell // width, []).append(cell % width)
                for g, own in met.items():
                    at.append(i)
                    groups.append(g)
                    cells.append(own)
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(groups, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=["vec_id", "v", "query", "grp", "cells"])

    visits = arrow_map(queries, visit, "vec_id long, v array<double>, query long, grp int, cells array<int>")
    visits = visits.withColumn("part", F.pmod(F.xxhash64("query", F.lit(6)), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("grp")] - 1)))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({k: pd.Series([], dtype=t) for k, t in (("query", "int64"), ("query_id", "int64"), ("vec_id", "int64"), ("score", "float64"))})
        ids, qids, cell = right["vec_id"].to_numpy(), left["vec_id"].to_numpy(), right["cell"].to_numpy() % width
        visited = left["cells"].to_numpy()

        def met(lo: int, hi: int) -> np.ndarray:
            out = np.zeros((hi - lo, width), bool)
            for r, cells in enumerate(visited[lo:hi]):
                out[r, cells] = True
            return out[:, cell]

        found = list(best_of(np.stack(left["v"].to_numpy()), qids, np.stack(right["v"].to_numpy()), ids, k, met))
        return pd.DataFrame(frame(found, qids, left["query"].to_numpy(), ids))

    keys = ["grp", "block", "part"]
    met = visits.groupBy(keys).cogroup(theirs.groupBy(keys)).applyInPandas(meet, MET)
    best_k = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    top = met.groupBy("query", "query_id").agg(best_k.alias("top"))
    return top.select("query_id", F.posexplode("top").alias("i", "t")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.s")).alias("score"))


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)
