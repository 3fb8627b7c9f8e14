"""Near-duplicate join: word shingles, a MinHash LSH forest, exact verification.

1. A text's words are its lower-cased runs of letters, digits and underscores; its shingles are the runs of WORDS
   words (a shorter text is one shingle).  Texts with equal shingle sets form a class, which has a number of its own; only
   classes go on, so copies are never paired.
2. The forest: TREES prefix tries over signatures of DEPTH MinHash values each.  A trie node is the run of signatures
   that share a prefix.  Matching starts at whole signatures; the classes that meet are verified, and the links found tell
   how many are still missing: a link of similarity s meets with the chance ``chance(s, depth)`` in some tree, so it stands for
   1 / chance links.  If less than TARGET of all links are expected to be found, the matched prefix is shortened, at once to the
   longest at which TARGET is expected, and only pairs that did not meet before are verified.  It ends when TARGET is
   reached, or at the prefix that gives TARGET even if every link were just at the threshold.  One link at the
   threshold is always assumed, so a few very similar links prove nothing.
3. Verification: nodes that share classes form candidate components.  A component is dealt into blocks, by its classes and their shingles, and each pair of blocks
   meets in one task; where that would carry more classes than its nodes would one by one (components that are chains),
   each node is dealt instead, and a pair counts in the first tree in which it meets.  Small components share a task.  Only pairs
   that share a node are compared, on their full shingle sets.  A task returns each class's number of links, a spanning forest of
   them and their similarities' histogram, never the pairs.
4. Components of the verified links are the groups.

Result: one row per document: doc_id, class_id (the smallest doc_id of its shingle set), group_id (the smallest doc_id of its
group), n_links (other classes with Jaccard similarity of at least THRESHOLD), class_size.  Null, empty and
wordless texts have no shingles: each is a class of its own without links.  Classes go by their texts, so rows that repeat a doc_id with other
texts, or have none, keep their own links.  Whole texts are read; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, discard, free_name, keep, located, locator, probably_in, shared_folder

WORDS, THRESHOLD, TARGET = 5, 0.8, 0.9995
TREES, DEPTH = 16, 8
#: Classes of a block, and their shingles (of 8 bytes each), in expectation; two blocks meet in a task.
BLOCK, WEIGHT = 512, 1 << 20
#: Distinct words whose hashes a task keeps.
TABLE = 200_000
WORD = re.compile(r"\w+")


def chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that a pair shares a prefix of ``depth`` values in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def depth_for(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES, deepest: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the target chance (1 at least)."""
    depth = deepest
    while depth > 1 and chance(threshold, depth, trees) < target:
        depth -= 1
    return depth


def next_depth(links: dict[float, int], depth: int, threshold: float = THRESHOLD, target: float = TARGET) -> int:
    """The longest prefix, ``depth`` at most, at which ``target`` of all links is expected; links: how many were found of each similarity."""
    weight = {s: n / chance(s, depth) for s, n in links.items()}
    weight[threshold] = weight.get(threshold, 0) + 1
    total, last = sum(weight.values()), depth_for(threshold, target)
    for d in range(depth, last, -1):
        if sum(w * chance(s, d) for s, w in weight.items()) >= target * total:
            return d
    return min(depth, last)


class Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < TABLE:
            self[word] = h
        return h


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, known: Hashes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(n, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
    return np.unique(out)


_RNG = np.random.default_rng(11)
_A = _RNG.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)
#: Shingles hashed at once.
STRETCH = 512


def signature(s: np.ndarray) -> bytes:
    """TREES x DEPTH MinHash values, of 32 bits each."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), STRETCH):
        h = _A[:, None] * s[None, at : at + STRETCH]
        h += _B[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low.astype("<u4").tobytes()


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, at, digest of the shingle set, its signature (null: no shingles) and its size."""
    schema = "doc_id long, at struct<file: string, row: long>, digest binary, signature binary, size int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            digests, signatures, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                s = shingles(text, known)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(signature(s) if len(s) else None)
                sizes.append(len(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int32())], names=["doc_id", "at", "digest", "signature", "size"])

    return arrow_map(docs.select("doc_id", "at", "text"), run, schema)


def node_keys(depth: int) -> Column:
    """A key for each tree's node at this depth."""
    return F.array(*[F.xxhash64(F.lit(t), F.substring("signature", 4 * DEPTH * t + 1, 4 * depth)) for t in range(TREES)])


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """id, root (the smallest id reachable) for every id in ``edges`` (a, b); each round is a table in ``folder``.

    Alternating stars: every vertex's larger neighbours, then its smaller ones, are linked to its smallest
    neighbour, until only stars are left.
    """
    edges = keep(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}0")
    step = 0
    while not stars(edges):
        step += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), folder, f"{name}m{step}")  # apart from the join, so that a crowded vertex can be split there
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        large = keep(large, folder, f"{name}l{step}")
        low2 = keep(large.groupBy("a").agg(F.min("b").alias("m")), folder, f"{name}n{step}")
        small = large.join(low2, "a")
        small = small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low2.select("a", F.col("m").alias("b"))).distinct()
        edges = keep(small, folder, f"{name}s{step}")
        discard(edges.sparkSession, folder, f"{name}l{step}", f"{name}m{step}", f"{name}n{step}", f"{name}s{step - 1}" if step > 1 else f"{name}0")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())


def stars(edges: DataFrame) -> bool:
    """Whether every vertex has one smaller neighbour and that has none."""
    if not edges.groupBy("a").count().filter("count > 1").isEmpty():
        return False
    return edges.select("b").distinct().join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def in_sorted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return b[at] == a


class Side:
    """A block's classes: their shingle sets and their node keys, now and at the prefix matched before."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        self.now, self.old = (np.stack(rows[c].to_numpy()).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0), np.int64) for c in ("nodes", "before"))
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(rows))


def similar(left: Side, right: Side, threshold: float, same: bool, node: int | None = None) -> Iterator[tuple[int, int, float]]:
    """(i, j, similarity) of pairs that meet now, did not before, and are similar enough; ``same``: both sides are one block; ``node``: only those whose first common node it is."""
    for i, a in enumerate(left.sets):
        n = len(a)
        equal = right.now == left.now[i]
        meets = equal.any(axis=1) & (np.minimum(right.sizes, n) >= threshold * np.maximum(right.sizes, n) - 1e-9)
        if same:
            meets[: i + 1] = False
        at = np.flatnonzero(meets)
        if len(at) and right.old.shape[1]:
            at = at[~(right.old[at] == left.old[i]).any(axis=1)]
        if len(at) and node is not None:
            at = at[left.now[i][equal[at].argmax(axis=1)] == node]
        for j in at.tolist():
            b = right.sets[j]
            both = int(np.count_nonzero(in_sorted(a, b)))  # sorted distinct hashes: those of the smaller set that stand in the larger
            if both >= threshold * (n + len(b) - both) - 1e-9:
                yield i, j, both / (n + len(b) - both)


LINK, COUNT, SHAPE = 0, 1, 2


def verify(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """kind, a, b, n: LINK (a spanning forest of the links), COUNT (links of class a), SHAPE (links of similarity a / 100, rounded down)."""
    rows = rows.sort_values(["block", "id"], kind="stable")
    x, y = int(rows["x"].iloc[0]), int(rows["y"].iloc[0])
    node = int(rows["grp"].iloc[0]) if rows["way"].iloc[0] == NODE else None
    ids, block = rows["id"].to_numpy(), rows["block"].to_numpy()
    p, q = np.flatnonzero(block == x), np.flatnonzero(block == y)
    links, shape, forest = np.zeros(len(ids), np.int64), np.zeros(101, np.int64), []
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left = Side(rows.iloc[p])
    for i, j, s in similar(left, left if x == y else Side(rows.iloc[q]), threshold, x == y, node) if len(p) and len(q) else ():  # a block may be empty
        i, j = int(p[i]), int(q[j])
        links[i] += 1
        links[j] += 1
        shape[int(100 * s + 1e-9)] += 1
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((LINK, int(ids[i]), int(ids[j]), 0))
    out = [(COUNT, int(ids[i]), -1, int(links[i])) for i in np.flatnonzero(links)] + [(SHAPE, int(s), -1, int(shape[s])) for s in np.flatnonzero(shape)] + forest
    return pd.DataFrame({k: pd.Series([r[c] for r in out], dtype="int64") for c, k in enumerate(("kind", "a", "b", "n"))})


WHOLE, NODE, SMALL = 0, 1, 2


def blocks(n: Column, weight: Column) -> Column:
    """Blocks for ``n`` classes of ``weight`` shingles."""
    return F.ceil(F.greatest(n / BLOCK, weight / WEIGHT)).cast("int")


def deal(classes: DataFrame, depth: int, before: int | None, folder: str) -> DataFrame:
    """id, way, grp, blocks, block: where each class meets others for which the prefixes of ``depth`` values agree."""
    keys = F.transform(node_keys(depth), lambda k: F.struct(k.alias("node"), F.lit(0).cast("long").alias("child")))
    if before:
        keys = F.zip_with(node_keys(depth), node_keys(before), lambda k, c: F.struct(k.alias("node"), c.alias("child")))
    members = classes.select("id", "size", F.explode(keys).alias("k")).select("id", "size", "k.*")
    branch = F.lit(True) if before is None else F.col("c0") != F.col("c1")  # else all pairs met before
    shared = members.groupBy("node").agg(F.min("id").alias("low"), F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("child").alias("c0"), F.max("child").alias("c1"))
    shared = shared.filter((F.col("n") > 1) & branch).select("node", "low", blocks(F.col("n"), F.col("weight")).alias("blocks"))
    meets = keep(members.select("id", "node").join(shared, "node"), folder, f"meets{depth}")
    places = keep(components(meets.select(F.col("id").alias("a"), F.col("low").alias("b")), folder, f"candidates{depth}"), folder, f"places{depth}")
    cost = meets.join(places, "id").groupBy("root").agg(F.sum("blocks").alias("by_node"))
    weighed = places.join(classes.select("id", "size"), "id").groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("weight"))
    sizes = weighed.withColumn("parts", blocks(F.col("m"), F.col("weight"))).join(cost, "root")
    way = F.when((F.col("m") <= BLOCK // 4) & (F.col("weight") <= WEIGHT // 4), SMALL).when(F.col("m") * F.col("parts") <= F.col("by_node"), WHOLE).otherwise(NODE)
    sizes = keep(sizes.select("root", "m", "weight", "parts", way.alias("way")), folder, f"sizes{depth}")
    bundles = sizes.filter(F.col("way") == SMALL).agg(blocks(F.sum("m"), F.sum("weight"))).first()[0] or 1
    of = places.join(sizes, "root")
    small = F.col("way") == SMALL
    whole = of.filter(F.col("way") != NODE).select("id", "way", F.when(small, F.pmod(F.xxhash64("root"), F.lit(bundles))).otherwise(F.col("root")).alias("grp"), F.when(small, 1).otherwise(F.col("parts")).alias("blocks"))
    chain = meets.join(of.filter(F.col("way") == NODE).select("id", "way"), "id").select("id", "way", F.col("node").alias("grp"), "blocks")
    return whole.unionByName(chain).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))


def links_at(docs: DataFrame, classes: DataFrame, depth: int, before: int | None, threshold: float, folder: str) -> DataFrame:
    """The links (see verify) of classes that meet at ``depth`` and did not at ``before``."""
    dealt = keep(deal(classes, depth, before, folder), folder, f"dealt{depth}")
    some = keep(dealt.select("id").distinct().join(classes, "id"), folder, f"some{depth}")  # their representatives
    old = node_keys(before) if before else F.array().cast("array<long>")
    some = some.select("id", "at", node_keys(depth).alias("nodes"), old.alias("before"))
    texts = docs.select("at", "text").filter(probably_in(F.xxhash64("at"), some.select(F.xxhash64("at").alias("k")).distinct(), folder, f"bloom{depth}"))
    whole = some.join(texts, "at").select("id", "nodes", "before", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Hashes()
        for batch in batches:
            s = [shingles(t, known).tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(s, pa.binary())], names=["id", "nodes", "before", "shingles"])

    whole = keep(arrow_map(whole, sets, "id long, nodes array<long>, before array<long>, shingles binary"), folder, f"sets{depth}")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = dealt.select("*", other).select("id", "way", "grp", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).join(whole, "id")

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        return verify(rows, threshold)

    links = paired.groupBy("way", "grp", "x", "y").applyInPandas(meet, "kind long, a long, b long, n long")
    links = keep(links, folder, f"links{depth}")
    discard(docs.sparkSession, folder, *[f"{name}{depth}" for name in ("meets", "places", "sizes", "dealt", "some", "bloom", "sets")])
    return links


def find(docs: DataFrame, folder: str, threshold: float, target: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, at, digest of every row; digest, id, class_id, class_size, root, n_links of every class)."""
    docs = located(docs, folder).select(F.col("doc_id").cast("long").alias("doc_id"), locator().alias("at"), "text")
    described = keep(describe(docs), folder, "described")
    first = F.min(F.struct("doc_id", "at", "signature", "size")).alias("first")  # equal shingle sets have equal signatures and sizes
    classes = described.filter("digest IS NOT NULL").groupBy("digest").agg(first, F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    classes = keep(classes.select("digest", "class_id", "class_size", "first.at", "first.signature", "first.size", F.monotonically_increasing_id().alias("id")), folder, "classes")
    depth, before, links, shape = DEPTH, None, None, {}
    while True:
        new = links_at(docs, classes.select("id", "at", "signature", "size"), depth, before, threshold, folder)
        links = new if links is None else links.unionByName(new)
        for r in new.filter(F.col("kind") == SHAPE).groupBy("a").agg(F.sum("n").alias("n")).collect():  # 101 rows at most
            s = max(threshold, r["a"] / 100)
            shape[s] = shape.get(s, 0) + r["n"]
        further = next_depth(shape, depth, threshold, target)
        if further == depth:
            break
        depth, before = further, depth
    groups = components(links.filter(F.col("kind") == LINK).select("a", "b"), folder, "groups")
    counts = links.filter(F.col("kind") == COUNT).groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    table = classes.drop("at", "signature", "size").join(groups, "id", "left").join(counts, "id", "left")
    return described.select("doc_id", "at", "digest"), table


def join(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, group_id, n_links, class_size of each document."""
    rows, table = find(docs, shared_folder(docs.sparkSession), threshold, target)
    smallest = table.filter("root IS NOT NULL").groupBy("root").agg(F.min("class_id").alias("group_id"))
    out = rows.select("doc_id", "digest").join(table.join(smallest, "root", "left"), "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select(
        "doc_id", own.alias("class_id"), F.when(F.col("root").isNull(), own).otherwise(F.col("group_id")).alias("group_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )


def survivors(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the one with the smallest doc_id (null first; then by file and row)."""
    folder = shared_folder(docs.sparkSession)
    docs = located(docs, folder)
    rows, table = find(docs, folder, threshold, target)
    grouped = rows.join(table.select("digest", F.coalesce("root", "id").alias("root")), "digest")
    first = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", "first.at")
    mark = free_name(docs, "_at")
    gone = grouped.join(first.select("root"), "root", "left_semi").select("at").join(first.select("at"), "at", "left_anti")
    return docs.withColumn(mark, locator()).join(gone.select(F.col("at").alias(mark)), mark, "left_anti").drop(mark)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
