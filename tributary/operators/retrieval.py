"""Text retrieval at table scale: chunking, BM25, cosine, incremental embedding sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators.search_index import UNIT, impact, tokens, whole_text
from tributary.scratch import keep, shared_folder


def chunks(docs: DataFrame, budget: int = 300, paragraph: str = r"\n\s*\n") -> DataFrame:
    """doc_id, section, heading, part, text, n_words: sections at heading lines, as they stand if they are within the word budget, else packed by paragraphs up to it.

    Text before the first heading has an empty heading; sections without words give none.  ``label`` names a chunk's heading with its part.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"(?m)^(?=#{1,6}[^\S\n]+)")
    sections = docs.select("doc_id", F.posexplode(lines).alias("section", "body"))
    is_head = F.col("body").rlike(r"^#{1,6}[^\S\n]+")
    head = F.when(is_head, F.regexp_extract("body", r"^#{1,6}[^\S\n]+([^\n]*)", 1)).otherwise("")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    body = strip(F.when(is_head, F.regexp_replace("body", r"^#{1,6}[^\S\n]+[^\n]*\n?", "")).otherwise(F.col("body")))
    words = lambda p: F.size(F.filter(F.split(p, r"\s+"), lambda w: w != ""))
    sections = sections.select("doc_id", "section", F.trim(head).alias("heading"), body.alias("body")).filter("body != ''").withColumn("n", words(F.col("body")))
    paragraphs = F.filter(F.transform(F.split("body", paragraph), strip), lambda p: p != "")
    empty = F.array().cast("array<struct<text:string,n:int>>")

    def add(acc: Column, p: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        fits = (F.size(acc) > 0) & (last["n"] + words(p) <= budget)
        joined = F.struct(F.concat(last["text"], F.lit("\n\n"), p).alias("text"), (last["n"] + words(p)).cast("int").alias("n"))
        alone = F.struct(p.alias("text"), words(p).cast("int").alias("n"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(alone)))

    whole = F.array(F.struct(F.col("body").alias("text"), F.col("n").cast("int").alias("n")))
    packed = sections.withColumn("packed", F.when(F.col("n") <= budget, whole).otherwise(F.aggregate(paragraphs, empty, add)))
    return packed.select("doc_id", "section", "heading", F.posexplode("packed").alias("i", "c")).select("doc_id", "section", "heading", (F.col("i") + 1).alias("part"), "c.text", F.col("c.n").alias("n_words"))


def label(heading: Column, part: Column, parts: Column) -> Column:
    """What a chunk's heading is called: with its part, if there are several."""
    return F.when(parts > 1, F.concat(heading, F.lit(" (part "), part.cast("string"), F.lit(")"))).otherwise(heading)


def bm25(docs: DataFrame, query: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """doc_id, score, rank: top k of one question; a repeated query word counts again; only scores above 0.  docs: doc_id, text and maybe heading.

    Ranked by the score in units of 10^-12, ties to the smaller doc_id.  For many questions see search_index.
    """
    spark = docs.sparkSession
    asked = spark.range(1).select(F.explode(tokens(F.lit(query))).alias("w")).groupBy("w").agg(F.count("*").alias("qn"))
    base = docs.select("doc_id", tokens(whole_text(docs)).alias("ws"))
    stats = base.agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("avgdl"))
    wanted = F.array_distinct(tokens(F.lit(query)))
    hits = base.select("doc_id", F.size("ws").alias("dl"), F.explode(F.filter("ws", lambda w: F.array_contains(wanted, w))).alias("w")).groupBy("doc_id", "dl", "w").agg(F.count("*").alias("tf"))
    df = hits.groupBy("w").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df.join(asked, "w").crossJoin(stats)), "w")  # a row per query word
    part = F.col("qn") * impact(F.col("tf"), F.col("dl"), F.col("df"), F.col("n"), F.col("avgdl"), k1, b)
    out = scored.groupBy("doc_id").agg(F.sum(part).alias("units")).filter("units > 0")
    top = out.orderBy(F.desc("units"), "doc_id").limit(k)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("units"), "doc_id"))).select("doc_id", F.round(F.col("units") / UNIT, 4).alias("score"), "rank")


#: Bytes of the queries that are sent to all tasks at once, and rows of one product.
QUERY_BYTES, ROWS = 8 << 20, 4096
NEAR = "query long, query_id long, vec_id long, units long"


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of all vectors for each query; a zero norm gives 0, ties go to the smaller vec_id.

    vectors and queries: vec_id, embedding (null ones, and those of another length than most queries, take no part).  Queries come in rounds of bounded bytes, sent to all
    tasks; vectors are read where they lie and never shuffled: a task hands on its k best of each query.  Ranked by the cosine to 12 decimals.
    """
    spark, folder = vectors.sparkSession, shared_folder(vectors.sparkSession)
    usable = lambda df: df.filter("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = usable(queries)
    d = asked.agg(F.mode(F.size("v"))).scalar()
    asked = keep(asked.filter(F.size("v") == d).withColumn("query", F.monotonically_increasing_id()), folder, "queries")
    rows = usable(vectors).filter(F.size("v") == d)
    unit = lambda m: m / np.maximum(np.sqrt((m**2).sum(axis=1)), 1e-300)[:, None]
    one = asked.select(F.size("v")).first()
    rounds = max(1, -(-asked.count() * (8 * one[0] + 64) // query_bytes)) if one else 0
    rank = F.row_number().over(W.partitionBy("query", "query_id").orderBy(F.desc("units"), "vec_id"))
    paths = []
    for i in range(rounds):
        some = asked.filter(F.pmod(F.xxhash64("query"), F.lit(rounds)) == i).collect()  # of bounded size, whatever the table's
        if not some:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["query"] for r in some]), np.array([r["vec_id"] for r in some]), unit(np.array([r["v"] for r in some]))))

        def meet(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            number, query_id, q = sent.value
            best = np.zeros((3, 0), np.int64)  # place of the query, units, vec_id
            for frame in frames:
                for lo in range(0, len(frame), ROWS):
                    part = frame.iloc[lo : lo + ROWS]
                    units = np.rint(q @ unit(np.stack(part["v"].to_numpy())).T * UNIT).astype(np.int64)
                    least = np.partition(units, -k, axis=1)[:, -k] if units.shape[1] > k else np.full(len(q), np.iinfo(np.int64).min)
                    at, row = np.nonzero(units >= least[:, None])
                    best = np.concatenate([best, [at, units[at, row], part["vec_id"].to_numpy()[row]]], axis=1)
                    best = best[:, np.lexsort((best[2], -best[1], best[0]))]
                    start = np.flatnonzero(np.append(True, best[0][1:] != best[0][:-1]))
                    best = best[:, np.arange(best.shape[1]) - np.repeat(start, np.diff(np.append(start, best.shape[1]))) < k]
            yield pd.DataFrame({"query": number[best[0]], "query_id": query_id[best[0]], "vec_id": best[2], "units": best[1]})

        near = rows.mapInPandas(meet, NEAR).withColumn("rank", rank).filter(F.col("rank") <= k)
        keep(near, folder, f"near{i}")
        sent.unpersist()
        paths.append(f"{folder}/near{i}")
    near = spark.read.parquet(*paths) if paths else spark.createDataFrame([], NEAR + ", rank int")
    return near.select("query_id", "vec_id", F.round(F.col("units") / UNIT, 6).alias("score"), "rank")


def to_embed(chunked: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks whose content key is not in ``cache`` (key).  chunked: source, heading, text."""
    key = F.concat_ws("|", F.coalesce("source", F.lit("")), F.coalesce("heading", F.lit("")), F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16))
    return chunked.withColumn("key", key).join(cache.select("key"), "key", "left_anti")


def content_key(source: Column, heading: Column, text: Column) -> Column:
    """What a chunk is known by: where it stands and a digest of what it says."""
    return F.concat_ws("::", F.coalesce(source, F.lit("")), F.coalesce(heading, F.lit("")), F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16))


class EmbedCache:
    """The keys of chunks that have been embedded, in a table bucketed by key.

    New chunks are dealt to the table's buckets and meet them there: the cache, which only grows, is never shuffled.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64) -> None:
        self.spark, self.table, self.buckets = spark, table, buckets
        if not spark.catalog.tableExists(table):
            self.write(spark.createDataFrame([], "key string"))

    def write(self, keys: DataFrame) -> None:
        keys.select("key").write.mode("append").format("parquet").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(self.table)

    def missing(self, keyed: DataFrame) -> DataFrame:
        """The rows of ``keyed`` whose key is not in the cache."""
        return keyed.repartition(self.buckets, "key").join(self.spark.table(self.table).hint("merge"), "key", "left_anti")

    def add(self, keyed: DataFrame) -> None:
        """Take in the keys that are missing; the same rows again add nothing."""
        self.write(self.missing(keyed).select("key").distinct().repartition(self.buckets, "key"))
