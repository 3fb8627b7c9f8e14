"""Exact deduplication by a stateful stream, in DataFrame functions only.

Arrivals (digest, identifier, content locator) flow through a keyed streaming aggregation whose state has no
expiry and lies on disk (RocksDB, with its snapshots in the shared folder; all stores of an executor share bounded memory).  The
state of a digest holds the number of rows, the identifier of the row that stays and that row's locator.  A digest that was hit
more than once is then checked on full bytes: the locators of its rows go into a Bloom filter, so that few other texts are
shuffled, and the smallest and the largest of its normalised texts, found by partial aggregation, must be the same.  Should a
digest cover different texts (no case is known for SHA-256, but a weaker digest is a parameter), its rows are grouped anew by the text itself.

Texts are equal when identical after lower-casing A-Z only; null counts as empty.  Of equal texts the row with
the largest identifier stays; rows that even share the identifier are told apart by the locator, so that one
row stays of each group.  Rows of a source without files are written to the shared folder first, so that a locator names the same
row in every scan.  Null identifiers sort first.  Empty tables give empty results; extra columns are
ignored.  Every group of copies is pre-aggregated by task before it is shuffled, and the join that brings
the groups back to the rows can be split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PLACE, discard, free_name, keep, located, locator, probably_in, shared_folder

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # no space set aside for each of many small stores
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",  # of an executor, for all its stores
}
ARRIVAL = f"doc_id long, digest string, at {PLACE}"


def normal(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def bodies(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    body = normal(F.col("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"), digest(body).alias("digest"), locator().alias("at"))


def stream_groups(spark: SparkSession, source: str, folder: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Run all arrivals in ``source`` through the keyed state; (digest, n, keep) of each digest at the end.

    Started again on the same folder, it goes on where it stopped: files that arrive later only add to the state.
    """
    old = {k: spark.conf.get(k, None) for k in ROCKSDB}
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        reader = spark.readStream.schema(ARRIVAL)
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger) if max_files_per_trigger else reader
        state = reader.parquet(source).groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"))
        query = (
            state.writeStream.outputMode("update")
            .foreachBatch(lambda df, batch: df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{folder}/updates/b{batch}"))
            .option("checkpointLocation", f"{folder}/stream")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    schema = f"digest string, n long, keep struct<doc_id: long, at: {PLACE}>, batch long"
    updates = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/updates")
    return updates.groupBy("digest").agg(F.max_by(F.struct("n", "keep"), "batch").alias("s")).select("digest", "s.*")


def dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256, max_files_per_trigger: int | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, at (its locator)."""
    folder = shared_folder(docs.sparkSession)
    return dedup_located(located(docs, folder), folder, digest, max_files_per_trigger)


def dedup_located(docs: DataFrame, folder: str, digest: Callable[[Column], Column] = sha256, max_files_per_trigger: int | None = None) -> DataFrame:
    spark = docs.sparkSession
    whole = bodies(docs, digest)
    rows = keep(whole.select("doc_id", "digest", "at"), folder, "arrivals")
    keep(rows.limit(0).select("digest", F.lit(0).cast("long").alias("n"), F.struct("doc_id", "at").alias("keep"), F.lit(-1).cast("long").alias("batch")), folder, "updates/none")
    groups = keep(stream_groups(spark, f"{folder}/arrivals", folder, max_files_per_trigger), folder, "groups")
    hits = keep(rows.join(groups.filter("n > 1").select("digest"), "digest").select("digest", "at", F.xxhash64("at").alias("k")), folder, "hits")
    some = whole.filter(probably_in(F.xxhash64("at"), hits.select("k").distinct(), folder, "bloom"))
    seen = some.join(hits.select("at"), "at", "left_semi").groupBy("digest").agg(F.min("body").alias("lo"), F.max("body").alias("hi"))
    torn = keep(seen.filter("lo != hi").select("digest"), folder, "torn")
    discard(spark, folder, "hits", "bloom")
    out = rows.join(groups, "digest")
    if not torn.isEmpty():
        bad = whole.join(torn, "digest", "left_semi")
        again = bad.groupBy("digest", "body").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "at")).alias("keep"))
        out = out.join(torn, "digest", "left_anti").unionByName(bad.join(again, ["digest", "body"]).drop("body"))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.struct("doc_id", "at").eqNullSafe(F.col("keep")).alias("kept"), "digest", "at")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    folder, place = shared_folder(docs.sparkSession), free_name(docs, "_at")
    docs = located(docs, folder)
    gone = dedup_located(docs, folder).filter("not kept").select(F.col("at").alias(place))
    return docs.withColumn(place, locator()).join(gone, place, "left_anti").drop(place)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP7_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""
