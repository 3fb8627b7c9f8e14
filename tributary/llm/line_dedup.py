"""Line deduplication, in DataFrame functions only.

Every text is split at line feeds (null or empty: one empty line).  A line's key is the line without white space (blank, tab to
carriage return) at both ends and with A-Z lower-cased.  Lines are exploded with their positions and known by 128 bits of hash of
their keys from there on; keys shorter than ``least_chars`` code points never count.  A key found in ``least_docs`` documents or more
loses all its lines except those of the largest doc_id that holds it.  What remains is put together by position.

The exploded lines are a table of hashes, a few bytes a line.  Lines are counted by hash first, with partial sums, so that a line
that stands everywhere is a row a task; only hashes of many lines are then counted by distinct documents.  The positions that a row loses
(never more than its own lines) meet its text by a join on file and row; a Bloom filter passes the other texts by, so only texts that
lose a line are shuffled.  A hot line is one key of joins that adaptive execution can split.

Rows that share a doc_id count as one document and all keep the lines that this document keeps; each stays a row of its own.  A null doc_id is one
document, smaller than all others.  Empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_name, keep, located, locator, probably_in, shared_folder
from .exact_dedup import normal

#: White space that is stripped from a line's ends (its line feeds are gone).
BLANK = " \t\x0b\x0c\r"


def text_of(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def exploded(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, at, pos, a, b: the lines that count, with the hash (a, b) of their keys."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), locator().alias("at"), F.posexplode(F.split(normal(F.col("text")), "\n")).alias("pos", "line"))
    key = F.btrim("line", F.lit(BLANK))
    lines = lines.select("doc_id", "at", "pos", key.alias("key")).filter(F.char_length("key") >= least_chars)
    return lines.select("doc_id", "at", "pos", F.xxhash64(F.lit(1), "key").alias("a"), F.xxhash64(F.lit(2), "key").alias("b"))


def lost(docs: DataFrame, folder: str, least_chars: int, least_docs: int) -> DataFrame:
    """at, gone: the sorted positions that a row loses."""
    lines = keep(exploded(docs, least_chars), folder, "lines")
    many = keep(lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).filter(F.col("n") >= least_docs).drop("n"), folder, "many")
    some = lines.filter(probably_in(F.col("a"), many.select("a").distinct(), folder, "many_bloom"))
    hits = keep(some.join(many, ["a", "b"]), folder, "hits")
    common = hits.groupBy("a", "b", "doc_id").agg(F.lit(1).alias("one")).groupBy("a", "b").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs)
    out = hits.filter(~F.col("doc_id").eqNullSafe(F.col("last"))).join(common, ["a", "b"])
    gone = keep(out.groupBy("at").agg(F.sort_array(F.collect_list("pos")).alias("gone")), folder, "gone")
    discard(docs.sparkSession, folder, "lines", "many", "many_bloom", "hits")
    return gone


def without(lines: Column, gone: Column) -> Column:
    """``lines`` without those at the sorted positions ``gone``: what lies between two of them, again and again."""

    def between(j: Column) -> Column:
        start = F.when(j == 0, F.lit(0)).otherwise(F.get(gone, j - 1) + 1)
        end = F.when(j == F.size(gone), F.size(lines)).otherwise(F.get(gone, j))
        return F.slice(lines, start + 1, end - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), between))


def dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """One row per row of ``docs``, with its columns: text is what remains, n_lines and n_dropped are added (or replaced)."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    docs = located(docs, folder)
    gone = lost(docs, folder, least_chars, least_docs)
    place, cut = free_name(docs, "_at"), free_name(docs, "_gone")
    maybe = probably_in(F.xxhash64(locator()), gone.select(F.xxhash64("at").alias("k")).distinct(), folder, "gone_bloom")
    flag = free_name(docs, "_maybe")
    marked = docs.withColumn(place, locator()).withColumn(flag, maybe)
    n = F.size(F.split(text_of(F.col("text")), "\n"))
    whole = marked.filter(~F.col(flag)).drop(place, flag).withColumns({"text": text_of(F.col("text")), "n_lines": n.cast("long"), "n_dropped": F.lit(0).cast("long")})
    # split before the join, so that what uses the lines again and again reads a column
    some = marked.filter(flag).drop(flag).withColumn("text", F.split(text_of(F.col("text")), "\n"))
    # what is lost grows with the table: the join shuffles at every size, instead of a broadcast of up to its limit
    some = some.join(gone.select(F.col("at").alias(place), F.col("gone").alias(cut)).hint("merge"), place, "left").drop(place)
    rest = F.when(F.col(cut).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(cut)))
    some = some.withColumns({"n_lines": F.size("text").cast("long"), "n_dropped": F.coalesce(F.size(cut), F.lit(0)).cast("long"), "text": F.array_join(rest, "\n")}).drop(cut)
    return whole.unionByName(some)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP13_SQL = """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, MAX(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING COUNT(DISTINCT doc_id) >= 5),
d AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
