"""Rows in order, in slices of bounded size: what a window per key would do in one task, however hot the key.

``slices`` sorts a table by range into slices of about equally many rows; a key of very many rows spans several.  What a row needs of its
neighbours beyond its slice is carried by a table with a row for each slice and key: a key that is not hot has one or two of them, a hot one as many as slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.scratch import keep

#: Rows of a slice, in expectation.
ROWS = 1_000_000


def slices(df: DataFrame, order: list[str], folder: str, name: str, rows: int = ROWS) -> DataFrame:
    """``df`` and ``slice``, written: slices follow each other in ``order``, which must tell rows apart for equal rows to stay in one slice."""
    n = max(1, -(-df.count() // rows))
    return keep(df.repartitionByRange(n, *order).withColumn("slice", F.spark_partition_id()).sortWithinPartitions(*order), folder, name)


def running(rows: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` and ``name``: the sum of ``value`` over a key's rows so far, carried from slice to slice."""
    own = W.partitionBy("slice", key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = rows.groupBy("slice", key).agg(F.sum(value).alias("_sum"))
    carried = F.coalesce(F.sum("_sum").over(W.partitionBy(key).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carry = totals.select("slice", F.col(key).alias("_key"), carried.alias("_before"))
    out = rows.withColumn(name, F.sum(value).over(own)).alias("r").join(carry.alias("c"), (F.col("r.slice") == F.col("c.slice")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.select("r.*", "_before").withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def before(rows: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """``rows`` and ``name``: ``value`` (never null) of the row before among the key's rows, in this slice or an earlier one."""
    last = rows.groupBy("slice", key).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carry = last.select("slice", F.col(key).alias("_key"), F.lag("_last").over(W.partitionBy(key).orderBy("slice")).alias("_before"))
    own = F.lag(value).over(W.partitionBy("slice", key).orderBy(*order))
    out = rows.withColumn(name, own).alias("r").join(carry.alias("c"), (F.col("r.slice") == F.col("c.slice")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.select("r.*", "_before").withColumn(name, F.coalesce(name, "_before")).drop("_before")
