"""Data-quality expectations; each gives (check, subject, observed, expected, ok) and reports, never raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def verdict(df: DataFrame, check: str, subject: Column, observed: Column, expected: Column, ok: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), subject.cast("string").alias("subject"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), F.coalesce(ok, F.lit(False)).alias("ok"))


def same(check: str, subject: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-value tables agree."""
    both = left.toDF("a").crossJoin(right.toDF("b"))
    return verdict(both, check, F.lit(subject), F.col("a"), F.col("b"), F.col("a").eqNullSafe(F.col("b")))


def reconcile(overview: DataFrame, truth: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Stage counts against a reference table (stage, users), within a relative tolerance."""
    both = overview.select("stage", F.col("users").alias("a")).join(truth.select("stage", F.col("users").alias("b")), "stage", "full")
    return verdict(both, "reconcile", F.col("stage"), F.col("a"), F.col("b"), F.abs(F.col("a") - F.col("b")) <= tolerance * F.col("b"))


def monotone(overview: DataFrame) -> DataFrame:
    before = F.lag("users").over(W.orderBy("stage_order"))
    return verdict(overview.withColumn("before", before).filter("before IS NOT NULL"), "monotone", F.col("stage"), F.col("users"), F.col("before"), F.col("users") <= F.col("before"))


def rates_in_range(marts: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [verdict(df.agg(F.count_if((F.col(c) < 0) | (F.col(c) > 1)).alias("bad")), "rate_range", F.lit(f"{name}.{c}"), F.col("bad"), F.lit(0), F.col("bad") == 0) for name, (df, c) in marts.items()]
    return reduce(DataFrame.unionByName, parts)


def all_of(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def unique_grain(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
    double = df.groupBy(*keys).count().filter("count > 1").agg(F.count("*").alias("bad"))
    return verdict(double, "unique_grain", F.lit(name), F.col("bad"), F.lit(0), F.col("bad") == 0)


def rows_where(name: str, df: DataFrame, bad: str) -> DataFrame:
    return verdict(df.agg(F.count_if(F.expr(bad)).alias("bad")), "bounds", F.lit(name), F.col("bad"), F.lit(0), F.col("bad") == 0)


def equivalent(name: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """Two queries give the same rows, with multiplicity."""
    extra = left.exceptAll(right).agg(F.count("*").alias("a")).crossJoin(right.exceptAll(left).agg(F.count("*").alias("b")))
    return verdict(extra, "equivalent", F.lit(name), F.col("a") + F.col("b"), F.lit(0), F.col("a") + F.col("b") == 0)


def fingerprints(df: DataFrame, buckets: int, side: str) -> DataFrame:
    """bucket, and the count and sums of the row hashes in it: the same for the same rows in any order, with multiplicity."""
    # a null leaves a hash as it is, so whether a column is null is hashed too; halves of 64 bits can be summed
    columns = [x for c in df.columns for x in (F.col(c).isNull(), F.col(c))]
    hashed = df.select(*[F.xxhash64(F.lit(i), *columns).alias(f"h{i}") for i in (1, 2)])
    halves = {f"{side}{i}{half}": F.sum(f(F.col(f"h{i}"))) for i in (1, 2) for half, f in (("lo", lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))), ("hi", lambda h: F.shiftrightunsigned(h, 32)))}
    return hashed.groupBy(F.pmod("h1", F.lit(buckets)).alias("bucket")).agg(F.count("*").alias(f"{side}n"), *[v.alias(k) for k, v in halves.items()])


def equivalent_marts(pairs: dict[str, tuple[DataFrame, DataFrame]], buckets: int = 256) -> DataFrame:
    """Whether the two sides of each pair have the same rows, with multiplicity: observed is the number of rows that only one side has.

    Each side is read once, for sums of row hashes by bucket; only buckets whose sums differ are compared row by row.
    """
    out = []
    for name, (left, right) in pairs.items():
        right = right.select(*[F.col(f.name).cast(f.dataType) for f in left.schema.fields])
        both = fingerprints(left, buckets, "l").join(fingerprints(right, buckets, "r"), "bucket", "full")
        same = reduce(Column.__and__, [F.col(f"l{c}").eqNullSafe(F.col(f"r{c}")) for c in ("n", "1lo", "1hi", "2lo", "2hi")])
        odd = [r["bucket"] for r in both.filter(~same).select("bucket").collect()]  # buckets at most
        if odd:
            columns = [x for c in left.columns for x in (F.col(c).isNull(), F.col(c))]
            mine = F.pmod(F.xxhash64(F.lit(1), *columns), F.lit(buckets)).isin(odd)
            out.append(equivalent(name, left.filter(mine), right.filter(mine)))
        else:
            out.append(verdict(left.sparkSession.range(1), "equivalent", F.lit(name), F.lit(0), F.lit(0), F.lit(True)))
    return all_of(out)
