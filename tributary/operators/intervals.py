"""Range joins by time bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def with_a_point(windows: DataFrame, points: DataFrame, key: str, ts: str, start: str, end: str, days: int, open_start: bool = False, closed_end: bool = False) -> DataFrame:
    """The distinct keys of ``windows`` (key, start, end) that have a point (key, ts) in [start, end); either end may be open or closed.

    Time is cut into bins of ``days`` days, which are best as long as a window: it is laid over the two or so bins that it touches, and points meet windows by key and bin.
    So points far from every window of their key meet nothing, and a key of very many points is spread over as many groups as it has bins.
    A null key, time, start or end meets nothing.
    """
    width = days * DAY
    at = lambda c: F.floor(micros(F.col(c)) / width)
    laid = windows.filter(F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)))
    laid = laid.select(F.col(key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), F.explode(F.sequence(at(start), at(end))).alias("_bin"))
    binned = points.select(key, ts, at(ts).alias("_at"))
    after = F.col(ts) > F.col("_start") if open_start else F.col(ts) >= F.col("_start")
    before = F.col(ts) <= F.col("_end") if closed_end else F.col(ts) < F.col("_end")
    met = binned.join(laid, (F.col(key) == F.col("_key")) & (F.col("_at") == F.col("_bin")) & after & before)
    return met.select(key).distinct()
