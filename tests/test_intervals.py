"""The binned range join: edges, and a hot key."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tributary.operators import intervals

T0 = datetime(2024, 1, 1, 5)
US = timedelta(microseconds=1)


@pytest.mark.parametrize("open_start, closed_end", [(False, False), (True, True)])
def test_edges_of_windows(spark, open_start, closed_end):
    span = timedelta(days=10)
    offsets = [-US, timedelta(0), US, span / 2, span - US, span, span + US]
    windows = [(f"k{i}", T0 + timedelta(days=3 * i), T0 + timedelta(days=3 * i) + span) for i in range(len(offsets))] + [("none", None, T0), ("back", T0, T0 - US), (None, T0, T0 + span)]
    points = [(f"k{i}", T0 + timedelta(days=3 * i) + o) for i, o in enumerate(offsets)] + [("none", T0), ("back", T0), (None, T0), ("k0", None)]
    w = spark.createDataFrame(windows, "k string, a timestamp_ntz, b timestamp_ntz")
    p = spark.createDataFrame(points, "k string, t timestamp_ntz")
    want = {f"k{i}" for i, o in enumerate(offsets) if (o > timedelta(0) if open_start else o >= timedelta(0)) and (o <= span if closed_end else o < span)}
    for days in (1, 7, 10, 40):
        assert {r.k for r in intervals.with_a_point(w, p, "k", "t", "a", "b", days, open_start, closed_end).collect()} == want


def test_a_hot_key_is_spread_over_bins(spark):
    points = spark.range(20_000).selectExpr("if(id % 3 = 0, concat('k', id % 50), 'hot') AS k", "timestamp_ntz'2024-01-01' + make_dt_interval(cast(id % 300 as int)) AS t")
    windows = spark.sql("SELECT concat('k', id) AS k, timestamp_ntz'2024-03-01' AS a, timestamp_ntz'2024-03-08' AS b FROM range(50) UNION ALL SELECT 'hot', timestamp_ntz'2024-05-01', timestamp_ntz'2024-05-03'")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = intervals.with_a_point(windows, points, "k", "t", "a", "b", 7)
        plain = points.alias("p").join(windows.alias("w"), F.expr("p.k = w.k AND t >= a AND t < b")).select("p.k").distinct()
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 3
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    dealt = [x for x in plan.splitlines() if "hashpartitioning(k#" in x and "_at#" in x]
    assert dealt and "SortMergeJoin" in plan  # by key and bin, never by key alone
    assert points.filter("k = 'hot'").selectExpr("floor(unix_micros(cast(t as timestamp)) / (7 * 86400000000D)) AS bin").groupBy("bin").count().selectExpr("max(count) < 700").first()[0]
