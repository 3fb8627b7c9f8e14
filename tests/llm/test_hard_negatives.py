"""Hard-negative mining against brute force in Python integers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tributary.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, number string, rank int, score int, bucket int, length string"


def brute(rows, every, k=10, positives=5):
    good = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sizes = [len(r[1]) for r in good]
    d = min(set(sizes), key=lambda s: (-sizes.count(s), s), default=0)
    v = [(r[0], [math.floor(256 * x) for x in r[1]], (r[2] + 1) % 10 if r[0] % 7 == 0 else r[2]) for r in good if len(r[1]) == d]
    out = []
    for a, anchor in enumerate(v):
        if anchor[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(anchor[1], r[1])), r[0], r[2] == anchor[2]) for i, r in enumerate(v) if i != a]
        for s, p, _ in sorted(r for r in scored if r[2])[:positives]:
            fit = sorted((t, n) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s)[:k]
            out += [(anchor[0], p, i, n, -s, -t) for i, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def result(spark, rows, every, **more):
    table = spark.createDataFrame([(*r, "x", 1, 2, 3, "y") for r in rows], SCHEMA).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in hn.mine(table, F.col("vec_id") % every == 0, label, **more).collect())


def table(n, d=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, d)) * 2
    return [(i, (centres[i % 9] * rng.uniform(0.3, 3) + rng.normal(size=d) * 0.6).tolist(), int(rng.integers(0, 10))) for i in range(n)]


def test_mining_of_a_mixed_table(spark, monkeypatch):
    rows = table(700)
    hot = rows[3][1]
    rows += [(1000 + i, hot, i % 4) for i in range(230)]  # a third of all rows are one vector
    rows += [(2000, None, 1), (2001, [1.0] * 12, None), (None, [1.0] * 12, 1), (2010, [float("nan")] + [1.0] * 11, 1), (2020, [None] + [1.0] * 11, 1), (2030, [float("inf")] + [1.0] * 11, 2), (2040, [1.0] * 5, 1), (2050, [], 1)]
    rows += [(2100 + i, [0.0] * 12, i) for i in range(10)] + [(20, rows[20][1], rows[20][2])] * 2 + [(40, rows[7][1], 3)]
    want = brute(rows, 20)
    monkeypatch.setattr(hn, "ROWS", 16)
    monkeypatch.setattr(hn, "BUCKETS", 6)
    assert result(spark, rows, 20) == want and len(want) > 1000
    assert result(spark, rows, 20, round_bytes=4000) == want  # many rounds


def test_wide_numbers_are_exact_and_beyond_64_bits_refused(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e5, 3e6) for _ in range(4)], i % 3) for i in range(60)]
    assert result(spark, rows, 5) == brute(rows, 5)
    with pytest.raises(ValueError, match="64 bits"):
        result(spark, [*rows, (99, [1e30] * 4, 1)], 5)


def test_few_rows(spark):
    assert result(spark, [], 5) == [] == result(spark, [(0, [1.0, 2.0], 1)], 5)
    rows = [(5, [1.0, 2.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [-1.0, -1.0], 1)]
    assert result(spark, rows, 5) == brute(rows, 5) != []


def test_ranges_let_every_fitting_coordinate_pass_and_prune():
    rng = np.random.default_rng(3)
    v = hn.unit(np.array([r[1] for r in table(2000)])) * rng.uniform(0.95, 1, 2000)[:, None]  # one bucket: lengths are alike
    v = np.floor(256 * v).astype(np.int64)
    order = np.argsort(hn.unit(v), axis=0, kind="stable").T.astype(np.int32)
    block = hn.Block({"number": np.arange(2000).tobytes(), "vec_id": np.arange(2000).tobytes(), "label": np.zeros(2000, np.int64).tobytes(), "v": v.tobytes(), "wide": True, "sorted": np.ascontiguousarray(order).tobytes(), "longest": float(np.sqrt((v**2).sum(axis=1)).max())}, 12)
    asked = v[rng.choice(2000, 50)]
    exact = asked @ v.T
    floor = np.sort(exact, axis=1)[:, -20][:, None]
    one = np.zeros((50, 1), np.int64)
    a = hn.Anchors(np.full(50, -1), np.arange(50), one[:, 0], asked, floor, np.full((50, 1), hn.HIGHEST), one, one, True)
    verified = []
    own = hn.products
    hn.products = lambda x, y, e: verified.append(len(x) * len(y)) or own(x, y, e)
    try:
        who, _, place, score = hn.meet(block, a, floor, 0, 50, True)
    finally:
        hn.products = own
    assert sorted(zip(who, place, score)) == sorted((i, j, exact[i, j]) for i, j in zip(*np.nonzero(exact >= floor)))
    assert sum(verified) < 0.25 * exact.size  # most rows are never multiplied
