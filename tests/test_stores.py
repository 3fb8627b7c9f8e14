"""The session store and the limiter against plain replays."""

import contextlib
import random
import threading
from collections import OrderedDict, defaultdict, deque
from datetime import datetime, timedelta

import psutil
import pytest

from tributary.operators import stores

T0 = datetime(2024, 1, 1)


def table(n, keys, seconds, hot=0.34, seed=1):
    rng = random.Random(seed)
    t, rows = 0, []
    for i in range(n):
        t += rng.choice((0, 1, rng.randint(0, seconds), rng.randint(0, seconds)))
        t += 40_000 if rng.random() < 0.004 else 0
        rows.append(("hot" if rng.random() < hot else f"k{rng.randint(0, keys)}", T0 + timedelta(seconds=t), i))
    rows += [(None, T0, n), ("k1", None, n + 1), ("", T0 + timedelta(seconds=5), n + 2)]
    rng.shuffle(rows)
    return rows


def replay_store(rows, idle, most):
    store, out = OrderedDict(), []
    for k, t, _ in sorted((r for r in rows if r[0] and r[1]), key=lambda r: (r[1], r[2])):
        for old in [x for x, s in store.items() if (t - s[1]).total_seconds() > idle]:
            s = store.pop(old)
            out.append((old, s[0], s[1], s[2], s[1] + timedelta(seconds=idle), "idle"))
        if k not in store:
            while len(store) >= most:
                old, s = store.popitem(last=False)
                out.append((old, *s, t, "evicted"))
            store[k] = [t, t, 0]
        store[k][1:] = [t, store[k][2] + 1]
        store.move_to_end(k)
    return sorted([*out, *((k, *s, None, "live") for k, s in store.items())], key=str)


@pytest.mark.parametrize("keys, idle, most, slice_rows", [(40, 7200, 200, 10_000), (40, 600, 9, 60), (300, 7200, 50, 40), (300, 7200, 50, 700)])
def test_session_store(spark, keys, idle, most, slice_rows):
    rows = table(900, keys, 60)
    events = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long").repartition(3)
    got = sorted((tuple(r) for r in stores.session_store(events, "k", "ts", "id", idle, most, slice_rows).collect()), key=str)
    want = replay_store(rows, idle, most)
    assert got == want and {r[5] for r in want} >= {"idle", "live"}


def replay_limiter(rows, hits, seconds):
    held, out = defaultdict(deque), []
    for k, t, i in sorted((r for r in rows if r[1]), key=lambda r: (r[1], r[2])):
        ring = held[k]
        while ring and (t - ring[0]).total_seconds() > seconds:
            ring.popleft()
        ok = len(ring) < hits
        if ok:
            ring.append(t)
        out.append((k, t, i, ok))
    return sorted(out, key=str)


@pytest.mark.parametrize("hits, seconds, step, slice_rows", [(20, 60, 8, 10_000), (3, 60, 20, 25), (5, 600, 3, 90), (20, 60, 1, 50)])
def test_limiter(spark, hits, seconds, step, slice_rows):
    rows = table(700, 5, step, hot=0.5)
    events = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long").repartition(3)
    got = sorted((tuple(r) for r in stores.limited(events, "k", "ts", "id", hits, seconds, slice_rows).collect()), key=str)
    want = replay_limiter(rows, hits, seconds)
    assert got == want and (step == 20 or not all(r[3] for r in want))


def test_no_events(spark):
    events = spark.createDataFrame([], "k string, ts timestamp_ntz, id long")
    assert stores.session_store(events, "k", "ts", "id").count() == 0 == stores.limited(events, "k", "ts", "id").count()


@pytest.mark.parametrize("batch", [7, 100])
def test_state_goes_on_from_batch_to_batch(spark, batch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        rows = table(500, 30, 60)
        events = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id long").repartition(3)
        got = sorted((tuple(r) for r in stores.session_store(events, "k", "ts", "id", 600, 9, 150).collect()), key=str)
        assert got == replay_store(rows, 600, 9)
        got = sorted((tuple(r) for r in stores.limited(events, "k", "ts", "id", 3, 600, 150).collect()), key=str)
        assert got == replay_limiter(rows, 3, 600)
    finally:
        spark.conf.set(name, before)


def test_a_task_never_holds_its_slice(spark):
    peak, over = [0], threading.Event()

    def watch():
        while not over.wait(0.1):
            for p in psutil.Process().children(recursive=True):
                with contextlib.suppress(psutil.Error):
                    peak[0] = max(peak[0], p.memory_info().rss if p.name().startswith("python") else 0)

    events = spark.range(600_000).selectExpr("CAST(id * 7919 % 5000 AS STRING) AS k", "CAST(timestamp_micros(id * 1000000) AS TIMESTAMP_NTZ) AS ts", "id")
    thread = threading.Thread(target=watch)
    thread.start()
    try:
        assert stores.session_store(events, "k", "ts", "id", most=12).count() == 600_000
    finally:
        over.set()
        thread.join()
    assert 0 < peak[0] < 250e6
