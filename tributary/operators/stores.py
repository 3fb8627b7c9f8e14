"""A session store and a rate limiter replayed over a table of events, as they would have run.

Both keep state from event to event.  Events are cut into slices by order; the state at a slice's start is small and is worked out
for all slices at once, so slices run as tasks of their own, whatever key fills them.  A task takes its slice in order, a batch at a time.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators import ordered
from tributary.scratch import keep, shared_folder

FRAGMENT = "slice int, seq long, key string, opened boolean, started long, last_seen long, events long, ended long, reason string"


def session_store(events: DataFrame, key: str, ts: str, tie: str, idle_seconds: int = 7200, most: int = 200, slice_rows: int = ordered.ROWS) -> DataFrame:
    """Every session of a store that drops what was idle for more than ``idle_seconds`` and, for a new one, the longest untouched of ``most``.

    key, started, last_seen, events, ended, reason: ``live`` (ended is null), ``idle`` (ended when the time was over) or ``evicted`` (by the event
    that began the session which took its place).  Events without a key (null or empty) or time do not count; equal times go by ``tie``.

    The store at any moment holds the ``most`` keys touched last, as far as they are not too old.  So a slice hands on its ``most`` last
    touched keys, and the lists of the slices before it, merged by doubling (list of 1, 2, 4, ... slices), are the store at its start.
    """
    folder = shared_folder(events.sparkSession)
    rows = events.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(tie).alias("tie"))
    rows = ordered.slices(rows.filter("key != '' AND t IS NOT NULL"), ["t", "tie"], folder, "events", slice_rows)
    last = W.partitionBy("slice").orderBy(F.desc("touch"))

    def newest(lists: DataFrame) -> DataFrame:
        top = lists.groupBy("slice", "key").agg(F.max("touch").alias("touch")).withColumn("i", F.row_number().over(last))
        return top.filter(F.col("i") <= most).drop("i")

    own = keep(newest(rows.select("slice", "key", F.struct("t", "tie").alias("touch"))), folder, "lists")
    slices = rows.select("slice").distinct()
    n, reach = (rows.agg(F.max("slice")).first()[0] or 0) + 1, 1
    lists = own  # of the slices slice - reach + 1 to slice
    while reach < n:
        counts = slices.join(lists.groupBy("slice").count(), "slice", "left").filter((F.coalesce("count", F.lit(0)) < most) & (F.col("slice") >= reach))
        if counts.isEmpty():
            break  # full lists need nothing older
        lists = keep(newest(lists.unionByName(lists.withColumn("slice", F.col("slice") + reach).filter(F.col("slice") < n))), folder, f"lists{reach}")
        reach *= 2
    carry = lists.select((F.col("slice") + 1).alias("slice"), "key", "touch").filter(F.col("slice") < n)
    now = F.max("touch.t").over(W.partitionBy("slice"))
    carry = carry.withColumn("now", now).filter(F.col("now") - F.col("touch.t") <= idle_seconds * 1_000_000).select("slice", "key", "touch.t", "touch.tie")
    idle = idle_seconds * 1_000_000

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, store, seq, done = None, OrderedDict(), 0, []  # store: key: opened here, started, last seen, events; longest untouched first

        def leave(k: str, ended: int | None, reason: str | None) -> None:
            nonlocal seq
            opened, started, seen, n = store.pop(k)
            done.append((at, seq, k, opened, started, seen, n, ended, reason))
            seq += 1

        def close() -> None:
            for k in [k for k, held in store.items() if held[3]]:
                leave(k, None, None)  # goes on in a later slice, or lives
            store.clear()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(done, columns=[c.split()[0] for c in FRAGMENT.split(", ")]).astype({"started": "Int64", "ended": "Int64", "opened": bool})
            done.clear()
            return frame

        for frame in frames:
            for s, new, k, t in frame[["slice", "new", "key", "t"]].itertuples(index=False):
                if s != at:
                    close()
                    at, seq = s, 0
                if not new:
                    store[k] = [False, None, t, 0]
                    continue
                while store and t - (first := next(iter(store.items())))[1][2] > idle:
                    leave(first[0], first[1][2] + idle, "idle")
                if k not in store:
                    while len(store) >= most:
                        leave(next(iter(store)), t, "evicted")
                    store[k] = [True, t, t, 0]
                held = store[k]
                held[2], held[3] = t, held[3] + 1
                store.move_to_end(k)
            yield out()
        close()
        yield out()

    # what a slice starts with, and then its rows: a task holds the store and a batch, never a slice
    both = carry.withColumn("new", F.lit(False)).unionByName(rows.withColumn("new", F.lit(True)))
    both = both.repartitionById(n, F.col("slice")).sortWithinPartitions("slice", "new", "t", F.asc_nulls_last("tie"))
    pieces = keep(both.mapInPandas(replay, FRAGMENT), folder, "fragments")
    # a session is the piece that opened it and those that follow without opening
    pieces = ordered.running(pieces, "key", [F.col("seq")], F.col("opened").cast("int"), "number")
    whole = pieces.groupBy("key", "number").agg(F.min("started").alias("started"), F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"), F.max("ended").alias("ended"), F.max("reason").alias("reason"))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz").alias(c)
    return whole.select("key", time("started"), time("last_seen"), "events", time("ended"), F.coalesce("reason", F.lit("live")).alias("reason"))


def limited(events: DataFrame, key: str, ts: str, tie: str, hits: int = 20, seconds: int = 60, slice_rows: int = ordered.ROWS) -> DataFrame:
    """key, ts, tie, allowed: whether each event passes a limiter of ``hits`` events a key in the trailing ``seconds``; what it rejects is not recorded.

    Events without a time are left out; a null key is a key.  Equal times go by ``tie``.  Slices follow each other by key and time, so only the first key of a slice can depend on
    the slice before, by its last ``hits`` allowed times.  All slices run at once as if nothing had come before; where the slice before turns out to
    hand on other times than these, the slice runs again with them.  A slice with a quiet stretch hands on the same times anyway, so one more run
    mends most keys; only a key that is over its limit without a pause through many slices is followed slice by slice.
    """
    spark, folder, window = events.sparkSession, shared_folder(events.sparkSession), seconds * 1_000_000
    rows = events.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(tie).alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).filter("t IS NOT NULL")
    rows = ordered.slices(rows, ["key", "t", "tie"], folder, "events", slice_rows)
    schema = f"{rows.select('key', 'ts', 'tie').schema.simpleString()[7:-1].replace(',', ', ').replace(':', ' ')}, slice int, allowed boolean, handed_on array<bigint>"

    def run(carried: dict[int, list[int]]):  # noqa: ANN202
        def decide(part: pd.DataFrame, ring: list[int]) -> tuple[pd.DataFrame, list[int]]:
            own, t = part["key"].factorize(use_na_sentinel=False)[0], part["t"].to_numpy()
            allowed = np.ones(len(t), bool)
            crowded = set(own[hits:][(own[hits:] == own[:-hits]) & (t[hits:] - t[:-hits] <= window)].tolist()) | {own[0]}
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            state: list[int] = []
            for lo, hi in zip(starts, np.append(starts[1:], len(t))):
                held = deque(ring if lo == 0 else [], hits)
                if own[lo] in crowded:
                    for i in range(lo, hi):
                        if len(held) == hits and t[i] - held[0] <= window:
                            allowed[i] = False
                        else:
                            held.append(int(t[i]))
                state = list(held) if own[lo] in crowded else t[lo:hi][-hits:].tolist()
            return part.drop(columns="t").assign(allowed=allowed, handed_on=None)[["key", "ts", "tie", "slice", "allowed", "handed_on"]], state

        def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, state = None, []  # the decisions before, whose last row hands on the state if its slice ends there

            def closed() -> pd.DataFrame:
                return last.assign(handed_on=[None] * (len(last) - 1) + [state])

            for frame in frames:
                for s, part in frame.groupby("slice", sort=False):
                    goes_on = last is not None and last["slice"].iloc[-1] == s
                    if last is not None:
                        yield last if goes_on else closed()
                    if goes_on:
                        a, b = last["key"].iloc[-1], part["key"].iloc[0]
                        ring = state if a == b or (pd.isna(a) and pd.isna(b)) else []
                    else:
                        ring = carried.get(int(s), [])
                    last, state = decide(part, ring)
            if last is not None:
                yield closed()

        return step

    ends = rows.groupBy("slice").agg(F.min(F.struct("key", "t", "tie")).alias("a"), F.max(F.struct("key", "t", "tie")).alias("b"))
    ends = {r["slice"]: (r["a"], r["b"]) for r in ends.collect()}  # a row a slice, as is what they hand on
    order = sorted(ends)
    chained = {s: p for p, s in zip(order, order[1:]) if ends[p][1]["key"] == ends[s][0]["key"]}  # slice: the one before, if its last key goes on
    carried: dict[int, list[int]] = {}
    known: dict[int, list[int]] = {}
    latest: dict[int, int] = {}
    todo, turn = order, 0
    while todo:
        part = rows if turn == 0 else rows.filter(F.col("slice").isin(todo))
        part = part.repartitionById(order[-1] + 1, F.col("slice")).sortWithinPartitions("slice", "key", "t", "tie")
        ran = keep(part.mapInPandas(run(dict(carried)), schema), folder, f"run{turn}")
        known |= {r["slice"]: list(r["handed_on"]) for r in ran.filter("handed_on IS NOT NULL").select("slice", "handed_on").collect()}
        latest |= dict.fromkeys(todo, turn)
        todo, turn, sure = [], turn + 1, set()
        for s in order:
            if s in chained:
                if chained[s] not in sure:
                    continue  # waits for the slices before
                right = [x for x in known[chained[s]] if ends[s][0]["t"] - x <= window]
                if right != carried.get(s, []):
                    carried[s] = right
                    todo.append(s)
                    continue
            sure.add(s)
    out = None
    for i in sorted(set(latest.values())):
        mine = [s for s, x in latest.items() if x == i]
        own = spark.read.schema(schema).parquet(f"{folder}/run{i}").filter(F.col("slice").isin(mine))
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = rows.withColumn("allowed", F.lit(True))
    return out.select(F.col("key").alias(key), F.col("ts").alias(ts), F.col("tie").alias(tie), "allowed")
