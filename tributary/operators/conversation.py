"""Conversation context, live sessions and bursts, as table jobs in which no hot key is one task's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tributary.operators import ordered
from tributary.scratch import shared_folder

# Words that refer back to an earlier turn.
MARKERS = ("that", "this", "it", "these", "those", "now", "also", "instead", "same", "again", "bunu", "şunu", "buna", "peki", "aynı", "şimdi", "onu", "bunlar")


def referential(text: Column, short: int = 5) -> Column:
    """Whether a question refers back: it holds a marker as a whole word, in whatever case, or has few words; without any word it does not."""
    inside = r"[\p{L}\p{N}_]"
    marked = text.rlike(f"(?iu)(?<!{inside})({'|'.join(MARKERS)})(?!{inside})")
    words = F.size(F.regexp_extract_all(text, F.lit(r"(?U)([^\s\x1c-\x1f]+)")))
    return (words > 0) & (marked | (words <= short))


def context(turns: DataFrame, last: int = 5, cut: int = 160, slice_rows: int = ordered.ROWS) -> DataFrame:
    """Per user turn: conv_id, turn, referential, context (the last questions with the first line of their answers, newest last).

    A question's answer is the next assistant turn before the next question; it is stripped before its first line is taken.
    Turns are worked through in slices: each hands on the first turns after it and the last questions before it, so one conversation may fill many.
    """
    rows = ordered.slices(turns.select("conv_id", "turn", "role", "text"), ["conv_id", "turn"], shared_folder(turns.sparkSession), "turns", slice_rows)
    is_ = lambda role: F.col("role") == role
    # what comes after a slice: the next question and the next answer of the conversation, wherever they are
    per = rows.groupBy("slice", "conv_id").agg(F.min(F.when(is_("user"), F.col("turn"))).alias("u"), F.min(F.when(is_("assistant"), F.struct("turn", "text"))).alias("a"))
    later = W.partitionBy("conv_id").orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)
    after = per.select("slice", "conv_id", *[F.last(c, ignorenulls=True).over(later).alias(f"later_{c}") for c in ("u", "a")])
    # from the end backwards, the latest turn seen is the next one: a frame that only grows
    back = W.partitionBy("slice", "conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, -1)
    nearest = lambda role, c: F.last(F.when(is_(role), c), ignorenulls=True).over(back)
    asked = rows.withColumns({"u": nearest("user", F.col("turn")), "a": nearest("assistant", F.struct("turn", "text"))}).filter("role = 'user'")
    asked = asked.join(after, ["slice", "conv_id"]).withColumns({"u": F.coalesce("u", "later_u"), "a": F.coalesce("a", "later_a")})
    own = F.when(F.col("u").isNull() | (F.col("a.turn") < F.col("u")), F.col("a.text"))
    line = F.substring(F.regexp_extract(F.regexp_replace(own, r"^\s+", ""), r"^([^\r\n\x0b\x0c]*)", 1), 1, cut)
    asked = asked.select("slice", "conv_id", "turn", "text", F.concat_ws(" => ", F.col("text"), line).alias("said"))
    # what comes before a slice: the last questions, each slice that has any has one at least
    tail = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("turn", "said")), asc=False), 1, last), lambda x: x["said"])
    numbered = asked.withColumn("i", F.row_number().over(W.partitionBy("slice", "conv_id").orderBy(F.desc("turn")))).filter(F.col("i") <= last)
    tails = numbered.groupBy("slice", "conv_id").agg(F.reverse(tail).alias("tail"))
    earlier = W.partitionBy("conv_id").orderBy("slice").rowsBetween(-last, -1)
    carry = tails.select("slice", "conv_id", F.flatten(F.collect_list("tail").over(earlier)).alias("carried"))
    here = F.collect_list("said").over(W.partitionBy("slice", "conv_id").orderBy("turn").rowsBetween(-last, -1))
    asked = asked.withColumn("here", here).join(carry, ["slice", "conv_id"]).withColumn("all", F.concat("carried", "here"))
    flag = referential(F.coalesce("text", F.lit("")))
    kept = F.slice("all", F.greatest(F.size("all") - (last - 1), F.lit(1)), last)
    return asked.select("conv_id", "turn", flag.alias("referential"), F.when(flag, kept).alias("context"))


def sessions(events: DataFrame, key: str, ts: str, idle_hours: int = 2, most: int = 200, slice_rows: int = ordered.ROWS) -> DataFrame:
    """Live sessions at the horizon: a gap of more than ``idle_hours`` starts a new one; only those seen last stay, ``most`` at most."""
    rows = ordered.slices(events.select(key, ts), [key, ts], shared_folder(events.sparkSession), "events", slice_rows)
    seconds = F.unix_timestamp(F.col(ts).cast("timestamp"))
    rows = ordered.before(rows.withColumn("t", seconds), key, [F.col("t")], F.col("t"), "previous")
    gap = F.coalesce((F.col("t") - F.col("previous") > idle_hours * 3600).cast("int"), F.lit(0))
    rows = ordered.running(rows.withColumn("gap", gap), key, [F.col("t"), F.desc("gap")], F.col("gap"), "s")  # of equal times the one after the gap comes first
    per = rows.groupBy(key, "s").agg(F.min(ts).alias("started"), F.max(ts).alias("last_seen"), F.count("*").alias("events"))
    live = per.withColumn("horizon", events.agg(F.max(ts)).scalar()).filter(F.col("last_seen") >= F.col("horizon") - F.expr(f"INTERVAL {idle_hours} HOUR"))
    return live.select(key, "started", "last_seen", "events").orderBy(F.desc("last_seen"), key).limit(most)


def bursts(events: DataFrame, key: str, ts: str, hits: int = 20, seconds: int = 60) -> DataFrame:
    """Keys with more than ``hits`` events in some trailing window: key, the most, when first beyond.

    Events are summed by second before any window, so a key's rows are bounded by the calendar.  A second's hits count until they leave the window.
    """
    t = F.unix_timestamp(F.col(ts).cast("timestamp"))
    per = events.select(key, F.col(ts).alias("ts"), t.alias("t")).groupBy(key, "t").agg(F.count("*").alias("n"), F.min("ts").alias("ts"))
    gone = per.select(key, (F.col("t") + seconds + 1).alias("t"), (-F.col("n")).alias("n"), F.lit(None).cast(per.schema["ts"].dataType).alias("ts"))
    both = per.unionByName(gone).groupBy(key, "t").agg(F.sum("n").alias("n"), F.min("ts").alias("ts"))
    rows = both.withColumn("c", F.sum("n").over(W.partitionBy(key).orderBy("t").rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter((F.col("c") > hits) & F.col("ts").isNotNull()).groupBy(key).agg(F.max("c").alias("most_hits"), F.min("ts").alias("first_ts"))
