"""Published ad-hoc analyses over the silver and gold layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gold import n, ratio
from .intervals import with_a_point
from .silver import days


def repeat_starters(web: DataFrame) -> DataFrame:
    """By market: users with more than one start, and the starts beyond their first."""
    one = web.filter("event_name = 'hearing_test_start'").groupBy("user_pseudo_id").agg(F.count("*").alias("c"), F.min("country").alias("market")).filter("c > 1")
    return one.groupBy("market").agg(F.count("*").alias("repeat_users"), F.sum(F.col("c") - 1).alias("extra_starts"))


def channel_quality(pairing: DataFrame, d30: DataFrame) -> DataFrame:
    return pairing.join(d30, "acquisition_channel", "full").select("acquisition_channel", "linked_downloads", "pairing_rate", "d30_retention_rate")


def attribution_swing(models: DataFrame) -> DataFrame:
    out = models.groupBy("channel").pivot("attribution_model", ["first_touch", "last_touch"]).agg(F.sum("attributed_downloads")).na.fill(0)
    out = out.withColumn("delta", F.col("last_touch") - F.col("first_touch"))
    return out.withColumn("pct_change", F.round(100 * ratio("delta", "first_touch"), 6))


def share(df: DataFrame, by: str, name: str) -> DataFrame:
    out = df.groupBy(by).agg(F.count("*").alias(name))
    return out.withColumn("share_pct", F.round(100 * ratio(F.col(name), F.sum(name).over(W.partitionBy())), 6))  # over the groups, not the rows


def mobile_share(by_channel_device: DataFrame) -> DataFrame:
    mobile = F.sum(F.when(F.col("device_category") == "mobile", F.col("users_started")).otherwise(0))
    return by_channel_device.groupBy("channel").agg(mobile.alias("mobile_starts"), F.sum("users_started").alias("starts")).withColumn("mobile_share", ratio("mobile_starts", "starts"))


def gap(df: DataFrame, by: str, over: str, high: str, low: str, rate: str) -> DataFrame:
    """Two groups' rates side by side, and their gap in points."""
    out = df.groupBy(by).pivot(over, [high, low]).agg(F.first(rate))
    return out.select(by, F.col(high).alias("high_rate"), F.col(low).alias("low_rate"), F.round(100 * (F.col(high) - F.col(low)), 6).alias("gap_pp"))


def marginals(by_channel_device: DataFrame) -> DataFrame:
    """The two-way mart rolled up by each dimension."""
    parts = [
        by_channel_device.groupBy(F.lit(c).alias("dimension"), F.col(c).alias("value")).agg(F.sum("users_started").alias("users_started"), F.sum("users_completed").alias("users_completed"))
        for c in ("channel", "device_category")
    ]
    return parts[0].unionByName(parts[1]).withColumn("completion_rate", ratio("users_completed", "users_started"))


def bridge_coverage(app: DataFrame, bridge: DataFrame) -> DataFrame:
    return app.agg(F.countDistinct("hashed_device_id").alias("app_devices")).crossJoin(bridge.agg(F.count("*").alias("bridge_rows"), n(F.col("opt_in_flag")).alias("eligible_rows")))


def cube_slice(cube: DataFrame, channel: str) -> DataFrame:
    out = cube.filter(F.col("channel") == channel).groupBy("market").agg(F.sum("test_starts").alias("test_starts"), F.sum("test_completes").alias("test_completes"))
    return out.withColumn("completion_rate", ratio("test_completes", "test_starts"))


def shift_scenarios(starts: DataFrame, pairing: DataFrame, weak: str, to: tuple[str, ...], shares: tuple[float, ...] = (0.1, 0.25)) -> DataFrame:
    """Net downloads and pairings if a share of a weak channel's completers came by the benchmark channels.

    starts: (channel, users_started); pairing: pairing_by_channel.  Rates are blended: sums over sums.
    """
    volume = starts.groupBy("channel").agg(F.sum("users_started").alias("s")).join(pairing, F.col("channel") == F.col("acquisition_channel"))
    is_to, is_weak = F.col("channel").isin(list(to)), F.col("channel") == weak
    total = lambda c, k: F.sum(F.when(c, F.col(k)).otherwise(0)).cast("double")
    one = volume.agg(
        total(is_weak, "s").alias("weak_starts"), (total(is_to, "linked_downloads") / total(is_to, "s")).alias("good_dl"), (total(is_weak, "linked_downloads") / total(is_weak, "s")).alias("weak_dl"),
        (total(is_to, "paired_users") / total(is_to, "linked_downloads")).alias("good_pair"), (total(is_weak, "paired_users") / total(is_weak, "linked_downloads")).alias("weak_pair"),
    )
    moved = F.col("shift_share") * F.col("weak_starts")
    return scenario(starts, "shift_share", shares).crossJoin(one).select(
        "shift_share", F.round(moved, 6).alias("moved_starts"), F.round(moved * (F.col("good_dl") - F.col("weak_dl")), 6).alias("net_downloads"),
        F.round(moved * (F.col("good_dl") * F.col("good_pair") - F.col("weak_dl") * F.col("weak_pair")), 6).alias("net_pairings"),
    )


def close_gap(starts: DataFrame, journeys: DataFrame, high: str, low: str, shares: tuple[float, ...] = (1 / 3, 1 / 2, 2 / 3)) -> DataFrame:
    """What closing a share of the completion gap between two devices adds down the funnel.

    starts: (device_category, users_started, users_completed).  The further steps take the rates of all linked journeys to completions.
    """
    at = lambda device, c: F.sum(F.when(F.col("device_category") == device, F.col(c)).otherwise(0)).cast("double")
    one = starts.agg((at(high, "users_completed") / at(high, "users_started")).alias("high"), (at(low, "users_completed") / at(low, "users_started")).alias("low"), at(low, "users_started").alias("n"), F.sum("users_completed").cast("double").alias("completes"))
    down = journeys.agg(F.count("*").alias("downloads"), n(F.col("is_paired")).alias("paired"), n(F.col("d30_active") & ~F.col("censored")).alias("retained"))
    extra = F.col("gap_share") * (F.col("high") - F.col("low")) * F.col("n")
    step = lambda c: F.round(extra * F.col(c) / F.col("completes"), 6)
    rows = scenario(starts, "gap_share", shares).crossJoin(one).crossJoin(down)
    return rows.select(F.round("gap_share", 6).alias("gap_share"), F.round(extra, 6).alias("extra_completes"), step("downloads").alias("extra_downloads"), step("paired").alias("extra_paired"), step("retained").alias("extra_retained"))


def lift_linkable(shares_by_market: DataFrame, market: str, to: str, steps: tuple[float, ...] = (0.5, 1.0)) -> DataFrame:
    """Linked users that a market would have if its linkable share closed a part of the gap to another market's."""
    of = lambda m, c: F.max(F.when(F.col("market") == m, F.col(c)))
    one = shares_by_market.agg(of(market, "linkable_share").alias("own"), of(to, "linkable_share").alias("goal"), of(market, "redirect_users").alias("users"), of(market, "bridge_users").alias("linked"))
    target = F.col("own") + F.col("parity") * (F.col("goal") - F.col("own"))
    rows = scenario(shares_by_market, "parity", steps).crossJoin(one)
    return rows.select("parity", F.round(target, 6).alias("target_share"), F.round(target * F.col("users"), 6).alias("target_linked"), F.round(target * F.col("users") - F.col("linked"), 6).alias("extra_linked"))


def scenario(like: DataFrame, name: str, values: tuple[float, ...]) -> DataFrame:
    return like.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"(CAST({v!r} AS DOUBLE))" for v in values) + f" AS s({name})")


def support_split(app_stages: DataFrame, support: DataFrame) -> DataFrame:
    """Retention of uncensored devices with and without a support event (a correlation)."""
    helped = support.select("hashed_device_id").distinct().withColumn("helped", F.lit(True))
    out = app_stages.filter("NOT censored").join(helped, "hashed_device_id", "left").groupBy(F.coalesce("helped", F.lit(False)).alias("had_support"))
    return out.agg(F.count("*").alias("devices"), n(F.col("d30_active")).alias("retained")).withColumn("retention_rate", ratio("retained", "devices"))


def recovered_after_support(app: DataFrame, support: DataFrame, window: int = 14) -> DataFrame:
    """Devices whose window after the first support event has closed, and those that opened the app again within it."""
    first = support.groupBy("hashed_device_id").agg(F.min("event_timestamp").alias("helped_ts"))
    first = first.withColumn("horizon", app.agg(F.max("event_timestamp")).scalar()).filter(F.col("helped_ts") + days(window) <= F.col("horizon"))
    windows = first.select("hashed_device_id", "helped_ts", (F.col("helped_ts") + days(window)).alias("closed_ts"))
    opens = app.filter("event_name = 'app_open'")
    back = with_a_point(windows, opens, "hashed_device_id", "event_timestamp", "helped_ts", "closed_ts", window, open_start=True, closed_end=True).agg(F.count("*").alias("recovered_devices"))
    return first.agg(F.count("*").alias("support_devices")).crossJoin(back).withColumn("recovered_share", ratio("recovered_devices", "support_devices"))
