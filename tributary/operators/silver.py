"""Conformed user- and device-grain tables, and the consent gate between the two identity spaces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.operators.intervals import with_a_point

#: Campaign names and the channels they belong to.
CHANNELS = {"summer_hearing_meta": "paid_social_meta", "tiktok_awareness": "paid_social_tiktok", "brand_search": "paid_search_brand", "retargeting_meta": "retargeting_meta"}
DIRECT, NO_CAMPAIGN = "organic_direct", "organic/none"


@dataclass(frozen=True)
class Retention:
    """Active: an open in [first + lo, first + hi) days; censored: first open later than horizon - censor days."""

    lo: int = 28
    hi: int = 35
    censor: int = 34


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {n} DAY")


def channel(utm: Column) -> Column:
    """The channel of a campaign; unknown or none: direct."""
    out = None
    for k, v in CHANNELS.items():
        out = F.when(utm == k, v) if out is None else out.when(utm == k, v)
    return out.otherwise(DIRECT)


def web_user_stages(web: DataFrame) -> DataFrame:
    """One row per web user, in one pass: attributes, last-touch campaign (ties by event_id), first time of each stage."""
    first = lambda name: F.min(F.when(F.col("event_name") == name, F.col("event_timestamp")))
    return web.groupBy("user_pseudo_id").agg(
        F.min("country").alias("market"), F.min("device_category").alias("device_category"), F.min("consent_state").alias("consent_state"),
        F.coalesce(F.max(F.struct("event_timestamp", "event_id", "utm_campaign"))["utm_campaign"], F.lit(NO_CAMPAIGN)).alias("last_touch_campaign"),
        first("hearing_test_start").alias("first_test_start_ts"), first("hearing_test_complete").alias("first_test_complete_ts"), first("app_store_redirect").alias("app_store_redirect_ts"),
    )


def app_user_stages(app: DataFrame, retention: Retention = Retention()) -> DataFrame:
    """One row per device with an open: platform, first open, first pairing, activity in the window, censoring.

    Both aggregations combine before they shuffle, and opens meet their device's window by bins of time, so a device with very many events is no bottleneck.
    """
    opened, paired = F.col("event_name") == "app_open", F.col("event_name") == "hearing_aid_paired"
    one = app.groupBy("hashed_device_id").agg(
        F.min("platform").alias("platform"), F.min(F.when(opened, F.col("event_timestamp"))).alias("first_open_ts"), F.min(F.when(paired, F.col("event_timestamp"))).alias("paired_ts")
    )
    one = one.filter("first_open_ts IS NOT NULL")
    start = F.col("first_open_ts")
    windows = one.select("hashed_device_id", (start + days(retention.lo)).alias("from_ts"), (start + days(retention.hi)).alias("to_ts"))
    again = with_a_point(windows, app.filter(opened), "hashed_device_id", "event_timestamp", "from_ts", "to_ts", max(1, retention.hi - retention.lo)).withColumn("back", F.lit(True))
    out = one.join(again, "hashed_device_id", "left").withColumn("horizon", app.agg(F.max("event_timestamp")).scalar())
    return out.select("hashed_device_id", "platform", "first_open_ts", "paired_ts", F.coalesce("back", F.lit(False)).alias("d30_active"), (start > F.col("horizon") - days(retention.censor)).alias("censored"))


def attribution_eligible(bridge: DataFrame) -> DataFrame:
    """The only path across devices: opted-in rows of the bridge."""
    return bridge.filter("opt_in_flag")


def linked_journeys(eligible: DataFrame, web_stages: DataFrame, app_stages: DataFrame) -> DataFrame:
    """Web completion and a strictly later first open, joined through the consent gate."""
    out = eligible.join(web_stages.drop("market"), F.col("web_pseudo_id") == F.col("user_pseudo_id")).join(app_stages, F.col("app_device_id") == F.col("hashed_device_id"))
    out = out.filter(F.col("first_open_ts") > F.col("first_test_complete_ts"))
    return out.select(
        "hashed_id", "market", "acquisition_channel", "last_touch_campaign", F.col("first_test_complete_ts").alias("test_complete_ts"), "platform",
        "first_open_ts", "paired_ts", F.col("paired_ts").isNotNull().alias("is_paired"), "d30_active", "censored",
    )
