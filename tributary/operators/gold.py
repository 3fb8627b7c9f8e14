"""Funnel marts and day-grain cubes.  Each takes the layers it needs and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .silver import channel

STAGES = ("hearing_test_start", "hearing_test_complete", "app_download", "hearing_aid_paired", "active_d30")


def n(condition: Column) -> Column:
    return F.count_if(condition)


def ratio(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.cast("double") / F.nullif(b, F.lit(0))


def retained() -> Column:
    return F.col("d30_active") & ~F.col("censored")


def funnel_overview(web_stages: DataFrame, app_stages: DataFrame) -> DataFrame:
    """Five independent stage counts (not chained by user)."""
    web = web_stages.agg(F.count("first_test_start_ts").alias("a"), F.count("first_test_complete_ts").alias("b"))
    app = app_stages.agg(F.count("*").alias("c"), F.count("paired_ts").alias("d"), n(retained()).alias("e"))
    long = lambda df, first, names: df.select(F.stack(F.lit(len(names)), *[x for i, (s, c) in enumerate(names) for x in (F.lit(first + i), F.lit(s), F.col(c))]).alias("stage_order", "stage", "users"))
    return long(web, 1, list(zip(STAGES[:2], "ab"))).unionByName(long(app, 3, list(zip(STAGES[2:], "cde"))))


def step_conversion(overview: DataFrame) -> DataFrame:
    w = W.orderBy("stage_order")  # five rows
    before, users = F.lag("stage").over(w), F.lag("users").over(w)
    out = overview.select("stage_order", F.concat(before, F.lit(" -> "), "stage").alias("step"), users.alias("from_users"), F.col("users").alias("to_users"))
    return out.withColumn("conversion_rate", ratio("to_users", "from_users"))


def completion(web_stages: DataFrame, by: dict[str, Column], names: tuple[str, str] = ("test_starts", "test_completes")) -> DataFrame:
    """Starts, and completions among starters, by any dimensions."""
    out = web_stages.filter("first_test_start_ts IS NOT NULL").groupBy(*[c.alias(k) for k, c in by.items()])
    return out.agg(F.count("*").alias(names[0]), F.count("first_test_complete_ts").alias(names[1])).withColumn("completion_rate", ratio(names[1], names[0]))


def completion_by_channel(web_stages: DataFrame) -> DataFrame:
    return completion(web_stages, {"channel": F.col("last_touch_campaign")})


def completion_by_device(web_stages: DataFrame) -> DataFrame:
    return completion(web_stages, {"device_category": F.col("device_category")})


def completion_by_channel_device(web_stages: DataFrame) -> DataFrame:
    return completion(web_stages, {"channel": channel(F.col("last_touch_campaign")), "device_category": F.col("device_category")}, ("users_started", "users_completed"))


def downloads_by_channel(journeys: DataFrame) -> DataFrame:
    return journeys.groupBy("acquisition_channel").agg(F.countDistinct("hashed_id").alias("linked_downloads"))


def pairing_by_channel(journeys: DataFrame) -> DataFrame:
    out = journeys.groupBy("acquisition_channel").agg(F.countDistinct("hashed_id").alias("linked_downloads"), n(F.col("is_paired")).alias("paired_users"))
    return out.withColumn("pairing_rate", ratio("paired_users", "linked_downloads"))


def gated_devices(app_stages: DataFrame, eligible: DataFrame) -> DataFrame:
    return app_stages.join(eligible, F.col("hashed_device_id") == F.col("app_device_id"))


def pairing_by_platform_market(app_stages: DataFrame, eligible: DataFrame) -> DataFrame:
    one = F.countDistinct("hashed_device_id").alias("app_devices"), F.countDistinct(F.when(F.col("paired_ts").isNotNull(), F.col("hashed_device_id"))).alias("paired_devices")
    return gated_devices(app_stages, eligible).groupBy("market", "platform").agg(*one).withColumn("pairing_rate", ratio("paired_devices", "app_devices"))


def d30_by_channel(app_stages: DataFrame, eligible: DataFrame) -> DataFrame:
    rows = gated_devices(app_stages, eligible).filter("NOT censored").groupBy("acquisition_channel")
    out = rows.agg(F.countDistinct("hashed_device_id").alias("eligible_users"), F.countDistinct(F.when(F.col("d30_active"), F.col("hashed_device_id"))).alias("retained_users"))
    return out.withColumn("d30_retention_rate", ratio("retained_users", "eligible_users"))


def week(c: str) -> Column:
    return F.date_trunc("week", F.col(c)).cast("date")


def weekly_test_starts(web_stages: DataFrame) -> DataFrame:
    return web_stages.filter("first_test_start_ts IS NOT NULL").groupBy(week("first_test_start_ts").alias("week_start")).agg(F.count("*").alias("test_starts"))


def linkable_share_by_market(web_stages: DataFrame, eligible: DataFrame) -> DataFrame:
    redirects = web_stages.filter("app_store_redirect_ts IS NOT NULL").groupBy("market").agg(F.count("*").alias("redirect_users"))
    linked = eligible.groupBy("market").agg(F.countDistinct("hashed_id").alias("b"))
    out = redirects.join(linked, "market", "left").select("market", "redirect_users", F.coalesce("b", F.lit(0)).alias("bridge_users"))
    return out.withColumn("linkable_share", ratio("bridge_users", "redirect_users"))


def attribution_first_vs_last(journeys: DataFrame) -> DataFrame:
    """The same population, counted by first touch (bridge) and by mapped last touch."""
    long = journeys.select("hashed_id", F.stack(F.lit(2), F.lit("first_touch"), "acquisition_channel", F.lit("last_touch"), channel(F.col("last_touch_campaign"))).alias("attribution_model", "channel"))
    return long.groupBy("channel", "attribution_model").agg(F.countDistinct("hashed_id").alias("attributed_downloads"))


def web_funnel_daily_cube(web_stages: DataFrame) -> DataFrame:
    """Each measure on its own first day: three (measure, time) pairs per user, one aggregation."""
    measures = {"test_starts": "first_test_start_ts", "test_completes": "first_test_complete_ts", "store_redirects": "app_store_redirect_ts"}
    pairs = F.stack(F.lit(3), *[x for m, c in measures.items() for x in (F.lit(m), F.col(c))]).alias("measure", "ts")
    rows = web_stages.select("market", "device_category", channel(F.col("last_touch_campaign")).alias("channel"), pairs).filter("ts IS NOT NULL")
    return rows.groupBy(F.to_date("ts").alias("day_date"), "market", "device_category", "channel").agg(*[n(F.col("measure") == m).alias(m) for m in measures])


def journey_daily_cube(journeys: DataFrame) -> DataFrame:
    return journeys.groupBy(F.to_date("first_open_ts").alias("day_date"), "acquisition_channel", "market", "platform").agg(
        F.countDistinct("hashed_id").alias("downloads"), n(F.col("is_paired")).alias("paired_users"), n(~F.col("censored")).alias("d30_eligible"), n(retained()).alias("d30_retained")
    )


def weekly(cube: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    return cube.groupBy(week("day_date").alias("week_start")).agg(*[F.sum(m).alias(m) for m in measures])
