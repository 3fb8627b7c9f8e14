"""The three event tables (web events, app events, identity bridge), derived from the driver's star schema.

An entity is a user and a tenth of ``k`` from the event's properties; see FIXTURES.md for the specification.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.operators import silver
from tributary.operators.silver import Retention
from tributary.scratch import keep, shared_folder

#: The driver's tables that the event tables are derived from.
RAW = ("events", "customer", "nation", "region")
#: The driver's data span 30 days.
DRIVER_RETENTION = Retention(7, 14, 13)


def pick(on: Column, cases: dict, other: str | None = None) -> Column:
    out = None
    for k, v in cases.items():
        out = F.when(on == k, v) if out is None else out.when(on == k, v)
    return out.otherwise(other)


def funnel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event with funnel attributes."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    people = (
        read("customer").select("c_custkey", "c_nationkey", "c_acctbal")
        .join(read("nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region").select("r_regionkey", "r_name"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("c_custkey", F.col("r_name").alias("country"), F.when(F.col("c_acctbal") >= 3000, "granted").otherwise("denied").alias("consent_state"))
    )
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    tenth = F.floor(F.col("k") / 10).cast("int")
    events = read("events").select("event_id", "ts", "event_type", "user_id", k.alias("k"))
    return events.join(people, F.col("c_custkey") == F.col("user_id")).select(
        "event_id", "ts", "event_type", "k", F.concat(F.col("user_id").cast("string"), F.lit("-"), tenth.cast("string")).alias("eid"),
        pick(F.col("k") % 5, {0: "summer_hearing_meta", 1: "tiktok_awareness", 2: "brand_search", 3: "retargeting_meta"}).alias("utm_campaign"),
        pick(F.col("user_id") % 3, {0: "desktop", 1: "mobile"}, "tablet").alias("device_category"), "country", "consent_state",
        F.when(tenth % 2 == 0, "iOS").otherwise("Android").alias("platform"), pick(F.col("event_id") % 3, {0: "6.2.1", 1: "6.3.0"}, "6.3.1").alias("app_version"),
    )


@dataclass
class Tables:
    """All layers over one data directory; each is built when it is first asked for."""

    spark: SparkSession
    sf_dir: str
    retention: Retention = DRIVER_RETENTION

    @cached_property
    def events(self) -> DataFrame:
        return funnel_events(self.spark, self.sf_dir)

    @cached_property
    def web(self) -> DataFrame:
        name = pick(F.col("event_type"), {"view": "app_store_redirect", "click": "hearing_test_start"}, "hearing_test_complete")
        web = self.events.filter(F.col("event_type").isin("view", "click", "signup"))
        return web.select("event_id", F.col("eid").alias("user_pseudo_id"), name.alias("event_name"), F.col("ts").alias("event_timestamp"), "utm_campaign", "device_category", "country", "consent_state")

    @cached_property
    def app(self) -> DataFrame:
        name = pick(F.col("event_type"), {"purchase": "app_open"}, "hearing_aid_paired")
        app = self.events.filter(F.col("event_type").isin("purchase", "error"))
        return app.select("event_id", F.col("eid").alias("hashed_device_id"), "platform", name.alias("event_name"), F.col("ts").alias("event_timestamp"), "app_version")

    @cached_property
    def bridge(self) -> DataFrame:
        e, web = self.events, F.col("event_type").isin("view", "click", "signup")
        one = e.groupBy("eid").agg(
            F.min(F.when(web, F.col("country"))).alias("market"), F.min(F.when(web, F.col("consent_state"))).alias("consent"),
            F.min(F.when(web, F.struct("ts", "event_id", "utm_campaign"))).alias("first"), F.max((F.col("event_type") == "signup").cast("int")).alias("done"),
            F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("first_open"),
        )
        one = one.filter((F.col("done") == 1) & F.col("first_open").isNotNull())
        return one.select(
            F.md5("eid").alias("hashed_id"), "market", (F.col("consent") == "granted").alias("opt_in_flag"), silver.channel(F.col("first.utm_campaign")).alias("acquisition_channel"),
            F.col("eid").alias("web_pseudo_id"), F.col("eid").alias("app_device_id"), (F.col("first_open") + F.expr("INTERVAL 2 HOUR")).alias("linked_at"),
        )

    @cached_property
    def support(self) -> DataFrame:
        """Support sessions: like pairings, they are stood in for by error events (those with k below 30)."""
        return self.events.filter((F.col("event_type") == "error") & (F.col("k") < 30)).select("event_id", F.col("eid").alias("hashed_device_id"), F.col("ts").alias("event_timestamp"))

    def with_events(self) -> Tables:
        """The same tables with events written once, for jobs that read them many times."""
        out = Tables(self.spark, self.sf_dir, self.retention)
        out.events = keep(self.events, shared_folder(self.spark), "events")
        return out

    def materialised(self) -> Tables:
        """The same tables with events and stages written once, for jobs that read them many times."""
        folder = shared_folder(self.spark)
        out = Tables(self.spark, self.sf_dir, self.retention)
        out.events = keep(self.events, folder, "events")
        for name in ("bridge", "web_stages", "app_stages", "journeys"):
            setattr(out, name, keep(getattr(out, name), folder, name))
        return out

    @cached_property
    def web_stages(self) -> DataFrame:
        return silver.web_user_stages(self.web)

    @cached_property
    def app_stages(self) -> DataFrame:
        return silver.app_user_stages(self.app, self.retention)

    @cached_property
    def eligible(self) -> DataFrame:
        return silver.attribution_eligible(self.bridge)

    @cached_property
    def journeys(self) -> DataFrame:
        return silver.linked_journeys(self.eligible, self.web_stages, self.app_stages)
