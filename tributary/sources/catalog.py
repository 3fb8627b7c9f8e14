"""The whole build as catalog objects: commented tables in three schemas, and the consent gate as a commented view over its table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tributary.sources import load
from tributary.sources.binding import Tables

LAYERS = ("bronze", "silver", "gold")


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@dataclass
class Catalog:
    """Schemas ``<prefix><layer>``; every object is known by (layer, name).

    A table is written beside the one that stands, and takes its name only when as many rows can be read from it as an observation of the write has counted.
    So a rebuild may read the tables that it replaces, and one that breaks off leaves them as they were; what it left behind is written over by the next one.
    """

    spark: SparkSession
    prefix: str = ""
    objects: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for layer in LAYERS:
            self.spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{self.prefix}{layer}`")

    def name(self, layer: str, name: str) -> str:
        return f"`{self.prefix}{layer}`.`{name}`"

    def read(self, layer: str, name: str) -> DataFrame:
        return self.spark.table(self.name(layer, name))

    def table(self, layer: str, name: str, rows: DataFrame, comment: str) -> DataFrame:
        """The rows as they can be read from the table that now holds them."""
        new, seen = f"{name}__new", Observation()
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(layer, new)}")
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").saveAsTable(self.name(layer, new))
        there = self.read(layer, new).count()  # from the footers
        if there != seen.get["n"]:
            raise RuntimeError(f"row counts differ: {layer}.{name} was given {seen.get['n']} rows and holds {there}")
        self.spark.sql(f"COMMENT ON TABLE {self.name(layer, new)} IS {quoted(comment)}")
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name(layer, name)}")
        self.spark.sql(f"ALTER TABLE {self.name(layer, new)} RENAME TO {self.name(layer, name)}")
        return self._known(layer, name)

    def view(self, layer: str, name: str, query: str, comment: str) -> DataFrame:
        """A view by ``query`` over tables of the catalog: it holds no rows, and sees each rebuild of what it reads."""
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name(layer, name)} COMMENT {quoted(comment)} AS {query}")
        return self._known(layer, name)

    def _known(self, layer: str, name: str) -> DataFrame:
        if (layer, name) not in self.objects:
            self.objects.append((layer, name))
        return self.read(layer, name)

    def inventory(self) -> DataFrame:
        """layer, name, kind (table or view), comment, columns, rows of every object of this catalog; tables are counted by their footers."""
        about = []
        for layer, name in self.objects:  # a row per object
            t = self.spark.catalog.getTable(self.name(layer, name))
            about.append((layer, name, "view" if t.tableType == "VIEW" else "table", t.description or "", ",".join(self.read(layer, name).columns)))
        known = self.spark.createDataFrame(about, "layer string, name string, kind string, comment string, columns string")
        counted = load.counts({f"{layer}.{name}": self.read(layer, name) for layer, name in self.objects})
        return known.join(counted, F.concat_ws(".", "layer", "name") == F.col("table")).drop("table")

    def drop(self) -> None:
        for layer in LAYERS:
            self.spark.sql(f"DROP SCHEMA IF EXISTS `{self.prefix}{layer}` CASCADE")


#: What the catalog says of each object.
COMMENTS = {
    "web_events": "Web events as delivered, one row per event",
    "app_events": "App events as delivered, one row per event",
    "id_bridge": "Pairs of a web user and an app device, and whether the user opted in",
    "web_user_stages": "First time of each web stage and last campaign, one row per user",
    "app_user_stages": "First open, pairing and retention, one row per device that opened",
    "v_attribution_eligible": "The consent gate: the only rows by which users and devices may be linked",
    "linked_journeys": "Completed tests followed by a later first open, linked through the consent gate",
    "funnel_overview": "Users at each of five stages",
    "step_conversion": "Conversion from each stage to the next",
    "completion_by_channel": "Tests completed of those started, by last campaign",
    "completion_by_device": "Tests completed of those started, by device category",
    "downloads_by_channel": "Linked downloads by acquisition channel",
    "pairing_by_channel": "Paired users of linked downloads, by acquisition channel",
    "pairing_by_platform_market": "Paired devices by market and platform",
    "d30_by_channel": "Retained users of those observed long enough, by acquisition channel",
    "weekly_test_starts": "Tests started by week",
    "linkable_share_by_market": "Users that can be linked of those redirected, by market",
    "attribution_first_vs_last": "Downloads by channel under first and last touch",
    "completion_by_channel_device": "Tests completed of those started, by channel and device category",
    "web_funnel_daily_cube": "Web measures by day, market, device category and channel",
    "journey_daily_cube": "Measures of linked journeys by day, channel, market and platform",
}


def publish(t: Tables, marts: dict[str, Callable[[Tables], DataFrame]], prefix: str = "") -> Catalog:
    """Every layer as catalog objects, each built from the objects below it; a table that does not hold all its rows stops the build."""
    catalog, t = Catalog(t.spark, prefix), t.with_events()
    out = Tables(t.spark, t.sf_dir, t.retention)
    held = lambda layer, name, rows: catalog.table(layer, name, rows, COMMENTS[name])
    out.web, out.app, out.bridge = held("bronze", "web_events", t.web), held("bronze", "app_events", t.app), held("bronze", "id_bridge", t.bridge)
    out.web_stages, out.app_stages = held("silver", "web_user_stages", out.web_stages), held("silver", "app_user_stages", out.app_stages)
    gate = "v_attribution_eligible"
    out.eligible = catalog.view("silver", gate, f"SELECT * FROM {catalog.name('bronze', 'id_bridge')} WHERE opt_in_flag", COMMENTS[gate])
    out.journeys = held("silver", "linked_journeys", out.journeys)
    for name, mart in marts.items():
        held("gold", name, mart(out))
    return catalog
