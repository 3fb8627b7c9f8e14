"""Filterable dashboard queries over the two day-grain cubes.

A filter that a cube does not carry is not applied to that cube's cards.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.scratch import keep, shared_folder

from .gold import ratio, week

#: Which column of a cube each filter means.
WEB = {"market": "market", "channel": "channel", "device": "device_category"}
APP = {"market": "market", "channel": "acquisition_channel", "platform": "platform"}
UNITS = {"day": "days", "week": "weeks", "month": "months"}


@dataclass(frozen=True)
class Filters:
    date_start: str | None = None
    date_end: str | None = None
    market: str | None = None
    channel: str | None = None
    device: str | None = None
    platform: str | None = None


def predicate(filters: Filters, columns: dict[str, str]) -> Column:
    out = F.lit(True)
    if filters.date_start:
        out &= F.col("day_date") >= F.to_date(F.lit(filters.date_start))
    if filters.date_end:
        out &= F.col("day_date") <= F.to_date(F.lit(filters.date_end))
    for name, column in columns.items():
        if (value := getattr(filters, name)) is not None:
            out &= F.col(column) == value
    return out


def known_values(web: DataFrame, app: DataFrame) -> DataFrame:
    """(filter, value): what each filter accepts."""
    both = [web.select(F.lit(k).alias("filter"), F.col(c).alias("value")) for k, c in WEB.items()] + [app.select(F.lit(k).alias("filter"), F.col(c).alias("value")) for k, c in APP.items()]
    return reduce(DataFrame.unionByName, both).filter("value IS NOT NULL").distinct()


def validate(filters: Filters, web: DataFrame, app: DataFrame) -> None:
    """Raise ValueError naming the field and the known values."""
    if filters.date_start and filters.date_end and filters.date_start > filters.date_end:
        raise ValueError(f"date_start {filters.date_start} is after date_end {filters.date_end}")
    asked = {f.name: v for f in fields(filters) if f.name in {*WEB, *APP} and (v := getattr(filters, f.name)) is not None}
    if not asked:
        return
    known: dict[str, list[str]] = {}
    for r in known_values(web, app).filter(F.col("filter").isin(list(asked))).collect():  # a cube's dimensions: small by design
        known.setdefault(r["filter"], []).append(r["value"])
    for name, value in asked.items():
        if value not in known.get(name, []):
            raise ValueError(f"{name}: unknown value {value!r}; known: {', '.join(sorted(known.get(name, [])))}")


def horizon(web: DataFrame, app: DataFrame) -> DataFrame:
    return web.select("event_timestamp").unionByName(app.select("event_timestamp")).agg(F.max("event_timestamp").alias("horizon"))


def relative_range(horizon_row: DataFrame, count: int, unit: str) -> DataFrame:
    """start, end: the last ``count`` units up to the horizon, both ends included."""
    end, unit = F.to_date("horizon"), unit.rstrip("s")
    if unit not in UNITS or count < 1:
        raise ValueError(f"unsupported range: {count} {unit}")
    start = F.add_months(end, -count) if unit == "month" else F.date_sub(end, count * (7 if unit == "week" else 1))
    return horizon_row.select(start.alias("start"), end.alias("end"))


@dataclass
class Board:
    """The cards under one set of filters."""

    web_cube: DataFrame
    app_cube: DataFrame
    filters: Filters = Filters()

    def __post_init__(self) -> None:
        self.web = self.web_cube.filter(predicate(self.filters, WEB))
        self.app = self.app_cube.filter(predicate(self.filters, APP))

    def totals(self) -> DataFrame:
        sums = lambda df, names: df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
        return sums(self.web, ("test_starts", "test_completes", "store_redirects")).crossJoin(sums(self.app, ("downloads", "paired_users", "d30_eligible", "d30_retained")))

    def funnel_stages(self) -> DataFrame:
        names = ("test_starts", "test_completes", "store_redirects")
        return self.totals().select(F.stack(F.lit(3), *[x for i, c in enumerate(names) for x in (F.lit(c), F.lit(i + 1), F.col(c))]).alias("stage", "stage_order", "users"))

    def step_conversions(self) -> DataFrame:
        steps = (("start -> complete", "test_starts", "test_completes"), ("complete -> store redirect", "test_completes", "store_redirects"))
        rows = [x for i, (s, a, b) in enumerate(steps) for x in (F.lit(s), F.lit(i + 1), F.col(a), F.col(b))]
        return self.totals().select(F.stack(F.lit(2), *rows).alias("step", "step_order", "from_users", "to_users")).withColumn("conversion_rate", ratio("to_users", "from_users"))

    def rates(self, df: DataFrame, by: tuple[str, ...], below: str, above: str, rate: str) -> DataFrame:
        return df.groupBy(*by).agg(F.sum(below).alias(below), F.sum(above).alias(above)).withColumn(rate, ratio(above, below))

    def completion_by_channel(self) -> DataFrame:
        return self.rates(self.web, ("channel",), "test_starts", "test_completes", "completion_rate")

    def completion_by_device(self) -> DataFrame:
        return self.rates(self.web, ("device_category",), "test_starts", "test_completes", "completion_rate")

    def completion_channel_device(self) -> DataFrame:
        return self.rates(self.web, ("channel", "device_category"), "test_starts", "test_completes", "completion_rate")

    def downloads_by_channel(self) -> DataFrame:
        return self.app.groupBy("acquisition_channel").agg(F.sum("downloads").alias("downloads"))

    def pairing_by_channel(self) -> DataFrame:
        return self.rates(self.app, ("acquisition_channel",), "downloads", "paired_users", "pairing_rate")

    def pairing_by_platform_market(self) -> DataFrame:
        return self.rates(self.app, ("market", "platform"), "downloads", "paired_users", "pairing_rate")

    def d30_by_channel(self) -> DataFrame:
        return self.rates(self.app, ("acquisition_channel",), "d30_eligible", "d30_retained", "d30_retention_rate")

    def weekly_test_starts(self) -> DataFrame:
        return self.web.groupBy(week("day_date").alias("week_start")).agg(F.sum("test_starts").alias("test_starts"))

    CARDS = ("funnel_stages", "step_conversions", "completion_by_channel", "completion_by_device", "completion_channel_device", "downloads_by_channel", "pairing_by_channel", "pairing_by_platform_market", "d30_by_channel", "weekly_test_starts")

    def run(self) -> DataFrame:
        """All cards in long form: card, dims (joined by |), measure, value, and the applied range (start, end, label).

        The filtered cubes are written once and read by every card.
        """
        folder = shared_folder(self.web.sparkSession)
        self.web, self.app = keep(self.web, folder, "web"), keep(self.app, folder, "app")
        start, end = self.filters.date_start, self.filters.date_end
        applied = {"start": F.lit(start).cast("date"), "end": F.lit(end).cast("date"), "label": F.lit(f"{start or 'first day'} to {end or 'last day'}" if start or end else "all days")}
        out = []
        for card in self.CARDS:
            df = getattr(self, card)()
            dims = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "date")]
            values = [c for c in df.columns if c not in dims and not c.endswith("_order")]
            pairs = [x for v in values for x in (F.lit(v), F.col(v).cast("double"))]
            label = F.concat_ws("|", *[F.coalesce(F.col(d).cast("string"), F.lit("")) for d in dims])
            out.append(df.select(F.lit(card).alias("card"), label.alias("dims"), F.stack(F.lit(len(values)), *pairs).alias("measure", "value")))
        return reduce(DataFrame.unionByName, out).withColumns(applied)

    def headline(self) -> DataFrame:
        t = self.totals().select("test_starts", "test_completes", "store_redirects", "downloads", "paired_users")
        return t.withColumn("completion_rate", ratio("test_completes", "test_starts"))


def extremes(card: DataFrame, group: str, measure: str) -> DataFrame:
    """Top and bottom group of a card by its measure (ties: the first by name), and the number of groups."""
    up, down = (F.struct(v.alias("v"), F.col(group).alias("g")) for v in (F.col(measure), -F.col(measure)))
    rows = card.filter(F.col(measure).isNotNull()).agg(F.min(down).alias("t"), F.min(up).alias("b"), F.count("*").alias("groups"))
    return rows.select(F.col("t.g").alias("top_group"), (-F.col("t.v")).alias("top_value"), F.col("b.g").alias("bottom_group"), F.col("b.v").alias("bottom_value"), "groups")


def trend(card: DataFrame, time: str, measure: str) -> DataFrame:
    """First and last value, number of periods, direction."""
    out = card.agg(F.min_by(measure, time).alias("first_value"), F.max_by(measure, time).alias("last_value"), F.count("*").alias("periods"))
    return out.withColumn("direction", F.when(F.col("last_value") > F.col("first_value"), "up").when(F.col("last_value") < F.col("first_value"), "down").otherwise("flat"))
