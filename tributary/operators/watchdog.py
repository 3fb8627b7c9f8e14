"""Statistical watchdog: trailing control bands, drift against a registry, severity roll-up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .gold import n

FINDING = ("check", "severity", "subject", "direction", "z", "message", "details")
# Severities, worst last, and the exit codes they mean.
RANK = {"info": 1, "warning": 2, "critical": 3}
EXIT = {"none": 0, "info": 0, "warning": 1, "critical": 2}
Day = Column  # the as-of day: a date, such as the scalar of ``default_day``


@dataclass(frozen=True)
class Thresholds:
    info: float = 1.5
    warning: float = 2.5
    critical: float = 4.0
    history: int = 14
    floor: float = 5.0
    band: int = 28
    maturity_days: int = 6


def default_day(web: DataFrame, app: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The last mature day: the latest event day less the maturity buffer."""
    both = web.select("event_timestamp").unionByName(app.select("event_timestamp"))
    return both.agg(F.date_sub(F.to_date(F.max("event_timestamp")), t.maturity_days).alias("as_of"))


def band(series: DataFrame, keys: list[str], value: str, rows: int) -> DataFrame:
    """Mean, deviation and count of the ``rows`` rows before each, the band around the mean, and the value's z."""
    w = W.partitionBy(*keys).orderBy("day").rowsBetween(-rows, -1)
    out = series.withColumns({"band_avg": F.avg(value).over(w), "band_stddev": F.stddev(value).over(w), "band_days": F.count(value).over(w)})
    spread = F.coalesce("band_stddev", F.lit(0.0))
    z = F.when(F.col("band_stddev").isNull() | (F.col("band_stddev") == 0), None).otherwise((F.col(value) - F.col("band_avg")) / F.col("band_stddev"))
    return out.withColumns({"band_lower": F.col("band_avg") - spread, "band_upper": F.col("band_avg") + spread, "deviation_z": z})


def event_volumes(web: DataFrame, app: DataFrame, as_of: Day, t: Thresholds = Thresholds()) -> DataFrame:
    """Daily counts by event, segment and source on the day, against the rows before."""
    parts = [(web, "country", "web"), (app, "platform", "app")]
    daily = [
        df.filter(F.to_date("event_timestamp") <= as_of).groupBy(F.to_date("event_timestamp").alias("day"), "event_name", F.col(seg).alias("segment")).agg(F.count("*").alias("actual_count")).withColumn("source", F.lit(name))
        for df, seg, name in parts
    ]
    rows = reduce(DataFrame.unionByName, daily)
    return band(rows, ["event_name", "segment", "source"], "actual_count", t.band).filter(F.col("day") == as_of)


def funnel_rates(web: DataFrame, app: DataFrame, eligible: DataFrame, as_of: Day, t: Thresholds = Thresholds()) -> DataFrame:
    """Same-day activity ratios of event counts: start -> complete, complete -> download (linked population), download -> pair."""
    day, upto = F.to_date("event_timestamp").alias("day"), F.to_date("event_timestamp") <= as_of
    name = F.col("event_name")
    w = web.filter(upto).groupBy(day).agg(n(name == "hearing_test_start").alias("starts"), n(name == "hearing_test_complete").alias("completes"))
    a = app.filter(upto).groupBy(day).agg(n(name == "app_open").alias("opens"), n(name == "hearing_aid_paired").alias("pairs"))
    lw = web.filter(upto & (name == "hearing_test_complete")).join(eligible.select("web_pseudo_id"), F.col("user_pseudo_id") == F.col("web_pseudo_id")).groupBy(day).agg(F.count("*").alias("done"))
    la = app.filter(upto & (name == "app_open")).join(eligible.select("app_device_id"), F.col("hashed_device_id") == F.col("app_device_id")).groupBy(day).agg(F.count("*").alias("got"))
    step = lambda df, s, x, y: df.select("day", F.lit(s).alias("step"), F.coalesce(x, F.lit(0)).alias("from_count"), F.coalesce(y, F.lit(0)).alias("to_count")).filter("from_count > 0 OR to_count > 0")
    rows = step(w, "start_to_complete", "starts", "completes").unionByName(step(lw.join(la, "day", "full"), "complete_to_download", "done", "got")).unionByName(step(a, "download_to_pair", "opens", "pairs"))
    rows = rows.withColumn("conversion_rate", F.col("to_count").cast("double") / F.nullif("from_count", F.lit(0)))
    return band(rows, ["step"], "conversion_rate", t.band).filter(F.col("day") == as_of)


def severity(z: Column, t: Thresholds) -> Column:
    return F.when(F.abs(z) >= t.critical, "critical").when(F.abs(z) >= t.warning, "warning").when(F.abs(z) >= t.info, "info")


def facts(**columns: Column) -> Column:
    """Details of a finding: a map of strings, numbers with a fraction to six places."""
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))])


def six(c: str) -> Column:
    return F.format_string("%.6f", F.col(c).cast("double"))


def band_findings(bands: DataFrame, check: str, subject: Column, signal: Column, actual: Column, details: Column, t: Thresholds = Thresholds()) -> DataFrame:
    """Findings on the ladder; none where z is missing, the history is short or the volume is below the floor."""
    z = F.col("deviation_z")
    out = bands.filter(z.isNotNull() & (F.col("band_days") >= t.history) & (signal >= t.floor)).withColumn("severity", severity(z, t)).filter("severity IS NOT NULL")
    direction = F.when(z >= 0, "above").otherwise("below")
    told = F.format_string("%s on %s: %s, %.2f deviations %s its mean of %.3f over the %d rows before", subject, F.col("day").cast("string"), actual, F.abs(z), direction, F.col("band_avg"), F.col("band_days"))
    return out.select(F.lit(check).alias("check"), "severity", subject.alias("subject"), direction.alias("direction"), z.alias("z"), told.alias("message"), details.alias("details"))


BAND = ("band_avg", "band_stddev", "deviation_z")


def volume_findings(bands: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    details = facts(**{c: F.col(c) for c in ("day", "event_name", "segment", "source", "actual_count", "band_days")}, **{c: six(c) for c in BAND})
    subject = F.concat_ws(":", "source", "event_name", "segment")
    return band_findings(bands, "daily_event_volume", subject, F.greatest(F.col("actual_count").cast("double"), "band_avg"), F.format_string("%d events", "actual_count"), details, t)


def rate_findings(bands: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    details = facts(**{c: F.col(c) for c in ("day", "step", "from_count", "to_count", "band_days")}, actual_rate=six("conversion_rate"), **{c: six(c) for c in BAND})
    actual = F.format_string("a rate of %.3f (%d of %d)", F.col("conversion_rate"), F.col("to_count"), F.col("from_count"))
    return band_findings(bands, "daily_funnel_rate", F.concat(F.lit("rate:"), "step"), F.col("from_count"), actual, details, t)


def schema_snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString(), i + 1) for t, df in tables.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal_position int")


def observed_values(web: DataFrame, app: DataFrame) -> DataFrame:
    """kind, table_name, value: event names of each table, app versions."""
    names = [df.select(F.lit("event_name").alias("kind"), F.lit(t).alias("table_name"), F.col("event_name").alias("value")) for t, df in (("web_events", web), ("app_events", app))]
    return names[0].unionByName(names[1]).unionByName(app.select(F.lit("app_version").alias("kind"), F.lit("app_events").alias("table_name"), F.col("app_version").alias("value"))).distinct()


def _finding(df: DataFrame, check: str, level: Column, subject: Column, direction: Column, message: Column, details: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), level.alias("severity"), subject.alias("subject"), direction.alias("direction"), F.lit(None).cast("double").alias("z"), message.alias("message"), details.alias("details"))


def column_drift(live: DataFrame, expected: DataFrame) -> DataFrame:
    """live, expected: table_name, column_name, data_type; only tables that are expected count."""
    live = live.join(expected.select("table_name").distinct(), "table_name", "left_semi")
    both = live.select("table_name", "column_name", F.col("data_type").alias("now")).join(expected.select("table_name", "column_name", F.col("data_type").alias("then")), ["table_name", "column_name"], "full")
    what = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("then"), "type_changed")
    both = both.withColumn("what", what).filter("what IS NOT NULL")
    told = F.concat(F.lit("column "), F.concat_ws(".", "table_name", "column_name"), F.lit(": expected "), F.coalesce("then", F.lit("none")), F.lit(", there is "), F.coalesce("now", F.lit("none")))
    details = facts(table=F.col("table_name"), column=F.col("column_name"), kind=F.col("what"))
    types = facts(expected_type=F.col("then"), actual_type=F.col("now"))
    details = F.when(F.col("what") == "type_changed", F.map_concat(details, types)).otherwise(details)
    return _finding(both, "schema_columns", F.when(F.col("what") == "missing", "critical").otherwise("warning"), F.concat(F.lit("column:"), F.concat_ws(".", "table_name", "column_name")), F.col("what"), told, details)


def event_drift(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """New or vanished event names, for tables that the registry (table_name, value) knows."""
    seen = observed.filter("kind = 'event_name'").join(expected.select("table_name").distinct(), "table_name", "left_semi").select("table_name", "value", F.lit(True).alias("now"))
    both = seen.join(expected.select("table_name", "value", F.lit(True).alias("then")), ["table_name", "value"], "full").filter("now IS NULL OR then IS NULL")
    gone = F.col("now").isNull()
    what = F.when(gone, "vanished").otherwise("new")
    told = F.concat(F.lit("event "), F.col("value"), F.when(gone, " is expected and stands in no row of ").otherwise(" is not expected and stands in "), F.col("table_name"))
    details = facts(table=F.col("table_name"), event_name=F.col("value"), kind=what)
    return _finding(both, "schema_event_names", F.when(gone, "critical").otherwise("warning"), F.concat(F.lit("event_name:"), F.concat_ws(".", "table_name", "value")), what, told, details)


def version_drift(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """New app versions only: that an old one goes is healthy."""
    new = observed.filter("kind = 'app_version'").join(expected, "value", "left_anti")
    told = F.concat(F.lit("app version "), F.col("value"), F.lit(" is not expected"))
    return _finding(new, "schema_app_versions", F.lit("warning"), F.concat(F.lit("app_version:"), "value"), F.lit("new"), told, facts(app_version=F.col("value"), kind=F.lit("new")))


def missing_events(web: DataFrame, app: DataFrame, expected: DataFrame, as_of: Day) -> DataFrame:
    """Expected events (table_name, value) without a row on the day."""
    on = F.to_date("event_timestamp") == as_of
    seen = [df.filter(on).select(F.lit(t).alias("table_name"), F.col("event_name").alias("value")) for t, df in (("web_events", web), ("app_events", app))]
    gone = expected.join(seen[0].unionByName(seen[1]).distinct(), ["table_name", "value"], "left_anti").withColumn("as_of", as_of.cast("string"))
    told = F.concat(F.lit("event "), F.col("value"), F.lit(" is expected and has no row in "), F.col("table_name"), F.lit(" on "), F.col("as_of"))
    details = facts(table=F.col("table_name"), event_name=F.col("value"), as_of=F.col("as_of"))
    return _finding(gone, "missing_event_today", F.lit("critical"), F.concat(F.lit("missing_today:"), F.concat_ws(".", "table_name", "value")), F.lit("absent"), told, details)


def rank(c: str = "severity") -> Column:
    return F.when(F.col(c) == "critical", 3).when(F.col(c) == "warning", 2).otherwise(1)


def combine(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings).orderBy(rank().desc(), "check", "subject")


def roll_up(findings: DataFrame) -> DataFrame:
    """Counts per severity, the worst one, the exit code, distinct checks, the first three subjects of the worst severity."""
    one = findings.agg(*[n(F.col("severity") == s).alias(s) for s in RANK], F.max(rank()).alias("r"), F.countDistinct("check").alias("checks"))
    worst = F.when(F.col("r") == 3, "critical").when(F.col("r") == 2, "warning").when(F.col("r") == 1, "info").otherwise("none")
    top = findings.withColumn("i", F.row_number().over(W.orderBy(rank().desc(), "check", "subject"))).filter("i <= 3").select("subject", "i", rank().alias("k"))
    names = top.agg(F.max("k").alias("kk"), F.collect_list(F.struct("i", "k", "subject")).alias("rows"))
    names = names.select(F.concat_ws(",", F.transform(F.array_sort(F.filter("rows", lambda x: x["k"] == F.col("kk"))), lambda x: x["subject"])).alias("top"))
    code = F.create_map(*[F.lit(x) for item in EXIT.items() for x in item])[F.col("worst")]
    return one.withColumn("worst", worst).withColumn("exit_code", code).drop("r").crossJoin(names)


# What a stored registry calls the thresholds.
THRESHOLDS = {"band_multiplier_info": "info", "band_multiplier_warning": "warning", "band_multiplier_critical": "critical", "min_volume_floor": "floor", "min_history_days": "history"}
STORED = "as_of_reference string, expected_schema map<string, struct<columns: map<string, string>>>, expected_event_names map<string, array<string>>, expected_app_versions array<string>, thresholds map<string, double>"


def registry(tables: dict[str, DataFrame], web: DataFrame, app: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """The present state as a registry: kind, table_name, values (sorted); thresholds belong to no table."""
    columns = schema_snapshot(tables).select(F.lit("column").alias("kind"), "table_name", F.concat_ws(":", "column_name", "data_type").alias("value"))
    limits = web.sparkSession.createDataFrame([("threshold", "", f"{k}:{float(getattr(t, v))}") for k, v in THRESHOLDS.items()], "kind string, table_name string, value string")
    return columns.unionByName(observed_values(web, app)).unionByName(limits).groupBy("kind", "table_name").agg(F.array_sort(F.collect_set("value")).alias("values"))


def store(state: DataFrame, as_of: Day, path: str) -> None:
    """A registry (see ``registry``) as one JSON document; it is a row for each table and kind."""
    lists = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("table_name", "values"))))
    of = lambda kind, value: F.map_from_entries(F.transform(lists(kind), lambda x: F.struct(x["table_name"].alias("k"), value(x["values"]).alias("v"))))
    pairs = lambda v, f=lambda x: x: F.map_from_entries(F.transform(v, lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), f(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))))
    one = state.agg(
        of("column", lambda v: F.struct(pairs(v).alias("columns"))).alias("expected_schema"), of("event_name", lambda v: v).alias("expected_event_names"),
        F.first(F.when(F.col("kind") == "app_version", F.col("values")), ignorenulls=True).alias("expected_app_versions"),
        F.first(F.when(F.col("kind") == "threshold", pairs("values", lambda x: x.cast("double"))), ignorenulls=True).alias("thresholds"),
    )
    one.withColumn("as_of_reference", as_of.cast("string")).select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Registry:
    columns: DataFrame  # table_name, column_name, data_type
    events: DataFrame  # table_name, value
    versions: DataFrame  # value
    thresholds: Thresholds


def read_registry(spark: SparkSession, path: str) -> Registry:
    """A stored registry; thresholds that it lacks have their usual values."""
    one = spark.read.text(path, wholetext=True).select(F.from_json("value", STORED).alias("r")).select("r.*")
    tables = one.select(F.explode("expected_schema").alias("table_name", "s"))
    limits = one.select("thresholds").first()["thresholds"] or {}
    known = {f: limits[k] for k, f in THRESHOLDS.items() if k in limits}
    return Registry(
        tables.select("table_name", F.explode("s.columns").alias("column_name", "data_type")),
        one.select(F.explode("expected_event_names").alias("table_name", "v")).select("table_name", F.explode("v").alias("value")),
        one.select(F.explode("expected_app_versions").alias("value")), Thresholds(**known),
    )
