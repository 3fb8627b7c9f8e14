"""Bronze loading, reconciliation, verification, and governed reads."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

NANOS = "spark.sql.legacy.parquet.nanosAsLong"


def bronze(spark: SparkSession, source: str, tables: list[str], prefix: str = "bronze_") -> dict[str, DataFrame]:
    """The raw tables as they are, each registered as the view ``prefix`` + its name."""
    out = {t: spark.read.parquet(f"{source}/{t}.parquet") for t in tables}
    for t, df in out.items():
        df.createOrReplaceTempView(f"{prefix}{t}")
    return out


def load_tables(spark: SparkSession, source: str, tables: list[str], schema: str, nanos: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The raw tables written to ``schema`` and read back.

    ``nanos`` names each table's columns of nanosecond timestamps, which Spark only reads as numbers: they become microseconds.
    A table whose count differs from its source's stops the load.
    """
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS `{schema}`")
    before, whole = spark.conf.get(NANOS), {}
    spark.conf.set(NANOS, "true")
    try:
        for t in tables:
            raw = spark.read.parquet(f"{source}/{t}.parquet")
            times = {c: F.timestamp_micros(F.expr(f"`{c}` div 1000")).cast("timestamp_ntz") for c in (nanos or {}).get(t, [])}
            raw.withColumns(times).write.mode("overwrite").saveAsTable(f"`{schema}`.`{t}`") if times else raw.write.mode("overwrite").saveAsTable(f"`{schema}`.`{t}`")
            spark.sql(f"COMMENT ON TABLE `{schema}`.`{t}` IS 'as delivered'")
            whole[t] = raw.count()
    finally:
        spark.conf.set(NANOS, before)
    loaded = {t: spark.table(f"`{schema}`.`{t}`") for t in tables}
    source_rows = {t: spark.range(1).select(F.lit(n).cast("long").alias("source_rows"), F.lit(t).alias("table")) for t, n in whole.items()}
    require(_agree(reduce(DataFrame.unionByName, source_rows.values()), loaded))
    return loaded


def counts(tables: dict[str, DataFrame], name: str = "rows") -> DataFrame:
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias(name)).select(F.lit(t).alias("table"), name) for t, df in tables.items()])


def _agree(source: DataFrame, loaded: dict[str, DataFrame]) -> DataFrame:
    both = source.join(counts(loaded, "loaded_rows"), "table", "full")
    return both.withColumn("ok", F.col("source_rows").eqNullSafe(F.col("loaded_rows")))


def reconcile(source: dict[str, DataFrame], loaded: dict[str, DataFrame]) -> DataFrame:
    """table, source_rows, loaded_rows, ok."""
    return _agree(counts(source, "source_rows"), loaded)


def require(reconciled: DataFrame) -> None:
    """Stop what comes after when a table did not load whole."""
    bad = [r["table"] for r in reconciled.filter("NOT ok").collect()]
    if bad:
        raise RuntimeError(f"row counts differ: {', '.join(sorted(bad))}")


#: What a governed statement may be made of, as Spark's parser names it: relational operators without side effects.
OPERATORS = set(
    "Project Filter Aggregate UnresolvedHaving Sort GlobalLimit LocalLimit Offset Distinct Union Except Intersect Join SubqueryAlias "
    "UnresolvedSubqueryColumnAliases UnresolvedRelation UnresolvedWith WithWindowDefinition UnresolvedInlineTable LocalRelation OneRowRelation Pivot Unpivot Sample UnresolvedHint".split()
)
#: The functions that a governed statement may call.
FUNCTIONS = set(
    "count count_if sum avg mean min max min_by max_by median percentile percentile_approx approx_count_distinct stddev stddev_samp stddev_pop variance var_samp var_pop corr first last "
    "row_number rank dense_rank percent_rank ntile lag lead first_value last_value coalesce nullif ifnull nvl if greatest least abs round floor ceil ceiling sqrt exp ln log pow power mod sign "
    "lower upper trim ltrim rtrim length char_length substring substr concat concat_ws replace split like contains startswith endswith regexp_extract regexp_replace instr lpad rpad "
    "date_trunc to_date to_timestamp date_add date_sub add_months datediff months_between last_day year quarter month week weekofyear day dayofmonth dayofweek hour minute second date_format "
    "extract date_part current_date current_timestamp cast try_cast try_divide isnull isnotnull isnan between ilike rlike and or not in".split()
)


#: Rows that a governed read gives at most: asked directly, and as a tool.
DIRECT_ROWS, TOOL_ROWS = 5000, 200


@dataclass(frozen=True)
class Result:
    rows: list[Row]
    row_count: int
    truncated: bool  # whether the statement has more rows than these


def governed_rows(spark: SparkSession, sql: str, allowed: set[str], cap: int = TOOL_ROWS) -> Result:
    """The rows of a governed read, ``cap`` at most, their number, and whether there are more; a smaller LIMIT of the statement's own holds.

    One row more than the cap is asked for, and an observation of that read counts what came: the statement runs once.
    """
    seen = Observation()
    rows = governed(spark, sql, allowed, cap + 1).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    return Result(rows[:cap], min(seen.get["n"], cap), seen.get["n"] > cap)


def governed(spark: SparkSession, sql: str, allowed: set[str], cap: int = DIRECT_ROWS) -> DataFrame:
    """The rows of one read-only statement over allowed relations, ``cap`` at most.

    Spark's own parser reads the statement.  It may hold only OPERATORS and FUNCTIONS.  A name that WITH defines stands for its
    query only inside that WITH and for later queries of the same one; everywhere else, and in its own query, a name must be allowed.
    """
    allowed = {a.lower() for a in allowed}
    relations, others = set(), set()
    items = lambda seq: [seq.apply(i) for i in range(seq.size())]

    def function(e) -> None:  # noqa: ANN001
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and (name := e.nameParts().mkString(".").lower()) not in FUNCTIONS:
            others.add(name)
        elif kind == "UnresolvedGenerator":
            others.add("a table function")
        for c in items(e.children()):
            function(c)

    def walk(node, inner: frozenset[str]) -> None:  # noqa: ANN001
        kind = node.getClass().getSimpleName()
        if kind not in OPERATORS:
            others.add(kind)
            return
        if kind == "UnresolvedRelation":
            name = node.multipartIdentifier().mkString(".").lower()
            if name not in inner and name not in allowed:
                relations.add(name)
        elif kind == "UnresolvedWith":
            if node.allowRecursion():
                others.add("WITH RECURSIVE")
            for cte in items(node.cteRelations()):
                walk(cte._2(), inner)
                inner = inner | {cte._1().lower()}
        elif kind == "WithWindowDefinition":
            for e in items(node.windowDefinitions().values().toSeq()):
                function(e)
        for e in items(node.expressions()):
            function(e)
        for child in [*items(node.children()), *items(node.subqueries())]:
            walk(child, inner)

    walk(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset())
    if others:
        raise PermissionError(f"not allowed in a governed read: {', '.join(sorted(others))}")
    if relations:
        raise PermissionError(f"relations not allowed: {', '.join(sorted(relations))}")
    return spark.sql(sql).limit(cap)
