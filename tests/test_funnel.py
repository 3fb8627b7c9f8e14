"""Boundary fixtures of the silver layer, dashboard, watchdog, retrieval and governed reads."""

from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tributary import registry
from tributary.operators import analyses, conversation, dashboard, ordered, quality, retrieval, silver, watchdog
from tributary.scratch import shared_folder
from tributary.sources import load
from tributary.sources.binding import Tables

T0 = datetime(2024, 1, 1)
APP = "event_id long, hashed_device_id string, platform string, event_name string, event_timestamp timestamp_ntz, app_version string"


def app_rows(spark, rows):
    return spark.createDataFrame([(i, d, "iOS", e, t, "6.2.1") for i, (d, e, t) in enumerate(rows)], APP)


def test_retention_edges(spark):
    us = timedelta(microseconds=1)
    offsets = {"before": timedelta(days=28) - us, "lo": timedelta(days=28), "last": timedelta(days=35) - us, "hi": timedelta(days=35)}
    rows = [(k, "app_open", T0) for k in offsets] + [(k, "app_open", T0 + o) for k, o in offsets.items()]
    horizon = T0 + timedelta(days=60)
    rows += [("end", "hearing_aid_paired", horizon), ("at", "app_open", horizon - timedelta(days=34)), ("late", "app_open", horizon - timedelta(days=34) + us)]
    got = {r.hashed_device_id: r for r in silver.app_user_stages(app_rows(spark, rows)).collect()}
    assert {k: got[k].d30_active for k in offsets} == {"before": False, "lo": True, "last": True, "hi": False}
    assert not got["at"].censored and got["late"].censored and "end" not in got


def test_last_touch_takes_the_latest_event_even_if_null(spark):
    schema = "event_id long, user_pseudo_id string, event_name string, event_timestamp timestamp_ntz, utm_campaign string, device_category string, country string, consent_state string"
    rows = [(1, "a", "page_view", T0, "tiktok_awareness", "mobile", "DE", "granted"), (2, "a", "page_view", T0 + timedelta(1), None, "mobile", "DE", "granted"),
            (3, "b", "page_view", T0, "tiktok_awareness", "mobile", "DE", "granted"), (4, "b", "page_view", T0, "brand_search", "mobile", "DE", "granted")]
    got = {r.user_pseudo_id: r.last_touch_campaign for r in silver.web_user_stages(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": "organic/none", "b": "brand_search"}


def test_relative_ranges(spark):
    day = spark.sql("SELECT TIMESTAMP_NTZ '2026-03-31 10:00:00' AS horizon")
    assert [str(x) for x in dashboard.relative_range(day, 1, "months").first()] == ["2026-02-28", "2026-03-31"]
    assert [str(x) for x in dashboard.relative_range(day, 3, "days").first()] == ["2026-03-28", "2026-03-31"]
    with pytest.raises(ValueError):
        dashboard.relative_range(day, 1, "fortnights")


def test_severity_ladder_floor_and_history(spark):
    rows = [("a", 10, 10.0, 14, z) for z in (1.49, 1.5, 2.5, -4.0)] + [("b", 4, 4.0, 20, 9.0), ("c", 10, 10.0, 13, 9.0), ("d", 10, 10.0, 20, None)]
    bands = spark.createDataFrame(rows, "event_name string, actual_count long, band_avg double, band_days long, deviation_z double").withColumns({"source": F.lit("web"), "segment": F.lit("x"), "day": F.lit("2026-01-10").cast("date"), "band_stddev": F.lit(10.0)})
    got = watchdog.volume_findings(bands).collect()
    low = next(r for r in got if r.z < 0)
    assert low.details == {"day": "2026-01-10", "event_name": "a", "segment": "x", "source": "web", "actual_count": "10", "band_days": "14", "band_avg": "10.000000", "band_stddev": "10.000000", "deviation_z": "-4.000000"}
    assert low.message == "web:a:x on 2026-01-10: 10 events, 4.00 deviations below its mean of 10.000 over the 14 rows before"
    assert sorted((r.severity, r.direction) for r in got) == [("critical", "below"), ("info", "above"), ("warning", "above")]


def test_band_of_a_flat_series_has_no_z(spark):
    rows = [(T0.date() + timedelta(i), "e", 5) for i in range(20)]
    out = watchdog.band(spark.createDataFrame(rows, "day date, event_name string, c long"), ["event_name"], "c", 28).orderBy(F.desc("day")).first()
    assert out.band_days == 19 and out.band_stddev == 0 and out.deviation_z is None


def test_column_drift(spark):
    live = spark.sql("SELECT * FROM VALUES ('t', 'a', 'int'), ('t', 'new', 'int'), ('t', 'b', 'string') AS v(table_name, column_name, data_type)")
    then = spark.sql("SELECT * FROM VALUES ('t', 'a', 'int'), ('t', 'gone', 'int'), ('t', 'b', 'int') AS v(table_name, column_name, data_type)")
    assert {(r.subject, r.severity, r.direction) for r in watchdog.column_drift(live, then).collect()} == {("column:t.new", "warning", "new"), ("column:t.gone", "critical", "missing"), ("column:t.b", "warning", "type_changed")}
    details = {r.subject: r.details for r in watchdog.column_drift(live, then).collect()}
    assert details["column:t.b"] == {"table": "t", "column": "b", "kind": "type_changed", "expected_type": "int", "actual_type": "string"} and details["column:t.gone"] == {"table": "t", "column": "gone", "kind": "missing"}


def test_filter_validation_names_the_known_values(spark):
    web = spark.sql("SELECT 'DE' AS market, 'organic_direct' AS channel, 'mobile' AS device_category")
    app = spark.sql("SELECT 'UK' AS market, 'organic_direct' AS acquisition_channel, 'iOS' AS platform")
    dashboard.validate(dashboard.Filters(market="UK", device="mobile"), web, app)
    with pytest.raises(ValueError, match="market.*DE, UK"):
        dashboard.validate(dashboard.Filters(market="FR"), web, app)


def test_chunks_split_at_headings_and_pack_paragraphs(spark):
    words = lambda n: " ".join(["w"] * n)
    text = f"before\n\n# One\n\n# Two\n{words(200)}\n\n{words(90)}\n\n{words(400)}\n"
    got = [(r.heading, r.part, r.n_words) for r in retrieval.chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("section", "part").collect()]
    assert got == [("", 1, 1), ("Two", 1, 290), ("Two", 2, 400)]


def test_short_sections_stay_as_they_stand(spark):
    text = "intro  line\n  with\ttabs\n\n\n\nmore\n## Head \none\n\n\ntwo\n#not a heading\n# Empty\n\n"
    got = [(r.heading, r.part, r.text, r.n_words) for r in retrieval.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section").collect()]
    assert got == [("", 1, "intro  line\n  with\ttabs\n\n\n\nmore", 5), ("Head", 1, "one\n\n\ntwo\n#not a heading", 5)]


def test_embed_cache_is_not_shuffled(spark):
    cache = retrieval.EmbedCache(spark, "embedded_test", 8)
    keyed = spark.range(100).select(F.concat(F.lit("k"), F.col("id") % 40).alias("key"), "id")
    assert cache.missing(keyed).count() == 100
    cache.add(keyed.filter("id < 30"))
    plan = cache.missing(keyed)._jdf.queryExecution().executedPlan().toString()
    assert {r.key for r in cache.missing(keyed).collect()} == {f"k{i}" for i in range(30, 40)} and plan.count("Exchange hashpartitioning") == 1
    cache.add(keyed)
    cache.add(keyed)
    assert cache.missing(keyed).count() == 0 and spark.table("embedded_test").count() == 40
    changed = keyed.filter("id = 5").select(F.concat("key", F.lit("changed")).alias("key"))
    assert [r.key for r in cache.missing(changed).collect()] == ["k5changed"]


def test_referential(spark):
    yes = ["What about that channel in the other of the two markets", "Show IT as a chart of all markets and weeks", "Şunu cihaza göre bütün pazarlar için kırar mısın", "Şimdi de app tarafını bütün pazarlar için göster", "one two three four five", "And by device?"]
    no = ["", "   ", "one two three four five six", "iterate over every single market and channel", "Please export the raw notebook analysis workbook file for review", "Compare hearing aid pairing rate by acquisition channel across markets"]
    got = {r.t: r.f for r in spark.createDataFrame([(x,) for x in yes + no], "t string").select("t", conversation.referential(F.col("t")).alias("f")).collect()}
    assert got == dict.fromkeys(yes, True) | dict.fromkeys(no, False)


def test_hot_keys_span_slices(spark):
    """The same rows in one slice and in many; one key has most of them."""
    rows = [("hot" if i % 3 else f"c{i % 7}", i, "assistant" if i % 5 == 2 or i % 11 == 3 else "user", f"what is number {i} of this all" if i % 4 else "it") for i in range(300)]
    turns = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole, cut = (order(conversation.context(turns, slice_rows=n)) for n in (10_000, 9))
    assert whole == cut and max(len(r[3] or []) for r in whole) == 5
    rows = [("hot" if i % 3 else f"k{i % 20}", T0 + timedelta(minutes=i * (1 if i % 50 else 200))) for i in range(400)]
    events = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    assert order(conversation.sessions(events, "k", "ts", slice_rows=10_000)) == order(conversation.sessions(events, "k", "ts", slice_rows=7))
    spread = ordered.slices(events, ["k", "ts"], shared_folder(spark), "hot", 40)
    assert spread.filter("k = 'hot'").select("slice").distinct().count() > 5 and spread.groupBy("slice").count().agg(F.max("count")).first()[0] < 100


READS = (
    "WITH x AS (SELECT * FROM ok_view) SELECT * FROM x LIMIT 3",
    "WITH a AS (SELECT 1 AS k), b AS (SELECT * FROM a) SELECT sum(k) OVER (ORDER BY k) FROM b",
    "SELECT count(*) FROM `ok_view` o JOIN (SELECT a FROM OK_VIEW WHERE a IN (SELECT a FROM ok_view)) p ON o.a = p.a",
    "SELECT s, count(*) FROM ok_view GROUP BY s HAVING count(*) > 0 ORDER BY 1 LIMIT 2",
    "SELECT a FROM ok_view UNION ALL SELECT 3 EXCEPT SELECT 4",
    "SELECT DISTINCT CASE WHEN a = 1 THEN 2 END, CAST(a AS STRING), a || s, extract(YEAR FROM DATE '2020-01-01') FROM ok_view WHERE EXISTS (SELECT 1 FROM ok_view) AND s LIKE 'x%' AND a BETWEEN 0 AND 2",
    "SELECT lag(a) OVER w FROM ok_view WINDOW w AS (PARTITION BY s ORDER BY a)",
    "SELECT * FROM (VALUES (1), (2)) v(z)",
)
REFUSED = (
    "SELECT * FROM secret",
    "DROP VIEW ok_view",
    "EXPLAIN SELECT * FROM ok_view",
    "INSERT INTO ok_view SELECT 1, 'a'",
    "SET x = 1",
    "SELECT (SELECT max(a) FROM secret) FROM ok_view",
    "SELECT sum(a) FILTER (WHERE a IN (SELECT a FROM secret)) FROM ok_view",
    "SELECT * FROM ok_view o JOIN (SELECT * FROM secret) s ON true",
    "SELECT * FROM ok_view, LATERAL (SELECT * FROM secret)",
    "SELECT a FROM ok_view WHERE a > (WITH q AS (SELECT a FROM secret) SELECT max(a) FROM q)",
    "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
    "SELECT * FROM secret, (WITH secret AS (SELECT 1 AS a) SELECT * FROM secret) x",
    "WITH b AS (SELECT * FROM a), a AS (SELECT 1 AS k) SELECT * FROM b",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home') FROM ok_view",
    "SELECT a FROM ok_view ORDER BY java_method('java.util.UUID', 'randomUUID')",
    "SELECT lag(a) OVER w FROM ok_view WINDOW w AS (ORDER BY reflect('java.lang.System', 'getProperty', 'user.home'))",
    "SELECT TRANSFORM(a) USING 'cat' FROM ok_view",
    "SELECT * FROM range(5)",
    "SELECT z FROM ok_view LATERAL VIEW explode(array(1, 2)) t AS z",
    "SELECT * FROM parquet.`/root/testdata/sf0.001/events.parquet`",
)


def test_governed_reads(spark):
    spark.sql("SELECT 1 AS a, 'x' AS s").createOrReplaceTempView("ok_view")
    spark.sql("SELECT 2 AS a").createOrReplaceTempView("secret")
    for good in READS:
        assert load.governed(spark, good, {"ok_view"}).count() > 0, good
    for bad in REFUSED:
        with pytest.raises(PermissionError):
            load.governed(spark, bad, {"ok_view"})
    assert load.governed(spark, "SELECT * FROM (VALUES (1), (2), (3)) v(z)", set(), cap=2).count() == 2


def test_governed_rows_are_counted_and_capped(spark):
    spark.range(30).selectExpr("id AS a", "'x' AS s").createOrReplaceTempView("ok_view")
    read = lambda sql, cap: load.governed_rows(spark, sql, {"ok_view"}, cap)
    for sql, cap, count, more in (("SELECT a FROM ok_view", 10, 10, True), ("SELECT a FROM ok_view", 30, 30, False), ("SELECT a FROM ok_view LIMIT 7", 10, 7, False), ("SELECT a FROM ok_view LIMIT 1000", 29, 29, True), ("SELECT a FROM ok_view WHERE a < 0", 5, 0, False)):
        got = read(sql, cap)
        assert (len(got.rows), got.row_count, got.truncated) == (count, count, more), sql
    with pytest.raises(PermissionError):
        read("SELECT * FROM secret", 5)


def test_load_turns_nanoseconds_into_microseconds(spark, tmp_path):
    pq.write_table(pa.table({"id": [1, 2], "ts": pa.array([1_700_000_000_123_456_789, None], pa.timestamp("ns"))}), tmp_path / "raw.parquet")
    before = spark.conf.get(load.NANOS)
    got = load.load_tables(spark, f"file://{tmp_path}", ["raw"], "bronze_test", {"raw": ["ts"]})["raw"]
    assert got.schema["ts"].dataType.typeName() == "timestamp_ntz" and spark.conf.get(load.NANOS) == before
    assert [r.ts for r in got.orderBy("id").collect()] == [datetime(2023, 11, 14, 22, 13, 20, 123456), None]
    assert spark.catalog.getTable("bronze_test.raw").description == "as delivered"


def test_links_need_a_strictly_later_open_and_consent(spark):
    us = timedelta(microseconds=1)
    web = spark.createDataFrame([(f"w{i}", "M", T0, "c") for i in range(4)], "user_pseudo_id string, market string, first_test_complete_ts timestamp_ntz, last_touch_campaign string")
    app = spark.createDataFrame([(f"a{i}", "iOS", T0 + d, None, False, False) for i, d in enumerate((-us, 0 * us, us, us))], "hashed_device_id string, platform string, first_open_ts timestamp_ntz, paired_ts timestamp_ntz, d30_active boolean, censored boolean")
    bridge = spark.createDataFrame([(f"h{i}", "DE", i < 3, "x", f"w{i}", f"a{i}") for i in range(4)], "hashed_id string, market string, opt_in_flag boolean, acquisition_channel string, web_pseudo_id string, app_device_id string")
    got = silver.linked_journeys(silver.attribution_eligible(bridge), web, app).collect()
    assert [(r.hashed_id, r.market) for r in got] == [("h2", "DE")]


def test_context_keeps_the_last_five_first_lines(spark):
    rows = [("c", 2 * i, "user", f"question number {i} is rather a long one") for i in range(7)] + [("c", 2 * i + 1, "assistant", f"\n  answer {i}\nmore") for i in range(6)]
    rows += [("c", 20, "user", "and it?"), ("d", 0, "user", "it"), ("d", 1, "system", "x"), ("d", 2, "assistant", "y" * 200), ("d", 3, "assistant", "later"), ("d", 4, "user", "that")]
    got = {(r.conv_id, r.turn): r.context for r in conversation.context(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    said = [f"question number {i} is rather a long one" + (f" => answer {i}" if i < 6 else "") for i in range(7)]
    assert got["c", 20] == said[2:] and got["c", 12] is None and got["d", 0] == [] and got["d", 4] == ["it => " + "y" * 160]


def test_support_windows(spark):
    day = timedelta(1)
    app = app_rows(spark, [("a", "app_open", T0), ("a", "app_open", T0 + 14 * day), ("b", "app_open", T0 + 15 * day), ("z", "app_open", T0 + 30 * day)])
    support = spark.createDataFrame([(d, t) for d, t in (("a", T0), ("b", T0), ("late", T0 + 17 * day))], "hashed_device_id string, event_timestamp timestamp_ntz")
    assert tuple(analyses.recovered_after_support(app, support).first()) == (2, 1, 0.5)


def test_registry_lists_sorted_values(spark):
    app = app_rows(spark, [("a", "x", T0), ("b", "w", T0)])
    got = {(r.kind, r.table_name): r["values"] for r in watchdog.registry({"app_events": app.select("platform", "event_id")}, app, app).collect()}
    assert got["column", "app_events"] == ["event_id:bigint", "platform:string"] and got["event_name", "app_events"] == ["w", "x"] and got["app_version", "app_events"] == ["6.2.1"]


def test_a_stored_registry_comes_back(spark, tmp_path):
    app = app_rows(spark, [("a", "x", T0), ("b", "w", T0)])
    state = watchdog.registry({"app_events": app.select("platform", "event_id")}, app, app, watchdog.Thresholds(warning=3.5, history=9))
    watchdog.store(state, F.lit("2024-01-01").cast("date"), f"file://{tmp_path}/registry")
    r = watchdog.read_registry(spark, f"file://{tmp_path}/registry")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(r.columns) == [("app_events", "event_id", "bigint"), ("app_events", "platform", "string")] and rows(r.versions) == [("6.2.1",)]
    assert rows(r.events) == [(t, e) for t in ("app_events", "web_events") for e in ("w", "x")] and r.thresholds == watchdog.Thresholds(warning=3.5, history=9)
    (tmp_path / "old.json").write_text('{"expected_app_versions": ["1"], "thresholds": {"band_multiplier_info": 2}}')
    assert watchdog.read_registry(spark, f"file://{tmp_path}/old.json").thresholds == watchdog.Thresholds(info=2.0)


def test_cosine_ties_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, None), (6, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r["rank"], r.vec_id, r.score) for r in retrieval.cosine_top_k(vectors, vectors.filter("vec_id = 0"), 4).orderBy("rank").collect()]
    assert got == [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0), (4, 3, 0.0)]


def test_build_stops_when_rows_are_lost(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    t.web = t.web.limit(10)
    with pytest.raises(RuntimeError, match="web_events"):
        registry.build(t)


def test_load_mismatch_blocks(spark):
    a, b = spark.range(3), spark.range(2)
    with pytest.raises(RuntimeError, match="t"):
        load.require(load.reconcile({"t": a}, {"t": b}))


def test_broken_copy_turns_ok_false(spark):
    good = spark.sql("SELECT 1 AS k, 2 AS v")
    assert not quality.equivalent("x", good, good.unionByName(good)).first().ok


def test_fingerprints_tell_multisets_apart(spark):
    rows = [(i % 7, None if i % 5 else f"x{i % 3}", i / 3) for i in range(300)]
    table = spark.createDataFrame(rows, "a int, b string, c double")
    swapped = spark.createDataFrame([(None, 1), (2, None)], "a int, b int")
    pairs = {
        "same": (table, table.repartition(5).select("a", "b", "c")),
        "one row twice": (table, table.unionByName(table.limit(1))),
        "one value": (table, table.withColumn("c", F.when((F.col("a") == 3) & (F.col("c") < 2), F.lit(9.0)).otherwise(F.col("c")))),
        "nulls elsewhere": (swapped, swapped.select(F.col("b").alias("a"), F.col("a").alias("b"))),
    }
    got = {r.subject: (r.observed, r.ok) for r in quality.equivalent_marts(pairs, buckets=16).collect()}
    assert got["same"] == (0.0, True) and got["one row twice"] == (1.0, False) and got["one value"] == (2.0, False) and got["nulls elsewhere"] == (4.0, False)


def test_flagship_runs(spark):
    assert registry.QUERIES[registry.FLAGSHIP](spark, "/root/testdata/sf0.001").count() == 5
