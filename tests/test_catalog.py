"""The build as catalog objects."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tributary import registry
from tributary.sources import catalog
from tributary.sources.binding import Tables
from tributary.sources.load import governed_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture
def own(spark, request):
    out = catalog.Catalog(spark, f"{request.node.name}_")
    yield out
    out.drop()


def test_a_rebuild_may_read_what_it_replaces(spark, own):
    own.table("gold", "n", spark.range(3), "it's a \\ comment")
    got = own.table("gold", "n", own.read("gold", "n").unionByName(spark.range(3, 5).toDF("id")), "again")
    assert sorted(r.id for r in got.collect()) == [0, 1, 2, 3, 4]
    assert [(r.name, r.comment, r.rows, r.columns) for r in own.inventory().collect()] == [("n", "again", 5, "id")]
    own.table("gold", "n", spark.range(0), "it's a \\ comment")  # an empty table stands as one
    assert [(r.comment, r.rows) for r in own.inventory().collect()] == [("it's a \\ comment", 0)]


def test_a_view_sees_rebuilds_and_keeps_its_comment(spark, own):
    own.table("bronze", "t", spark.range(4), "t")
    view = lambda: sorted(r.id for r in own.view("silver", "v", f"SELECT * FROM {own.name('bronze', 't')} WHERE id % 2 = 0", "even ones").collect())
    assert view() == [0, 2]
    own.table("bronze", "t", spark.range(7), "t")
    assert sorted(r.id for r in own.read("silver", "v").collect()) == [0, 2, 4, 6] == view()
    assert {(r.name, r.kind, r.comment, r.rows) for r in own.inventory().collect()} == {("t", "table", "t", 7), ("v", "view", "even ones", 4)}


def test_lost_rows_leave_the_old_table(spark, own, monkeypatch):
    own.table("gold", "n", spark.range(3), "old")
    monkeypatch.setattr(Observation, "get", property(lambda self: {"n": 99}))
    with pytest.raises(RuntimeError, match="gold.n was given 99 rows and holds 2"):
        own.table("gold", "n", spark.range(2), "new")
    monkeypatch.undo()
    assert own.read("gold", "n").count() == 3
    assert own.table("gold", "n", spark.range(2), "new").count() == 2


def test_published_layers_answer_sql(spark):
    t = Tables(spark, SF)
    own = catalog.publish(t, {k: f for k, (f, _) in registry.MARTS.items()}, "published_")
    try:
        assert len(own.objects) == 21 == len(catalog.COMMENTS)
        assert spark.catalog.getTable("published_silver.v_attribution_eligible").tableType == "VIEW"
        direct = {tuple(r) for r in registry.MARTS["pairing_by_channel"][0](t).collect()}
        assert {tuple(r) for r in own.read("gold", "pairing_by_channel").collect()} == direct
        name = "published_silver.v_attribution_eligible"
        got = governed_rows(spark, f"SELECT count(*) AS n FROM {name}", {name})
        assert got.rows[0].n == t.bridge.filter(F.col("opt_in_flag")).count()
    finally:
        own.drop()
    assert not spark.catalog.databaseExists("published_gold")
