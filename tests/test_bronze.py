"""Bronze tables take in each file once."""

import shutil
from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tributary.sources.bronze import Bronze


def put(folder, name, ids, times):
    pq.write_table(pa.table({"id": ids, "ts": pa.array(times, pa.timestamp("ns"))}), folder / f"{name}.parquet")


def test_files_are_taken_in_once(spark, tmp_path):
    source, day = tmp_path / "source", 86_400 * 10**9
    source.mkdir()
    put(source, "a", [1, 2], [123_456_789, None])
    put(source, "b", [3], [day + 5_000])
    bronze = Bronze(spark, f"file://{tmp_path}/bronze")
    take = lambda: bronze.take_in(f"file://{source}", "events", "ts", ("ts",))
    ids = lambda: sorted(r.id for r in bronze.table("events").collect())
    assert take() == {"files": 2, "rows": 3, "source_rows": 3} and take() == {"files": 0, "rows": 0, "source_rows": 0}
    got = {r.id: (r.ts, r._day and str(r._day)) for r in bronze.table("events").collect()}
    assert got == {1: (datetime(1970, 1, 1, 0, 0, 0, 123456), "1970-01-01"), 2: (None, None), 3: (datetime(1970, 1, 2, 0, 0, 0, 5), "1970-01-02")}
    put(source, "c", [4, 5], [day, 2 * day])  # a later file of a day that is there already
    assert take()["files"] == 1 and ids() == [1, 2, 3, 4, 5]
    put(source, "b", [6, 7, 8], [day, 3 * day, 3 * day])  # a changed one replaces its rows
    assert take() == {"files": 1, "rows": 3, "source_rows": 3} and ids() == [1, 2, 4, 5, 6, 7, 8]
    shutil.rmtree(tmp_path / "bronze/events/manifest")  # as if the run had broken off before its end
    assert take()["files"] == 3 and ids() == [1, 2, 4, 5, 6, 7, 8]


def test_rows_that_get_lost_stop_the_load(spark, tmp_path, monkeypatch):
    put(tmp_path, "a", [1, 2], [1, 2])
    bronze = Bronze(spark, f"file://{tmp_path}/bronze")
    monkeypatch.setattr("tributary.sources.bronze.Observation", type("Short", (), {"get": {"rows": 1}}))
    monkeypatch.setattr(f"{type(spark.range(1)).__module__}.DataFrame.observe", lambda self, *a: self)
    with pytest.raises(RuntimeError, match="1 of 2"):
        bronze.take_in(f"file://{tmp_path}/a.parquet", "events")
    assert bronze.manifest("events").count() == 0
