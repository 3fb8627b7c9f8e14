"""Bronze tables that take in only files they have not seen, and count rows as they write them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tributary.sources.load import NANOS

FILE = "path string, size long, modified timestamp, load string"


@dataclass
class Bronze:
    """Tables below ``folder`` (one that all executors see): ``<table>/rows`` by day and load, and ``<table>/manifest``, a row for each file taken in.

    A load is a source file's place; its rows lie in partitions of their own.  Rows are written before the manifest, with dynamic overwrite, so a run that
    broke off in between is mended by the next one, which writes the same partitions again; a file that has changed replaces its rows, and one that has not is not read.
    Rows are as delivered, but for nanoseconds, which become microseconds.  Rows are counted by an observation of the write itself; a source's count comes from its footers.
    """

    spark: SparkSession
    folder: str

    def manifest(self, table: str) -> DataFrame:
        path = f"{self.folder}/{table}/manifest"
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], FILE)
        return self.spark.read.schema(FILE).parquet(path)

    def take_in(self, source: str, table: str, day: str | None = None, nanos: tuple[str, ...] = ()) -> dict[str, int]:
        """Load what is new or changed at ``source``: numbers of files and rows, and the rows that these files' footers tell of.

        day: a column of times by whose date rows are laid out; nanos: columns of nanosecond timestamps.  Rows that do not all arrive stop the load before the manifest knows of them.
        """
        spark, before = self.spark, self.spark.conf.get(NANOS)
        spark.conf.set(NANOS, "true")
        try:
            meta = F.col("_metadata")
            there = spark.read.parquet(source).groupBy(meta["file_path"].alias("path"), meta["file_size"].alias("size"), meta["file_modification_time"].alias("modified")).agg(F.count("*").alias("n"))
            there = there.withColumn("load", F.substring(F.sha2("path", 256), 1, 16))
            known = self.manifest(table)
            files = there.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti").collect()  # a row a new file, as a listing has
            if not files:
                return {"files": 0, "rows": 0, "source_rows": 0}
            self.forget(table, [r["load"] for r in known.join(spark.createDataFrame([(r["path"],) for r in files], "path string"), "path", "left_semi").select("load").distinct().collect()])
            rows = spark.read.parquet(*[r["path"] for r in files])
            rows = rows.withColumns({c: F.timestamp_micros(F.expr(f"`{c}` div 1000")).cast("timestamp_ntz") for c in nanos})
            seen = Observation()
            rows = rows.withColumns({"_day": F.to_date(day) if day else F.lit(None).cast("date"), "_load": F.substring(F.sha2(F.col("_metadata.file_path"), 256), 1, 16)})
            rows = rows.observe(seen, F.count(F.lit(1)).alias("rows")).hint("rebalance", "_day", "_load")
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day", "_load").parquet(f"{self.folder}/{table}/rows")
            count = {"files": len(files), "rows": seen.get["rows"], "source_rows": sum(r["n"] for r in files)}
            if count["rows"] != count["source_rows"]:
                raise RuntimeError(f"row counts differ: {table}: {count['rows']} of {count['source_rows']}")
            stored = [(r["path"], r["size"], r["modified"], r["load"]) for r in files]
            spark.createDataFrame(stored, FILE).write.mode("append").parquet(f"{self.folder}/{table}/manifest")
            return count
        finally:
            spark.conf.set(NANOS, before)

    def forget(self, table: str, loads: list[str]) -> None:
        """Delete the rows of files that have changed."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for load in loads:
            glob = path(f"{self.folder}/{table}/rows/_day=*/_load={load}")
            fs = glob.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for s in fs.globStatus(glob) or []:
                fs.delete(s.getPath(), True)

    def table(self, table: str) -> DataFrame:
        """The rows as delivered; _day and _load stand beside them."""
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{table}/rows").withColumn("_load", F.col("_load").cast("string"))
