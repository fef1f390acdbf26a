"""Daily bars as immutable snapshots, bucketed by symbol, behind a manifest.

A snapshot is a Parquet table in buckets of ``symbol``, so windows, joins and
aggregations by symbol read it without an exchange.  A merge keeps the stored
rows in their buckets: only the new bars move.  The manifest has one row a
snapshot; readers name a version or take the newest, and a snapshot that has
been written never changes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from barloom.sources.archive import assert_unique

MANIFEST = "version int, parent int, path string, buckets int, n long, symbols long, schema string"


class BarStore:
    """Bars (symbol, date, ...) in ``folder``, which all executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def manifest(self) -> DataFrame:
        """One row a snapshot; empty before the first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest") if there else self.spark.createDataFrame([], MANIFEST)

    def _entry(self, version: int | None):
        rows = self.manifest().where(F.lit(version is None) | (F.col("version") == F.lit(version)))
        found = rows.orderBy(F.col("version").desc()).first()
        if found is None:
            raise ValueError(f"the store has no snapshot {version if version is not None else ''}")
        return found

    def read(self, version: int | None = None) -> DataFrame:
        """Bars of a snapshot, the newest by default, in buckets of their symbol."""
        entry = self._entry(version)
        name = "bars_" + entry["path"].rsplit("-", 1)[-1]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(json.loads(entry["schema"])))
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (symbol) SORTED BY (date) INTO {entry['buckets']} BUCKETS LOCATION '{entry['path']}'")
        return self.spark.table(name)

    def _commit(self, bars: DataFrame, parent: int | None, path: str) -> int:
        version = 0 if parent is None else parent + 1
        n = bars.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("symbol").alias("symbols"))
        entry = n.select(F.lit(version).alias("version"), F.lit(parent).cast("int").alias("parent"), F.lit(path).alias("path"), F.lit(self.buckets).alias("buckets"), "n", "symbols", F.lit(bars.schema.json()).alias("schema"))
        entry.coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")
        return version

    def _save(self, bars: DataFrame) -> str:
        key = uuid.uuid4().hex
        path = f"{self.folder}/bars-{key}"
        bars.write.bucketBy(self.buckets, "symbol").sortBy("date").option("path", path).saveAsTable(f"bars_{key}")
        return path

    def write(self, bars: DataFrame, unique: bool = False, placed: bool = False) -> int:
        """First or new snapshot of exactly these bars; a repeated (symbol, date) is an error.

        ``unique`` bars are known to have none; ``placed`` ones are already dealt by symbol over as many partitions as there are buckets.
        """
        newest = self.manifest().agg(F.max("version")).first()[0]
        bars = bars if unique else assert_unique(bars)
        path = self._save(bars if placed else bars.repartition(self.buckets, "symbol"))
        return self._commit(self.spark.table("bars_" + path.rsplit("-", 1)[-1]), newest, path)

    def merge(self, batch: DataFrame, version: int | None = None) -> int:
        """New snapshot in which the bars of ``batch`` win by (symbol, date) over those of ``version``.

        Stored rows are read and written bucket by bucket; the days of the
        batch come to them as one array a symbol.  Two merges of the same
        version would both follow it, so a store has one writer.
        """
        entry = self._entry(version)
        self.buckets = entry["buckets"]
        old = self.read(entry["version"])
        batch = assert_unique(batch.select(*old.columns)).repartition(self.buckets, "symbol")
        days = batch.groupBy("symbol").agg(F.collect_set("date").alias("_days"))
        kept = old.join(days, "symbol", "left").where(F.col("_days").isNull() | ~F.array_contains("_days", F.col("date"))).select(*old.columns)
        path = self._save(kept.unionByName(batch))
        newest = self.manifest().agg(F.max("version")).first()[0]
        return self._commit(self.spark.table("bars_" + path.rsplit("-", 1)[-1]), newest, path)
