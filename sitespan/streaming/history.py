"""Views of stored history kept up by streams: latest runs, and first and last sight of every issue.

The streaming aggregations are the batch views' own (state by key, combined
before it moves). Each batch gives new whole rows for the keys it touched; they
replace the rows of those keys in a bucketed table. A batch writes a version of
the buckets it touched and is seen only when that write is complete, so a batch
that is run again after a failure gives the same table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..lineage import cut, remove


@dataclass(frozen=True)
class KeyedTable:
    """One row for each key, in buckets by hash of the key: path/v=<batch>/bucket=<b>. The newest complete version of a bucket counts."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def versions(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The newest complete version of each bucket, of those below `before`. The driver sees names of folders alone: buckets times kept versions."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found: dict[int, int] = {}
        for v in fs.listStatus(root) if fs.exists(root) else ():
            name = re.fullmatch(r"v=(\d+)", v.getPath().getName())
            if name is None or (before is not None and int(name[1]) >= before) or not fs.exists(hadoop.Path(v.getPath(), "_SUCCESS")):
                continue
            for b in fs.listStatus(v.getPath()):
                part = re.fullmatch(r"bucket=(\d+)", b.getPath().getName())
                if part:
                    found[int(part[1])] = max(found.get(int(part[1]), -1), int(name[1]))
        return found

    def read(self, spark: SparkSession, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows as of now, or as of before a version."""
        chosen = {b: v for b, v in self.versions(spark, before).items() if only is None or b in only}
        paths = [f"{self.path}/v={v}/bucket={b}" for b, v in chosen.items()]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def merge(self, rows: DataFrame, version: int) -> None:
        """Rows replace those of their keys. The same version may be written again; what it wrote before is then not read."""
        spark = rows.sparkSession
        new = cut(rows.select(self.schema.names).withColumn("bucket", self.bucket()), "batch")
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            remove(spark, new.cut_path)
            return
        old = self.read(spark, before=version, only=touched).join(new.select(*self.key), list(self.key), "left_anti").select(self.schema.names)
        both = old.withColumn("bucket", self.bucket()).unionByName(new)
        both.hint("rebalance", "bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/v={version}")
        remove(spark, new.cut_path)

    def tidy(self, spark: SparkSession) -> None:
        """Deletes the buckets of versions that newer ones replace."""
        newest = self.versions(spark)
        last = max(newest.values(), default=-1)
        for b, v in newest.items():
            for old in range(last):
                if old < v:
                    remove(spark, f"{self.path}/v={old}/bucket={b}")


def kept_up(changes: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts the query that keeps a table equal to a streaming aggregation by its key; by default it ends with what is there."""
    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(table.merge).trigger(**(trigger or {"availableNow": True})).start()


def latest_run_changes(runs: DataFrame, version: str = "version") -> DataFrame:
    """The latest run of each site, from a feed in which a run comes again, with a higher version, whenever it changes."""
    rest = [c for c in runs.columns if c != "site_id"]
    d = runs.groupBy("site_id").agg(F.max_by(F.struct(*rest), F.struct("started_at", "id", version)).alias("r"))
    return d.select("site_id", "r.*").select(runs.columns)


def issue_history_changes(occurrences: DataFrame) -> DataFrame:
    """First and last sight and the number of sightings of each issue, from a feed of occurrences (site_id, issue_key, crawl_started_at)."""
    from ..plans.views import issue_history

    return issue_history(occurrences)
