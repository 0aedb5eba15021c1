"""Heartbeats as a stream: a run that falls silent is reported once, one that ends is not."""

import datetime as dt

from sitespan.streaming import control


def test_heartbeat_watch(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 12, m)
    schema = "run_id long, at timestamp, status string, stage string"
    batches = [[(1, t(0), "running", "crawling"), (2, t(0), "running", "crawling"), (3, t(1), "running", "crawling")], [(2, t(5), "success", "completed"), (3, t(16), "running", "scoring")], [(3, t(31), "running", "scoring")], [(3, t(32), "running", "scoring")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = control.heartbeat_watch(source.select("run_id", "at", "status")).writeStream.format("memory").queryName("silent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r["run_id"] for r in spark.sql("select run_id from silent").collect()] == [1]


def test_throttled(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 12, 0, s)
    d = spark.createDataFrame([(1, t(0), "a"), (1, t(1), "b"), (1, t(2), "c")], "run_id long, at timestamp, stage string")
    assert sorted(r["stage"] for r in control.throttled(d).collect()) == ["b", "c"]
