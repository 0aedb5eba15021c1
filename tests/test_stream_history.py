"""Kept-up views after any split of the feed into batches, restarts and repeated batches, against the batch views."""

import datetime as dt
import random

import pytest

from sitespan.plans import views
from sitespan.streaming.history import KeyedTable, issue_history_changes, kept_up, latest_run_changes

RUN = "id int, site_id int, started_at timestamp_ntz, status string, version int"
SEEN = "site_id int, issue_key string, run_id int, crawl_started_at timestamp_ntz"


def feed(rng, n):
    t = lambda: dt.datetime(2024, 1, rng.randint(1, 20))
    runs = [(k, rng.randint(1, 4), t(), "running", 0) for k in range(n)]
    runs += [(*r[:3], rng.choice(["success", "failed"]), 1) for r in runs if rng.random() < 0.7]
    rng.shuffle(runs)
    return runs, [(rng.randint(1, 4), f"u::{rng.randint(0, 9)}", k, t()) for k in range(3 * n)]


def put(spark, rows, schema, path, files, rng):
    cuts = sorted(rng.sample(range(1, len(rows)), files - 1))
    for part in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 4])
def test_equal_to_the_batch_views(spark, tmp_path, files):
    rng = random.Random(files)
    runs, seen = feed(rng, 20)
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")
    half = len(runs) // 2
    everything = spark.createDataFrame(runs, RUN)
    latest = views.latest_runs(spark.createDataFrame([max((r for r in runs if r[0] == k), key=lambda r: r[4]) for k in {r[0] for r in runs}], RUN))
    history = views.issue_history(spark.createDataFrame(seen, SEEN))
    r_table = KeyedTable(f"{tmp_path}/latest", everything.schema, ("site_id",), 3)
    h_table = KeyedTable(f"{tmp_path}/history", history.schema, ("site_id", "issue_key"), 5)
    for part in (runs[:half], runs[half:]):  # the query ends and is started again
        put(spark, part, RUN, f"{tmp_path}/runs", files, rng)
        kept_up(latest_run_changes(stream("runs", RUN)), r_table, f"{tmp_path}/c1").awaitTermination()
    put(spark, seen, SEEN, f"{tmp_path}/seen", files, rng)
    kept_up(issue_history_changes(stream("seen", SEEN)), h_table, f"{tmp_path}/c2").awaitTermination()
    for table, want in ((r_table, latest), (h_table, history)):
        expected = sorted(map(tuple, want.collect()))
        assert sorted(map(tuple, table.read(spark).select(want.columns).collect())) == expected
        table.tidy(spark)
        assert sorted(map(tuple, table.read(spark).select(want.columns).collect())) == expected


def test_a_batch_that_is_run_again(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(x, "k string, v int")
    t = KeyedTable(f"{tmp_path}/t", rows(("", 0)).schema, ("k",), 2)
    got = lambda: sorted(map(tuple, t.read(spark).collect()))
    assert got() == []
    t.merge(rows(("a", 1), ("b", 1)), 0)
    t.merge(rows(("a", 2), ("c", 2)), 1)
    t.merge(rows(("a", 2), ("c", 2)), 1)
    assert got() == [("a", 2), ("b", 1), ("c", 2)]
    t.merge(rows(("a", 3)).filter("false"), 2)
    (tmp_path / "t" / "v=3" / "bucket=0").mkdir(parents=True)  # a write that was cut off: no _SUCCESS
    (tmp_path / "t" / "v=3" / "bucket=0" / "part-0.parquet").write_bytes(b"half")
    assert got() == [("a", 2), ("b", 1), ("c", 2)]
    t.merge(rows(("a", 3), ("d", 3)), 3)
    assert got() == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]
