"""First rows of groups and counts of the others, against plain code; one reading of the rows."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitespan.operators import scoring, topk


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_streams_in_batches_of_any_size(size):
    rng = random.Random(size)
    rows = sorted(((rng.choice([None, "a", "b", "c", "d"]), rng.choice([1, 2]), k) for k in range(60)), key=lambda r: (r[0] is not None, r[0] or "", r[2]))
    table = pa.table({"k": pa.array([r[0] for r in rows], pa.string()), "t": [r[1] for r in rows], "o": [r[2] for r in rows]})
    got = [r for b in topk.cut_to_first(iter(table.to_batches(max_chunksize=size)), ["k"], 4, ["t"]) for r in b.to_pylist()]
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        assert [(r["t"], r["o"]) for r in got if r["k"] == key and not r["_rest"]] == [r[1:] for r in mine[:4]]
        for t in (1, 2):
            assert sum(r["_n"] for r in got if r["k"] == key and r["_rest"] and r["t"] == t) == sum(r[1] == t for r in mine[4:])
    assert len([r for r in got if r["_rest"]]) <= 10  # counts leave once for each group


@pytest.mark.parametrize("parts", [1, 5])
def test_first_rows_and_how_many_more(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b", "c"]), rng.randint(0, 30), k) for k in range(400)] + [("one", 1, -1)]
    d = spark.createDataFrame(rows, "k string, o int, id int").repartition(parts)
    got = topk.top_of(d, ["k"], ["o", "id"], 5)
    assert got.columns == ["k", "o", "id", "rank", "more"]
    found = {}
    for r in got.collect():
        found.setdefault(r.k, []).append((r.rank, r.o, r.id, r.more))
    for key in {r[0] for r in rows}:
        mine = sorted((r[1], r[2]) for r in rows if r[0] == key)
        assert sorted(found[key]) == [(i + 1, *x, max(0, len(mine) - 5)) for i, x in enumerate(mine[:5])]
    assert topk.top_of(d.filter("false"), ["k"], ["o"]).collect() == []


def test_penalties_of_mixed_severities(spark):
    rng = random.Random(7)
    rows = [(run, t, rng.choice(["critical", "high", "medium", "low"]), f"https://h/{rng.choice('aAbB')}{rng.randint(0, 9)}", k) for run in (1, 2) for t in ("title_too_short", "missing_h1", "strange") for k in range(60)]
    d = spark.createDataFrame(rows, "run int, issue_type string, severity string, url string, ord int").repartition(6)
    got = {(r.run, r.issue_type): r for r in scoring.penalties(d, collation=False).collect()}
    base = {"critical": 20, "high": 10, "medium": 4, "low": 1}
    multiplier = {r.issue_type: r.multiplier for r in scoring.category_map(spark).collect()}
    assert set(got) == {(run, t) for run in (1, 2) for t in ("title_too_short", "missing_h1")}
    for (run, t), r in got.items():
        mine = sorted((x[3], x[4], x[2]) for x in rows if x[:2] == (run, t))
        tier = lambda n: 1.0 if n == 1 else 0.75 if n <= 5 else 0.4 if n <= 20 else 0.2
        assert (r.occurrences, r.severity) == (60, mine[0][2])
        assert abs(r.penalty - sum(base[x[2]] * multiplier[t] * tier(n + 1) for n, x in enumerate(mine))) < 1e-9


def test_issues_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "missing_h1", "low", "u", 1)], "run int, issue_type string, severity string, url string, ord int").write.parquet(f"{tmp_path}/i")
    plan = scoring.penalties(spark.read.parquet(f"{tmp_path}/i"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 or plan.count("FileScan parquet") == 1
    d = topk.top_of(spark.read.parquet(f"{tmp_path}/i"), ["run"], [F.col("ord")])
    assert d._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
