"""The first rows of every group, with the others counted: one reading of the rows, and little that moves.

Each task sorts its own rows by group and order and lets the first n of each
group pass; the others are counted, by chosen columns, while they stream by.
What moves is n rows and one row for each count, of every group and task. The
final rank is taken over those alone, so a group of any size is ranked in one
task without being gathered there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def _changes(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """Whether each row but the first has another key than the row before it; nulls are equal."""
    out = np.zeros(max(batch.num_rows - 1, 0), bool)
    for name in names:
        a, b = batch.column(name).slice(1), batch.column(name).slice(0, batch.num_rows - 1)
        differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        out |= differs | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))
    return out


def cut_to_first(batches: Iterator[pa.RecordBatch], key: list[str], n: int, tally: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: the first n of each key with _n = 1, then for each key and tally how many more there were (_rest)."""
    last: tuple | None = None  # key of the row before, and how many of it have passed
    passed = 0
    counts: dict[tuple, int] = {}
    schema = None

    def rest() -> pa.RecordBatch:
        rows = [dict(zip([*key, *tally], k, strict=True)) | {"_n": v, "_rest": True} for k, v in counts.items()]
        counts.clear()
        return pa.RecordBatch.from_pylist(rows, schema)

    for batch in batches:
        if schema is None:
            schema = batch.schema.append(pa.field("_n", pa.int64())).append(pa.field("_rest", pa.bool_()))
        if not batch.num_rows:
            continue
        first = tuple(batch.column(k)[0].as_py() for k in key)
        if first != last:
            passed = 0
        starts = np.concatenate([[0], np.flatnonzero(_changes(batch, key)) + 1])
        group = np.zeros(batch.num_rows, np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        nth = np.arange(batch.num_rows) - starts[group]
        nth[group == 0] += passed
        kept = nth < n
        some = batch.filter(pa.array(kept))
        yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.ones(some.num_rows, np.int64)), pa.array(np.zeros(some.num_rows, bool))], schema=schema)
        more = pa.Table.from_batches([batch.select([*key, *tally]).filter(pa.array(~kept))]).group_by([*key, *tally]).aggregate([([], "count_all")])
        last = tuple(batch.column(k)[-1].as_py() for k in key)
        passed = int(nth[-1]) + 1
        done = {k: v for k, v in counts.items() if k[: len(key)] != first} if counts else {}
        if done:  # groups that ended with the batch before
            held = {k: v for k, v in counts.items() if k not in done}
            counts.clear()
            counts.update(done)
            yield rest()
            counts.update(held)
        for r in more.to_pylist():
            k = tuple(r[c] for c in [*key, *tally])
            counts[k] = counts.get(k, 0) + r["count_all"]
    if counts:
        yield rest()


def bounded(rows: DataFrame, key: list[str], order: list[Column | str], n: int, tally: list[str] | None = None) -> DataFrame:
    """The rows that can be among the first n of their key, with rank, _n = 1 and _rest false; and rows of counts (_rest) of what else there is, for each value of `tally`, with ranks beyond n.

    Ranks are exact up to n. Rows of counts hold nulls but for key and tally.
    """
    tally = tally or []
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in rows.schema] + [T.StructField("_n", T.LongType()), T.StructField("_rest", T.BooleanType())])
    local = rows.sortWithinPartitions(*key, *order).mapInArrow(lambda b: cut_to_first(b, key, n, tally), schema)
    return local.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("_rest", *order)))


def top_of(rows: DataFrame, key: list[str], order: list[Column | str], n: int = 5) -> DataFrame:
    """The first n rows of each key with their rank and how many more there are."""
    d = bounded(rows, key, order, n).withColumn("more", F.sum("_n").over(Window.partitionBy(*key)) - n)
    d = d.filter((F.col("rank") <= n) & ~F.col("_rest")).withColumn("more", F.greatest("more", F.lit(0).cast("long")))
    return d.select(*key, *(c for c in rows.columns if c not in key), "rank", "more")
