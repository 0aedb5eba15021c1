"""Vectors as exact integers: scaled floors, sums over all rows, floor means.

Integers up to a bound (2**26, less for vectors above 512 components) live in
int64 matrices, where no squared distance can overflow. Larger ones go through
Python integers in object matrices, slower and just as exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VALUES = 1 << 19  # components handled at once
LIMB = 40  # bits of a sum that travel in one row
MOST = 2**63 - 1
SUMS = "part int, entry int, place int, limb int, total long"


def bound(size: int) -> int:
    """Size of components up to which the squared distance of two vectors stays below 2**62."""
    return min(1 << 26, math.isqrt((1 << 60) // max(size, 1)))


def finite(vector: str | Column) -> Column:
    """Whether a vector is there and none of its components is null, NaN or infinite."""
    v = F.col(vector) if isinstance(vector, str) else vector
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def floor_scaled(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def blocks(vectors: pa.ListArray, size: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and floor(scale * x) of the rows with `size` finite components, as int64 or as Python integers.

    Each block holds about VALUES components at most; a row is in one block.
    """
    step = max(1, VALUES // max(size, 1))
    for at in range(0, len(vectors), step):
        part = vectors.slice(at, step)
        lengths = np.diff(part.offsets.to_numpy())
        lengths[part.is_null().to_numpy(zero_copy_only=False)] = -1
        flat = part.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
        rows = np.flatnonzero(lengths == size)
        starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[rows]
        x = flat[starts[:, None] + np.arange(size)]
        whole = np.isfinite(x).all(axis=1)
        rows, x = rows[whole], x[whole]
        with np.errstate(over="ignore"):
            y = np.floor(x * scale)
        small = (np.abs(y) <= bound(size)).all(axis=1)
        if small.any():
            yield at + rows[small], y[small].astype(np.int64)
        if not small.all():
            big = np.array([[floor_scaled(v, scale) for v in r] for r in x[~small].tolist()], object)
            yield at + rows[~small], big.reshape(-1, size)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All squared distances by Python integers, for what int64 cannot hold."""
    return ((x.astype(object)[:, None, :] - c.astype(object)[None]) ** 2).sum(axis=2)


def as_longs(values: np.ndarray) -> list[int | None]:
    """Values as they fit a long; what does not fit is null."""
    return [v if v <= MOST else None for v in values.tolist()]


class Sums:
    """Sums and counts of integer rows by (part, entry), exact at any size."""

    def __init__(self, parts: int, entries: int, size: int) -> None:
        self.total = np.zeros((parts, entries, size + 1), np.int64)  # a count at the end
        self.large: dict[tuple[int, int, int], int] = {}

    def add(self, part: int, to: np.ndarray, x: np.ndarray) -> None:
        if x.dtype == object:
            for e, row in zip(to.tolist(), x, strict=True):
                for i, v in enumerate([*row, 1]):
                    self.large[part, e, i] = self.large.get((part, e, i), 0) + v
            return
        one = np.zeros((len(to), self.total.shape[1]))
        one[np.arange(len(to)), to] = 1
        # Doubles add exactly here: no sum over a block reaches 2**53.
        self.total[part, :, :-1] += (one.T @ x.astype(np.float64)).astype(np.int64)
        self.total[part, :, -1] += one.sum(axis=0).astype(np.int64)

    def batch(self) -> pa.RecordBatch:
        """The sums by sign and magnitude in limbs of LIMB bits, so that longs can add them over any number of tasks."""
        rows = []
        at = np.nonzero(self.total)
        for *key, v in zip(*(a.tolist() for a in at), self.total[at].tolist(), strict=True):
            rows.append((tuple(key), v))
        out = []
        for (p, e, i), v in [*rows, *self.large.items()]:
            left, limb = abs(v), 0
            while left:
                out.append((p, e, i, limb, (left & ((1 << LIMB) - 1)) * (1 if v > 0 else -1)))
                left, limb = left >> LIMB, limb + 1
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32()] * 4 + [pa.int64()], strict=True)], names=["part", "entry", "place", "limb", "total"])


def summed(vectors: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> dict[tuple[int, int], list[int]]:
    """Sums of all tasks by (part, entry): a list of totals by place, the count last. As many rows as the model has numbers."""
    found: dict[tuple[int, int], dict[int, int]] = {}
    added = vectors.mapInArrow(work, SUMS).groupBy("part", "entry", "place", "limb").agg(F.sum("total").alias("total"))
    for r in added.collect():
        places = found.setdefault((r.part, r.entry), {})
        places[r.place] = places.get(r.place, 0) + (r.total << (LIMB * r.limb))
    return {k: [v.get(i, 0) for i in range(max(v) + 1)] for k, v in found.items()}


def floor_means(old: np.ndarray, part: int, sums: dict[tuple[int, int], list[int]]) -> np.ndarray:
    """Componentwise floor(sum / count); entries without rows stay."""
    rows = [[s // t[-1] for s in t[:-1]] if (t := sums.get((part, e))) else row.tolist() for e, row in enumerate(old)]
    return integers(rows, old.shape[1])


def integers(rows: list[list[int]], size: int) -> np.ndarray:
    fits = all(abs(v) <= bound(size) for r in rows for v in r)
    return np.array(rows, np.int64 if fits else object).reshape(len(rows), size)


def with_group_total(df: DataFrame, key: str, value: str, name: str, hot: int = 1000) -> DataFrame:
    """df with the sum of `value` over rows of equal `key` (nulls together); null where a value is null or the sum exceeds a long.

    The `hot` largest groups are sent to every task, so no group that passes
    through the sort holds more than 1 / hot of all rows.
    """
    fits = F.sum(F.col(value).isNull().cast("long")) == 0
    totals = df.groupBy(F.col(key).alias("_key")).agg(
        F.count(F.lit(1)).alias("_rows"), F.when(fits, F.try_sum(value)).alias(name), F.count(value).alias("_there")
    )
    most = totals.orderBy(F.desc("_rows"), F.col("_key")).limit(hot)
    same = df[key].eqNullSafe(F.col("_key"))
    keep = [df[c] for c in df.columns]
    first = df.join(F.broadcast(most), same).select(*keep, name)
    few = F.broadcast(most.select("_key"))
    rest = totals.join(few.withColumnRenamed("_key", "_hot"), F.col("_key").eqNullSafe(F.col("_hot")), "left_anti")
    return first.unionByName(df.join(few, same, "left_anti").join(rest, same).select(*keep, name))


def field_of(df: DataFrame, name: str) -> T.StructField:
    return T.StructField(name, df.schema[name].dataType, True)
