"""Centroid clustering in exact integers, with partial-distance search.

Vectors become floor(1024 * x). Squared differences are added up over the
dimensions of highest variance first; a centroid is abandoned for a vector once
its partial sum is strictly above the best distance known, and those that
survive finish all dimensions. Equal distances go to the smaller number, so the
order of dimensions changes the work and never the result.

A round reads the vectors once and moves one sum for each number of the
centroids and task; the driver sees centroids x length numbers.

Rows are kept if their vector has exactly `size` components, none of them null
or non-finite. Starts are the kept rows with the smallest SHA-256 of
"3:<id>"; null ids come last, and rows of one id are ordered by their vectors.
Repeated rows count each time; with fewer kept rows than centroids there are
fewer centroids. A distance or sum beyond a long is null. An empty table gives
an empty result. Other columns than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, stored
from .vectors import Sums, as_longs, blocks, distances, field_of, finite, floor_means, integers, summed


@dataclass(frozen=True)
class Centroids:
    scale: int
    places: np.ndarray  # centroids x size, int64 or Python integers
    order: np.ndarray  # dimensions by falling variance

    def digests(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in self.places.tolist()]


class PartialSearch:
    """Nearest centroids; `ends` are the numbers of dimensions after which centroids are abandoned."""

    def __init__(self, centroids: Centroids, ends: tuple[int, ...] = (8, 16, 32)) -> None:
        self.order, self.raw = centroids.order, centroids.places
        size = self.raw.shape[1]
        self.ends = [*(e for e in ends if e < size), size]
        self.places = self.raw[:, self.order]
        self.finished = 0  # pairs of vector and centroid whose distance was added up to the end

    def nearest(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if raw.dtype == object or self.raw.dtype == object:
            d = distances(raw, self.raw)
            at = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
            return at, d[np.arange(len(raw)), at]
        x, c, head = raw[:, self.order], self.places, self.ends[0]
        first = np.stack([((x[:, :head] - p[:head]) ** 2).sum(axis=1) for p in c], axis=1)
        guess = first.argmin(axis=1)  # what looks nearest so far gives the first best
        every = np.arange(len(x))
        at, best = guess.copy(), first[every, guess] + ((x[:, head:] - c[guess, head:]) ** 2).sum(axis=1)
        self.finished += len(x)
        for j in range(len(c)):
            rows = np.flatnonzero((guess != j) & (first[:, j] <= best))
            part = first[rows, j]
            for a, b in pairwise(self.ends):
                part = part + ((x[rows, a:b] - c[j, a:b]) ** 2).sum(axis=1)
                alive = part <= best[rows]
                rows, part = rows[alive], part[alive]
            self.finished += len(rows)
            better = (part < best[rows]) | (j < at[rows])  # equal distances: the smaller number
            at[rows[better]], best[rows[better]] = j, part[better]
        return at, best


def kept_rows(vector: str, size: int) -> Column:
    return (F.size(vector) == size) & finite(vector)


def variances(vectors: DataFrame, size: int, scale: int) -> np.ndarray:
    """Dimensions by falling variance over all kept rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        n, one, two = 0, np.zeros(size), np.zeros(size)
        for batch in batches:
            for _, x in blocks(batch.column(0), size, scale):
                y = x.astype(np.float64) / scale
                n, one, two = n + len(y), one + y.sum(axis=0), two + (y * y).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, n), pa.int64()), pa.array(one), pa.array(two)], names=["place", "n", "one", "two"])

    found = vectors.mapInArrow(work, "place int, n long, one double, two double").groupBy("place").agg(F.sum("n").alias("n"), F.sum("one").alias("one"), F.sum("two").alias("two"))
    out = np.zeros(size)
    for r in found.collect():
        out[r.place] = r.two / r.n - (r.one / r.n) ** 2 if r.n else 0
    return np.argsort(-np.nan_to_num(out), kind="stable")


def start(vectors: DataFrame, id_col: str, vector: str, size: int, k: int, scale: int, seed: str) -> Centroids:
    rank = F.sha2(F.concat(F.lit(seed), F.col(id_col).cast("string")), 256)
    first = vectors.where(kept_rows(vector, size)).select(rank.alias("rank"), F.col(vector).alias("v")).orderBy(F.col("rank").asc_nulls_last(), F.col("v")).limit(k).collect()
    rows: list = [None] * len(first)
    for at, x in blocks(pa.array([r.v for r in first], pa.list_(pa.float64())), size, scale):
        for i, row in zip(at.tolist(), x.tolist(), strict=True):
            rows[i] = row
    return Centroids(scale, integers(rows, size), variances(vectors.select(vector), size, scale))


def moved(vectors: DataFrame, centroids: Centroids) -> Centroids:
    """One round: every vector to its nearest centroid, every centroid to the floor mean of its vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        search = PartialSearch(centroids)
        k, size = centroids.places.shape
        sums = Sums(1, k, size)
        for batch in batches:
            for _, x in blocks(batch.column(0), size, centroids.scale):
                sums.add(0, search.nearest(x)[0], x)
        yield sums.batch()

    return Centroids(centroids.scale, floor_means(centroids.places, 0, summed(vectors, work)), centroids.order)


def assigned(vectors: DataFrame, centroids: Centroids, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Id, cluster and squared distance of every kept row."""
    schema = T.StructType([field_of(vectors, id_col), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        search = PartialSearch(centroids)
        for batch in batches:
            for rows, x in blocks(batch.column(1), centroids.places.shape[1], centroids.scale):
                at, d = search.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at, pa.int32()), pa.array(as_longs(d), pa.int64())], names=schema.names)

    return vectors.select(id_col, vector).mapInArrow(work, schema)


def clustered(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", size: int = 64, k: int = 8, scale: int = 1024, rounds: int = 10, seed: str = "3:") -> DataFrame:
    """Clusters of all kept vectors, with inertia by cluster and in all, and a digest of each final centroid."""
    centroids = start(vectors, id_col, vector, size, k, scale, seed)
    for _ in range(rounds if len(centroids.places) else 0):
        centroids = moved(vectors.select(vector), centroids)
    out = stored(assigned(vectors, centroids, id_col, vector), "clusters")
    if not len(centroids.places):
        return out.withColumns({"cluster_inertia": F.lit(None).cast("long"), "inertia": F.lit(None).cast("long"), "centroid_sha256": F.lit(None).cast("string")})
    fits = F.count("distance") == F.count(F.lit(1))
    by = {r.cluster: r.total for r in out.groupBy("cluster").agg(F.when(fits, F.try_sum("distance")).alias("total")).collect()}  # k rows
    whole = sum(by.values()) if None not in by.values() else None
    at = F.col("cluster") + 1
    return out.withColumns({
        "cluster_inertia": F.element_at(F.array(*(F.lit(by.get(i, 0)).cast("long") for i in range(len(centroids.places)))), at),
        "inertia": F.lit(whole if whole is None or whole < 2**63 else None).cast("long"),
        "centroid_sha256": F.element_at(F.array(*map(F.lit, centroids.digests())), at),
    })
