"""Vector code compression: product quantisation whose every result is exact in integers.

Vectors become floor(4096 * x) and are cut into equal consecutive parts, each
with a codebook of its own. The nearest entry is found by a float32 matrix
product first: |c|^2 - 2 x.c of all entries, with an interval around each that
no rounding can leave. Entries whose interval overlaps the best one's are
compared again in int64; ties go to the lower index. Codebooks are moved by
floor means over all rows for a fixed number of rounds.

A round reads the vectors once and moves one sum for each number of the
codebooks and task; the driver sees parts x entries x length numbers.

Rows whose vector is null or holds null or non-finite components are dropped.
The length is that of the kept vector with the smallest id which the parts
divide; kept vectors of other lengths (empty ones, too) are returned with null
code and error, as no codebook can express them. Null ids come last in the
order of starts, equal ids are ordered by their vectors; repeated rows count
each time. With fewer vectors than entries, codebooks are shorter. An error
beyond a long is null. An empty table gives an empty result. Other columns than
the three named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import claim, stored
from .vectors import Sums, as_longs, blocks, bound, distances, field_of, finite, floor_means, integers, summed, with_group_total

UNIT = 2.0**-24  # rounding unit of float32


@dataclass(frozen=True)
class Codebooks:
    scale: int
    entries: list[np.ndarray]  # for each part: entries x part length, int64 or Python integers

    @property
    def size(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def digest(self) -> str:
        numbers = [str(v) for part in self.entries for row in part.tolist() for v in row]
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()


class Screen:
    """Nearest entries of one codebook."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.small = entries.dtype != object
        if self.small:
            self.single = entries.astype(np.float32).T.copy()
            self.squares = (entries * entries).sum(axis=1)
            self.norms = np.sqrt(self.squares.astype(np.float64))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry, and the squared distance."""
        if not self.small or x.dtype == object:
            d = distances(x, self.entries)
            at = np.array([min(range(len(r)), key=r.__getitem__) for r in d.tolist()], np.int64)
            return at, d[np.arange(len(x)), at]
        # Converting both sides and adding `length` products in any order leaves the dot product within
        # g = k u / (1 - k u), k = length + 2, of |x| |c|; what float64 rounds afterwards is below `rest`.
        k = x.shape[1] + 2
        g = k * UNIT / (1 - k * UNIT)
        dot = (x.astype(np.float32) @ self.single).astype(np.float64)
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        score = self.squares - 2 * dot
        rest = 2.0**-48 * (self.squares + 2 * np.abs(dot))
        off = 2 * g * (1 + 2.0**-40) * norm[:, None] * self.norms + rest
        near = score - off <= (score + off).min(axis=1)[:, None]
        at = near.argmax(axis=1)
        rows, entries = np.nonzero(near[open_ := np.flatnonzero(near.sum(axis=1) > 1)])
        if len(rows):
            exact = ((x[open_[rows]] - self.entries[entries]) ** 2).sum(axis=1)
            order = np.lexsort((entries, exact, rows))  # by row, then distance, then index
            first = order[np.concatenate([[True], np.diff(rows[order]) > 0])]
            at[open_[rows[first]]] = entries[first]
        return at, ((x - self.entries[at]) ** 2).sum(axis=1)


def start(vectors: DataFrame, id_col: str, vector: str, parts: int, entries: int, scale: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; None if no vector can be cut."""
    kept = vectors.where(finite(vector) & (F.size(vector) > 0) & (F.size(vector) % parts == 0)).select(F.col(id_col).alias("id"), F.col(vector).alias("v"))
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return None
    size = len(first[0].v)
    rows = [r.v for r in kept.where(F.size("v") == size).orderBy(*order).limit(entries).collect()]
    column = pa.array(rows, pa.list_(pa.float64()))
    whole: list = [None] * len(rows)
    for at, x in blocks(column, size, scale):
        for i, row in zip(at.tolist(), x.tolist(), strict=True):
            whole[i] = row
    cut = size // parts
    return Codebooks(scale, [integers([r[p * cut : (p + 1) * cut] for r in whole], cut) for p in range(parts)])


def moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor mean of its parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        screens = [Screen(e) for e in books.entries]
        cut = books.size // len(screens)
        sums = Sums(len(screens), len(books.entries[0]), cut)
        for batch in batches:
            for _, x in blocks(batch.column(0), books.size, books.scale):
                for p, s in enumerate(screens):
                    part = x[:, p * cut : (p + 1) * cut]
                    sums.add(p, s.nearest(part)[0], part)
        yield sums.batch()

    sums = summed(vectors, work)
    return Codebooks(books.scale, [floor_means(e, p, sums) for p, e in enumerate(books.entries)])


def fitted(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> Codebooks | None:
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    books = start(vectors, id_col, vector, parts, entries, scale)
    for _ in range(rounds if books else 0):
        books = moved(vectors.select(vector), books)
    return books


def coded(vectors: DataFrame, books: Codebooks | None, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """Id, label, code and error of every kept row."""
    schema = T.StructType([field_of(vectors, id_col), field_of(vectors, label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(__name__)
        screens = [Screen(e) for e in books.entries] if books else []
        size = books.size if books else -1
        cut = size // max(1, len(screens))
        for batch in batches:
            codes: list[str | None] = [None] * batch.num_rows
            errors: list[int | None] = [None] * batch.num_rows
            for rows, x in blocks(batch.column(2), size, books.scale) if books else ():
                near = [s.nearest(x[:, p * cut : (p + 1) * cut]) for p, s in enumerate(screens)]
                digits = np.stack([n[0] for n in near], axis=1).astype(np.uint8).tobytes().hex()
                total = sum(n[1].astype(object) if x.dtype == object or size * (2 * bound(cut)) ** 2 > 2**62 else n[1] for n in near)
                for k, (i, e) in enumerate(zip(rows.tolist(), as_longs(total), strict=True)):
                    codes[i], errors[i] = digits[2 * len(near) * k : 2 * len(near) * (k + 1)], e
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, pa.string()), pa.array(errors, pa.int64())], names=schema.names)

    kept = vectors.select(id_col, label, vector).where(finite(vector))
    return kept.mapInArrow(work, schema)


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6) -> DataFrame:
    """Codes of all kept vectors, with the error summed over equal labels and a digest of the codebooks."""
    books = fitted(vectors, id_col, vector, parts, entries, scale, rounds)
    out = stored(coded(vectors, books, id_col, vector, label), "vector-codes")
    return with_group_total(out, label, "error", "label_error").withColumn("codebooks_sha256", F.lit(books.digest() if books else None).cast("string"))
