"""Helpers shared by the operators: tables, the shared folder, Arrow mapping."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only where that setting is absent and the session runs in this one machine
    (local mode, as in tests) a temporary folder stands in for it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _local:
        _local["dir"] = tempfile.mkdtemp(prefix="sitespan-")
        atexit.register(shutil.rmtree, _local["dir"], ignore_errors=True)
    return f"file://{_local['dir']}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write a result to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    if _scratch:
        _scratch[-1].append(path)
    return out


_scratch: list[list[str]] = []  # paths stored within each open scratch()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end what was stored within, but for results passed to the function it gives."""
    _scratch.append([])

    def keep(df: DataFrame) -> DataFrame:
        if df.stored_path in _scratch[-1]:
            _scratch[-1].remove(df.stored_path)
            if len(_scratch) > 1:
                _scratch[-2].append(df.stored_path)
        return df

    try:
        yield keep
    finally:
        for path in _scratch.pop():
            remove(spark, path)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete stored results that no later plan reads."""
    for df in frames:
        remove(spark, df.stored_path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_held: dict[str, dict] = {}


def claim(owner: str) -> dict:
    """What a worker process remembers for an operator. Workers are used again by others: what those held is let go first."""
    if owner not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the C library of Linux has it
            ctypes.CDLL(None).malloc_trim(0)
        _held[owner] = {}
    return _held[owner]


def row_mapper(
    df: DataFrame, schema: str, fields: list[pa.Field], make: Callable[[], Callable[[list[list]], list[list]]], rows: int = 256
) -> DataFrame:
    """Map rows in slices of at most `rows`, so that memory follows the slice and not the partition.

    `make` runs once a task and returns the function from input columns (lists) to output columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(make.__module__)
        work = make()
        out = pa.schema(fields)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = work([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, out, strict=True)], schema=out)

    return df.mapInArrow(run, schema)


def held_out(column: str, mod: int, part: int):
    """Whether crc32 of the id as text leaves the remainder `part`; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(mod) == F.lit(part), F.lit(False))
