"""Cutting the lineage of loops by tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []  # tables of this process that were not deleted yet
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only in local mode, where it is unset (as in tests), a temporary one stands in for it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="sitespan-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


def cut(df: DataFrame, tag: str = "step") -> DataFrame:
    """df computed, written as Parquet and read from there from now on: columns are pruned, sizes known, and lost executors lose nothing.

    The table stays for later reads; scope() or clear() delete it.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end every table that was cut within. For results that were written or collected by then."""
    before = len(_written)
    try:
        yield
    finally:
        while len(_written) > before:
            remove(spark, _written.pop())


def clear(spark: SparkSession) -> None:
    """Deletes all tables this process has cut; results that still read them can no longer be computed."""
    while _written:
        remove(spark, _written.pop())
