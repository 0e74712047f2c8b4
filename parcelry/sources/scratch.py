"""Intermediate tables that cut lineage, kept in the cluster's shared folder.

``keep`` writes a DataFrame as Parquet below the checkpoint directory of the session
(``spark.checkpoint.dir``) and reads it back. A lost executor then costs a re-read, not a
recomputation, and every column of a later read is pruned as in any other Parquet scan. The files
go when ``discard`` or the end of a ``tables_of`` block says so, or else when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Paths written so far, for each tables_of block that is open.
_open_blocks: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint directory of the session; one of our own only in local mode and where none is set (tests)."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-parcelry-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/parcelry-{name}-{uuid.uuid4().hex}"


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Delete an existing path, wherever Hadoop keeps it, when the application ends."""
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(target)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return the re-read table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    drop_at_exit(spark, path)
    for block in _open_blocks:
        block.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned and nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table._kept_at)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def tables_of(spark: SparkSession, *, but: list[DataFrame]) -> Iterator[None]:
    """At the end of the block, delete the tables kept inside it, apart from those the block has put into ``but``."""
    _open_blocks.append([])
    try:
        yield
    finally:
        stay = {table._kept_at for table in but}
        for path in _open_blocks.pop():
            if path not in stay:
                _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
