"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Lists of staged tables, one for each open :func:`owned` block, the innermost last.
_OWNERS: ContextVar[tuple[list[tuple[SparkSession, str]], ...]] = ContextVar("owners", default=())


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the folder given to ``setCheckpointDir``, else one below the warehouse.

    The first two are folders that every executor sees. So is a cluster's warehouse; only where none is configured, which
    is a session on one machine, is it a folder of that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/staged").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and return it as read back.

    Later steps read the written table, so they neither repeat the work nor depend on the executors that did it. The
    table belongs to the :func:`owned` block around the call - with ``keep`` to the one around that - and else to the
    caller, who may :func:`unstage` it once nothing lazy reads it any more.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    owners = _OWNERS.get()[:-1] if keep else _OWNERS.get()
    if owners:
        owners[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def owned() -> Iterator[None]:
    """Drop what is staged inside at the end, also after a failure.

    What leaves the block must not read those tables lazily: it is staged with ``keep``, or has been used up.
    """
    mine: list[tuple[SparkSession, str]] = []
    token = _OWNERS.set((*_OWNERS.get(), mine))
    try:
        yield
    finally:
        _OWNERS.reset(token)
        for spark, path in mine:
            drop_folder(spark, path)


def _qualified(spark: SparkSession, path: str):
    """``path`` as its file system writes it, and that file system."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(found), system


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder below the shared one; any other is refused."""
    root = _qualified(spark, shared_root(spark))[0].toString()
    path, system = _qualified(spark, folder)
    if not path.toString().startswith(f"{root}/"):
        raise ValueError(f"not a staged table: {folder}")
    system.delete(path, True)


def unstage(staged: DataFrame) -> None:
    """Delete the table that :func:`stage` wrote for ``staged``; frames of anything else are refused."""
    for folder in {f.rpartition("/")[0] for f in staged.inputFiles()}:
        drop_folder(staged.sparkSession, folder)
