"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only on one machine, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, local, True)
        spark.sparkContext.setCheckpointDir(local)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders through Hadoop's file systems, whichever they are in."""
    sc = spark.sparkContext
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


class Stored:
    """A table cut off from its lineage: Parquet in the shared folder."""

    def __init__(self, df: DataFrame, label: str):
        self.spark, self.path = df.sparkSession, new_folder(df.sparkSession, label)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


#: Folders of results, a list for each open block of ``passing``.
_PASSING: list[list[str]] = []


@contextmanager
def passing(spark: SparkSession):
    """Results that work leaves behind inside this block go when it ends: for a caller that has stored what it made of them."""
    _PASSING.append([])
    try:
        yield
    finally:
        remove(spark, *_PASSING.pop())


class Scope:
    """The stored tables of one piece of work; they go together when it ends.

    with Scope(spark) as scope:
        edges = scope.store(df, "edges")
        return scope.result(edges.groupBy(...), "degrees")
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._tables = spark, [], []

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *error) -> None:
        for name in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, *self._paths)
        # plans that nobody holds any more still own shuffle files until the driver's JVM collects them
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def store(self, df: DataFrame, label: str) -> DataFrame:
        """The table read back from the shared folder."""
        stored = Stored(df, label)
        self._paths.append(stored.path)
        return stored.df

    def holds(self, path: str | None = None, table: str | None = None) -> None:
        """A folder or a catalog entry that goes with the rest."""
        if path:
            self._paths.append(path)
        if table:
            self._tables.append(table)

    def result(self, df: DataFrame, label: str) -> DataFrame:
        """What the work leaves behind: stored, so that nothing else has to stay."""
        stored = Stored(df, label)
        if _PASSING:
            _PASSING[-1].append(stored.path)
        return stored.df
