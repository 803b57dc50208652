"""Cutting lineage, and broadcasting only what was measured."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset the session must be a local one, and a temporary folder is made and set.
    """
    folder = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set(_KEY, folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns a scan of what was written.

    The table survives the loss of executors, is read with column pruning and has measured sizes for
    later plans. It is removed when the Python process ends.
    """
    spark = df.sparkSession
    path = staged_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is removed when the Python process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(_remove_all, spark)
    _staged[path] = None
    return path


def _remove_all(spark: SparkSession) -> None:
    for path in _staged:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone; the folder's owner clears it
        pass


def spread(df: DataFrame) -> DataFrame:
    """A scan of files, over all cores: a file of one row group is one task however much each row costs.

    A scan that already has a partition per core, as any large one does, is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def wide(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` shuffled by ``cols`` to as many partitions as a shuffle has or the cluster has cores: for small rows that make much work, which would be put into one task by their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *cols)


def within(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; counts no further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``max_rows`` rows, else as it is.

    Rows must be of bounded width. ``df`` should be cheap to read again, such as a staged table.
    """
    return F.broadcast(df) if within(df, max_rows) else df


@contextmanager
def released() -> Iterator[None]:
    """Removes, at its end, the tables staged inside of it: for work that repeats in a session that doesn't end, such as a stream's batches."""
    before = set(_staged)
    yield
    spark = SparkSession.getActiveSession()
    for path in [p for p in _staged if p not in before]:
        _remove(spark, path)
        _staged.pop(path)


#: Tables staged in this process, in order.
_staged: dict[str, None] = {}
