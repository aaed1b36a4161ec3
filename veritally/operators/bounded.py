"""Small sides and cut lineage.

Two rules used all over the package: a side is broadcast only after its row
count was checked, and a table that several later jobs read is written once to
the cluster's shared checkpoint folder.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def small_table(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> pa.Table | None:
    """The rows of a small result, or None when it has more than ``max_rows``."""
    table = df.limit(max_rows + 1).toArrow()
    return table if table.num_rows <= max_rows else None


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is proven small, else unchanged.

    A side beyond the bound keeps Spark's shuffle join.
    """
    table = small_table(df, max_rows)
    if table is None:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(table, schema=df.schema))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a session on one machine, as in tests, may leave it unset; such a session gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared folder, for tables and models."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # known to Spark 4.1; others ignore it
_writing = threading.Lock()
_writers: list = []  # one entry per write under way; the first knows the setting found


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: they go when their query ends, not when the driver collects garbage."""
    with _writing:
        _writers.append(_writers[0] if _writers else spark.conf.get(CLEANUP, "false"))
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _writing:
            found = _writers.pop()
            if not _writers:
                spark.conf.set(CLEANUP, found)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it from there.

    Later jobs read the columns they need, and a lost executor costs no recomputation.
    """
    path = scratch_path(df.sparkSession, "stored")
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
