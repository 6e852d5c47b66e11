"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written by this process and not yet removed.
_PATHS: dict[str, None] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, the context's own, or a temporary folder if all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    sc = spark.sparkContext
    if not (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sitelore_"))
        found = sc._jsc.sc().getCheckpointDir()
    return found.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder; it goes by ``remove_path``, by ``clear_scratch`` or when the driver's Python ends."""
    if not _PATHS:
        atexit.register(clear_scratch, spark)
    path = f"{shared_dir(spark)}/sitelore/{name}-{uuid.uuid4().hex}"
    _PATHS[path] = None
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    _PATHS.pop(path, None)
    try:
        jvm, sc = spark.sparkContext._jvm, spark.sparkContext
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables still there: a driver that lives long calls this between jobs, once it has read their results."""
    for path in list(_PATHS):
        remove_path(spark, path)


def written(df: DataFrame, name: str, *, rows: int | None = None, compression: str = "zstd") -> DataFrame:
    """Cut the lineage: write to the shared folder and read again.

    With ``rows``, a bound of a narrow table's size, its files hold half a million
    rows or so each: small tables of many partitions don't become many files.
    """
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // 500_000)))
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame | None) -> None:
    """Remove tables of ``written`` that no later step reads."""
    for table in tables:
        if table is not None and (path := getattr(table, "_scratch", None)):
            remove_path(table.sparkSession, path)
