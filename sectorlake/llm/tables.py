"""Durable intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: While a table is written, its query's shuffle files go as soon as it ends: nothing reads them again.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCAL: list[str] = []
_RUN = uuid.uuid4().hex


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where it is unset on a local master (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="sectorlake-"))
    return _LOCAL[0]


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def _sweep(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when Python ends, or when the JVM does if the session has been stopped by then."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(hadoop)
    system.deleteOnExit(hadoop)

    def now() -> None:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)

    atexit.register(now)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Lineage ends at the written table, so a lost executor costs no recomputation of what came
    before, and every later branch sees the very same rows.  The run's folder goes at exit.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/sectorlake-{_RUN}"
    if root not in _SWEPT:
        _SWEPT.add(root)
        _sweep(spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table made by ``materialize`` that nothing reads any more."""
    if df is not None and hasattr(df, "_shared_path"):
        _remove(df.sparkSession, df._shared_path)


_SWEPT: set[str] = set()
