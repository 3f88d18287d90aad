"""Files in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex
_LOCAL: list[str] = []
_KEPT: set[str] = set()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under ``spark.checkpoint.dir``, which goes when the session ends.

    Only on a local master, where the setting may be missing, a temporary folder serves instead.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append("file://" + tempfile.mkdtemp(prefix="sectorlake-files-"))
        root = _LOCAL[0]
    own = f"{root}/files-{_RUN}"
    if own not in _KEPT:
        _KEPT.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once, where its lineage ends and which all later branches read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
