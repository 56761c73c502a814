"""Shared scratch storage for cutting lineage.

The folder is the one the cluster names in ``spark.checkpoint.dir``; it must be visible to every executor. Only where
the setting is absent and Spark runs in this process alone (tests, a laptop) a private temporary folder is made; on a
cluster without the setting there is no folder that all executors see, and that is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; in local mode a temporary one of our own where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        path = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own[app] = "file://" + path
    return _own[app]


def _folder(spark: SparkSession) -> str:
    """This application's folder. It goes when the driver's Python ends: nothing that reads from it outlives that."""
    app = spark.sparkContext.applicationId
    if app not in _used:
        _used.add(app)
        atexit.register(discard, spark)
    return f"{shared_dir(spark)}/corpusloom/{app}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the result survives lost executors and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "lz4")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(spark: SparkSession) -> None:
    """Delete what this application staged in the shared folder. Results that still read from it become invalid."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(spark))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except (AttributeError, Py4JError, OSError):
        pass  # the session is gone already, and with it the means to delete
