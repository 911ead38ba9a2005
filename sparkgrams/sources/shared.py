"""The folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Only where that is unset one of
    its own is used: on a single machine a temporary folder that goes with the
    process, else one in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local["):
        base = os.path.join(tempfile.gettempdir(), f"sparkgrams-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    elif not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_sparkgrams"
    return base.rstrip("/")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any file system; none if it isn't
    there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return []
    return [f.getPath().getName() for f in system.listStatus(target) if f.isDirectory()]
