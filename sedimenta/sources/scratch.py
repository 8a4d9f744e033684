"""Tables that are written and read again: folders below the one in spark.checkpoint.dir, which all executors share, until clear() deletes them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path. Where spark.checkpoint.dir is not set it lies in a temporary folder that goes with the process, which serves a
    session in one process (tests, a laptop) only; on a cluster the setting is asked for."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="sedimenta-"))
            atexit.register(shutil.rmtree, _LOCAL[0], True)
        base = f"file://{_LOCAL[0]}"
    _MADE.append(f"{base.rstrip('/')}/sedimenta/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this process has asked for, when no result that reads them is needed any more; returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_MADE)
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)
    return n
