"""A passing folder for what queries write and read back: in the cluster's shared folder, or a local one in local sessions."""

from __future__ import annotations

import atexit
import os
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

_made: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file:///tmp/geotide-scratch-{os.getpid()}"
    if not _made:
        atexit.register(_drop)
    path = f"{base.rstrip('/')}/geotide-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def put(path: str, data: bytes) -> None:
    store, at = fs.FileSystem.from_uri(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(data)


def _drop() -> None:
    for spark, path in _made:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            return
