"""What the text operators need of a session: the shared folder, written tables, importable workers."""

from __future__ import annotations

import atexit
import io
import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.column import Column

from .store import put

_ROOT = Path(__file__).resolve().parents[2]
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets
    a folder of its own; on a cluster there is no such folder to choose."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
    return (found or f"file:///tmp/geotide-shared-{os.getpid()}").rstrip("/")


_shipped: set[str] = set()

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that operators on whole texts take at once: the JVM and the worker each hold several copies of a batch.
LITTLE = 4 << 20
#: By session, its own limit of a batch and the one that ``ready`` has set.
_batches: dict[str, tuple[str, str]] = {}


def ready(spark: SparkSession, batch: int | None = None) -> None:
    """Ship this package to the Python workers, once a session, and limit what goes to a worker at once to ``batch`` bytes.

    The limit is the session's that holds when rows are asked for, so it stays set until the next operator is made ready;
    one that asks for none gets the session's own, and a smaller one of the session's own is left."""
    app = spark.sparkContext.applicationId
    now = spark.conf.get(_BATCH)
    own, ours = _batches.get(app, (now, now))
    own = own if now == ours else now
    size = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own)
    _batches[app] = own, own if batch is None or 0 < size <= batch else f"{batch}b"
    spark.conf.set(_BATCH, _batches[app][1])
    if app in _shipped:
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted((_ROOT / "geotide").rglob("*.py")):
            z.write(f, str(f.relative_to(_ROOT)))
    path, name = new_path(spark, "code"), "geotide.zip"
    put(path, name, held.getvalue())
    spark.sparkContext.addPyFile(f"{path}/{name}")
    _shipped.add(app)


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/geotide-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_drop_all)
    _written.append((spark, path))
    return path


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and survives lost executors.

    The shuffle files go as soon as the rows are written, not when the driver happens to collect its garbage.
    """
    path, before = new_path(spark, what), spark.conf.get(_CLEAN)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Delete what ``table`` wrote, once nothing lazy reads it any more."""
    for file in df.inputFiles()[:1]:
        remove(spark, file.rsplit("/", 1)[0])


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: the folder's owner cleans up
            return


def remainder(column: str | Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; a null id counts as empty text, whose remainder is 0."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) from the columns' text and the seed: the first 48 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
