"""Arrays in the shared folder."""

import os
import re
import resource
import time

import numpy as np
from pyspark.sql import functions as F

from geotide.llm import store
from geotide.llm.runtime import table


def test_many_names_of_many_arrays_stay_readable_under_a_small_limit_of_open_files(tmp_path):
    path = f"file://{tmp_path}"
    kinds = [np.uint8, np.uint64, np.int64, np.float64]
    given = {f"a{k}": np.arange(k * 3).astype(kinds[k % 4]) for k in range(20)} | {"flat": np.arange(6.0).reshape(2, 3)}
    for n in range(60):
        store.save(path, f"part-{n}", given | {"n": np.array([n])})
    soft, hard = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (len(os.listdir("/proc/self/fd")) + 90, hard))
    try:
        held = [store.load(path, f"part-{n}") for n in range(60)]
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, (soft, hard))
    for n, got in enumerate(held):
        assert got["n"][0] == n and set(got) == set(given) | {"n"}
        assert all(got[k].dtype == a.dtype and np.array_equal(got[k], a) for k, a in given.items())
    assert store.load(path, "absent") == {}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """They go at once, not when the driver collects its garbage; the session's setting stays as it was."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return set(re.findall(r"shuffle_\d+", disk.getAllBlocks().mkString(" ")))

    old = files()
    df = spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count()
    out = table(spark, df, "counts")
    for _ in range(100):
        if not files() - old:
            break
        time.sleep(0.1)
    assert not files() - old and out.count() == 100 and spark.conf.get(name) == before
