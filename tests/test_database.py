"""A database that other processes read."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
RUN = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://" + sys.argv[1]).config("spark.executor.memory", "512m")
    .config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.sql.shuffle.partitions", "2").getOrCreate())
from geotide.queries_io import postgres_source
spark.range(3000).select(F.col("id").alias("c_custkey"), F.when(F.col("id") % 7 > 0, F.col("id") / 3).alias("c_acctbal"), F.lit("x").alias("c_mktsegment")).write.parquet(sys.argv[1] + "/in/customer.parquet")
got = {r["id"]: tuple(r)[1:] for r in postgres_source(spark, sys.argv[1] + "/in").collect()}
want = {k: (k * 37 % 3600 / 10 - 180, k * 53 % 1800 / 10 - 90, k / 3 if k % 7 else None) for k in range(3000)}
want = {k: v for k, v in want.items() if -60 <= v[0] <= 90.5 and -30 <= v[1] <= 60}
assert got == want and len(want) > 500, (len(got), len(want))
print("EQUAL", len(got))
"""


def test_the_database_is_read_by_executors_of_a_cluster(tmp_path):
    paths = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
    done = subprocess.run([sys.executable, "-c", RUN, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": paths, "SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": str(Path(__import__("pyspark").__file__).parent)}, capture_output=True, text=True, timeout=120)
    assert "EQUAL" in done.stdout, done.stderr[-3000:]
