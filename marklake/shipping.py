"""Getting this package to the executors, and rows to all cores."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add this package to the Python path of all executors, once for each Spark application."""
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.abspath(__file__))
    if app in _SHIPPED or not os.path.isdir(root):
        return
    out = os.path.join(tempfile.mkdtemp(prefix="marklake-"), "marklake-engine.zip")
    with zipfile.ZipFile(out, "w") as z:
        for top, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(top, n)
                    z.write(path, os.path.join("marklake", os.path.relpath(path, root)))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a scan has fewer parts than there are: a small file of one row group is one
    task otherwise.  Large tables have more parts than cores and stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
