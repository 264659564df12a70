"""Python workers: they import this package, and get batches of bounded size."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Rows of a batch that Spark hands to Python.
ARROW_ROWS = 2000


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster may ship it with --py-files
    instead), and hand them no more than ARROW_ROWS rows at once, which bounds their memory where rows are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) not in range(1, ARROW_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
