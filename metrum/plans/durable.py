"""Lineage cuts and written tables that survive the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _local(spark: SparkSession) -> str:
    """A folder of this machine, for tests; refused where executors run elsewhere."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a directory shared by all executors")
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def scratch(spark: SparkSession) -> str:
    """A fresh directory in the shared folder the cluster names in ``spark.checkpoint.dir``."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/{uuid.uuid4()}" if shared else _local(spark)


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` into the reliable directory the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Only where neither that setting nor a checkpoint directory
    is present, as in local tests, a scratch directory is chosen.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or _local(spark))
    return df.checkpoint(eager=True)
