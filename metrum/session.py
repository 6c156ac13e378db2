"""Session settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Applied to any session the operators run in; all of them can be set at run time.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot session in a join by session even where the rows must be shuffled again afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A hash partitioning by session alone also "satisfies" a window by (session, tile); Spark would then keep a
    # hot session in one task. Requiring all keys makes every tile its own unit of work.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}

FIRST_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"

PARTITIONS = 200
"""Partitions that a shuffle begins with at least; small ones are put together afterwards."""

TASK_BYTES = 16 << 20
"""Bytes of a table for which a shuffle begins with one more partition, and bytes up to which partitions are put together."""

# A task holds several times what it reads, since shuffles and files are compressed.
SMALL_TASKS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(TASK_BYTES),
    "spark.sql.files.maxPartitionBytes": str(2 * TASK_BYTES),
}

OWN_PARTITIONS = "metrum.initialPartitionNum"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings in :data:`REQUIRED` to a session and return it."""
    for name, value in REQUIRED.items():
        if spark.conf.get(name, None) != value:
            spark.conf.set(name, value)
    return spark


def spread(spark: SparkSession, size: int = 0) -> SparkSession:
    """Begin shuffles with as many partitions as tables of ``size`` bytes need, and return the session.

    They are :data:`PARTITIONS` at least, and never fewer than for a table before. With a few, whatever the size of the
    tables, what a task sorts or groups grows with them. Numbers and sizes that the session names are left alone.
    """
    for name, value in SMALL_TASKS.items():
        if spark.conf.get(name, None) is None:
            spark.conf.set(name, value)
    named, own = spark.conf.get(FIRST_PARTITIONS, None), spark.conf.get(OWN_PARTITIONS, None)
    if named is None or named == own:
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        wanted = str(max(PARTITIONS, shuffled, -(-size // TASK_BYTES), int(named or 0)))
        if wanted != named:
            spark.conf.set(FIRST_PARTITIONS, wanted)
            spark.conf.set(OWN_PARTITIONS, wanted)
    return spark


def build_session(app: str = "metrum", master: str | None = None, **conf: str) -> SparkSession:
    """A tuned session. ``master`` is left to spark-submit unless given."""
    builder = SparkSession.builder.appName(app)
    if master:
        cores = master.removeprefix("local[").removesuffix("]")
        builder = (
            builder.master(master)
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else str(os.cpu_count() or 8))
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "12g")
        )
    for name, value in {**REQUIRED, **conf}.items():
        builder = builder.config(name, value)
    return tune(builder.getOrCreate())
