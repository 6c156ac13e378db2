"""Writers. Every writer replaces its target as a whole; Spark's committer makes the swap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.functions.scalars import revision_text
from metrum.plans.rank import ranked

INDEX_KEYS = 50_000
"""Keys per part of a written sync index."""


def write_sessions(sessions: DataFrame, path: str) -> None:
    """One JSON line per session document, spread over as many files as the data has partitions."""
    drop = [c for c in ("file", "modified", "_corrupt") if c in sessions.columns]
    sessions.drop(*drop).write.mode("overwrite").json(path)


def replace_session_parts(rows: DataFrame, path: str, part: str = "part") -> None:
    """Overwrite only the partitions of ``part`` that occur in ``rows``."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def write_library(library: DataFrame, path: str) -> None:
    library.write.mode("overwrite").json(path)


def write_jobs(jobs: DataFrame, path: str) -> None:
    """All records. To keep only the latest ones is :func:`metrum.operators.jobs.latest_jobs`."""
    jobs.write.mode("overwrite").json(path)


def write_folders(folders: DataFrame, path: str) -> None:
    """One JSON line per folder document."""
    folders.write.mode("overwrite").json(path)


def write_local_state(sessions: DataFrame, tombstones: DataFrame, devices: DataFrame, path: str) -> None:
    """What a device remembers, as JSON lines in a folder for each table; the inverse of ``read_local_state_lines``.

    The document form holds a whole device in one row; lines hold any number of sessions.
    """
    parts = {
        "sessions": sessions.select("id", F.col("local_digest").alias("localDigest"), revision_text("remote_revision").alias("remoteRevision")),
        "tombstones": tombstones.select("id", F.col("deleted_at").alias("deletedAt"), F.col("device").alias("deviceId")),
        "device": devices.select(F.col("device").alias("deviceId"), F.col("name").alias("deviceName"), F.col("workspace").alias("workspaceKey")),
    }
    for name, rows in parts.items():
        rows.write.mode("overwrite").json(f"{path}/{name}")


def write_sync_index(index: DataFrame, path: str, keys: int = INDEX_KEYS) -> None:
    """Sorted-key index documents ``{"version": 1, "files": {...}}`` of at most ``keys`` keys each.

    One document for everything would pass the whole index through one task; parts hold consecutive keys instead, and
    :func:`metrum.sources.readers.read_sync_index` reads any number of them.
    """
    placed = ranked(index, [F.col("key").asc()], "_pos")
    parts = placed.groupBy(F.floor(F.col("_pos") / keys).alias("_part")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "sha")))).alias("files")
    )
    document = F.to_json(F.struct(F.lit(1).alias("version"), "files"))
    # One document per file, so that a reader never holds more than one of them.
    documents = parts.select(document.alias("value"))
    documents.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
