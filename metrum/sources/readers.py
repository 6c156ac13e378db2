"""Readers. Documents keep their nested form; ``*_long`` functions give the row form the operators use."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from metrum.functions.scalars import parse_revision
from metrum.plans.durable import durable
from metrum.sources import schemas


def read_sessions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """All session documents in a directory, with ``file`` and ``modified``; unreadable ones have ``_corrupt`` set.

    ``lines`` reads what :func:`metrum.sources.writers.write_sessions` writes: one document per line.
    """
    documents = (
        spark.read.schema(schemas.SESSION)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    name = F.col("_metadata.file_name")
    return documents.select("*", name.alias("file"), F.col("_metadata.file_modification_time").alias("modified")).filter(
        ~F.col("file").isin("manifest.json", "folders.json")
    )


def beats_long(sessions: DataFrame, column: str = "beats") -> DataFrame:
    return sessions.select(F.col("id").alias("s"), F.posexplode(column).alias("idx", "t")).withColumn("idx", F.col("idx").cast("long"))


def sections_long(sessions: DataFrame, column: str = "sections") -> DataFrame:
    rows = sessions.select(F.col("id").alias("s"), F.posexplode(column).alias("idx", "_x"))
    return rows.select("s", F.col("idx").cast("long").alias("idx"), "_x.*")


def read_library(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Library entries with an id, with their ``position``; ``lines`` for one entry per line."""
    return _listed(spark, path, schemas.LIBRARY, lines).filter(F.col("id").isNotNull())


def read_folders(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Folder listings in long form ``(folder, name, collapsed, folder_pos, pos, id)``."""
    folders = _listed(spark, path, schemas.FOLDER, lines).filter(F.col("id").isNotNull())
    return folders.select(
        F.col("id").alias("folder"), "name", F.coalesce("collapsed", F.lit(False)).alias("collapsed"),
        F.col("position").alias("folder_pos"), F.posexplode_outer("sessionIds").alias("pos", "_id"),
    ).withColumnRenamed("_id", "id")


def _listed(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """Items of documents that hold one list, or of JSON lines; a document that is no list counts as empty."""
    if lines:
        return spark.read.schema(f"{schema}, position bigint").json(path)
    text = spark.read.text(path, wholetext=True).select("value")
    items = F.from_json("value", f"array<struct<{_struct(schema)}>>", {"mode": "PERMISSIVE"})
    usable = F.when(F.ltrim("value").startswith("["), items)
    return text.select(F.posexplode(usable).alias("position", "_x")).filter("_x is not null").select("_x.*", "position")


def _struct(schema: str) -> str:
    """Struct members from a column list: ``a string`` becomes ``a:string``."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).simpleString().removeprefix("struct<").removesuffix(">")


def read_jobs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Job records with an id; ``spec`` and ``result`` stay JSON text. ``lines`` for one record per line."""
    return _listed(spark, path, schemas.JOB, lines).filter(F.col("id").isNotNull()).drop("position")


def read_sync_index(spark: SparkSession, path: str) -> DataFrame:
    """``(key, sha)`` of one index document or of a directory of index parts."""
    documents = spark.read.text(path, wholetext=True).select(F.from_json("value", schemas.INDEX).alias("_d"))
    return documents.select(F.explode("_d.files").alias("key", "sha"))


@dataclass(frozen=True)
class DeviceState:
    """Tables of a device state document."""

    sessions: DataFrame
    tombstones: DataFrame
    devices: DataFrame


def read_remote_state(spark: SparkSession, path: str) -> DeviceState:
    """Shared state: entries, deleted entries and devices; absent parts are empty tables."""
    d = _document(spark, path, schemas.REMOTE_STATE)
    entries = d.select(F.explode("sessions").alias("id", "_e")).select(
        "id", F.col("_e.digest").alias("digest"), F.col("_e.updatedAt").alias("updated_at"),
        F.coalesce("_e.deleted", F.lit(False)).alias("deleted"), F.col("_e.deletedAt").alias("deleted_at"),
        F.col("_e.deviceId").alias("device"), F.col("_e.entryDate").alias("date"), F.col("_e.files").alias("files"),
    )
    devices = d.select(F.explode("devices").alias("device", "_v")).select(
        "device", F.col("_v.name").alias("name"), F.col("_v.lastSeenAt").alias("last_seen")
    )
    return DeviceState(entries, entries.filter("deleted").select("id", "deleted_at", "device"), devices)


def read_local_state(spark: SparkSession, path: str) -> DeviceState:
    """State a device remembers: digests by session, tombstones, and the device itself."""
    d = _document(spark, path, schemas.LOCAL_STATE)
    sessions = d.select(F.explode("sessions").alias("id", "_e")).select(
        "id", F.col("_e.localDigest").alias("local_digest"), parse_revision("_e.remoteRevision").alias("remote_revision")
    )
    tombs = d.select(F.explode("tombstones").alias("id", "_e")).select(
        "id", F.col("_e.deletedAt").alias("deleted_at"), F.col("_e.deviceId").alias("device")
    )
    devices = d.select(
        F.col("deviceId").alias("device"), F.coalesce("deviceName", F.lit("device")).alias("name"), F.col("workspaceKey").alias("workspace")
    )
    return DeviceState(sessions, tombs, devices)


def read_local_state_lines(spark: SparkSession, path: str) -> DeviceState:
    """The same from the folders that ``write_local_state`` writes."""
    sessions = spark.read.schema(schemas.LOCAL_SESSION).json(f"{path}/sessions")
    tombs = spark.read.schema(schemas.TOMBSTONE).json(f"{path}/tombstones")
    devices = spark.read.schema(schemas.DEVICE).json(f"{path}/device")
    return DeviceState(
        sessions.select("id", F.col("localDigest").alias("local_digest"), parse_revision("remoteRevision").alias("remote_revision")),
        tombs.select("id", F.col("deletedAt").alias("deleted_at"), F.col("deviceId").alias("device")),
        devices.select(F.col("deviceId").alias("device"), F.coalesce("deviceName", F.lit("device")).alias("name"), F.col("workspaceKey").alias("workspace")),
    )


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("_d")).select("_d.*")


def read_file_inventory(spark: SparkSession, *paths: str) -> DataFrame:
    """``(path, length, modified)`` of all files below the paths. Contents are not read. Spark lists no empty files."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
        .option("ignoreCorruptFiles", True).load(list(paths))
    )
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def read_frames(spark: SparkSession, *paths: str) -> DataFrame:
    """Frame files ``(path, name, idx)``; the name ``frame_000123`` carries the scan index plus one."""
    name = F.element_at(F.split("path", "/"), -1)
    number = F.regexp_extract(name, r"^frame_(\d+)\.", 1)
    files = read_file_inventory(spark, *paths).withColumn("name", name)
    return files.filter(number != "").select("path", "name", (number.cast("long") - 1).alias("idx"))


PIECE = 4 << 20
"""Bytes of a file that are held at once while it is hashed."""


def open_file(path: str):
    """A stream of bytes from a path as Spark lists it. Runs where the file is hashed."""
    from pyarrow import fs

    store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_stream(place)


def hash_content(files: DataFrame, opened=open_file, piece: int = PIECE) -> DataFrame:
    """Add ``sha`` to rows with a ``path``: the SHA-256 of the file, read in pieces; null where it can't be read any more.

    A file of any size is hashed by one task in the memory of one piece; files are dealt out by a hash of their path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                try:
                    with opened(path) as stream:
                        while part := stream.read(piece):
                            digest.update(part)
                except FileNotFoundError:
                    found.append(None)
                else:
                    found.append(digest.hexdigest())
            yield batch.append_column("sha", pa.array(found, pa.string()))

    schema = StructType([*files.schema.fields, StructField("sha", StringType())])
    return files.repartition("path").mapInArrow(run, schema)


def hash_files(spark: SparkSession, paths: list[str], cache: DataFrame, opened=open_file) -> DataFrame:
    """``(path, length, modified, sha)``: the cached hash where size and time are unchanged, else that of the content.

    Files are listed without their contents; only those the cache doesn't know are opened. A file that is gone by the
    time it is read has a null hash. ``opened`` opens a path of another store than the ones Arrow knows.
    """
    inventory = read_file_inventory(spark, *paths)
    key = ["path", "length", "modified"]
    known = durable(inventory.join(cache.select(*key, "sha").dropDuplicates(key), key, "left").select(*key, "sha"))
    fresh = hash_content(known.filter("sha is null").select(*key), opened)
    return known.filter("sha is not null").unionByName(fresh)


def rebuild_library(sessions: DataFrame, existing: DataFrame) -> DataFrame:
    """Library from session documents, newest file first, but only if there is no library yet."""
    rebuilt = sessions.filter(F.col("id").isNotNull()).select(
        "id", "title", "bpm", F.date_format("modified", "yyyy-MM-dd").alias("date"), "assets", "tags", "lastPracticedAt",
        "practiceCount", "modified",
    )
    empty = existing.isEmpty()
    kept = rebuilt if empty else rebuilt.limit(0)
    return kept.orderBy(F.col("modified").desc(), "id")


def stream_job_events(spark: SparkSession, path: str, schema: str = schemas.JOB_EVENT, **options: str) -> DataFrame:
    """Status events as they arrive in a directory of JSON lines."""
    return spark.readStream.schema(schema).options(**options).json(path)


def stream_log_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Log lines ``(id, line, at, seq)``: the file they came from, its time, and their place in it.

    A log file is read once, when it is complete, and as a whole, since only so its lines keep their order.
    """
    files = spark.readStream.options(**options).text(path, wholetext=True)
    ids = F.element_at(F.split(F.col("_metadata.file_name"), r"\."), 1)
    # The last line may end with a break or not.
    lines = F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")
    placed = files.select(ids.alias("id"), F.col("_metadata.file_modification_time").alias("at"), F.posexplode(lines).alias("seq", "line"))
    return placed.select("id", "line", "at", F.col("seq").cast("long").alias("seq"))
