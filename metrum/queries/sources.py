"""Documents made from the tables, written to the shared folder and read back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from metrum.operators.sync import apply_reconciled, reconcile
from metrum.plans.durable import durable
from metrum.queries.registry import query, scratch
from metrum.queries.streaming import ARRIVALS, STATE_SQL, drain, status_events
from metrum.queries.views import Views
from metrum.sources import readers as I
from metrum.sources import writers as O
from metrum.streaming import streams as Z


def _documents(v: Views):
    """A session for each order: its lines are the beats, and so at most seven."""
    lines = v.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("b"))
    orders = v.table("orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("bpm"), "o_custkey")
    joined = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    return joined.select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), "bpm",
        F.transform("b", lambda x: x["l_quantity"].cast("double")).alias("beats"), F.array("o_orderpriority").alias("tags"),
        F.col("o_custkey").cast("int").alias("practiceCount"),
    )


def _sessions(v: Views):
    path = f"{scratch(v.spark)}/sessions"
    O.write_sessions(_documents(v), path)
    return I.read_sessions(v.spark, path, lines=True)


@query(
    "sessions_round_trip",
    """
    SELECT 'o' || l_orderkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) - 1 AS idx,
           CAST(l_quantity AS DOUBLE) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
)
def _(v: Views):
    return I.beats_long(_sessions(v))


@query(
    "rebuild_library",
    """
    SELECT 'o' || o_orderkey AS id, o_orderpriority AS title, CAST(o_totalprice AS DOUBLE) AS bpm,
           CAST(o_custkey AS INTEGER) AS "practiceCount"
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def _(v: Views):
    nothing = v.spark.createDataFrame([], "id string")
    return I.rebuild_library(_sessions(v), nothing).select("id", "title", "bpm", "practiceCount")


@query("library_round_trip", "SELECT id, title, bpm, date, position, array_to_string(tags, '|') AS tags FROM v_library")
def _(v: Views):
    path = f"{scratch(v.spark)}/library"
    O.write_library(v.library.select("id", "title", "bpm", "date", "tags", "position"), path)
    return I.read_library(v.spark, path, lines=True).select("id", "title", "bpm", "date", "position", F.array_join("tags", "|").alias("tags"))


@query(
    "folders_round_trip",
    """
    SELECT 'f' || l_orderkey AS folder, l_orderkey % 2 = 0 AS collapsed, 'p' || l_partkey AS id,
           CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS INTEGER) AS pos FROM lineitem""",
)
def _(v: Views):
    """A folder for each order, of at most seven parts."""
    path = f"{scratch(v.spark)}/folders"
    lines = v.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("b"))
    folders = lines.select(
        F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("id"), (F.col("l_orderkey") % 2 == 0).alias("collapsed"),
        F.transform("b", lambda x: F.concat(F.lit("p"), x["l_partkey"].cast("string"))).alias("sessionIds"),
    )
    O.write_folders(folders, path)
    return I.read_folders(v.spark, path, lines=True).select("folder", "collapsed", "pos", "id")


@query(
    "jobs_round_trip",
    "SELECT id, kind, done, error, canceled, CAST(started AS DOUBLE) AS started_at, CAST(updated AS DOUBLE) AS updated_at FROM v_jobs",
)
def _(v: Views):
    path = f"{scratch(v.spark)}/jobs"
    jobs = v.jobs.select("id", "kind", "done", "error", "canceled", F.col("started").cast("double").alias("started_at"), F.col("updated").cast("double").alias("updated_at"))
    O.write_jobs(jobs, path)
    return I.read_jobs(v.spark, path, lines=True).select(*jobs.columns)


@query(
    "device_state_round_trip",
    """
    SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'download' ELSE 'publish' END AS first, 'none' AS second FROM documents""",
)
def _(v: Views):
    """Two passes of a device whose state is written and read in between; the second has nothing left to do."""
    work = scratch(v.spark)
    docs = v.table("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    local = docs.filter("id % 3 <> 0").withColumn("modified_at", F.lit(5.0))
    remote = docs.filter("id % 3 = 0").select(
        "id", "digest", F.lit(10.0).alias("updated_at"), F.lit(False).alias("deleted"), F.lit(None).cast("double").alias("deleted_at"), F.lit("a|b").alias("device")
    )
    device = v.spark.createDataFrame([("me", "me", "w")], "device string, name string, workspace string")
    known = local.select("id", F.col("digest").alias("local_digest"), F.lit(None).cast("struct<at:double,device:string,digest:string>").alias("remote_revision")).filter("false")
    buried = local.select("id", F.lit(0.0).alias("deleted_at"), F.lit("me").alias("device")).filter("false")
    passes = []
    for turn in range(2):
        O.write_local_state(known, buried, device, f"{work}/state{turn}")
        state = I.read_local_state_lines(v.spark, f"{work}/state{turn}")
        sessions, tombstones = (rows.withColumn("id", F.col("id").cast("long")) for rows in (state.sessions, state.tombstones))
        result = durable(reconcile(local, remote, sessions, tombstones, 50.0))
        passes.append(result.select("id", F.col("action").alias(("first", "second")[turn])))
        local, remote, known, buried = apply_reconciled(result)
    return passes[0].join(passes[1], "id")


# --- files ---------------------------------------------------------------------------------------------------


def _scans(v: Views):
    """A folder with a file for each supplier, ``nation/frame_000001.pgm`` and so on in the order of keys, and the folder's path."""
    folder = f"{scratch(v.spark)}/scans"
    suppliers = v.table("supplier")
    numbered = suppliers.select(F.col("s_nationkey").cast("string").alias("nation"), F.col("s_suppkey").alias("number"), "s_name")
    named = numbered.select(F.concat_ws("/", F.lit(folder), "nation", F.concat(F.lit("frame_"), F.lpad(F.col("number").cast("string"), 9, "0"), F.lit(".pgm"))).alias("path"), F.repeat(F.concat("s_name", F.lit("\n")), (F.col("number") % 5 + 1).cast("int")).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                store, place = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
                store.create_dir(os.path.dirname(place))
                with store.open_output_stream(place) as out:
                    out.write(text.encode())
            yield batch.select(["path"])

    written = named.mapInArrow(write, "path string").count()
    assert written == suppliers.count()
    return folder


def _numbers(files):
    """Nation and supplier of a path."""
    return [F.element_at(F.split("path", "/"), -2).alias("nation"), F.regexp_extract("path", r"frame_(\d+)", 1).cast("long").alias("number")]


FILE_SQL = "repeat(s_name || chr(10), CAST(s_suppkey % 5 + 1 AS INTEGER))"


@query("file_inventory", f"SELECT CAST(s_nationkey AS VARCHAR) AS nation, s_suppkey AS number, CAST(strlen({FILE_SQL}) AS BIGINT) AS length, true AS dated FROM supplier")
def _(v: Views):
    files = I.read_file_inventory(v.spark, _scans(v))
    return files.select(*_numbers(files), "length", F.col("modified").isNotNull().alias("dated"))


@query("read_frames", "SELECT CAST(s_nationkey AS VARCHAR) AS nation, s_suppkey - 1 AS idx FROM supplier")
def _(v: Views):
    frames = I.read_frames(v.spark, _scans(v))
    return frames.select(_numbers(frames)[0], "idx")


@query(
    "hash_files",
    f"""
    SELECT CAST(s_nationkey AS VARCHAR) AS nation, s_suppkey AS number, CASE WHEN s_suppkey % 3 = 0 THEN 'known' ELSE sha256({FILE_SQL}) END AS sha
    FROM supplier""",
)
def _(v: Views):
    """A third of the files is known as it is, a third was known with another size, the rest is new."""
    folder = _scans(v)
    files = I.read_file_inventory(v.spark, folder)
    number = _numbers(files)[1]
    kind = number % 3
    cache = files.where(kind < 2).select("path", (F.col("length") + kind).alias("length"), "modified", F.lit("known").alias("sha"))
    hashed = I.hash_files(v.spark, [folder], cache)
    return hashed.select(*_numbers(hashed), "sha")


@query("sync_index_parts", "SELECT key, sha, (row_number() OVER (ORDER BY key) - 1) // 1000 AS part FROM v_index")
def _(v: Views):
    """Written as documents of a thousand keys; a document's smallest key tells its place."""
    path = f"{scratch(v.spark)}/index"
    O.write_sync_index(v.index.select("key", "sha"), path, keys=1000)
    documents = v.spark.read.text(path).select(F.from_json("value", "version int, files map<string,string>").alias("d"))
    files = documents.select(F.array_min(F.map_keys("d.files")).alias("first"), F.explode("d.files").alias("key", "sha"))
    order = files.select("first").distinct().select("first", (F.rank().over(Window.orderBy("first")) - 1).cast("long").alias("part"))
    return files.join(order, "first").select("key", "sha", "part")


@query("job_events_from_files", STATE_SQL)
def _(v: Views):
    """Status events as JSON lines in several files, followed as a stream."""
    work = scratch(v.spark)
    status_events(v.table("events")).repartitionByRange(ARRIVALS, "at", "seq").write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(f"{work}/events")
    drain(Z.job_state_stream(I.stream_job_events(v.spark, f"{work}/events", maxFilesPerTrigger="1"), f"{work}/out"), work)
    return Z.read_job_states(v.spark, f"{work}/out").withColumns({c: F.unix_micros(c) for c in ("started", "updated")})


@query("log_lines_from_files", "SELECT 'order ' || o_orderkey AS line, true AS named, true AS dated FROM orders")
def _(v: Views):
    """Log lines in several files, each named after its job, followed as a stream."""
    work = scratch(v.spark)
    v.table("orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("line")).repartition(ARRIVALS, "line").write.text(f"{work}/logs")
    drain(Z.write_epochs(I.stream_log_lines(v.spark, f"{work}/logs", maxFilesPerTrigger="1"), f"{work}/out"), work)
    found = Z.read_epochs(v.spark, f"{work}/out")
    return found.select("line", F.col("id").startswith("part-").alias("named"), F.col("at").isNotNull().alias("dated"))
