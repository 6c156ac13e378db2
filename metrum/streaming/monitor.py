"""Watching running jobs: heartbeats, and limits on silence and on total time.

A job runs from its first line of output. Each line puts the next heartbeat off by ``beat`` seconds; a heartbeat is due
every ``beat`` seconds after that. The job is over when its last line (``done``) is read, ``quiet`` seconds after a line
with none following, or ``limit`` seconds after its start; lines that come after count for nothing. Where two things
fall on one moment, the limit comes first, then silence, then the heartbeat, then the line.

``watch`` finds all that from a finished table. ``watch_stream`` finds it while lines arrive: a batch runs the batch
twin over the lines its watermark has passed and the last line of each job still running, and writes what happens up to
the watermark. Lines wait until the watermark has passed them, so the rows do not depend on the order in which lines
came in, and equal those of the batch twin up to the watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from metrum.functions.fixed import RUNNING_MESSAGE
from metrum.plans.durable import durable
from metrum.plans.ordered import Scan, running, time_tile
from metrum.streaming.streams import LATENESS, epoch_path

MICROS = 1_000_000


def messages() -> Column:
    """The status message of a heartbeat."""
    return F.when(F.col("kind") == "heartbeat", F.format_string(RUNNING_MESSAGE, F.col("elapsed")))


# --- the batch twin ------------------------------------------------------------------------------------------


def watch(lines: DataFrame, beat: int, quiet: int | None = None, limit: int | None = None, until: Column | None = None, seconds: float = 3600.0) -> DataFrame:
    """``id, kind, at, elapsed`` of lines ``(id, at, done)``; lines without a time are left out.

    ``until`` cuts off what happens after that moment: a table that ends is not a job that fell silent.
    """
    rows = _line_rows(lines).where("t IS NOT NULL").groupBy("id", "t").agg(F.max("d").alias("d"))
    known, over = _spans(rows.withColumn("begun", F.col("t")), quiet, limit, seconds)
    return _named(_happenings(known, over, beat, None if until is None else F.unix_micros(until)))


def _line_rows(lines: DataFrame) -> DataFrame:
    """``id, t, d``. Equal lines of a job are one; of two at one moment the last line of all is read last."""
    return lines.select("id", F.unix_micros("at").alias("t"), F.coalesce("done", F.lit(False)).cast("int").alias("d"))


def _named(happenings: DataFrame) -> DataFrame:
    return happenings.select(F.col("id").cast("string").alias("id"), "kind", F.timestamp_micros("t").alias("at"), F.floor((F.col("t") - F.col("start")) / MICROS).cast("long").alias("elapsed"))


END_OF_TIME = 1 << 62


def _spans(rows: DataFrame, quiet: int | None, limit: int | None, seconds: float) -> tuple[DataFrame, DataFrame]:
    """Rows ``(id, t, d, begun)`` with ``next`` and ``start``, and when each job is over, and by what."""
    end_of_time = F.lit(END_OF_TIME).cast("long")
    known = running(
        rows, ["id"], time_tile(F.col("t") / MICROS, seconds), ["t"],
        {"next": Scan("last", F.col("t"), (-F.col("t"),), reverse=True, exclusive=True), "start": Scan("min", F.col("begun"), whole=True)},
    )
    silent = F.lit(None).cast("long") if quiet is None else F.when((F.col("d") == 0) & (F.coalesce("next", end_of_time) - F.col("t") >= quiet * MICROS), F.col("t") + quiet * MICROS)
    expired = F.lit(None).cast("long") if limit is None else F.min("start") + limit * MICROS
    ends = known.groupBy("id").agg(F.min("start").alias("start"), F.min(silent).alias("silent"), F.min(F.when(F.col("d") == 1, F.col("t"))).alias("last"), expired.alias("expired"), F.max("t").alias("latest"))
    first = F.least("silent", "last", "expired")
    kind = F.when(F.col("expired") == first, "expired").when(F.col("silent") == first, "silent")
    return known, ends.select("id", "start", "latest", first.alias("over"), kind.alias("kind"))


def _happenings(known: DataFrame, over: DataFrame, beat: int, until: Column | None) -> DataFrame:
    """``id, kind, t, start`` of all that happens up to the microsecond ``until``."""
    end_of_time = F.lit(END_OF_TIME).cast("long")
    stopped = over.where("kind IS NOT NULL").select("id", "kind", F.col("over").alias("t"), "start")
    lively = known.select("id", "t", "next", "start").join(over.select("id", "over", "kind"), "id")
    # A heartbeat comes before a line of the same moment, but after the end.
    bound = F.least(F.coalesce("next", end_of_time), F.coalesce(F.when(F.col("kind").isNotNull(), F.col("over") - 1).otherwise(F.col("over")), end_of_time))
    if until is not None:
        bound = F.least(bound, until)
        stopped = stopped.where(F.col("t") <= until)
    count = F.floor((bound - F.col("t")) / (beat * MICROS)).cast("long")
    # Without an end in sight there is no last heartbeat.
    beats = lively.where(F.coalesce("over", end_of_time) > F.col("t")).where(bound < end_of_time).where(count >= 1)
    each = beats.select("id", "t", "start", F.explode(F.sequence(F.lit(1).cast("long"), count)).alias("k"))
    ticks = each.select("id", F.lit("heartbeat").alias("kind"), (F.col("t") + F.col("k") * (beat * MICROS)).alias("t"), "start")
    return stopped.unionByName(ticks)


# --- the stream ----------------------------------------------------------------------------------------------


def watch_stream(lines: DataFrame, path: str, beat: int, quiet: int | None = None, limit: int | None = None, delay: str = LATENESS, keep: int = 86_400) -> DataStreamWriter:
    """Append what happens to running jobs to ``path``: the rows of :func:`watch`, as soon as the watermark has passed them.

    Lines ``(id, at, done)`` may come out of order by ``delay``. A job that is over is remembered for ``keep`` seconds;
    lines of its id that come later are a new job. By epoch, a folder beside ``path`` holds the watermark, the lines
    that wait for it, and start and last line of the jobs that run or are remembered. A batch reads and writes these.
    """
    marks, waiting, jobs = (f"{path}_state/{name}" for name in ("watermark", "waiting", "jobs"))

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession

        def keep_rows(rows: DataFrame, folder: str) -> None:
            rows.write.mode("overwrite").parquet(epoch_path(folder, epoch))
            # A retry needs the epoch before.
            old = spark._jvm.org.apache.hadoop.fs.Path(epoch_path(folder, epoch - 2))
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

        rows = _line_rows(batch).withColumn("id", F.col("id").cast("string")).where("t IS NOT NULL")
        before = spark.read.parquet(epoch_path(marks, epoch - 1)).first()["t"] if epoch else None
        millis = F.timestamp_millis(F.floor(F.max("t") / 1000).cast("long"))
        newest = rows.agg(F.unix_micros(millis - F.expr(f"INTERVAL {delay}")).alias("t")).first()["t"]
        now = max((t for t in (before, newest) if t is not None), default=-END_OF_TIME)
        since = -END_OF_TIME if before is None else before
        rows, begun = rows.where(F.col("t") > since), []
        if epoch:
            held = spark.read.parquet(epoch_path(jobs, epoch - 1))
            rows = rows.join(held.where("forget IS NOT NULL").select("id"), "id", "left_anti")
            rows = rows.unionByName(spark.read.parquet(epoch_path(waiting, epoch - 1)))
            begun = [held.where("forget IS NULL").select("id", F.col("last").alias("t"), F.lit(0).alias("d"), F.col("start").alias("begun"))]
        rows = durable(rows.groupBy("id", "t").agg(F.max("d").alias("d")))
        due = rows.where(F.col("t") <= now).withColumn("begun", F.col("t"))
        for part in begun:
            due = due.unionByName(part)
        known, over = map(durable, _spans(due, quiet, limit, 86_400.0))
        found = _happenings(known, over, beat, F.lit(now)).where(F.col("t") > since)
        _named(found).write.mode("overwrite").parquet(epoch_path(path, epoch))
        ended = F.coalesce(F.col("over") <= now, F.lit(False))
        after = over.select("id", "start", F.col("latest").alias("last"), F.when(ended, F.lit(now + keep * MICROS)).alias("forget"))
        if epoch:
            after = after.unionByName(held.where(F.col("forget") > now))
        keep_rows(after, jobs)
        keep_rows(rows.where(F.col("t") > now).join(over.where(ended).select("id"), "id", "left_anti"), waiting)
        keep_rows(spark.range(1).select(F.lit(None if now == -END_OF_TIME else now).cast("long").alias("t")), marks)

    return lines.writeStream.foreachBatch(sink)
