"""Job records: state, history, archive, restart and cancellation.

Job rows are ``(id, done, error, canceled, interrupted, resumable, archived, started, updated, finished, ...)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.functions.fixed import CANCELED_MESSAGE, CANCEL_REQUESTED_MESSAGE
from metrum.functions.scalars import or_default


def truthy(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def has_error() -> Column:
    return F.coalesce(F.col("error"), F.lit("")) != ""


def job_history(jobs: DataFrame) -> DataFrame:
    """Without result and spec; a finished job without a finish time gets its last update; adds ``duration``."""
    finished = or_default("finished", F.when(truthy("done"), F.col("updated")))
    history = jobs.drop("result", "spec").withColumn("finished", finished)
    return history.withColumn("duration", F.when(
        F.col("started").isNotNull() & F.col("finished").isNotNull(),
        F.greatest(F.lit(0.0), (F.col("finished") - F.col("started")).cast("double")),
    ))


def recoverable_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(truthy("interrupted") & truthy("resumable") & ~truthy("archived"))


def job_state() -> Column:
    return (
        F.when(truthy("canceled"), "canceled").when(has_error(), "error").when(truthy("done"), "success").otherwise("running")
    )


def job_summary(jobs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Totals, per ``keys`` where given."""
    return jobs.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(truthy("done") & ~has_error() & ~truthy("canceled")).alias("succeeded"),
        F.count_if(has_error()).alias("failed"),
        F.count_if(~truthy("done")).alias("running"),
    )


def latest_jobs(jobs: DataFrame, limit: int = 200, tie: str = "id") -> DataFrame:
    return jobs.orderBy(F.coalesce("updated", F.lit(0)).desc(), tie).limit(limit)


def archive_runs(runs: DataFrame, tie: str = "run") -> DataFrame:
    """Runs that share a job id: the latest keeps the id, earlier finished ones become archived history rows."""
    latest = runs.groupBy("id").agg(F.max(F.struct("started", tie)).alias("_last"))
    marked = runs.join(latest, "id").withColumn(
        "_old", (F.struct("started", tie) < F.col("_last")) & truthy("done")
    )
    millis = F.floor(F.col("started") * 1000).cast("long")
    return (
        marked.withColumn("source_job_id", F.when(F.col("_old"), F.col("id")))
        .withColumn("archived", F.when(F.col("_old"), F.lit(True)).otherwise(truthy("archived")))
        .withColumn("id", F.when(F.col("_old"), F.concat("id", F.lit(":history:"), millis)).otherwise(F.col("id")))
        .drop("_old", "_last")
    )


def recover(jobs: DataFrame, now: Column) -> DataFrame:
    """State after a restart: unfinished jobs are interrupted, and resumable if they have a ``spec``."""
    archived, done = truthy("archived"), truthy("done")
    hit = ~archived & ~done
    finish = F.when(hit, now).when(~archived & done, or_default("finished", F.col("updated"))).otherwise(F.col("finished"))
    resumable = F.when(archived, F.lit(False)).when(hit, F.col("spec").isNotNull()).otherwise(F.col("resumable"))
    values = {
        "stage": F.when(hit, "interrupted").otherwise(F.col("stage")),
        "message": F.when(hit, "Application restarted; resume when ready").otherwise(F.col("message")),
        "error": F.when(~hit, F.col("error")),
        "interrupted": hit | truthy("interrupted"),
        "resumable": resumable,
        "cancel_requested": ~hit & truthy("cancel_requested"),
        "updated": F.when(hit, now).otherwise(F.col("updated")),
        "finished": finish,
        "done": F.when(archived, F.col("done")).otherwise(F.lit(True)),
    }
    return jobs.select(*[values[c].alias(c) if c in values else F.col(c) for c in jobs.columns])


def cancel(jobs: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Apply cancel requests ``(id)``.

    Queued jobs and interrupted jobs awaiting resumption are canceled, running ones get a request flag, finished
    ones stay. An interrupted job loses its spec, so that it cannot be resumed later.
    """
    asked = requests.select("id").distinct().withColumn("_asked", F.lit(True))
    joined = jobs.join(asked, "id", "left")
    due = truthy("_asked")
    waiting = due & truthy("interrupted") & truthy("done") & truthy("resumable")
    queued = due & ~truthy("done") & F.coalesce(F.col("stage") == "queued", F.lit(False))
    running_ = due & ~truthy("done") & ~queued
    stop = waiting | queued
    values = {
        "stage": F.when(stop, "canceled").otherwise(F.col("stage")),
        "message": F.when(stop, CANCELED_MESSAGE).when(running_, CANCEL_REQUESTED_MESSAGE).otherwise(F.col("message")),
        "error": F.when(~stop, F.col("error")),
        "canceled": stop | truthy("canceled"),
        "cancel_requested": stop | running_ | truthy("cancel_requested"),
        "interrupted": ~waiting & truthy("interrupted"),
        "resumable": ~waiting & truthy("resumable"),
        "spec": F.when(~waiting, F.col("spec")),
        "done": stop | truthy("done"),
        "updated": F.when(stop | running_, now).otherwise(F.col("updated")),
        "finished": F.when(stop, now).otherwise(F.col("finished")),
    }
    return joined.select(*[values[c].alias(c) if c in values else F.col(c) for c in jobs.columns])
