"""Stream jobs over status events, log lines, plays and sync changes.

Each job is a plain streaming plan where Spark has the operator (session window, de-duplication). Where rows of one key
depend on each other without bound, a micro-batch is processed with the skew-safe batch operator that its twin uses, and
what later batches need goes to a :class:`metrum.streaming.store.Store`, which writes about as much as the batch has
keys. Where time itself acts (heartbeats, limits), keyed state with timers does. Epoch directories and runs are
overwritten on a retry, so output is exactly once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from metrum.functions.fixed import CANCELED_MESSAGE, CANCEL_REQUESTED_MESSAGE
from metrum.functions.scalars import stage_of
from metrum.operators.sync import apply_reconciled, reconcile
from metrum.plans.durable import durable
from metrum.plans.ordered import Scan, once, running, time_tile
from metrum.streaming.store import Store

LATENESS = "10 minutes"


# --- output by epoch -----------------------------------------------------------------------------------------


def epoch_path(path: str, epoch: int) -> str:
    return f"{path}/epoch={epoch}"


def write_epochs(stream: DataFrame, path: str, mode: str = "append") -> DataStreamWriter:
    """Write every micro-batch to its own directory, replacing it when the batch is retried."""

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(epoch_path(path, epoch))

    return stream.writeStream.outputMode(mode).foreachBatch(sink)


def read_epochs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# --- job states ----------------------------------------------------------------------------------------------


JOB_PARTS = {"_started": F.min, "_last": F.max, "_done": F.min, "_cancel": F.min}
"""What is kept of a job: the earliest or latest of each, so parts of a job's events can be put together in any order."""


def job_parts(events: DataFrame) -> DataFrame:
    """One row per job of events ``(id, at, seq, stage, message, done, error, cancel)`` with the columns of :data:`JOB_PARTS`."""
    order = [F.col("at"), F.col("seq")]
    update = ~F.col("cancel")
    place = F.struct(*order)
    values = {
        "_started": F.col("at"),
        "_last": F.when(update, F.struct(*order, "stage", "message", "done", "error")),
        "_done": F.when(update & F.col("done"), place),
        "_cancel": F.when(F.col("cancel"), place),
    }
    return events.groupBy("id").agg(*[JOB_PARTS[name](value).alias(name) for name, value in values.items()])


def states_of(parts: DataFrame) -> DataFrame:
    """The state of each job from its parts."""
    counts = F.col("_cancel").isNotNull() & (F.col("_done").isNull() | (F.col("_cancel") < F.col("_done")))
    queued = counts & F.coalesce(F.col("_last.stage") == "queued", F.lit(True))
    stage = F.when(queued, "canceled").otherwise(F.col("_last.stage"))
    message = F.when(queued, CANCELED_MESSAGE).when(counts & ~F.col("_last.done"), CANCEL_REQUESTED_MESSAGE).otherwise(F.col("_last.message"))
    latest = F.greatest(F.col("_last.at"), F.when(counts, F.col("_cancel.at")))
    return parts.select(
        "id", stage.alias("stage"), message.alias("message"), (queued | F.coalesce("_last.done", F.lit(False))).alias("done"),
        F.when(~queued, F.col("_last.error")).alias("error"), counts.alias("cancel_requested"), F.col("_started").alias("started"), latest.alias("updated"),
    )


def job_states(events: DataFrame) -> DataFrame:
    """Latest state per job from events ``(id, at, seq, stage, message, done, error, cancel)``.

    The order of events is ``(at, seq)``, whatever order they arrive in, so late ones never overwrite newer ones. A
    cancel request counts only before the job is done. All parts are mergeable aggregates: a job with very many
    events is combined before the shuffle.
    """
    return states_of(job_parts(events))


def job_state_stream(events: DataFrame, path: str, keep: str | None = None) -> DataStreamWriter:
    """Keep the state of every job under ``path``; read it with :func:`read_job_states`.

    A batch looks up the jobs it has events of, and writes these. With ``keep``, an interval, a job that is done is
    closed that long after its last event: a later event of its id begins a new record, as a new run of the job does,
    and records that old, against the newest event of the batch, go when the base is rewritten.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        store = Store(batch.sparkSession, path, ["id"])
        new = job_parts(batch)
        known, forget = store.read(epoch, new.select("id")), None
        if keep:
            age = F.expr(f"INTERVAL {keep}")
            over = F.col("_done").isNotNull()
            last = F.greatest("_last.at", "_cancel.at")
            if known is not None:
                first = new.select("id", F.col("_started").alias("_from"))
                known = known.join(first, "id").where(~(over & (last < F.col("_from") - age))).drop("_from")
            newest = batch.agg(F.max("at")).first()[0]
            forget = over & (last < F.lit(newest) - age)
        if known is not None:
            both = known.select(*new.columns).unionByName(new)
            new = both.groupBy("id").agg(*[merge(name).alias(name) for name, merge in JOB_PARTS.items()])
        store.write(epoch, new, forget)

    return events.writeStream.foreachBatch(sink)


def read_job_states(spark: SparkSession, path: str) -> DataFrame | None:
    """The states after the last batch."""
    parts = Store(spark, path, ["id"]).read()
    return None if parts is None else states_of(parts)


# --- change log ----------------------------------------------------------------------------------------------

TRIPLE = ("stage", "message", "error")


def change_log(events: DataFrame, keys: tuple[str, ...] = ("id",), seconds: float = 86400.0) -> DataFrame:
    """Events ``(id, at, seq, stage, message, error)`` whose triple differs from the one before."""
    triple = F.struct(*TRIPLE)
    order = [F.col("at"), F.col("seq")]
    tile = time_tile(F.unix_micros("at") / 1e6, seconds)
    scans = {"_prev": Scan("last", triple, tuple(order), exclusive=True)}
    seen = running(events, list(keys), tile, order, scans)
    return seen.filter(F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(triple)).drop("_prev")


def _until(micros: int | None) -> Column:
    return F.coalesce(F.unix_micros("at") <= F.lit(micros).cast("long"), F.lit(False))


def change_log_stream(events: DataFrame, path: str, state_path: str, late_path: str | None = None, delay: str = LATENESS) -> DataStreamWriter:
    """Append changes to ``path`` once they are settled: events older by ``delay`` than the newest one seen.

    Younger events wait, by epoch, under ``state_path``; so does the last settled event of each job, in a store. A batch
    reads and writes what waits, and the jobs that settle. Events that come after their time was settled go to
    ``late_path`` (``path`` with ``_late``). So the log is that of the batch twin over all events in time, whatever
    order they came in; ``change_log`` over log and late events is the twin's log over all. Events without a time are
    late. A batch is read many times, so its rows are made once and stored.
    """
    aside = late_path or f"{path}_late"
    columns = ["id", "at", "seq", *TRIPLE]
    place = F.struct("at", "seq")

    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, f"{state_path}/last", ["id"])
        waiting, marks = f"{state_path}/waiting", f"{state_path}/settled"
        held, mark = durable(batch.select(*columns)), None
        if epoch > 0:
            mark = spark.read.parquet(epoch_path(marks, epoch - 1)).first()["at"]
        newest = held.agg(F.unix_micros(F.max("at") - F.expr(f"INTERVAL {delay}")).alias("at")).first()["at"]
        settled = max((t for t in (mark, newest) if t is not None), default=None)
        late = F.col("at").isNull() | _until(mark)
        held.where(late).write.mode("overwrite").parquet(epoch_path(aside, epoch))
        held = held.where(~late)
        if epoch > 0:
            held = held.unionByName(spark.read.parquet(epoch_path(waiting, epoch - 1)))
        spark.range(1).select(F.lit(settled).cast("long").alias("at")).write.mode("overwrite").parquet(epoch_path(marks, epoch))
        over = _until(settled)
        held.where(~over).write.mode("overwrite").parquet(epoch_path(waiting, epoch))
        due = held.where(over)
        now = due.withColumn("_old", F.lit(False))
        known = store.read(epoch, due.select("id").distinct())
        if known is not None:
            now = now.unionByName(known.select(*columns).withColumn("_old", F.lit(True)))
        change_log(now).filter("not _old").select(*columns).write.mode("overwrite").parquet(epoch_path(path, epoch))
        last = due.groupBy("id").agg(F.max_by(F.struct(*columns[1:]), place).alias("_r"))
        store.write(epoch, last.select("id", "_r.*"))

    return events.writeStream.foreachBatch(sink)


def stages(lines: DataFrame) -> DataFrame:
    """Known log lines ``(id, at, seq, line)`` as status events; other lines are left out."""
    hit = once(lines, "_s", stage_of("line")).filter(F.col("_s").isNotNull())
    return hit.select("id", "at", "seq", "_s.stage", "_s.message", F.lit(None).cast("string").alias("error"))


def stage_stream(lines: DataFrame, path: str, state_path: str, delay: str = LATENESS) -> DataStreamWriter:
    return change_log_stream(stages(lines), path, state_path, delay=delay)


# --- silence -------------------------------------------------------------------------------------------------


def stalls(lines: DataFrame, quiet: str, limit: float | None = None) -> DataFrame:
    """Spans of output ``(id, at)`` that end in silence of at least ``quiet``, batch or stream (append mode).

    ``stalled_at`` is when the silence became a stall; ``timed_out`` tells whether the span ran past ``limit`` seconds.
    """
    spans = lines.groupBy("id", F.session_window("at", quiet)).agg(
        F.count(F.lit(1)).alias("lines"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
    length = (F.unix_micros("last_at") - F.unix_micros("first_at")) / 1e6
    late = F.lit(False) if limit is None else length >= limit
    return spans.select(
        "id", "first_at", "last_at", F.col("session_window.end").alias("stalled_at"), "lines", late.alias("timed_out")
    )


def heartbeats(spans: DataFrame, beat: int) -> DataFrame:
    """One row per ``beat`` seconds of running time of a span: ``(id, beat_at, elapsed)``."""
    whole = F.floor((F.unix_micros("last_at") - F.unix_micros("first_at")) / 1e6 / beat).cast("long")
    ticks = spans.filter(whole >= 1).withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), whole)))
    elapsed = F.col("_k") * beat
    return ticks.select("id", F.timestamp_micros(F.unix_micros("first_at") + elapsed * 1_000_000).alias("beat_at"), elapsed.alias("elapsed"))


def stall_stream(lines: DataFrame, path: str, quiet: str, limit: float | None = None) -> DataStreamWriter:
    return write_epochs(stalls(lines.withWatermark("at", LATENESS), quiet, limit), path)


# --- plays ---------------------------------------------------------------------------------------------------


def play_stream(plays: DataFrame, path: str, within: str | None = None) -> DataStreamWriter:
    """Append plays ``(id, visit, at)``, one per session and page visit.

    With ``within``, an interval, repetitions of a visit are looked for in that time only, and visits are then
    forgotten. Without it a repetition is found however late it comes: visits met are kept in a store under ``path``
    with ``_met``, where a batch looks up and adds its own, not in the memory of executors. Counts and latest plays are
    :func:`metrum.operators.library.practice_stats` over the appended table.
    """
    if within:
        return write_epochs(plays.withWatermark("at", within).dropDuplicatesWithinWatermark(["id", "visit"]), path)
    keys = ["id", "visit"]

    def sink(batch: DataFrame, epoch: int) -> None:
        store = Store(batch.sparkSession, f"{path}_met", keys)
        new = batch.groupBy(*keys).agg(F.min("at").alias("at"))
        known = store.read(epoch, new.select(*keys))
        if known is not None:
            new = new.join(known.select(*keys), keys, "left_anti")
        new.write.mode("overwrite").parquet(epoch_path(path, epoch))
        store.write(epoch, batch.sparkSession.read.parquet(epoch_path(path, epoch)))

    return plays.writeStream.foreachBatch(sink)


# --- sync ----------------------------------------------------------------------------------------------------


def sync_stream(
    changes: DataFrame, local: DataFrame, previous: DataFrame, tombstones: DataFrame, path: str, now: float
) -> DataStreamWriter:
    """Reconcile each micro-batch of remote entries with the local state; actions are written by epoch.

    Only ids in the batch are looked at. If a batch holds several versions of an id, the newest counts. The state after
    a batch (local, previous, tombstone of its ids) goes to a store under ``path`` with ``_state``; later batches start
    from the newest state of an id, and from the given tables for ids not met before.
    """
    fields = ["digest", "updated_at", "deleted", "deleted_at", "device"]

    def sink(batch: DataFrame, epoch: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by(F.struct(*fields), F.struct("updated_at", "digest")).alias("_r"))
        remote = durable(newest.select("id", "_r.*"))
        ids = remote.select("id")
        parts = [table.join(ids, "id", "left_semi") for table in (local, previous, tombstones)]
        store = Store(batch.sparkSession, f"{path}_state", ["id"])
        known = store.read(epoch, ids)
        if known is not None:
            for k, name in enumerate(("local", "previous", "tombstone")):
                now_known = known.filter(F.col(name).isNotNull()).select("id", f"{name}.*")
                parts[k] = parts[k].join(known.select("id"), "id", "left_anti").unionByName(now_known.select(*parts[k].columns))
        # Written twice below, in two forms.
        result = durable(reconcile(parts[0], remote, parts[1], parts[2], now))
        result.select("id", "action", "conflict", "deletes_local", "removes").write.mode("overwrite").parquet(epoch_path(path, epoch))
        remembered = apply_reconciled(result)[2].select("id", F.struct("local_digest", "remote_revision").alias("previous"))
        after = result.select("id", "local", "tombstone").join(remembered, "id", "left")
        store.write(epoch, after)

    return changes.writeStream.foreachBatch(sink)
