"""Stream jobs run over the event table until it is read through, and their batch twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.operators.library import practice_stats
from metrum.queries.registry import query, scratch
from metrum.queries.scalars import LINES_SQL, log_lines
from metrum.queries.views import Views
from metrum.streaming import monitor as M
from metrum.streaming import streams as Z


def drain(writer, work: str) -> None:
    writer.option("checkpointLocation", f"{work}/progress").trigger(availableNow=True).start().awaitTermination()


def source(v: Views, table: str) -> DataFrame:
    schema = v.table(table).schema
    reader = v.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet")
    return reader.parquet(v.sf_dir)


ARRIVALS = 5


class Arrivals:
    """Rows that arrive as a stream: those of part 0, 1, ... one after the other, a batch each.

    A part of a table in order of time lies in few of its files, so its rows are dealt anew to a file for each core.
    """

    def __init__(self, v: Views, rows: DataFrame, part: Column, work: str):
        self.rows, self.part, self.work = rows, part, work
        self._arrive(0)
        self.stream = v.spark.readStream.schema(rows.schema).parquet(f"{work}/arrived")

    def _arrive(self, k: int) -> None:
        spread = self.rows.where(self.part == k).repartition(self.rows.sparkSession.sparkContext.defaultParallelism)
        spread.write.mode("append").parquet(f"{self.work}/arrived")

    def drain(self, writer) -> None:
        """Run the stream to the end of each part; what has arrived since the last run is one batch, of any number of files."""
        for k in range(ARRIVALS):
            if k:
                self._arrive(k)
            drain(writer, self.work)


def arriving(v: Views, table: str, at: str, work: str) -> Arrivals:
    """The whole table as a stream of several batches: cut by time, with rows up to six minutes out of order."""
    rows = v.table(table)
    moment = F.unix_micros(F.col(at).cast("timestamp")) + F.col("event_id") % 7 * 60_000_000
    low, high = rows.agg(F.min(moment), F.max(moment)).first()
    return Arrivals(v, rows, F.floor((moment - F.lit(low)) * ARRIVALS / F.lit(max(1, (high or 0) - (low or 0) + 1))), work)


def status_events(events: DataFrame) -> DataFrame:
    """Status events of jobs named after the visitor's tens; purchases finish a job, errors ask to cancel it."""
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("id"),
        F.col("ts").cast("timestamp").alias("at"),
        F.col("event_id").alias("seq"),
        F.when(kind == "view", "queued").when(kind == "purchase", "done").otherwise("inferencing").alias("stage"),
        F.when(kind == "view", "Queued").when(kind == "purchase", "Complete").otherwise("Separating stems").alias("message"),
        (kind == "purchase").alias("done"),
        F.when(F.col("event_id") % 11 == 0, "failed").alias("error"),
        ((kind == "error") & (F.col("event_id") % 3 == 0)).alias("cancel"),
    )


STATUS_SQL = """
    ev AS (SELECT 'job' || user_id AS id, ts AS t, event_id AS seq,
        CASE event_type WHEN 'view' THEN 'queued' WHEN 'purchase' THEN 'done' ELSE 'inferencing' END AS stage,
        CASE event_type WHEN 'view' THEN 'Queued' WHEN 'purchase' THEN 'Complete' ELSE 'Separating stems' END AS message,
        event_type = 'purchase' AS done, CASE WHEN event_id % 11 = 0 THEN 'failed' END AS error,
        event_type = 'error' AND event_id % 3 = 0 AS cancel FROM events)"""

STATE_SQL = f"""
    WITH {STATUS_SQL},
    a AS (SELECT id, min(t) AS t0,
        max_by(struct_pack(stage := stage, message := message, done := done, error := error), {{'a': t, 'b': seq}}) FILTER (NOT cancel) AS l,
        max({{'a': t, 'b': seq}}) FILTER (NOT cancel) AS l_at, min({{'a': t, 'b': seq}}) FILTER (NOT cancel AND done) AS d,
        min({{'a': t, 'b': seq}}) FILTER (cancel) AS c FROM ev GROUP BY id),
    b AS (SELECT *, c IS NOT NULL AND (d IS NULL OR c < d) AS counts FROM a),
    q AS (SELECT *, counts AND coalesce(l.stage = 'queued', true) AS queued FROM b)
    SELECT id, CASE WHEN queued THEN 'canceled' ELSE l.stage END AS stage,
           CASE WHEN queued THEN 'Canceled' WHEN counts AND NOT l.done THEN 'Cancel requested' ELSE l.message END AS message,
           queued OR coalesce(l.done, false) AS done, CASE WHEN NOT queued THEN l.error END AS error, counts AS cancel_requested,
           epoch_us(t0) AS started, epoch_us(greatest(l_at.a, CASE WHEN counts THEN c.a END)) AS updated FROM q"""


def _micros(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in columns})


@query("job_states", STATE_SQL)
def _(v: Views):
    return _micros(Z.job_states(status_events(v.table("events"))), "started", "updated")


@query("job_state_stream", STATE_SQL)
def _(v: Views):
    work = scratch(v.spark)
    events = arriving(v, "events", "ts", work)
    events.drain(Z.job_state_stream(status_events(events.stream), f"{work}/out"))
    return _micros(Z.read_job_states(v.spark, f"{work}/out"), "started", "updated")


CHANGES_SQL = f"""
    WITH {STATUS_SQL},
    l AS (SELECT *, row_number() OVER w AS n, lag(stage) OVER w AS ps, lag(message) OVER w AS pm, lag(error) OVER w AS pe FROM ev
          WINDOW w AS (PARTITION BY id ORDER BY t, seq))
    SELECT id, seq, stage, message, error FROM l
    WHERE n = 1 OR ps IS DISTINCT FROM stage OR pm IS DISTINCT FROM message OR pe IS DISTINCT FROM error"""


@query("change_log", CHANGES_SQL)
def _(v: Views):
    return Z.change_log(status_events(v.table("events"))).select("id", "seq", "stage", "message", "error")


SETTLED_SQL = "t <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTES"


@query("change_log_stream", f"SELECT id, seq, stage, message, error FROM ({CHANGES_SQL.replace('SELECT id, seq, stage', 'SELECT t, id, seq, stage')}) WHERE {SETTLED_SQL}")
def _(v: Views):
    work = scratch(v.spark)
    # What is younger than the delay when the table ends is not settled yet.
    events = arriving(v, "events", "ts", work)
    events.drain(Z.change_log_stream(status_events(events.stream), f"{work}/out", f"{work}/state"))
    return Z.read_epochs(v.spark, f"{work}/out").select("id", "seq", "stage", "message", "error")


def _lines(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), "line")


@query(
    "stage_stream",
    f"""
    WITH {LINES_SQL},
    k AS (SELECT CAST(e.user_id AS VARCHAR) AS id, e.ts AS t, e.event_id AS seq, stage, message,
                 lag(stage) OVER w AS ps, lag(message) OVER w AS pm FROM stages t JOIN events e ON e.event_id = t.event_id
          WHERE stage IS NOT NULL WINDOW w AS (PARTITION BY e.user_id ORDER BY e.ts, e.event_id))
    SELECT id, seq, stage, message FROM k WHERE (ps IS DISTINCT FROM stage OR pm IS DISTINCT FROM message)
        AND t <= (SELECT max(e.ts) FROM stages t JOIN events e ON e.event_id = t.event_id WHERE stage IS NOT NULL) - INTERVAL 10 MINUTES""",
)
def _(v: Views):
    work = scratch(v.spark)
    events = arriving(v, "events", "ts", work)

    class Streamed:
        @staticmethod
        def table(name: str) -> DataFrame:
            return events.stream

    events.drain(Z.stage_stream(_lines(log_lines(Streamed)), f"{work}/out", f"{work}/state"))
    return Z.read_epochs(v.spark, f"{work}/out").select("id", "seq", "stage", "message")


STALL_SQL = """
    WITH g AS (SELECT user_id AS id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS b FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT id, ts, sum(b) OVER (PARTITION BY id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g),
    st AS (SELECT id, min(ts) AS f, max(ts) AS l, count(*) AS n FROM r GROUP BY id, run)"""


@query(
    "stalls",
    f"""{STALL_SQL}
    SELECT id, epoch_us(f) AS first_at, epoch_us(l) AS last_at, epoch_us(l) + 21600000000 AS stalled_at, n AS lines,
           epoch_us(l) - epoch_us(f) >= 36000000000 AS timed_out FROM st""",
)
def _(v: Views):
    lines = v.table("events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return _micros(Z.stalls(lines, "6 hours", 36000.0), "first_at", "last_at", "stalled_at")


@query(
    "heartbeats",
    f"""{STALL_SQL},
    k AS (SELECT id, f, unnest(range(1, (epoch_us(l) - epoch_us(f)) // 1800000000 + 1)) AS k FROM st)
    SELECT id, epoch_us(f) + k * 1800000000 AS beat_at, k * 1800 AS elapsed FROM k""",
)
def _(v: Views):
    lines = v.table("events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return _micros(Z.heartbeats(Z.stalls(lines, "6 hours"), 1800), "beat_at")


@query(
    "stall_stream",
    f"""{STALL_SQL}
    SELECT id, epoch_us(f) AS first_at, epoch_us(l) AS last_at, epoch_us(l) + 21600000000 AS stalled_at, n AS lines,
           epoch_us(l) - epoch_us(f) >= 36000000000 AS timed_out FROM st
    WHERE epoch_us(l) + 21600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""",
)
def _(v: Views):
    work = scratch(v.spark)
    lines = source(v, "events").select(F.col("user_id").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    drain(Z.stall_stream(lines, f"{work}/out", "6 hours", 36000.0), work)
    # Spans still open when the table ends are not stalled yet, so they are not in the output.
    return _micros(Z.read_epochs(v.spark, f"{work}/out").drop("epoch"), "first_at", "last_at", "stalled_at")


BEAT, QUIET, LIMIT = 7200, 72_000, 180_000
WATCH_SQL = f"""
    WITH RECURSIVE l AS (SELECT user_id || '-' || epoch_us(ts) // 259200000000 AS id, epoch_us(ts) AS t, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS d
        FROM events GROUP BY ALL),
    n AS (SELECT *, lead(t) OVER (PARTITION BY id ORDER BY t) AS nx, min(t) OVER (PARTITION BY id) AS f FROM l),
    steps AS (
        SELECT id, t, nx, f, d, t = f AS run FROM n WHERE t = f
        UNION ALL
        SELECT n.id, n.t, n.nx, n.f, n.d, true FROM steps s JOIN n ON n.id = s.id AND n.t = s.nx
        WHERE s.d = 0 AND s.nx - s.t < {QUIET}000000 AND s.nx < s.f + {LIMIT}000000),
    e AS (SELECT *, least(t + {QUIET}000000, f + {LIMIT}000000) AS stop, d = 0 AND (nx IS NULL OR nx >= least(t + {QUIET}000000, f + {LIMIT}000000)) AS over FROM steps),
    seen AS (
        SELECT id, CASE WHEN stop = f + {LIMIT}000000 THEN 'expired' ELSE 'silent' END AS kind, stop AS moment, f FROM e WHERE over
        UNION ALL
        SELECT id, 'heartbeat', t + k * {BEAT}000000, f FROM e, unnest(range(1, {LIMIT // BEAT + 2})) AS r(k)
        WHERE d = 0 AND CASE WHEN over THEN t + k * {BEAT}000000 < stop ELSE t + k * {BEAT}000000 <= nx END)
    SELECT id, kind, moment AS "at", (moment - f) // 1000000 AS elapsed FROM seen
    WHERE moment <= (SELECT max(epoch_us(ts)) // 1000 * 1000 - 600000000 FROM events)"""


def _job_lines(events: DataFrame) -> DataFrame:
    """Lines of jobs, one for each visitor and three days; a purchase is the last line."""
    at = F.col("ts").cast("timestamp")
    job = F.concat(F.col("user_id").cast("string"), F.lit("-"), F.floor(F.unix_micros(at) / 259_200_000_000).cast("string"))
    return events.select(job.alias("id"), at.alias("at"), (F.col("event_type") == "purchase").alias("done"))


@query("watch", WATCH_SQL)
def _(v: Views):
    lines = _job_lines(v.table("events"))
    last = lines.agg(F.unix_micros(F.max("at"))).first()[0] or 0
    return _micros(M.watch(lines, BEAT, QUIET, LIMIT, F.timestamp_micros(F.lit(last // 1000 * 1000 - 600_000_000))), "at")


@query("watch_stream", WATCH_SQL)
def _(v: Views):
    work = scratch(v.spark)
    events = arriving(v, "events", "ts", work)
    events.drain(M.watch_stream(_job_lines(events.stream), f"{work}/out", BEAT, QUIET, LIMIT))
    return _micros(Z.read_epochs(v.spark, f"{work}/out").drop("epoch"), "at")


@query(
    "practice_stream",
    """
    WITH once AS (SELECT DISTINCT user_id AS id, event_id % 40 AS visit FROM events)
    SELECT id, count(*) AS play_count FROM once GROUP BY id""",
)
def _(v: Views):
    work = scratch(v.spark)
    events = arriving(v, "events", "ts", work)
    plays = events.stream.select(F.col("user_id").alias("id"), (F.col("event_id") % 40).alias("visit"), F.col("ts").cast("timestamp").alias("at"))
    events.drain(Z.play_stream(plays, f"{work}/out"))
    return practice_stats(Z.read_epochs(v.spark, f"{work}/out")).select("id", "play_count")


@query(
    "sync_stream",
    """
    WITH t AS (SELECT doc_id AS id, doc_id % 8 = 0 AS buried, (53 * doc_id) % 100 AS since FROM documents)
    SELECT id, CASE WHEN buried AND since >= 10 THEN 'mark_deleted' WHEN buried AND since >= 5 THEN 'download'
                    WHEN id % 2 = 0 THEN 'none' ELSE 'download' END AS action, CAST(NULL AS VARCHAR) AS conflict,
           buried AND since >= 10 AS deletes_local, CASE WHEN buried AND since >= 10 THEN 'all' END AS removes FROM t""",
)
def _(v: Views):
    work = scratch(v.spark)
    k = F.col("doc_id")
    digest = F.sha2("text", 256)
    documents = Arrivals(v, v.table("documents"), k % ARRIVALS, work)
    changes = documents.stream.select(
        k.alias("id"), digest.alias("digest"), F.lit(10.0).alias("updated_at"), F.lit(False).alias("deleted"),
        F.lit(None).cast("double").alias("deleted_at"), F.lit("d").alias("device"),
    )
    local = v.hashes.select("id", F.when(F.col("id") % 2 == 0, F.col("h")).otherwise(F.concat("h", F.lit("L"))).alias("digest"), F.lit(5.0).alias("modified_at"))
    remembered = v.hashes.select("id", local_digest(), F.lit(None).cast("struct<at:double,device:string,digest:string>").alias("remote_revision"))
    documents.drain(Z.sync_stream(changes, local, remembered, v.tombstones, f"{work}/out", 50.0))
    return Z.read_epochs(v.spark, f"{work}/out").drop("epoch")


def local_digest():
    return F.when(F.col("id") % 2 == 0, F.col("h")).otherwise(F.concat("h", F.lit("L"))).alias("local_digest")
