"""Stores of streams, and watched jobs: order of arrival, retries, limits, and how much a batch writes."""

import os
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from metrum.queries.streaming import ARRIVALS, Arrivals
from metrum.streaming import monitor, store
from metrum.streaming import streams as Z
from tests.conftest import rows

START = 1_700_000_000_000_000


def drain(writer, root, name):
    query = writer.option("checkpointLocation", f"{root}/progress-{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    assert query.exception() is None


def feed(spark, root, batches, schema):
    """One file for each batch, read one by one."""
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(spark.read.parquet(f"{root}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_runs_are_a_binary_counter():
    assert store.live_runs(0) == [] and store.live_runs(13) == [(0, 8), (8, 12), (12, 13)]
    for n in range(1, 200):
        runs = store.live_runs(n)
        assert len(runs) <= n.bit_length() and runs[0][0] == 0 and runs[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(runs, runs[1:]))


def test_store_keeps_the_newest_and_survives_retries(spark, tmp_path):
    held, want, draw = store.Store(spark, str(tmp_path / "s"), ["id"]), {}, random.Random(1)
    assert held.read() is None
    for epoch in range(9):
        batch = {k: epoch * 100 + k for k in draw.sample(range(12), 3)}
        want |= batch
        frame = spark.createDataFrame(list(batch.items()), "id long, value long").coalesce(1)
        for _ in range(1 + epoch % 2):
            # A batch that is done again finds what it found before.
            known = held.read(epoch)
            assert known is None or epoch > 0
            held.write(epoch, frame)
        assert dict(rows(held.read())) == want
        assert held.batches() == epoch + 1
        left = {n for n in os.listdir(tmp_path / "s") if n.startswith("run=")}
        assert {f"run={a}-{b}" for a, b in store.live_runs(epoch + 1)} <= left and len(left) <= 8
    assert dict(rows(held.read(ids=spark.createDataFrame([(3,), (99,)], "id long")))) == {3: want[3]}
    held.write(9, frame.limit(0))
    assert dict(rows(held.read())) == want


def test_store_forgets_in_the_base(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"), ["id"])
    for epoch in range(4):
        held.write(epoch, spark.createDataFrame([(epoch, epoch)], "id long, value long"), F.col("value") < 2)
    assert dict(rows(held.read())) == {2: 2, 3: 3}


EVENT = "id string, at timestamp, seq long, stage string, message string, done boolean, error string, cancel boolean"


def event(job, second, seq, stage="run", done=False, cancel=False):
    from datetime import datetime, timedelta

    return (job, datetime(2024, 1, 1) + timedelta(seconds=second), seq, stage, stage, done, None, cancel)


def test_a_batch_writes_its_own_jobs(spark, tmp_path):
    """Two hundred jobs once, then single ones: what later batches write doesn't hold the two hundred."""
    batches = [[event(f"j{k}", k, k) for k in range(200)]] + [[event(f"j{k}", 300 + k, 300 + k, "done", True)] for k in range(6)]
    drain(Z.job_state_stream(feed(spark, tmp_path, batches, EVENT), f"{tmp_path}/out"), tmp_path, "s")
    sizes = {run: spark.read.parquet(f"{tmp_path}/out/run={run[0]}-{run[1]}").count() for run in store.live_runs(7)}
    assert sizes == {(0, 4): 200, (4, 6): 2, (6, 7): 1}
    states = {r.id: r.stage for r in Z.read_job_states(spark, f"{tmp_path}/out").collect()}
    assert len(states) == 200 and sum(s == "done" for s in states.values()) == 6
    twin = Z.job_states(spark.createDataFrame([e for b in batches for e in b], EVENT))
    assert rows(twin, "id") == rows(Z.read_job_states(spark, f"{tmp_path}/out").select(*twin.columns), "id")


def test_done_jobs_are_closed_and_go(spark, tmp_path):
    batches = [
        [event("a", 0, 0), event("a", 5, 1, "done", True), event("b", 0, 2)],
        [event("a", 8, 3, cancel=True), event("b", 6, 4)],
        [event("a", 500, 5, "queued"), event("c", 501, 6, "done", True)],
        [event("d", 900, 7)],
    ]
    drain(Z.job_state_stream(feed(spark, tmp_path, batches, EVENT), f"{tmp_path}/out", keep="60 seconds"), tmp_path, "s")
    got = {r.id: (r.stage, r.done) for r in Z.read_job_states(spark, f"{tmp_path}/out").collect()}
    # "a" was begun anew long after it was done; "c" is done and old by the last batch; "b" never ended.
    assert got == {"a": ("queued", False), "b": ("run", False), "d": ("run", False)}


def test_order_of_arrival_does_not_matter(spark, tmp_path):
    draw = random.Random(7)
    events = [event(f"j{draw.randrange(4)}", k * 3, k, draw.choice("xyz")) for k in range(120)]
    shuffled = sorted(events, key=lambda e: (e[1].timestamp() + draw.random() * 50))
    batches = [shuffled[k : k + 24] for k in range(0, 120, 24)]
    drain(Z.change_log_stream(feed(spark, tmp_path, batches, EVENT).where("not cancel"), f"{tmp_path}/log", f"{tmp_path}/st", delay="60 seconds"), tmp_path, "c")
    last = max(e[1] for e in events)
    twin = Z.change_log(spark.createDataFrame(events, EVENT)).where(F.col("at") <= F.lit(last) - F.expr("INTERVAL 60 SECONDS"))
    assert rows(Z.read_epochs(spark, f"{tmp_path}/log").select("seq"), "seq") == rows(twin.select("seq"), "seq")
    assert Z.read_epochs(spark, f"{tmp_path}/log_late").count() == 0


def test_plays_met_once(spark, tmp_path):
    batches = [[("x", 1, START), ("x", 1, START), ("y", 1, START)], [("x", 2, START)], [("x", 1, START + 10**12), ("y", 2, START)]]
    plays = feed(spark, tmp_path, batches, "id string, visit long, t long").select("id", "visit", F.timestamp_micros("t").alias("at"))
    drain(Z.play_stream(plays, f"{tmp_path}/all"), tmp_path, "all")
    assert rows(Z.read_epochs(spark, f"{tmp_path}/all").select("id", "visit"), "id", "visit") == [("x", 1), ("x", 2), ("y", 1), ("y", 2)]


# --- watched jobs --------------------------------------------------------------------------------------------


def plain(lines, beat, quiet, limit, until):
    """A loop over moments, for lines (id, second, done)."""
    out = []
    for job in {x[0] for x in lines}:
        own = sorted({(t, d) for i, t, d in lines if i == job})
        times = sorted({t for t, _ in own})
        last_lines = {t for t, d in own if d}
        start = last = mark = times[0]
        over, k = times[0] in last_lines, 1
        while not over:
            line = times[k] if k < len(times) else None
            due = min([(mark + beat, 2, "heartbeat")] + ([(last + quiet, 1, "silent")] if quiet else []) + ([(start + limit, 0, "expired")] if limit else []))
            if line is not None and due[0] > line:
                last = mark = line
                over, k = line in last_lines, k + 1
                continue
            if due[0] > until:
                break
            out.append((job, due[2], due[0], due[0] - start))
            mark, over = due[0], due[2] != "heartbeat"
    return sorted(out)


LINES = [
    ("ties", 0, False), ("ties", 10, False), ("ties", 40, False), ("ties", 60, False),
    ("silent", 0, False), ("silent", 29, False), ("silent", 200, False),
    ("long", 0, False), *[("long", k * 7, False) for k in range(1, 40)],
    ("done", 0, False), ("done", 3, True), ("done", 50, False), ("once", 5, True), ("chatty", 0, False), *[("chatty", k, False) for k in range(1, 90)], ("chatty", 90, True),
    ("clock", 400, False), ("both", 0, False), ("both", 30, True),
]


def table(spark, lines):
    return spark.createDataFrame(lines, "id string, s long, done boolean").select("id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "done")


def seen(df):
    return sorted((r.id, r.kind, r.s - 1_700_000_000, r.elapsed) for r in df.select("id", "kind", F.unix_seconds("at").alias("s"), "elapsed").collect())


@pytest.mark.parametrize(("beat", "quiet", "limit"), [(10, 30, 120), (10, None, 100), (7, 30, None), (50, 20, 90)])
def test_watch_against_a_loop(spark, beat, quiet, limit):
    until = F.timestamp_seconds(F.lit(1_700_000_390))
    got = seen(monitor.watch(table(spark, LINES + LINES[:5] + [("ties", 10, None)]), beat, quiet, limit, until, seconds=25.0))
    assert got == plain([x for x in LINES if x[0] != "clock"], beat, quiet, limit, 390)
    assert monitor.watch(table(spark, LINES).limit(0), beat, quiet, limit).count() == 0


def test_watch_stream_against_a_loop(spark, tmp_path):
    """Lines in five files, out of order within the delay; one job is quiet while the clock goes on."""
    draw = random.Random(3)
    shuffled = sorted(LINES, key=lambda x: x[1] + draw.random() * 15)
    cut = [shuffled[k * len(shuffled) // 5 : (k + 1) * len(shuffled) // 5] for k in range(5)]
    source = feed(spark, tmp_path, cut, "id string, s long, done boolean").select("id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "done")
    drain(monitor.watch_stream(source, f"{tmp_path}/out", 10, 30, 120, delay="20 seconds", keep=100_000), tmp_path, "w")
    out = Z.read_epochs(spark, f"{tmp_path}/out")
    assert seen(out) == plain([x for x in LINES if x[0] != "clock"], 10, 30, 120, 380)
    assert len({r.epoch for r in out.select("epoch").distinct().collect()}) > 1
    assert out.select(monitor.messages().alias("m")).where("m = 'Analyzer running for 10s'").count() > 0


def test_watch_stream_keeps_what_runs(spark, tmp_path):
    """Jobs by the thousand end in the first batch: the state holds none of their lines, and forgets them after ``keep``."""
    first = [(f"j{k}", k % 50, False) for k in range(2000)]
    batches = [first, [("run", 300, False)], [("clock", 905, False)], [("j1", 1500, False)], [("end", 3000, False)]]
    source = feed(spark, tmp_path, batches, "id string, s long, done boolean").select("id", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("at"), "done")
    drain(monitor.watch_stream(source, f"{tmp_path}/out", 500, 100, None, delay="20 seconds", keep=60), tmp_path, "k")
    got = seen(Z.read_epochs(spark, f"{tmp_path}/out"))
    # The line at 1500 is of a new job: the watermark has passed 340, when the first one is forgotten.
    assert got == sorted([(i, "silent", t + 100, 100) for i, t, _ in [*first, *(x for batch in batches[1:4] for x in batch)]])
    held = spark.read.parquet(f"{tmp_path}/out_state/jobs")
    assert {r.epoch for r in held.select("epoch").distinct().collect()} == {3, 4}
    assert [r.id for r in held.where("epoch = 4").collect()] == ["j1"]


# --- arrivals ------------------------------------------------------------------------------------------------


def test_arrivals_are_batches_of_many_files(spark, tmp_path):
    """A part is written by as many tasks as read it, not by one, and is one batch all the same."""
    arrivals = Arrivals(SimpleNamespace(spark=spark), spark.range(0, 100, 1, 4), F.col("id") % ARRIVALS, str(tmp_path))
    sizes = []
    arrivals.drain(arrivals.stream.writeStream.foreachBatch(lambda batch, epoch: sizes.append((epoch, sorted(r.id % ARRIVALS for r in batch.collect())))))
    assert sizes == [(k, [k] * 20) for k in range(ARRIVALS)]
    assert len(spark.read.parquet(f"{tmp_path}/arrived").inputFiles()) == 4 * ARRIVALS


def test_settled_changes_make_the_rows_of_a_batch_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(message):
        made.add(1)
        return message

    batch = [(f"j{k % 3}", k, "queued", f"m{k % 2}", None) for k in range(12)]
    stream = feed(spark, tmp_path, [batch], "id string, seq long, stage string, message string, error string")
    events = stream.withColumns({"at": F.timestamp_seconds(F.col("seq") * 60), "message": told("message")})
    drain(Z.change_log_stream(events, f"{tmp_path}/log", f"{tmp_path}/st", delay="0 seconds"), tmp_path, "once")
    assert made.value == len(batch)
    assert spark.read.parquet(f"{tmp_path}/log").count() == len(batch)


def test_a_part_that_lies_in_one_file_arrives_by_many(spark, tmp_path):
    arrivals = Arrivals(SimpleNamespace(spark=spark), spark.range(0, 1000, 1, 1), F.floor(F.col("id") * ARRIVALS / 1000), str(tmp_path))
    arrived = spark.read.parquet(f"{tmp_path}/arrived")
    assert sorted(r.id for r in arrived.collect()) == list(range(1000 // ARRIVALS))
    assert arrived.select(F.input_file_name()).distinct().count() == spark.sparkContext.defaultParallelism
    assert arrivals.stream.isStreaming
