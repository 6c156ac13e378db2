"""Files in, files out, and streams over several files."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from metrum.operators.library import practice_stats
from metrum.sources import readers as I
from metrum.sources import schemas
from metrum.sources import writers as O
from metrum.streaming import streams as Z
from tests.conftest import rows


@pytest.fixture
def home(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content if isinstance(content, str) else json.dumps(content, ensure_ascii=False), encoding="utf-8")
        return str(path)

    put.root = str(tmp_path)
    return put


def test_sessions_are_read_without_the_lists(spark, home):
    home("results/b.json", {"id": "b", "title": "B", "bpm": 90, "beats": [0, 0.5], "sections": [{"label": "intro", "start_bar": 1, "end_bar": 2}], "new": 1})
    home("results/a.json", {"id": "a", "title": "A"})
    home("results/broken.json", "{not json")
    home("results/manifest.json", [])
    sessions = I.read_sessions(spark, f"{home.root}/results").cache()
    assert sorted(r.file for r in sessions.collect()) == ["a.json", "b.json", "broken.json"]
    assert sessions.filter("_corrupt is not null").count() == 1
    assert rows(I.beats_long(sessions), "idx") == [("b", 0, 0.0), ("b", 1, 0.5)]
    assert I.sections_long(sessions).first().label == "intro"
    library = I.rebuild_library(sessions, I.read_library(spark, home("lib.json", [])))
    assert sorted(r.id for r in library.collect()) == ["a", "b"] and library.first().date
    assert I.rebuild_library(sessions, I.read_library(spark, home("lib2.json", [{"id": "z"}]))).count() == 0
    O.write_sessions(sessions.filter("_corrupt is null"), f"{home.root}/out")
    assert I.read_sessions(spark, f"{home.root}/out", lines=True).count() == 2


def test_lists(spark, home):
    library = I.read_library(spark, home("m.json", [{"id": "x", "title": "X"}, {"title": "no id"}, {"id": "y"}]))
    assert rows(library.select("id", "position"), "position") == [("x", 0), ("y", 2)]
    assert I.read_library(spark, home("n.json", {"id": "x"})).count() == 0
    folders = I.read_folders(spark, home("f.json", [{"id": "f", "name": "F", "sessionIds": ["x", "y"]}, {"id": "g", "name": "G"}]))
    assert rows(folders.select("folder", "pos", "id"), "folder", "pos") == [("f", 0, "x"), ("f", 1, "y"), ("g", None, None)]
    jobs = I.read_jobs(spark, home("j.json", [{"id": "a", "spec": {"type": "x"}, "updated_at": 3}, {"stage": "s"}]))
    assert jobs.count() == 1 and json.loads(jobs.first().spec) == {"type": "x"}
    O.write_jobs(jobs, f"{home.root}/jobs")
    assert I.read_jobs(spark, f"{home.root}/jobs", lines=True).first().id == "a"
    O.write_library(library, f"{home.root}/library")
    assert rows(I.read_library(spark, f"{home.root}/library", lines=True).select("id", "position"), "id") == [("x", 0), ("y", 2)]


def test_index_round_trip(spark, home):
    index = I.read_sync_index(spark, home("i.json", {"version": 1, "files": {f"k{n:03d}": str(n) for n in range(50)}}))
    assert index.count() == 50
    O.write_sync_index(index, f"{home.root}/index", keys=20)
    parts = [f for f in os.listdir(f"{home.root}/index") if f.endswith(".txt")]
    again = I.read_sync_index(spark, f"{home.root}/index")
    assert len(parts) >= 1 and rows(again, "key") == rows(index, "key")
    documents = [json.loads(r.value) for r in spark.read.text(f"{home.root}/index").collect()]
    assert len(documents) == 3 and all(list(d["files"]) == sorted(d["files"]) for d in documents)


def test_device_states(spark, home):
    remote = I.read_remote_state(spark, home("r.json", {
        "sessions": {"a": {"deviceId": "d", "updatedAt": 1, "digest": "x", "files": {"k": "v"}}, "b": {"deleted": True, "deletedAt": 5, "deviceId": "d"}}}))
    assert rows(remote.sessions.select("id", "deleted"), "id") == [("a", False), ("b", True)]
    assert rows(remote.tombstones) == [("b", 5.0, "d")] and remote.devices.count() == 0
    local = I.read_local_state(spark, home("l.json", {"deviceId": "me", "tombstones": {"z": {"deletedAt": 2, "deviceId": "me"}}}))
    assert rows(local.tombstones) == [("z", 2.0, "me")] and local.devices.first().device == "me" and local.sessions.count() == 0


def test_inventory_frames_and_hashes(spark, home):
    home("w/frame_000001.pgm", "12345")
    home("w/deep/frame_000123.pgm", "abc")
    home("w/notes.txt", "zz")
    root = f"{home.root}/w"
    inventory = I.read_file_inventory(spark, root)
    assert inventory.agg(F.sum("length")).first()[0] == 10 and "content" not in inventory.columns
    assert rows(I.read_frames(spark, root).select("idx"), "idx") == [(0,), (122,)]
    empty = spark.createDataFrame([], "path string, length long, modified timestamp, sha string")
    first = I.hash_files(spark, [root], empty).cache()
    assert first.count() == 3 and all(len(r.sha) == 64 for r in first.collect())
    cached = first.withColumn("sha", F.lit("cached"))
    assert {r.sha for r in I.hash_files(spark, [root], cached).collect()} == {"cached"}
    home("w/notes.txt", "changed")
    again = [r.sha for r in I.hash_files(spark, [root], cached).collect()]
    assert sorted(x == "cached" for x in again) == [False, True, True]


def test_hashes_read_only_what_is_missing(spark, home):
    """Contents are opened for misses alone, in pieces; a file that is gone by then has no hash."""
    for k in range(6):
        home(f"w/{k}.bin", "x" * (k * 1000 + 1))
    root, log = f"{home.root}/w", f"{home.root}/opened"
    os.makedirs(log)

    def opened(path):
        open(f"{log}/{os.path.basename(path)}", "w").close()
        return open(path.removeprefix("file:"), "rb")

    inventory = I.read_file_inventory(spark, root)
    even = F.regexp_extract("path", r"(\d)\.bin$", 1).cast("int") % 2 == 0
    got = {os.path.basename(r.path): r.sha for r in I.hash_files(spark, [root], inventory.where(even).withColumn("sha", F.lit("known")), opened).collect()}
    assert sorted(os.listdir(log)) == ["1.bin", "3.bin", "5.bin"]
    assert got == {f"{k}.bin": "known" if k % 2 == 0 else hashlib.sha256(b"x" * (k * 1000 + 1)).hexdigest() for k in range(6)}
    gone = spark.createDataFrame([(f"file:{root}/1.bin",), (f"file:{root}/no.bin",)], "path string")
    assert {os.path.basename(r.path): r.sha is None for r in I.hash_content(gone, piece=7).collect()} == {"1.bin": False, "no.bin": True}


def test_log_lines_keep_their_order(spark, home):
    for name, text in (("a.log", "one\ntwo\n\nfour\n"), ("b.x.log", "only"), ("empty.log", "")):
        home(f"logs/{name}", text)
    drain(Z.write_epochs(I.stream_log_lines(spark, f"{home.root}/logs"), f"{home.root}/out"), home.root, "lines")
    found = rows(Z.read_epochs(spark, f"{home.root}/out").select("id", "seq", "line"), "id", "seq")
    assert [x for x in found if x[0] != "empty"] == [("a", 0, "one"), ("a", 1, "two"), ("a", 2, ""), ("a", 3, "four"), ("b", 0, "only")]


def drain(writer, root, name):
    writer.option("checkpointLocation", f"{root}/progress-{name}").trigger(availableNow=True).start().awaitTermination()


def event(id, second, seq, stage, message, done=False, error=None, cancel=False):
    at = f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}.000Z"
    return json.dumps({"id": id, "at": at, "seq": seq, "stage": stage, "message": message, "done": done, "error": error, "cancel": cancel})


def test_job_streams_over_several_files(spark, home):
    batches = [
        [event("a", 1, 1, "queued", "Queued"), event("b", 1, 2, "queued", "Queued"), event("a", 3, 4, "demixing", "x")],
        [event("a", 2, 3, "demixing", "late"), event("a", 4, 5, "demixing", "x"), event("b", 5, 6, "", "", cancel=True)],
        [event("a", 9, 7, "done", "Complete", done=True), event("a", 12, 8, "", "", cancel=True)],
    ]
    for n, lines in enumerate(batches):
        home(f"ev/{n}.json", "\n".join(lines))
        os.utime(f"{home.root}/ev/{n}.json", (1000 + n, 1000 + n))
    source = lambda: I.stream_job_events(spark, f"{home.root}/ev", maxFilesPerTrigger="1")
    drain(Z.job_state_stream(source(), f"{home.root}/state"), home.root, "s")
    latest = {r.id: r for r in Z.read_job_states(spark, f"{home.root}/state").collect()}
    assert latest["a"].stage == "done" and latest["a"].done and not latest["a"].cancel_requested
    assert latest["b"].stage == "canceled" and latest["b"].done
    batch = Z.job_states(spark.read.schema(schemas.JOB_EVENT).json(f"{home.root}/ev"))
    assert {r.id: r.stage for r in batch.collect()} == {k: r.stage for k, r in latest.items()}

    updates = source().filter("not cancel")
    drain(Z.change_log_stream(updates, f"{home.root}/log", f"{home.root}/last", delay="2 seconds"), home.root, "c")
    log = Z.read_epochs(spark, f"{home.root}/log").orderBy("seq").collect()
    # The event that comes late (seq 3) is in time and in its place; the repeated triple (seq 5) is no change; the last
    # event is not settled.
    assert [r.seq for r in log] == [1, 2, 3, 4] and Z.read_epochs(spark, f"{home.root}/log_late").count() == 0


def test_plays_count_once_per_visit(spark, home):
    for n, lines in enumerate([[("x", 1, 5), ("x", 1, 9), ("y", 1, 7)], [("x", 2, 30), ("x", 1, 31)]]):
        home(f"plays/{n}.json", "\n".join(json.dumps({"id": i, "visit": v, "at": f"2024-01-01T00:00:{t:02d}.000Z"}) for i, v, t in lines))
    plays = spark.readStream.schema("id string, visit long, at timestamp").option("maxFilesPerTrigger", 1).json(f"{home.root}/plays")
    drain(Z.play_stream(plays, f"{home.root}/once"), home.root, "p")
    counts = practice_stats(Z.read_epochs(spark, f"{home.root}/once"))
    assert rows(counts.select("id", "play_count"), "id") == [("x", 2), ("y", 1)]


def test_a_retried_epoch_does_not_repeat_rows(spark, home):
    df = spark.createDataFrame([(1,), (2,)], "x long")
    for _ in range(2):
        df.write.mode("overwrite").parquet(Z.epoch_path(f"{home.root}/e", 0))
    assert Z.read_epochs(spark, f"{home.root}/e").count() == 2


def test_all_jobs_are_written(spark, home):
    jobs = spark.range(201).select(F.col("id").cast("string").alias("id"), F.col("id").cast("double").alias("updated_at"))
    O.write_jobs(jobs, f"{home.root}/many")
    assert spark.read.json(f"{home.root}/many").count() == 201


def test_long_keys_stay_whole(spark):
    from metrum.operators.sync import group_legacy_index

    key = "sessions/" + "s" * 120_000 + "/audio.mp3"
    out = group_legacy_index(spark.createDataFrame([(key, "h")], "key string, sha string")).first()
    assert out.key == key and out.id == "s" * 120_000


def test_late_events_are_put_aside(spark, home):
    for n, lines in enumerate([[event("a", 1, 1, "x", "1"), event("a", 5, 5, "x", "2")], [event("a", 3, 3, "y", "late"), event("a", 6, 6, "z", "3")]]):
        home(f"ev/{n}.json", "\n".join(lines))
        os.utime(f"{home.root}/ev/{n}.json", (1000 + n, 1000 + n))
    source = I.stream_job_events(spark, f"{home.root}/ev", maxFilesPerTrigger="1")
    drain(Z.change_log_stream(source, f"{home.root}/log", f"{home.root}/last", delay="0 seconds"), home.root, "late")
    log, late = Z.read_epochs(spark, f"{home.root}/log"), Z.read_epochs(spark, f"{home.root}/log_late")
    assert sorted(r.seq for r in log.collect()) == [1, 5, 6] and [r.seq for r in late.collect()] == [3]
    twin = Z.change_log(spark.read.schema(schemas.JOB_EVENT).json(f"{home.root}/ev"))
    both = Z.change_log(log.unionByName(late))
    assert sorted(r.seq for r in twin.collect()) == sorted(r.seq for r in both.collect()) == [1, 3, 5, 6]


def test_device_state_survives_a_round_trip(spark, home):
    """State is written, read as document and as lines, reconciled and applied; a second pass has nothing to do."""
    from metrum.operators.sync import apply_reconciled, reconcile

    local = spark.createDataFrame([("aaaaaaaa-0000-0000-0000-000000000001", "d1", 5.0), ("aaaaaaaa-0000-0000-0000-000000000002", "d2", 5.0)], "id string, digest string, modified_at double")
    remote = spark.createDataFrame([], "id string, digest string, updated_at double, deleted boolean, deleted_at double, device string")
    device = spark.createDataFrame([("me", "my|device", "w")], "device string, name string, workspace string")
    nothing = spark.createDataFrame([], "id string, deleted_at double, device string")
    state = spark.createDataFrame([], "id string, local_digest string, remote_revision struct<at:double,device:string,digest:string>")
    for turn in range(2):
        O.write_local_state(state, nothing, device, f"{home.root}/state{turn}")
        read = I.read_local_state_lines(spark, f"{home.root}/state{turn}")
        result = reconcile(local, remote, read.sessions, read.tombstones, 50.0)
        actions = {r.action for r in result.collect()}
        local, remote, state, nothing = apply_reconciled(result)
    assert actions == {"none"} and state.count() == 2
    home("device.json", json.dumps({"deviceId": "me", "sessions": {"a": {"localDigest": "d", "remoteRevision": "10.5|dev|ice|digest"}, "b": {"localDigest": "e", "remoteRevision": ""}}, "tombstones": {}}))
    sessions = {r.id: r for r in I.read_local_state(spark, f"{home.root}/device.json").sessions.collect()}
    assert tuple(sessions["a"].remote_revision) == (10.5, "dev|ice", "digest") and sessions["b"].remote_revision is None


def test_sync_stream_remembers(spark, home):
    """A second version of an id meets the state after the first."""
    key = "aaaaaaaa-0000-0000-0000-000000000001"
    for n, (digest, at) in enumerate([("r1", 10.0), ("r2", 20.0), ("r2", 20.0)]):
        home(f"ch/{n}.json", json.dumps({"id": key, "digest": digest, "updated_at": at, "deleted": False, "deleted_at": None, "device": "d", "n": n}))
        os.utime(f"{home.root}/ch/{n}.json", (1000 + n, 1000 + n))
    changes = spark.readStream.schema("id string, digest string, updated_at double, deleted boolean, deleted_at double, device string").option("maxFilesPerTrigger", 1).json(f"{home.root}/ch")
    local = spark.createDataFrame([], "id string, digest string, modified_at double")
    previous = spark.createDataFrame([], "id string, local_digest string, remote_revision struct<at:double,device:string,digest:string>")
    tombstones = spark.createDataFrame([], "id string, deleted_at double, device string")
    drain(Z.sync_stream(changes, local, previous, tombstones, f"{home.root}/sync", 50.0), home.root, "sync")
    out = Z.read_epochs(spark, f"{home.root}/sync").orderBy("epoch").collect()
    assert [(r.action, r.conflict) for r in out] == [("download", None), ("download", None), ("none", None)]
