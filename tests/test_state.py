"""Library, jobs and reconciliation on literal fixtures."""

import itertools

from pyspark.sql import functions as F

from metrum.functions import scalars as X
from metrum.operators import jobs as K
from metrum.operators import library as L
from metrum.operators import reports as R
from metrum.operators import sync as Y
from tests.conftest import rows

LIBRARY = "id string, position long, title string, tags array<string>, date string, last_played string, play_count long"


def library(frame):
    return frame(
        [("a", 0, "Song A", ["ライブ"], "2024-01-01", None, 0), ("b", 1, "Air", [], "2024-03-01", "2024-05-05", 4)], LIBRARY
    )


def test_search_and_order(frame):
    lib = library(frame)
    assert [r.id for r in L.search_library(lib, "ライブ").collect()] == ["a"]
    assert [r.id for r in L.search_library(lib, unpracticed=True).collect()] == ["a"]
    assert L.search_library(lib, "  ").count() == 2
    for mode, want in (("recent", "ba"), ("title", "ba"), ("added", "ba"), ("manual", "ab")):
        assert "".join(r.id for r in L.sort_library(lib, mode).collect()) == want


def test_tags(frame):
    tags = frame([([" 課題曲 ", "課題曲", "", "ライブ", "Straße", "STRASSE", "x" * 50],)], "t array<string>")
    assert tags.select(X.normalize_tags("t")).first()[0] == ["課題曲", "ライブ", "Straße", "x" * 40]
    many = frame([([str(k) for k in range(30)],)], "t array<string>")
    assert len(many.select(X.normalize_tags("t")).first()[0]) == 20


def test_assets_default_and_given(frame):
    sessions = frame([("a", {"audio": "mine.mp3"}), ("b", None)], "id string, assets map<string,string>")
    files = frame([(f"stems/b/{s}.mp3",) for s in ("vocals", "drums", "bass", "other")] + [("stems/a/bass.mp3",)], "path string")
    out = {r.id: r.assets for r in L.attach_assets(sessions, files).collect()}
    assert out["a"] == {"result": "results/a.json", "audio": "mine.mp3", "video": "video/a.mp4"}
    assert out["b"]["stems/drums"] == "stems/b/drums.mp3" and len(out["b"]) == 7
    assert L.changed_assets(L.attach_assets(sessions, files), L.attach_assets(sessions, files)).count() == 0


def test_deleting_reaches_folders_and_files(frame):
    folders = frame([(0, 0, "a"), (0, 1, "b"), (1, 0, "a")], "folder long, pos long, id string")
    files = frame([("sessions/a/audio.mp3",), ("sessions/b/audio.mp3",), ("sessions/a/other.txt",)], "key string")
    lib, fold, gone = L.cascade_delete(frame([("a",)], "id string"), library(frame), folders, files)
    assert rows(lib.select("id")) == [("b",)] and rows(fold.select("folder", "pos", "id")) == [(0, 1, "b")] and rows(gone) == [("sessions/a/audio.mp3",)]


def test_playback_groups_and_next(frame):
    folders = frame([(0, 0, "b"), (0, 1, "gone"), (1, 0, "b")], "folder long, pos long, id string")
    groups = L.playback_groups(folders, library(frame))
    assert rows(groups.select("group_id", "id"), "group_id") == [("0", "b"), ("root", "a")]
    nxt = L.next_in_group(groups)
    assert nxt.filter("next_id is not null").count() == 0


JOB = """id string, stage string, message string, done boolean, error string, canceled boolean, cancel_requested boolean,
started double, updated double, finished double, interrupted boolean, resumable boolean, archived boolean, spec string,
result string"""


def job(id, stage="inferencing", done=False, error=None, canceled=False, started=100.0, updated=110.0, finished=None, interrupted=False,
        resumable=False, archived=False, spec=None, result=None):
    return (id, stage, "m", done, error, canceled, False, started, updated, finished, interrupted, resumable, archived, spec, result)


def test_history_has_duration_and_no_result(frame):
    out = K.job_history(frame([job("j", done=True, finished=112.5, result="{}")], JOB)).first()
    assert out.duration == 12.5 and "result" not in out and "spec" not in out
    assert K.job_history(frame([job("j")], JOB)).first().duration is None


def test_restart_and_cancel(frame):
    jobs = frame([job("run", spec="{}"), job("old", done=True, archived=True, interrupted=True, resumable=True), job("nospec")], JOB)
    after = {r.id: r for r in K.recover(jobs, F.lit(200.0)).collect()}
    assert after["run"].interrupted and after["run"].done and after["run"].resumable and after["run"].finished == 200.0
    assert not after["old"].resumable and not after["nospec"].resumable
    assert rows(K.recoverable_jobs(K.recover(jobs, F.lit(200.0))).select("id")) == [("run",)]
    stopped = K.cancel(K.recover(jobs, F.lit(200.0)), frame([("run",)], "id string"), F.lit(300.0))
    run = stopped.filter("id = 'run'").first()
    assert run.canceled and run.spec is None and not run.resumable and run.stage == "canceled"
    live = K.cancel(frame([job("q", stage="queued"), job("r")], JOB), frame([("q",), ("r",)], "id string"), F.lit(1.0))
    assert rows(live.select("id", "stage", "canceled", "cancel_requested"), "id") == [
        ("q", "canceled", True, True), ("r", "inferencing", False, True)]


def test_repeated_runs_are_archived(frame):
    runs = frame([("j", 1, 1.0, True, None), ("j", 2, 2.0, False, None)], "id string, run long, started double, done boolean, archived boolean")
    out = rows(K.archive_runs(runs).select("id", "source_job_id", "archived"), "run")
    assert out == [("j:history:1000", "j", True), ("j", None, False)]


def test_titles(frame):
    lib = frame([("e2e", "Base"), ("v-clip-0-5000", "Clip"), ("v-clip-0-9000", "Later")], "id string, title string")
    jobs = frame(
        [("e2e:stems:history:1", None, None), ("e2e-clip-0-end", None, None), ("v", None, None), ("w", None, "sent"), ("x", "own", "sent")],
        "id string, display_title string, submitted_title string",
    )
    out = {r.id: r.title for r in L.resolve_job_title(jobs, lib).collect()}
    assert out == {"e2e:stems:history:1": "Base", "e2e-clip-0-end": "Base", "v": "Clip", "w": "sent", "x": "own"}


# --- sync ----------------------------------------------------------------------------------------------------

LOCAL = "id string, digest string, modified_at double"
REMOTE = "id string, digest string, updated_at double, deleted boolean, deleted_at double, device string"
PREV = "id string, local_digest string, remote_revision struct<at:double,device:string,digest:string>"
TOMB = "id string, deleted_at double, device string"


def reconciled(frame, local=(), remote=(), previous=(), tombs=(), now=50.0):
    out = Y.reconcile(frame(list(local), LOCAL), frame(list(remote), REMOTE), frame(list(previous), PREV), frame(list(tombs), TOMB), now)
    return {r.id: r for r in out.collect()}


def test_remote_only_is_downloaded(frame):
    r = reconciled(frame, remote=[("s", "d", 10.0, False, None, "x")])["s"]
    assert r.action == "download" and r.removes is None and not r.deletes_local


def test_tombstone_beats_older_remote(frame):
    r = reconciled(frame, remote=[("s", "d", 10.0, False, None, "x")], tombs=[("s", 20.0, "me")])["s"]
    assert r.action == "mark_deleted" and r.removes == "all" and r.remote.deleted and r.remote.updated_at == 20.0


def test_newer_remote_wins_a_conflict(frame):
    r = reconciled(frame, local=[("s", "a", 5.0)], remote=[("s", "b", 9.0, False, None, "x")], previous=[("s", "old", (1.0, "x", "old"))])["s"]
    assert r.action == "download" and r.conflict == "remote"
    tie = reconciled(frame, local=[("s", "a", 9.0)], remote=[("s", "b", 9.0, False, None, "x")])["s"]
    assert tie.action == "publish" and tie.conflict == "local" and tie.removes == "missing"


def test_bad_id_is_left_alone(frame):
    r = reconciled(frame, local=[("../x", "a", 5.0)])["../x"]
    assert r.action == "invalid" and r.conflict == "ignored-invalid-id"


def every_case():
    """All combinations of presence, change and age of one entry."""
    cases = itertools.product(
        (None, "same", "changed"), (None, "same", "changed", "deleted", "deleted-new"), (False, True), (None, 2.0, 30.0), (1.0, 40.0)
    )
    for n, (l, r, known, tomb, mod) in enumerate(cases):
        id = f"c{n}"
        local = (id, "base" if l == "same" else "local", mod) if l else None
        remote = None
        if r:
            deleted = r.startswith("deleted")
            digest = None if deleted else ("base" if r == "same" else "remote")
            remote = (id, digest, 10.0 if r in ("same", "deleted") else 20.0, deleted, 20.0 if deleted else None, "d")
        prev = (id, "base", (10.0, "d", "deleted" if r == "deleted" else "base")) if known else None
        yield local, remote, prev, (id, tomb, "me") if tomb else None


def expected(local, remote, prev, tomb, now):
    """The rules of one entry, step by step."""
    L = local and {"d": local[1], "m": local[2]}
    R = remote and {"d": remote[1], "u": remote[2], "x": remote[3], "xa": remote[4], "v": remote[5]}
    rev = R and (R["u"] or R["xa"] or 0.0, R["v"], R["d"] or ("deleted" if R["x"] else ""))
    changed_r = R is not None and (prev is None or rev != prev[2])
    changed_l = L is not None and (prev is None or L["d"] != prev[1])
    if L and tomb and L["m"] > tomb[1]:
        tomb = None
    if tomb:
        return ("download", None) if R and not R["x"] and (R["u"] or 0) > tomb[1] else ("mark_deleted", None)
    conflict = None
    if R and R["x"]:
        if changed_l and L["m"] > R["xa"]:
            conflict, R = "local", None
        elif changed_r or prev is None:
            return ("delete_local" if L else "none", None)
    if not L:
        return ("download" if R and not R["x"] else "none", conflict)
    if R is None or R["x"]:
        return "publish", conflict
    if L["d"] == R["d"]:
        return "none", None
    if changed_l and changed_r:
        return ("publish", "local") if L["m"] >= R["u"] else ("download", "remote")
    return ("download" if changed_r else "publish" if changed_l else "none"), None


def test_every_branch_of_reconcile(frame):
    cases = list(every_case())
    pick = lambda k: [c[k] for c in cases if c[k]]
    got = reconciled(frame, pick(0), pick(1), pick(2), pick(3))
    seen = set()
    for case in cases:
        id = next((part[0] for part in (case[0], case[1], case[3]) if part), None)
        if id is None:
            continue
        want = expected(*case, 50.0)
        assert (got[id].action, got[id].conflict) == want, case
        seen.add(want)
    assert len(seen) == 7


def test_reconciling_twice_changes_nothing(frame):
    cases = list(every_case())
    pick = lambda k: [c[k] for c in cases if c[k]]
    first = Y.reconcile(frame(pick(0), LOCAL), frame(pick(1), REMOTE), frame(pick(2), PREV), frame(pick(3), TOMB), 50.0)
    local, remote, previous, tombs = Y.apply_reconciled(first)
    again = Y.reconcile(local, remote, previous, tombs, 60.0)
    # A tombstone still marks its remote entry deleted; nothing else is left to do.
    assert again.filter("action not in ('none', 'mark_deleted') or deletes_local or conflict is not null").count() == 0


def test_index_transfer(frame):
    index = frame([("app.js", "1"), ("same.mp3", "2"), ("stale.mp3", "3"), ("kept.mp3", "4")], "key string, sha string")
    local = frame([("app.js", "9", "a"), ("same.mp3", "2", "s")], "key string, sha string, id string")
    protected = frame([("kept.mp3", "4")], "key string, sha string")
    assert rows(Y.upload_plan(local, index).filter("action = 'upload'").select("key")) == [("app.js",)]
    forced = Y.upload_plan(local, index, frame([("s",)], "id string"))
    assert forced.filter("action = 'upload'").count() == 2
    final = Y.final_index(protected, local)
    assert rows(final, "key") == [("app.js", "9"), ("kept.mp3", "4"), ("same.mp3", "2")]
    stale = Y.stale_keys(index, final)
    assert rows(stale) == [("stale.mp3",)]
    assert stale.join(final, "key", "left_semi").count() == 0


def test_allow_list(frame):
    good = "a" * 64
    files = {"sessions/song-1/session.json": good, "sessions/song-1/evil.sh": good, "other/song-1/audio.mp3": good, "sessions/song-1/audio.mp3": "A" * 64}
    out = Y.allowed_files(frame([("song-1", files), ("../x", files)], "id string, files map<string,string>"))
    assert {r.id: r.files for r in out.collect()} == {"song-1": {"sessions/song-1/session.json": good}, "../x": {}}
    assert not frame([("abc\n",)], "id string").select(X.is_valid_id("id")).first()[0]


def test_deletions_are_recorded(frame):
    tombs, prev = Y.record_deletions(
        frame([("a", 1.0, "x"), ("b", 1.0, "x")], TOMB), frame([("a", "d", None), ("c", "d", None)], PREV), frame([("a",)], "id string"), 9.0, "me"
    )
    assert rows(tombs, "id") == [("a", 9.0, "me"), ("b", 1.0, "x")] and rows(prev.select("id")) == [("c",)]
    tombs, prev = Y.record_deletions(frame([("b", 1.0, "x")], TOMB), frame([("c", "d", None)], PREV), frame([("a",)], "id string"), 9.0, "me", False)
    assert rows(tombs.select("id")) == [("a",)] and prev.count() == 0


def test_storage_and_retention(frame):
    files = frame([("work/a.bin", "work", 5, 10), ("work/uploads/b.mp3", "work", 7, 10)], "path string, category string, length long, modified long")
    report = {r.category: (r.bytes, r.files) for r in R.storage_report(files).collect()}
    assert report["work"] == (12, 2) and report["logs"] == (0, 0) and report[None] == (12, 2)
    assert rows(R.retention(files, F.lit(100_000)).select("path")) == [("work/a.bin",)]
    assert rows(R.clear_categories(files, ["work", "work"]).select("path")) == [("work/a.bin",)]


def test_ranks(spark):
    """Places in any order over many ranges: equal keys, one value in most rows, long common prefixes, nulls."""
    from metrum.plans.rank import in_order, range_of, ranked

    data = [("same",)] * 400 + [("p" * 50 + str(k % 37),) for k in range(200)] + [(None,)] * 5
    df = spark.createDataFrame(data, "k string").repartition(5)
    got = sorted((r.rank, r.k) for r in ranked(df, [F.col("k").asc_nulls_first()], ranges=8).collect())
    assert [r for r, _ in got] == list(range(len(data)))
    assert [k for _, k in got] == sorted((k for (k,) in data), key=lambda k: (k is not None, k or ""))
    sizes = [r["count"] for r in in_order(df, [F.col("k").asc()], ranges=8).groupBy(range_of()).count().collect()]
    # Two thirds of the rows are equal, and still no range is much larger than its share.
    assert len(sizes) == 8 and max(sizes) < 2.5 * len(data) / 8
    assert ranked(df.limit(0), [F.col("k").asc()]).count() == 0
    titles = spark.createDataFrame([(k, t) for k, t in enumerate(["ん", "い", "b", "あ", "カ", "A", None])], "position long, title string").withColumns({c: F.lit(None).cast("string") for c in ("date", "last_played")})
    order = rows(L.rank_library(titles, "title").select("rank", "title"), "rank")
    assert [t for _, t in order] == [None, "A", "b", "あ", "い", "カ", "ん"]


def test_legacy_entries(spark, frame):
    """The digest is that of the session's compact JSON map, however the keys are spread over ranges and blocks."""
    import hashlib
    import json

    from metrum.plans.digest import ordered_digest

    index = {f"sessions/{s}/f{k}é\".txt": f"{k:x}" for s, n in (("a", 1), ("b", 40)) for k in range(n)} | {"sessions/manifest.json": "m", "other/a/x": "o"}
    df = frame(list(index.items()), "key string, sha string").repartition(3)
    got = {r.id: r for r in Y.legacy_entries(df, "2024-01-01").collect()}
    for s in "ab":
        own = {k: v for k, v in index.items() if k.startswith(f"sessions/{s}/")}
        want = hashlib.sha256(json.dumps(own, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        assert got[s].digest == want and got[s].device == "legacy" and got[s].entry_date == "2024-01-01" and not got[s].deleted
    assert len(got) == 2
    actions = Y.reconcile(frame([], LOCAL), Y.legacy_entries(df, "x").select("id", "digest", "updated_at", "deleted", "deleted_at", "device"), frame([], PREV), frame([], TOMB), 5.0)
    assert {r.id: r.action for r in actions.collect()} == {"a": "download", "b": "download"}
    small = ordered_digest(spark.range(30).select((F.col("id") % 2).alias("g"), "id"), ["g"], [F.col("id")], F.col("id").cast("string"), block_rows=4)
    assert {r.g: r.digest for r in small.collect()} == {g: hashlib.sha256(",".join(str(k) for k in range(g, 30, 2)).encode()).hexdigest() for g in (0, 1)}
    assert Y.legacy_entries(df.limit(0), "x").count() == 0
