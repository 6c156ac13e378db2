"""Library, folders and jobs on the part, line item and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrum.operators import jobs as K
from metrum.operators import library as L
from metrum.queries.registry import query
from metrum.queries.views import Views

NOW = 2_000_000_000

# --- library -------------------------------------------------------------------------------------------------


@query(
    "library_entry",
    "SELECT id, title, bpm, date, array_to_string(tags, ',') AS tags, last_played, play_count FROM v_library",
)
def _(v: Views):
    dates = v.library.select("id", "date")
    return L.library_entry(v.library, dates).withColumn("tags", F.array_join("tags", ","))


@query(
    "search_library",
    """
    SELECT id, title FROM v_library
    WHERE last_played IS NULL AND contains(lower(title || ' ' || array_to_string(tags, ' ')), 'brand#1')""",
)
def _(v: Views):
    return L.search_library(v.library, " BRAND#1 ", unpracticed=True).select("id", "title")


@query("search_library_blank", "SELECT id, title FROM v_library")
def _(v: Views):
    return L.search_library(v.library, "  ").select("id", "title")


# Titles of which most begin in Japanese; the order of the letters is not that of their codes.
TITLES = ("ん", "あ", "か", "", "ア", "z")
TITLE_SQL = "list_value(" + ", ".join(f"'{t}'" for t in TITLES) + ")[position % 6 + 1] || title"
ORDERS = {
    "manual": "position", "recent": "coalesce(last_played, '') DESC, position", "added": "coalesce(date, '') DESC, position",
    "title": "coalesce(title, '') COLLATE ja, position",
}


for _mode, _order in ORDERS.items():

    @query(
        f"sort_library_{_mode}",
        f"""
        WITH l AS (SELECT * REPLACE ({TITLE_SQL} AS title) FROM v_library)
        SELECT id, position, title, date, last_played, row_number() OVER (ORDER BY {_order}) - 1 AS rank FROM l""",
    )
    def _(v: Views, mode=_mode):
        begin = F.element_at(F.array(*map(F.lit, TITLES)), (F.col("position") % 6 + 1).cast("int"))
        titled = v.library.withColumn("title", F.concat(begin, "title"))
        return L.rank_library(titled, mode).select("id", "position", "title", "date", "last_played", "rank")


@query(
    "latest_jobs",
    "SELECT id, run, updated FROM v_jobs ORDER BY updated DESC, run LIMIT 200",
)
def _(v: Views):
    return K.latest_jobs(v.jobs, 200, "run").select("id", "run", "updated")


@query(
    "recent_per_key",
    """
    WITH newest AS (SELECT id, max({'a': started, 'r': run}) AS m FROM v_jobs GROUP BY id)
    SELECT id, m.a AS started, m.r AS run FROM newest ORDER BY m.a DESC, id LIMIT 30""",
)
def _(v: Views):
    return L.recent_per_key(v.jobs.select("id", "started", "run"), "id", "started", 30)


@query("entry_date", "SELECT id, coalesce(date, '2024-01-01') AS date FROM v_library")
def _(v: Views):
    return L.entry_date(v.library, "2024-01-01").select("id", "date")


CLEAN_SQL = """
    clean AS (SELECT id, min({'f': folder, 'p': pos}) AS m FROM v_folders
              WHERE id IN (SELECT id FROM v_library) GROUP BY id)"""


@query("clean_folders", f"WITH {CLEAN_SQL} SELECT m.f AS folder, m.p AS pos, id FROM clean")
def _(v: Views):
    return L.clean_folders(v.folders, v.library)


SAVED_SQL = "saved AS (SELECT 'p' || p_partkey AS id, -p_partkey AS saved_pos FROM part WHERE p_partkey % 10 = 3)"


def _saved(v: Views):
    return v.library.filter("position % 10 = 3").select("id", (-F.col("position")).alias("saved_pos"))


@query(
    "root_order",
    f"""
    WITH {CLEAN_SQL}, {SAVED_SQL}
    SELECT l.id, CASE WHEN s.id IS NULL THEN 1 ELSE 0 END AS rank_group, coalesce(s.saved_pos, l.position) AS rank_pos
    FROM v_library l LEFT JOIN saved s ON s.id = l.id WHERE l.id NOT IN (SELECT id FROM clean)""",
)
def _(v: Views):
    cleaned = L.clean_folders(v.folders, v.library)
    return L.root_order(v.library, _saved(v), cleaned).select("id", "rank_group", "rank_pos")


GROUPS_SQL = f"""
    {CLEAN_SQL}, {SAVED_SQL},
    playback AS (
        SELECT CAST(m.f AS VARCHAR) AS group_id, m.f AS group_pos, 0 AS rank_group, m.p AS rank_pos, id FROM clean
        UNION ALL
        SELECT 'root', 2147483648, CASE WHEN s.id IS NULL THEN 1 ELSE 0 END, coalesce(s.saved_pos, l.position), l.id
        FROM v_library l LEFT JOIN saved s ON s.id = l.id WHERE l.id NOT IN (SELECT id FROM clean))"""


@query("playback_groups", f"WITH {GROUPS_SQL} SELECT * FROM playback")
def _(v: Views):
    return L.playback_groups(v.folders, v.library, _saved(v))


@query(
    "next_in_group",
    f"""
    WITH {GROUPS_SQL}
    SELECT group_id, id, lead(id) OVER (PARTITION BY group_id ORDER BY rank_group, rank_pos, id) AS next_id FROM playback""",
)
def _(v: Views):
    groups = L.playback_groups(v.folders, v.library, _saved(v))
    return L.next_in_group(groups).select("group_id", "id", "next_id")


@query(
    "apply_overrides",
    """
    WITH shared AS (SELECT DISTINCT folder, folder % 2 = 0 AS collapsed FROM v_folders),
    own AS (SELECT s_suppkey AS user_id, s_suppkey % 10 AS folder, s_suppkey % 3 = 0 AS collapsed FROM supplier)
    SELECT f.folder, u.user_id AS "user", coalesce(o.collapsed, f.collapsed) AS collapsed
    FROM shared f CROSS JOIN (SELECT DISTINCT user_id FROM own) u
    LEFT JOIN own o ON o.folder = f.folder AND o.user_id = u.user_id""",
)
def _(v: Views):
    shared = v.folders.select("folder").distinct().withColumn("collapsed", F.col("folder") % 2 == 0)
    own = v.table("supplier").select(
        F.col("s_suppkey").alias("user"), (F.col("s_suppkey") % 10).alias("folder"), (F.col("s_suppkey") % 3 == 0).alias("collapsed")
    )
    return L.apply_overrides(shared, own)


def _changes(v: Views):
    return v.library.filter("position % 6 = 1").select(
        F.when(F.col("position") % 4 == 1, F.concat(F.lit("new"), "position")).otherwise(F.col("id")).alias("id"),
        F.concat(F.lit("retitled "), "title").alias("title"), "position",
    )


CHANGES_SQL = """
    changes AS (SELECT CASE WHEN position % 4 = 1 THEN 'new' || position ELSE id END AS id,
                'retitled ' || title AS title, position FROM v_library WHERE position % 6 = 1)"""


@query(
    "upsert_front",
    f"""
    WITH {CHANGES_SQL}
    SELECT id, title, position, 0 AS rank_group, position AS rank_pos FROM changes
    UNION ALL SELECT id, title, position, 1, position FROM v_library WHERE id NOT IN (SELECT id FROM changes)""",
)
def _(v: Views):
    return L.upsert_front(v.library.select("id", "title", "position"), _changes(v))


@query(
    "upsert_in_place",
    f"""
    WITH {CHANGES_SQL}
    SELECT c.id, c.title, c.position, CASE WHEN l.id IS NULL THEN 0 ELSE 1 END AS rank_group,
           coalesce(l.position, c.position) AS rank_pos FROM changes c LEFT JOIN v_library l ON l.id = c.id
    UNION ALL SELECT id, title, position, 1, position FROM v_library WHERE id NOT IN (SELECT id FROM changes)""",
)
def _(v: Views):
    return L.upsert_in_place(v.library.select("id", "title", "position"), _changes(v))


@query(
    "distinct_keep_first",
    """
    SELECT page_id, array_to_string(list_filter(words, lambda x, i: list_position(words, x) = i), '/') AS kept
    FROM (SELECT page_id, string_split(url, '/') AS words FROM pages)""",
)
def _(v: Views):
    words = F.split("url", "/")
    return v.table("pages").select("page_id", F.array_join(L.distinct_keep_first(words), "/").alias("kept"))


@query(
    "mirror_plan",
    """
    WITH src AS (SELECT path AS name FROM v_files WHERE doc_id % 3 <> 0),
    dst AS (SELECT path AS name FROM v_files WHERE doc_id % 4 <> 0)
    SELECT coalesce(s.name, d.name) AS name, CASE WHEN s.name IS NOT NULL THEN 'copy' ELSE 'remove' END AS action
    FROM src s FULL JOIN dst d ON d.name = s.name""",
)
def _(v: Views):
    names = v.files.select(F.col("path").alias("name"), "doc_id")
    return L.mirror_plan(names.filter("doc_id % 3 <> 0"), names.filter("doc_id % 4 <> 0"))


def _doomed(v: Views):
    return v.library.filter("position % 9 = 2").select("id")


@query("cascade_delete_library", "SELECT id, title FROM v_library WHERE position % 9 <> 2")
def _(v: Views):
    inventory = v.index.select("key")
    return L.cascade_delete(_doomed(v), v.library, v.folders, inventory)[0].select("id", "title")


@query(
    "cascade_delete_folders",
    "SELECT * FROM v_folders WHERE id NOT IN (SELECT id FROM v_library WHERE position % 9 = 2)",
)
def _(v: Views):
    return L.cascade_delete(_doomed(v), v.library, v.folders, v.index.select("key"))[1]


@query(
    "cascade_delete_files",
    """
    SELECT key FROM v_index WHERE key IN (
        SELECT 'sessions/' || id || '/' || name FROM v_hash,
        (SELECT unnest(['session.json', 'audio.mp3', 'video.mp4', 'stems/vocals.mp3', 'stems/drums.mp3',
                        'stems/bass.mp3', 'stems/other.mp3']) AS name) WHERE id % 9 = 2)""",
)
def _(v: Views):
    ids = v.hashes.filter("id % 9 = 2").select(F.col("id").cast("string").alias("id"))
    return L.cascade_delete(ids, v.library, v.folders, v.index.select("key"))[2]


ASSET_FILES_SQL = """
    stem_files AS (SELECT p_partkey, CAST(n AS BIGINT) AS n FROM part,
                   (SELECT unnest([0, 1, 2, 3]) AS n) WHERE p_partkey % 5 <> n)"""


@query(
    "attach_assets",
    f"""
    WITH {ASSET_FILES_SQL},
    n AS (SELECT p_partkey, count(*) AS n FROM stem_files GROUP BY p_partkey)
    SELECT l.id, CASE WHEN l.position % 2 = 0 THEN 'kept.mp3' ELSE 'audio/' || l.id || '.mp3' END AS audio,
           'results/' || l.id || '.json' AS result,
           CASE WHEN n.n = 4 THEN 'stems/' || l.id || '/vocals.mp3' END AS vocals, CASE WHEN n.n = 4 THEN 7 ELSE 3 END AS entries
    FROM v_library l LEFT JOIN n ON n.p_partkey = l.position""",
)
def _(v: Views):
    names = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(s).alias("stem")) for i, s in enumerate(("vocals", "drums", "bass", "other"))])
    inventory = (
        v.table("part")
        .select("p_partkey", F.explode(names).alias("f"))
        .filter(F.col("p_partkey") % 5 != F.col("f.n"))
        .select(F.concat(F.lit("stems/p"), "p_partkey", F.lit("/"), "f.stem", F.lit(".mp3")).alias("path"))
    )
    given = F.when(F.col("position") % 2 == 0, F.create_map(F.lit("audio"), F.lit("kept.mp3")))
    out = L.attach_assets(v.library.withColumn("assets", given), inventory)
    take = lambda k: F.try_element_at("assets", F.lit(k))
    return out.select(
        "id", take("audio").alias("audio"), take("result").alias("result"), take("stems/vocals").alias("vocals"),
        F.size("assets").alias("entries"),
    )


@query(
    "practice_stats",
    """
    WITH once AS (SELECT user_id AS id, CAST(floor(value) AS BIGINT) % 10 AS visit, max(event_id) AS seen FROM events GROUP BY ALL)
    SELECT id, count(*) AS play_count, max(seen) AS last_played FROM once GROUP BY id""",
)
def _(v: Views):
    plays = v.table("events").select(
        F.col("user_id").alias("id"), (F.floor("value").cast("long") % 10).alias("visit"), F.col("event_id").alias("at")
    )
    return L.practice_stats(plays)


TITLES_SQL = """
    titles AS (
        SELECT CASE c_custkey % 4 WHEN 0 THEN 'v' || c_custkey WHEN 1 THEN 'v' || (c_custkey + 1) || '-clip-0-end'
               WHEN 2 THEN 'v' || c_custkey || '-clip-5000-9000' ELSE 'v' || (c_custkey - 1) || '-clip-1000-2000' END AS id,
               CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS title FROM customer),
    asked AS (
        SELECT run, CASE WHEN run % 3 = 0 THEN 'v' || substr(id, 2) || ':stems:history:1'
               WHEN run % 3 = 1 THEN 'v' || substr(id, 2) || '-clip-5000-9000' ELSE 'v' || substr(id, 2) END AS id,
               CASE WHEN run % 7 = 0 THEN 'own ' || run END AS display_title,
               CASE WHEN run % 2 = 0 THEN 'sent ' || run END AS submitted_title FROM v_jobs)"""


@query(
    "resolve_job_title",
    f"""
    WITH {TITLES_SQL},
    named AS (SELECT *, regexp_replace(split_part(id, ':history:', 1),
                     ':(?:stems|stem-export|score-preview|score-extract).*$', '', 's') AS ses FROM asked),
    clips AS (SELECT split_part(id, '-clip-', 1) AS src, min_by(title, id) AS t FROM titles
              WHERE contains(id, '-clip-') AND coalesce(title, '') <> '' GROUP BY 1)
    SELECT n.run, n.id, coalesce(n.display_title, e.title, s.title, c.t, n.submitted_title) AS title
    FROM named n LEFT JOIN titles e ON e.id = n.ses AND e.title IS NOT NULL
    LEFT JOIN titles s ON s.id = split_part(n.ses, '-clip-', 1) AND s.title IS NOT NULL
    LEFT JOIN clips c ON c.src = split_part(n.ses, '-clip-', 1)""",
)
def _(v: Views):
    key = F.col("c_custkey")
    titles = v.table("customer").select(
        F.when(key % 4 == 0, F.concat(F.lit("v"), key))
        .when(key % 4 == 1, F.concat(F.lit("v"), key + 1, F.lit("-clip-0-end")))
        .when(key % 4 == 2, F.concat(F.lit("v"), key, F.lit("-clip-5000-9000")))
        .otherwise(F.concat(F.lit("v"), key - 1, F.lit("-clip-1000-2000")))
        .alias("id"),
        F.when(key % 11 != 0, F.col("c_name")).alias("title"),
    )
    run, video = F.col("run"), F.concat(F.lit("v"), F.substring("id", 2, 100))
    asked = v.jobs.select(
        "run",
        F.when(run % 3 == 0, F.concat(video, F.lit(":stems:history:1")))
        .when(run % 3 == 1, F.concat(video, F.lit("-clip-5000-9000")))
        .otherwise(video)
        .alias("id"),
        F.when(run % 7 == 0, F.concat(F.lit("own "), run)).alias("display_title"),
        F.when(run % 2 == 0, F.concat(F.lit("sent "), run)).alias("submitted_title"),
    )
    return L.resolve_job_title(asked, titles).select("run", "id", "title")


# --- jobs ----------------------------------------------------------------------------------------------------


def _jobs(v: Views):
    """Job rows with the state columns the operators use."""
    run = F.col("run")
    return v.jobs.select(
        "*",
        F.when(run % 4 == 0, "queued").otherwise("inferencing").alias("stage"),
        F.lit("working").alias("message"),
        (F.col("done") & (run % 6 == 0)).alias("interrupted"),
        (run % 2 == 0).alias("resumable"),
        F.lit(False).alias("cancel_requested"),
        F.when(F.col("has_spec"), F.lit('{"type":"analyze"}')).alias("spec"),
        F.when(F.col("done") & (run % 4 != 1), F.col("updated")).alias("finished"),
    ).drop("has_spec")


JOBS_SQL = """
    j AS (SELECT *, CASE WHEN run % 4 = 0 THEN 'queued' ELSE 'inferencing' END AS stage, 'working' AS message,
                 done AND run % 6 = 0 AS interrupted, run % 2 = 0 AS resumable,
                 CASE WHEN done AND run % 4 <> 1 THEN updated END AS finished FROM v_jobs)"""


@query(
    "job_history",
    f"""
    WITH {JOBS_SQL}
    SELECT id, run, started, coalesce(finished, CASE WHEN done THEN updated END) AS finished,
           CASE WHEN finished IS NOT NULL OR done THEN CAST(greatest(0, coalesce(finished, updated) - started) AS DOUBLE) END AS duration FROM j
    """,
)
def _(v: Views):
    return K.job_history(_jobs(v)).select("id", "run", "started", "finished", "duration")


@query("recoverable_jobs", f"WITH {JOBS_SQL} SELECT id, run FROM j WHERE interrupted AND resumable AND NOT archived")
def _(v: Views):
    return K.recoverable_jobs(_jobs(v)).select("id", "run")


STATE_SQL = """CASE WHEN canceled THEN 'canceled' WHEN error IS NOT NULL THEN 'error' WHEN done THEN 'success'
               ELSE 'running' END"""


@query("job_state", f"SELECT id, run, {STATE_SQL} AS state FROM v_jobs")
def _(v: Views):
    return v.jobs.select("id", "run", K.job_state().alias("state"))


SUMMARY_SQL = """count(*) AS total, count(*) FILTER (done AND error IS NULL AND NOT canceled) AS succeeded,
                 count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (NOT done) AS running"""


@query("job_summary", f"SELECT {SUMMARY_SQL} FROM v_jobs")
def _(v: Views):
    return K.job_summary(v.jobs)


@query("job_summary_by_kind", f"SELECT kind, {SUMMARY_SQL} FROM v_jobs GROUP BY kind")
def _(v: Views):
    return K.job_summary(v.jobs, ["kind"])


@query(
    "archive_runs",
    """
    WITH last AS (SELECT id, max({'a': started, 'r': run}) AS m FROM v_jobs GROUP BY id),
    m AS (SELECT j.*, {'a': j.started, 'r': j.run} < l.m AND j.done AS old FROM v_jobs j JOIN last l ON l.id = j.id)
    SELECT CASE WHEN old THEN id || ':history:' || (started * 1000) ELSE id END AS id, run,
           CASE WHEN old THEN id END AS source_job_id, old OR archived AS archived FROM m""",
)
def _(v: Views):
    return K.archive_runs(v.jobs).select("id", "run", "source_job_id", "archived")


@query(
    "recover",
    f"""
    WITH {JOBS_SQL}, h AS (SELECT *, NOT archived AND NOT done AS hit FROM j)
    SELECT run, CASE WHEN hit THEN 'interrupted' ELSE stage END AS stage,
           CASE WHEN hit THEN 'Application restarted; resume when ready' ELSE message END AS message,
           CASE WHEN NOT hit THEN error END AS error, hit OR interrupted AS interrupted,
           CASE WHEN archived THEN false WHEN hit THEN has_spec ELSE resumable END AS resumable,
           CASE WHEN hit THEN {NOW} ELSE updated END AS updated,
           CASE WHEN hit THEN {NOW} WHEN NOT archived AND done THEN coalesce(finished, updated) ELSE finished END AS finished,
           CASE WHEN archived THEN done ELSE true END AS done FROM h""",
)
def _(v: Views):
    return K.recover(_jobs(v), F.lit(NOW).cast("long")).select(
        "run", "stage", "message", "error", "interrupted", "resumable", "updated", "finished", "done"
    )


@query(
    "cancel",
    f"""
    WITH {JOBS_SQL},
    f AS (SELECT *, CAST(substr(id, 2) AS BIGINT) % 3 = 0 AS due FROM j),
    g AS (SELECT *, due AND interrupted AND done AND resumable AS waiting,
                 due AND NOT done AND stage = 'queued' AS queued, due AND NOT done AND stage <> 'queued' AS active FROM f)
    SELECT run, CASE WHEN waiting OR queued THEN 'canceled' ELSE stage END AS stage,
           CASE WHEN waiting OR queued THEN 'Canceled' WHEN active THEN 'Cancel requested' ELSE message END AS message,
           waiting OR queued OR canceled AS canceled, waiting OR queued OR active AS cancel_requested,
           NOT waiting AND interrupted AS interrupted, NOT waiting AND resumable AS resumable,
           has_spec AND NOT waiting AS keeps_spec, waiting OR queued OR done AS done,
           CASE WHEN waiting OR queued OR active THEN {NOW} ELSE updated END AS updated,
           CASE WHEN waiting OR queued THEN {NOW} ELSE finished END AS finished FROM g""",
)
def _(v: Views):
    requests = v.jobs.select("id").distinct().filter(F.substring("id", 2, 20).cast("long") % 3 == 0)
    out = K.cancel(_jobs(v), requests, F.lit(NOW).cast("long"))
    return out.withColumn("keeps_spec", F.col("spec").isNotNull()).select(
        "run", "stage", "message", "canceled", "cancel_requested", "interrupted", "resumable", "keeps_spec", "done",
        "updated", "finished",
    )
