"""Reconciliation, transfers and file reports on the document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrum.functions import scalars as X
from metrum.operators import reports as R
from metrum.operators import sync as Y
from metrum.queries.registry import query, scratch
from metrum.queries.views import Views
from metrum.sources.readers import read_sync_index
from metrum.sources.writers import write_sync_index

NOW = 50.0


@query("all_ids", "SELECT id FROM v_local UNION SELECT id FROM v_remote UNION SELECT id FROM v_tomb")
def _(v: Views):
    return Y.all_ids(v.local, v.remote, v.tombstones)


ODD_IDS = """
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN source || '/' || doc_id WHEN doc_id % 7 = 0 THEN source || chr(10)
           ELSE source || '-' || doc_id END AS id FROM documents"""


@query("valid_session_ids", f"SELECT doc_id, id FROM ({ODD_IDS}) WHERE regexp_full_match(id, '[A-Za-z0-9_-]{{1,128}}')")
def _(v: Views):
    key = F.col("doc_id")
    odd = F.when(key % 5 == 0, F.concat("source", F.lit("/"), key)).when(key % 7 == 0, F.concat("source", F.lit("\n")))
    ids = v.table("documents").select(key, odd.otherwise(F.concat("source", F.lit("-"), key)).alias("id"))
    return Y.valid_session_ids(ids)


SEVEN = """['session.json', 'audio.mp3', 'video.mp4', 'stems/vocals.mp3', 'stems/drums.mp3', 'stems/bass.mp3',
            'stems/other.mp3']"""


@query(
    "allowed_files",
    """
    SELECT id, CAST(1 + (id % 3 <> 0)::INT AS BIGINT) AS kept, 'sessions/' || id || '/audio.mp3' AS always FROM v_hash
    """,
)
def _(v: Views):
    sid = F.col("id").cast("string")
    files = F.create_map(
        F.concat(F.lit("sessions/"), sid, F.lit("/audio.mp3")), F.col("h"),
        F.concat(F.lit("sessions/"), sid, F.lit("/session.json")), F.when(F.col("id") % 3 != 0, F.col("h")).otherwise(F.upper("h")),
        F.concat(F.lit("sessions/"), sid, F.lit("/other.bin")), F.col("h"),
        F.concat(F.lit("sessions/x"), sid, F.lit("/video.mp4")), F.col("h"),
    )
    kept = Y.allowed_files(v.hashes.select(sid.alias("id"), files.alias("files")))
    name = F.concat(F.lit("sessions/"), "id", F.lit("/audio.mp3"))
    always = F.when(F.array_contains(F.map_keys("files"), name), name)
    return kept.select(F.col("id").cast("long"), F.size("files").cast("long").alias("kept"), always.alias("always"))


@query(
    "allowed_index",
    "SELECT key, sha, split_part(key, '/', 2) AS id FROM v_index WHERE key LIKE 'sessions/%' AND length(sha) = 64",
)
def _(v: Views):
    return Y.allowed_index(v.index)


@query(
    "verify_files",
    """
    SELECT i.key, i.sha FROM v_index i JOIN v_local_files f ON f.key = i.key AND f.sha = i.sha
    JOIN v_hash h ON h.id = f.id AND h.n_chars <= 4000""",
)
def _(v: Views):
    return Y.verify_files(v.index, _inventory(v), 4000)[0]


@query(
    "rejected_files",
    """
    SELECT i.key, CASE WHEN f.key IS NULL THEN 'missing' WHEN h.n_chars > 4000 THEN 'too large' ELSE 'hash differs' END AS reason
    FROM v_index i LEFT JOIN v_local_files f ON f.key = i.key LEFT JOIN v_hash h ON h.id = f.id
    WHERE f.key IS NULL OR h.n_chars > 4000 OR f.sha <> i.sha""",
)
def _(v: Views):
    return Y.verify_files(v.index, _inventory(v), 4000)[1]


def _inventory(v: Views):
    return v.local_files.join(v.hashes.select("id", F.col("n_chars").alias("length")), "id")


@query("valid_payload", "SELECT doc_id AS id, lang AS title FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def _(v: Views):
    key = F.col("doc_id")
    entries = v.table("documents").select(
        key.alias("key_id"), F.when(key % 3 == 0, key + 1).otherwise(key).alias("id"), F.col("lang").alias("title"),
        F.when(key % 5 != 0, 100.0).alias("bpm"),
    )
    return Y.valid_payload(entries)[0].select("id", "title")


# --- reconciliation ------------------------------------------------------------------------------------------

RECONCILE_SQL = f"""
    ids AS (SELECT id FROM v_local UNION SELECT id FROM v_remote UNION SELECT id FROM v_tomb),
    x AS (SELECT i.id, l.id IS NOT NULL AS L, r.id IS NOT NULL AS R, p.id IS NOT NULL AS P, t.id IS NOT NULL AS T,
                 l.digest AS ld, l.modified_at AS lm, r.digest AS rdg, r.updated_at AS ru, coalesce(r.deleted, false) AS gone0,
                 r.deleted_at AS rda, p.local_digest AS pl, coalesce(p.same_remote, false) AS same_rev, t.deleted_at AS td
          FROM ids i LEFT JOIN v_local l ON l.id = i.id LEFT JOIN v_remote r ON r.id = i.id
          LEFT JOIN v_prev p ON p.id = i.id LEFT JOIN v_tomb t ON t.id = i.id),
    y AS (SELECT *, L AND T AND lm > coalesce(td, 0) AS forgotten, R AND gone0 AS gone, R AND NOT gone0 AS live,
                 coalesce(nullif(td, 0), {NOW}) AS buried_at, coalesce(nullif(ru, 0), nullif(rda, 0), 0) AS r_at,
                 R AND NOT same_rev AS rc, L AND ld IS DISTINCT FROM pl AS lc FROM x),
    z AS (SELECT *, T AND NOT forgotten AS buried FROM y),
    w AS (SELECT *, buried AND live AND r_at > buried_at AS revived,
                 NOT buried AND gone AND lc AND lm > coalesce(rda, 0) AS outlived FROM z),
    u AS (SELECT *, NOT buried AND gone AND NOT outlived AND (rc OR NOT P) AS follow,
                 coalesce(ld = rdg, false) AS same, lm >= coalesce(ru, 0) AS newer FROM w),
    acts AS (SELECT *, CASE WHEN revived THEN 'download' WHEN buried THEN 'mark_deleted' WHEN follow AND L THEN 'delete_local'
        WHEN follow THEN 'none' WHEN NOT L AND live THEN 'download' WHEN NOT L THEN 'none' WHEN NOT live THEN 'publish'
        WHEN same THEN 'none' WHEN lc AND rc AND newer THEN 'publish' WHEN lc AND rc THEN 'download'
        WHEN rc THEN 'download' WHEN lc THEN 'publish' ELSE 'none' END AS action FROM u),
    plan AS (SELECT *, CASE WHEN buried OR follow THEN NULL WHEN outlived THEN 'local'
        WHEN L AND live AND NOT same AND lc AND rc THEN CASE WHEN newer THEN 'local' ELSE 'remote' END END AS conflict,
        action = 'delete_local' OR (action = 'mark_deleted' AND L) AS deletes_local,
        CASE WHEN action = 'mark_deleted' AND R THEN 'all' WHEN action = 'publish' AND live THEN 'missing' END AS removes
        FROM acts)"""


def _reconciled(v: Views):
    return Y.reconcile(v.local, v.remote, v.previous, v.tombstones, NOW)


@query("reconcile", f"WITH {RECONCILE_SQL} SELECT id, action, conflict, deletes_local, removes FROM plan")
def _(v: Views):
    return _reconciled(v).select("id", "action", "conflict", "deletes_local", "removes")


@query(
    "reconcile_tombstones",
    f"""
    WITH {RECONCILE_SQL}
    SELECT id, CASE WHEN follow THEN coalesce(nullif(rda, 0), {NOW}) ELSE td END AS deleted_at FROM plan
    WHERE follow OR (T AND NOT forgotten AND NOT revived)""",
)
def _(v: Views):
    return Y.apply_reconciled(_reconciled(v))[3].select("id", "deleted_at")


@query(
    "reconcile_state",
    f"""
    WITH {RECONCILE_SQL},
    s AS (SELECT id, CASE WHEN action = 'download' THEN rdg ELSE ld END AS local_digest,
                 (L OR action = 'download') AND NOT deletes_local AS has_local,
                 action IN ('publish', 'download') OR (live AND action <> 'mark_deleted') AS has_remote FROM plan)
    SELECT id, local_digest FROM s WHERE has_local AND has_remote""",
)
def _(v: Views):
    return Y.apply_reconciled(_reconciled(v))[2].select("id", "local_digest")


@query(
    "reconcile_folders",
    """
    WITH x AS (SELECT c_custkey AS ws, c_custkey % 2 = 0 AS same, c_custkey % 3 = 0 AS no_prev, c_custkey % 5 = 0 AS empty,
                      c_custkey % 7 < 3 AS l_same, c_custkey % 11 < 4 AS r_same, c_custkey % 13 = 0 AS no_remote,
                      CAST(c_custkey % 17 AS DOUBLE) AS lm, CAST(c_custkey % 19 AS DOUBLE) AS ru FROM customer),
    y AS (SELECT *, NOT (l_same AND NOT no_prev) AND NOT (no_prev AND empty) AS lc, NOT (r_same AND NOT no_prev) AS rc FROM x),
    z AS (SELECT *, lc AND (NOT rc OR lm >= ru) AS keep FROM y)
    SELECT ws AS workspace, CASE WHEN no_remote THEN 'publish' WHEN same THEN 'none' WHEN keep THEN 'publish'
           WHEN rc THEN 'download' ELSE 'none' END AS action,
           CASE WHEN NOT no_remote AND NOT same AND lc AND rc THEN CASE WHEN keep THEN 'local' ELSE 'remote' END END AS conflict
    FROM z""",
)
def _(v: Views):
    k = F.col("c_custkey")
    base = v.table("customer").select(k.alias("workspace"), "c_name", "c_custkey")
    local = base.select("workspace", F.col("c_name").alias("digest"), (k % 17).cast("double").alias("modified_at"), (k % 5 == 0).alias("empty"))
    other = F.when(k % 2 == 0, F.col("c_name")).otherwise(F.concat("c_name", F.lit("R")))
    remote = base.filter("c_custkey % 13 <> 0").select(
        "workspace", other.alias("digest"), (k % 19).cast("double").alias("updated_at"), F.lit("d").alias("device"), "c_custkey"
    )
    rev = X.revision("updated_at", F.lit(None).cast("double"), "device", "digest", F.lit(False))
    revisions = remote.filter("c_custkey % 11 < 4").select("workspace", rev.alias("remote_revision"))
    previous = base.filter("c_custkey % 3 <> 0").select(
        "workspace", F.when(k % 7 < 3, F.col("c_name")).otherwise(F.lit("old")).alias("local_digest")
    ).join(revisions, "workspace", "left")
    return Y.reconcile_folders(local, remote, previous)


# --- transfers -----------------------------------------------------------------------------------------------

UPLOAD_SQL = """
    up AS (SELECT f.key, f.sha, CASE WHEN i.sha = f.sha AND f.id % 10 <> 1 THEN 'unchanged' ELSE 'upload' END AS action
           FROM v_local_files f LEFT JOIN v_index i ON i.key = f.key)"""


def _uploads(v: Views):
    return Y.upload_plan(v.local_files, v.index, v.hashes.filter("id % 10 = 1").select("id"))


@query("upload_plan", f"WITH {UPLOAD_SQL} SELECT key, sha, action FROM up")
def _(v: Views):
    return _uploads(v)


@query("stale_keys", "SELECT key FROM v_index WHERE key NOT IN (SELECT key FROM v_local_files)")
def _(v: Views):
    return Y.stale_keys(v.index, v.local_files)


@query("minus_files", "SELECT key FROM v_index EXCEPT SELECT key FROM v_local_files")
def _(v: Views):
    return Y.minus_files(v.index, v.local_files)


@query(
    "final_index",
    """
    SELECT coalesce(l.key, i.key) AS key, coalesce(l.sha, i.sha) AS sha
    FROM v_index i FULL JOIN v_local_files l ON l.key = i.key""",
)
def _(v: Views):
    return Y.final_index(v.index, v.local_files)


@query(
    "desired_files",
    f"""
    SELECT key FROM v_index WHERE key IN (
        SELECT 'sessions/' || id || '/' || name FROM v_hash, (SELECT unnest({SEVEN}) AS name) WHERE id % 3 = 0)
    OR key = 'other/2/notes.txt'""",
)
def _(v: Views):
    entries = v.hashes.filter("id % 3 = 0").select(F.col("id").cast("string").alias("id"))
    return Y.desired_files(entries, v.index.select("key"), ("other/2/notes.txt", "index.html"))


@query(
    "legacy_entries",
    """
    WITH f AS (SELECT split_part(key, '/', 2) AS id, key, sha FROM v_index WHERE key LIKE 'sessions/%')
    SELECT id, sha256('{' || string_agg('"' || key || '":"' || sha || '"', ',' ORDER BY key) || '}') AS digest, 0.0::DOUBLE AS updated_at,
           false AS deleted, CAST(NULL AS DOUBLE) AS deleted_at, 'legacy' AS device, '2024-01-01' AS entry_date FROM f GROUP BY id""",
)
def _(v: Views):
    return Y.legacy_entries(v.index, "2024-01-01")


@query(
    "group_legacy_index",
    """
    SELECT split_part(key, '/', 2) AS id, key, sha, 'legacy' AS device, 0.0::DOUBLE AS updated_at FROM v_index
    WHERE key LIKE 'sessions/%'""",
)
def _(v: Views):
    return Y.group_legacy_index(v.index)


@query(
    "bundle_digest",
    """
    SELECT CAST(id AS VARCHAR) AS id, sha256('{' || string_agg('"' || key || '":"' || sha || '"', ',' ORDER BY key) || '}') AS digest,
           max(length(key)) AS modified_at FROM v_local_files GROUP BY id""",
)
def _(v: Views):
    files = v.local_files.select(F.col("id").cast("string").alias("id"), "key", "sha", F.length("key").cast("long").alias("modified"))
    return Y.bundle_digest(files)


@query(
    "reconcile_summary",
    f"""
    WITH {RECONCILE_SQL}, {UPLOAD_SQL}
    SELECT (SELECT count(*) FROM plan WHERE action = 'download') AS downloaded,
           (SELECT count(*) FROM plan WHERE deletes_local OR removes = 'all') AS deleted,
           (SELECT count(conflict) FROM plan) AS conflicts, (SELECT count(*) FROM up WHERE action = 'upload') AS uploaded,
           (SELECT count(*) FROM up WHERE action = 'unchanged') AS unchanged,
           (SELECT count(DISTINCT device) FROM v_remote) AS devices""",
)
def _(v: Views):
    return Y.reconcile_summary(_reconciled(v), _uploads(v), v.remote.select("device"))


@query(
    "apply_devices",
    """
    SELECT 'c' || c_custkey AS device, c_name AS name, CAST(c_custkey AS DOUBLE) AS last_seen FROM customer WHERE c_custkey % 6 <> 0
    UNION ALL SELECT 'c' || c_custkey, 'renamed', 1e9 FROM customer WHERE c_custkey % 4 = 0
    AND c_custkey % 6 = 0
    UNION ALL SELECT 'c' || c_custkey, c_name, CAST(c_custkey AS DOUBLE) FROM customer WHERE c_custkey % 6 = 0 AND c_custkey % 4 <> 0
    """,
)
def _(v: Views):
    devices = v.table("customer").select(
        F.concat(F.lit("c"), "c_custkey").alias("device"), F.col("c_name").alias("name"), F.col("c_custkey").cast("double").alias("last_seen"), "c_custkey"
    )
    seen = devices.filter("c_custkey % 12 = 0").select("device", F.lit("renamed").alias("name"), F.lit(1e9).alias("last_seen"))
    return Y.apply_devices(devices.drop("c_custkey"), seen)


@query(
    "record_deletions",
    """
    SELECT id, deleted_at, device FROM v_tomb WHERE id % 3 <> 0
    UNION ALL SELECT id, 77.0::DOUBLE, 'me' FROM v_hash WHERE id % 3 = 0""",
)
def _(v: Views):
    ids = v.hashes.filter("id % 3 = 0").select("id")
    return Y.record_deletions(v.tombstones, v.previous, ids, 77.0, "me")[0]


@query("sync_index_round_trip", "SELECT key, sha FROM v_index")
def _(v: Views):
    path = f"{scratch(v.spark)}/index"
    write_sync_index(v.index, path, 1000)
    return read_sync_index(v.spark, path)


# --- reports -------------------------------------------------------------------------------------------------

CATEGORIES = ("src0", "src1", "src2", "src3", "src4", "unused")


@query(
    "storage_report",
    """
    WITH c AS (SELECT unnest(['src0', 'src1', 'src2', 'src3', 'src4', 'unused']) AS category),
    r AS (SELECT c.category, CAST(coalesce(sum(f.length), 0) AS BIGINT) AS bytes, count(f.path) AS files
          FROM c LEFT JOIN v_files f ON f.category = c.category GROUP BY c.category)
    SELECT * FROM r UNION ALL SELECT NULL, CAST(sum(bytes) AS BIGINT), CAST(sum(files) AS BIGINT) FROM r""",
)
def _(v: Views):
    return R.storage_report(v.files, CATEGORIES)


@query(
    "retention",
    """
    SELECT path, length FROM v_files WHERE category IN ('src0', 'src1') AND modified < 1700150000 - 86400
    AND path NOT LIKE '%/7.txt'""",
)
def _(v: Views):
    old = R.retention(v.files, F.lit(1700150000), 86400, ("src0", "src1"), ("7.txt",))
    return old.select("path", "length")


REPAIR_SQL = """
    n AS (SELECT *, lag(label) OVER w AS b, lead(label) OVER w AS a FROM v_labels WINDOW w AS (PARTITION BY s ORDER BY idx)),
    per AS (SELECT s, count(*) FILTER (label = 'verse' AND b = 'verse' AND a = 'chorus') AS label_changes FROM n GROUP BY s)"""


def _repaired(v: Views):
    from metrum.operators.sections import relabel_runs

    after = relabel_runs(v.labels).select("s", "idx", F.col("new_label").alias("label"))
    return R.repair_summary(v.labels, after)


@query(
    "repair_summary",
    f"""
    WITH {REPAIR_SQL}
    SELECT count(*) AS scanned, count(*) FILTER (label_changes > 0) AS changed,
           CAST(sum(label_changes) AS BIGINT) AS label_changes FROM per""",
)
def _(v: Views):
    return _repaired(v)[0]


@query("repaired_sessions", f"WITH {REPAIR_SQL} SELECT s, label_changes FROM per WHERE label_changes > 0")
def _(v: Views):
    return _repaired(v)[1]
