"""Reconciling local, remote and deleted versions of a collection, and planning transfers.

``local (id, digest, modified_at)``, ``remote (id, digest, updated_at, deleted, deleted_at, device)``,
``previous (id, local_digest, remote_revision)``, ``tombstones (id, deleted_at, device)``; indexes are ``(key, sha)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.functions.scalars import asset_keys, is_sha256, is_valid_id, or_default, revision
from metrum.plans.digest import ordered_digest


def all_ids(*tables: DataFrame) -> DataFrame:
    ids = tables[0].select("id")
    for table in tables[1:]:
        ids = ids.unionByName(table.select("id"))
    return ids.distinct()


def valid_session_ids(df: DataFrame, column: str = "id") -> DataFrame:
    return df.filter(is_valid_id(column))


def allowed_files(entries: DataFrame, prefix: str = "sessions") -> DataFrame:
    """Keep map items whose key is one of the session's seven keys and whose value is a SHA-256 in lower-case hex."""
    keys = asset_keys("id", prefix)
    kept = F.map_filter(
        F.coalesce("files", F.create_map().cast("map<string,string>")),
        lambda k, v: F.array_contains(keys, k) & is_sha256(v),
    )
    return entries.withColumn("files", F.when(is_valid_id("id"), kept).otherwise(F.create_map().cast("map<string,string>")))


def allowed_index(index: DataFrame, prefix: str = "sessions") -> DataFrame:
    """The same rule for ``(key, sha)`` rows; adds ``id``."""
    session = F.get(F.split("key", "/"), F.lit(1))
    named = index.withColumn("id", session)
    return named.filter(is_valid_id("id") & is_sha256("sha") & F.array_contains(asset_keys("id", prefix), F.col("key")))


def valid_payload(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split downloaded results ``(key_id, id, title, bpm)`` into usable ones and rejects."""
    good = (F.col("id") == F.col("key_id")) & F.col("title").isNotNull() & F.col("bpm").isNotNull()
    marked = entries.withColumn("_good", F.coalesce(good, F.lit(False)))
    return marked.filter("_good").drop("_good"), marked.filter("not _good").drop("_good")


def verify_files(index: DataFrame, inventory: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Split expected files into those present with the expected hash and size, and rejects with a reason."""
    actual = inventory.select("key", F.col("sha").alias("actual"), "length")
    reason = (
        F.when(F.col("actual").isNull(), "missing")
        .when(F.col("length") > limit, "too large")
        .when(F.col("actual") != F.col("sha"), "hash differs")
    )
    judged = index.join(actual, "key", "left").withColumn("reason", reason)
    return judged.filter("reason is null").select("key", "sha"), judged.filter("reason is not null").select("key", "reason")


def reconcile(
    local: DataFrame, remote: DataFrame, previous: DataFrame, tombstones: DataFrame, now: float, device: str = "me"
) -> DataFrame:
    """One row per id with the action to take, the conflict if any, and the state afterwards.

    Actions: download, publish, delete_local, mark_deleted, invalid, none. ``removes`` tells which remote files go:
    all, or those the local version lacks. Ids are unique in every table, so the joins spread evenly.
    """
    l = local.select(F.col("id"), F.struct("digest", "modified_at").alias("l"))
    r = remote.select("id", F.struct("digest", "updated_at", "deleted", "deleted_at", "device").alias("r"))
    p = previous.select("id", F.struct("local_digest", "remote_revision").alias("p"))
    t = tombstones.select("id", F.struct("deleted_at", "device").alias("t"))
    ids = all_ids(local, remote, tombstones)
    joined = ids.join(l, "id", "left").join(r, "id", "left").join(p, "id", "left").join(t, "id", "left")

    L, R, P, T = (F.col(c).isNotNull() for c in "lrpt")
    at = F.lit(float(now))
    mod = F.col("l.modified_at")

    def sure(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))

    valid = is_valid_id(F.col("id").cast("string"))
    forgotten = sure(L & T & (mod > F.coalesce("t.deleted_at", F.lit(0.0))))
    buried = T & ~forgotten
    gone = sure(R & F.coalesce("r.deleted", F.lit(False)))
    live = R & ~gone
    buried_at = or_default("t.deleted_at", at)
    remote_at = or_default("r.updated_at", or_default("r.deleted_at", F.lit(0.0)))
    revived = buried & sure(live & (remote_at > buried_at))
    rev = revision("r.updated_at", "r.deleted_at", "r.device", "r.digest", "r.deleted")
    remote_changed = R & ~sure(rev == F.col("p.remote_revision"))
    local_changed = L & ~sure(F.col("l.digest") == F.col("p.local_digest"))
    outlived = ~buried & gone & local_changed & sure(mod > F.coalesce("r.deleted_at", F.lit(0.0)))
    follow = ~buried & gone & ~outlived & (remote_changed | ~P)
    same = sure(F.col("l.digest") == F.col("r.digest"))
    both = live & ~same & local_changed & remote_changed
    local_wins = sure(mod >= F.coalesce("r.updated_at", F.lit(0.0)))

    action = (
        F.when(~valid, "invalid")
        .when(revived, "download")
        .when(buried, "mark_deleted")
        .when(follow & L, "delete_local")
        .when(follow, "none")
        .when(~L & live, "download")
        .when(~L, "none")
        .when(~live, "publish")
        .when(same, "none")
        .when(both & local_wins, "publish")
        .when(both, "download")
        .when(remote_changed, "download")
        .when(local_changed, "publish")
        .otherwise("none")
    )
    settled = ~valid | buried | follow
    conflict = (
        F.when(~valid, "ignored-invalid-id")
        .when(settled, None)
        .when(outlived, "local")
        .when(L & both & local_wins, "local")
        .when(L & both, "remote")
    )
    out = joined.withColumn("action", action).withColumn("conflict", conflict)
    act = F.col("action")
    deletes_local = sure((act == "delete_local") | ((act == "mark_deleted") & L))
    out = out.withColumn("deletes_local", deletes_local).withColumn(
        "removes",
        F.when((act == "mark_deleted") & R, "all").when((act == "publish") & live, "missing"),
    )
    published_at = F.greatest(at, mod)
    # The state after the action.
    new_local = F.when(deletes_local, None).when(
        act == "download", F.struct(F.col("r.digest").alias("digest"), at.alias("modified_at"))
    ).otherwise(F.col("l"))

    def entry(digest, updated, deleted, deleted_at, by):
        return F.struct(
            digest.alias("digest"), updated.alias("updated_at"), deleted.alias("deleted"),
            deleted_at.alias("deleted_at"), by.alias("device"),
        )

    nothing = F.lit(None).cast("double")
    new_remote = (
        F.when(
            act == "mark_deleted",
            entry(F.lit(None).cast("string"), buried_at, F.lit(True), buried_at, F.coalesce("t.device", F.lit(device))),
        )
        .when(act == "publish", entry(F.col("l.digest"), published_at, F.lit(False), nothing, F.lit(device)))
        .otherwise(F.col("r"))
    )
    # A forgotten tombstone does not stop the later rules, so a new one may be written for the same id.
    new_tomb = F.when(
        valid & follow,
        F.struct(or_default("r.deleted_at", at).alias("deleted_at"), F.coalesce("r.device", F.lit("remote")).alias("device")),
    ).otherwise(F.when(~(valid & (forgotten | revived)), F.col("t")))
    return out.select(
        "id", "action", "conflict", "deletes_local", "removes",
        new_local.alias("local"), new_remote.alias("remote"), new_tomb.alias("tombstone"),
    )


def apply_reconciled(result: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(local, remote, previous, tombstones) after the actions of :func:`reconcile`."""
    local = result.filter("local is not null").select("id", "local.*")
    remote = result.filter("remote is not null").select("id", "remote.*")
    tombstones = result.filter("tombstone is not null").select("id", "tombstone.*")
    rev = revision("remote.updated_at", "remote.deleted_at", "remote.device", "remote.digest", "remote.deleted")
    live = F.col("remote").isNotNull() & ~F.coalesce("remote.deleted", F.lit(False)) & F.col("local").isNotNull()
    previous = result.filter(live).select("id", F.col("local.digest").alias("local_digest"), rev.alias("remote_revision"))
    return local, remote, previous, tombstones


def reconcile_folders(local: DataFrame, remote: DataFrame, previous: DataFrame) -> DataFrame:
    """One action per workspace for its folder document.

    ``local (workspace, digest, modified_at, empty)``, ``remote (workspace, digest, updated_at, deleted_at, device)``,
    ``previous (workspace, local_digest, remote_revision)``.
    """
    l = local.select("workspace", F.struct("digest", "modified_at", "empty").alias("l"))
    r = remote.select("workspace", F.struct("digest", "updated_at", "device").alias("r"))
    p = previous.select("workspace", F.struct("local_digest", "remote_revision").alias("p"))
    joined = l.join(r, "workspace", "left").join(p, "workspace", "left")
    rev = revision("r.updated_at", F.lit(None).cast("double"), "r.device", "r.digest", F.lit(False))
    first_time = F.col("p").isNull() & F.coalesce("l.empty", F.lit(False))
    local_changed = ~F.coalesce(F.col("l.digest") == F.col("p.local_digest"), F.lit(False)) & ~first_time
    remote_changed = ~F.coalesce(rev == F.col("p.remote_revision"), F.lit(False))
    newer = F.col("l.modified_at") >= F.coalesce("r.updated_at", F.lit(0.0))
    keep = local_changed & (~remote_changed | newer)
    same = F.col("l.digest") == F.col("r.digest")
    action = (
        F.when(F.col("r").isNull(), "publish").when(same, "none").when(keep, "publish")
        .when(remote_changed, "download").otherwise("none")
    )
    conflict = F.when(F.col("r").isNotNull() & ~same & local_changed & remote_changed, F.when(keep, "local").otherwise("remote"))
    return joined.select("workspace", action.alias("action"), conflict.alias("conflict"))


# --- transfers -----------------------------------------------------------------------------------------------


def upload_plan(local: DataFrame, index: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """``(key, sha, action)``: upload where the index has another hash or the session is forced, else unchanged."""
    joined = local.join(index.select("key", F.col("sha").alias("_known")), "key", "left")
    equal = F.col("sha").eqNullSafe(F.col("_known"))
    if forced is not None:
        joined = joined.join(forced.select("id").distinct().withColumn("_forced", F.lit(True)), "id", "left")
        equal = equal & ~F.coalesce("_forced", F.lit(False))
    return joined.select("key", "sha", F.when(equal, "unchanged").otherwise("upload").alias("action"))


def stale_keys(index: DataFrame, final: DataFrame) -> DataFrame:
    """Keys of the index that are not wanted any more."""
    return index.select("key").join(final.select("key"), "key", "left_anti")


def minus_files(remote: DataFrame, local: DataFrame) -> DataFrame:
    return remote.select("key").join(local.select("key"), "key", "left_anti").distinct()


def final_index(protected: DataFrame, local: DataFrame) -> DataFrame:
    """Union of two indexes; the local hash wins."""
    p = protected.select("key", F.col("sha").alias("_p"))
    l = local.select("key", F.col("sha").alias("_l"))
    return p.join(l, "key", "full_outer").select("key", F.coalesce("_l", "_p").alias("sha"))


def desired_files(
    library: DataFrame, inventory: DataFrame, shared: tuple[str, ...] = (), prefix: str = "sessions"
) -> DataFrame:
    """Existing files of every library entry, and existing shared files."""
    keys = library.select(F.explode(asset_keys("id", prefix)).alias("key"))
    if shared:
        spark = library.sparkSession
        keys = keys.unionByName(spark.createDataFrame([(k,) for k in shared], "key string"))
    return inventory.join(keys, "key", "left_semi")


def group_legacy_index(index: DataFrame, prefix: str = "sessions") -> DataFrame:
    """Keys ``prefix/session/...`` of an old index as entry rows ``(id, key, sha, device, updated_at)``.

    Entries stay in long form: a file map per session would gather all keys of a session in one row.
    """
    rest = F.col("key").substr(F.lit(len(prefix) + 2), F.length("key"))
    parts = F.split(rest, "/")
    own = F.col("key").startswith(f"{prefix}/") & (F.size(parts) >= 2)
    shared = parts[0].isin("manifest.json", "folders.json", "sync-index.json")
    return index.filter(own & ~shared).select(
        parts[0].alias("id"), "key", "sha", F.lit("legacy").alias("device"), F.lit(0.0).alias("updated_at")
    )


def legacy_entries(index: DataFrame, today: str, prefix: str = "sessions") -> DataFrame:
    """An old index as remote entries ``(id, digest, updated_at, deleted, deleted_at, device, entry_date)``, ready for :func:`reconcile`.

    The digest is that of the session's files as a compact JSON map in the order of its keys. Keys of a session are put
    in order and hashed as a stream, however many there are.
    """
    files = group_legacy_index(index, prefix)
    # A map of one entry, without its braces.
    entry = F.to_json(F.create_map("key", "sha"))
    digests = ordered_digest(files, ["id"], [F.col("key")], entry.substr(F.lit(2), F.length(entry) - 2), "{", ",", "}")
    return digests.select(
        "id", "digest", F.lit(0.0).alias("updated_at"), F.lit(False).alias("deleted"), F.lit(None).cast("double").alias("deleted_at"), F.lit("legacy").alias("device"), F.lit(today).alias("entry_date")
    )


def bundle_digest(files: DataFrame, prefix: str = "sessions") -> DataFrame:
    """Per session the SHA-256 of its key-sorted compact JSON map and its newest change.

    Only the seven keys of a session count, so a group holds at most seven rows.
    """
    own = files.filter(F.array_contains(asset_keys("id", prefix), F.col("key")))
    pairs = F.array_sort(F.collect_set(F.struct("key", "sha")))
    text = F.to_json(F.map_from_entries(pairs))
    return own.groupBy("id").agg(F.sha2(text, 256).alias("digest"), F.max("modified").alias("modified_at"))


def reconcile_summary(actions: DataFrame, uploads: DataFrame, devices: DataFrame) -> DataFrame:
    """One row of totals."""
    a = actions.agg(
        F.count_if(F.col("action") == "download").alias("downloaded"),
        F.count_if(F.col("deletes_local") | (F.coalesce("removes", F.lit("")) == "all")).alias("deleted"),
        F.count("conflict").alias("conflicts"),
    )
    u = uploads.agg(
        F.count_if(F.col("action") == "upload").alias("uploaded"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
    )
    d = devices.agg(F.count_distinct("device").alias("devices"))
    # Three one-row tables.
    return a.join(u, F.lit(True)).join(d, F.lit(True))


def apply_devices(devices: DataFrame, seen: DataFrame) -> DataFrame:
    """Upsert ``(device, name, last_seen)``."""
    return devices.join(seen.select("device"), "device", "left_anti").unionByName(seen)


def record_deletions(
    tombstones: DataFrame, previous: DataFrame, ids: DataFrame, at: float, device: str, same_workspace: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(tombstones, previous) after deleting ``ids``; a changed workspace forgets both first."""
    doomed = ids.select("id").distinct()
    fresh = doomed.select("id", F.lit(float(at)).alias("deleted_at"), F.lit(device).alias("device"))
    if not same_workspace:
        return fresh, previous.limit(0)
    return (
        tombstones.join(doomed, "id", "left_anti").unionByName(fresh),
        previous.join(doomed, "id", "left_anti"),
    )
