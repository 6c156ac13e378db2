"""The library of sessions: entries, search, order, folders, playback groups, upserts.

Library rows are ``(id, position, title, tags, bpm, date, last_played, play_count, ...)``; folder listings are
``(folder, pos, id)`` in long form, ``folder`` being ordered by its own value or by ``folder_pos`` where given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.functions import fixed
from metrum.functions.scalars import asset_keys, source_id, stable_id
from metrum.plans.ordered import neighbours, positions, row_tile
from metrum.plans.rank import ranked

ROOT = "root"


def library_entry(sessions: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """Library columns of sessions; ``dates`` gives the entry date by id."""
    optional = [c for c in ("assets", "tags", "last_played", "play_count") if c in sessions.columns]
    entries = sessions.drop("date").join(dates.select("id", "date"), "id", "left") if dates is not None else sessions
    return entries.select("id", "title", "bpm", "date", *optional)


def search_library(library: DataFrame, query: str = "", unpracticed: bool = False) -> DataFrame:
    """Entries whose title or tags contain the text, ignoring case; optionally only those never played."""
    kept = library
    if unpracticed:
        kept = kept.filter(F.coalesce(F.col("last_played"), F.lit("")) == "")
    needle = query.strip().lower()
    if needle:
        text = F.concat_ws(" ", "title", F.coalesce("tags", F.array().cast("array<string>")))
        kept = kept.filter(F.lower(text).contains(needle))
    return kept


def library_order(mode: str) -> list[Column]:
    """Sort expressions: the user's order, last play, date of entry, or title in Japanese collation."""
    place = F.col("position").asc()
    orders = {
        "recent": [F.coalesce("last_played", F.lit("")).desc(), place],
        "added": [F.coalesce("date", F.lit("")).desc(), place],
        "title": [F.collate(F.coalesce("title", F.lit("")), "ja_CI").asc(), place],
        "manual": [place],
    }
    if mode not in orders:
        raise ValueError(f"unknown order: {mode}")
    return orders[mode]


def sort_library(library: DataFrame, mode: str = "manual") -> DataFrame:
    """The library in one of the orders of :func:`library_order`, as long as nothing follows."""
    return library.orderBy(*library_order(mode))


def rank_library(library: DataFrame, mode: str = "manual") -> DataFrame:
    """Add ``rank``, the place in one of the orders of :func:`library_order`, from 0: an order that later steps keep."""
    return ranked(library, library_order(mode))


def recent_per_key(history: DataFrame, key: str, at: str, limit: int = 30) -> DataFrame:
    """The newest row of each key, then the newest ``limit`` of them."""
    payload = F.struct(*history.columns)
    newest = history.groupBy(key).agg(F.max_by(payload, F.struct(at, *[c for c in history.columns if c not in (key, at)])).alias("_r"))
    return newest.select("_r.*").orderBy(F.col(at).desc(), key).limit(limit)


def entry_date(library: DataFrame, today: str) -> DataFrame:
    return library.withColumn("date", F.coalesce(F.nullif(F.col("date"), F.lit("")), F.lit(today)))


def attach_assets(sessions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Default asset paths by session, with stems only where all four exist; given assets win.

    ``inventory`` has ``path``; ``sessions`` may have ``assets MAP<STRING,STRING>`` with stems as ``stems/<name>``.
    """
    parts = F.split("path", "/")
    stems = (
        inventory.select(parts[0].alias("kind"), parts[1].alias("id"), parts[2].alias("file"))
        .filter((F.col("kind") == "stems") & F.col("file").isin(*[f"{s}.mp3" for s in fixed.STEMS]))
        .distinct()
        .groupBy("id")
        .agg(F.count(F.lit(1)).alias("_stems"))
    )
    named = {"result": ("results/", ".json"), "audio": ("audio/", ".mp3"), "video": ("video/", ".mp4")}
    base = [x for name, (pre, post) in named.items() for x in (F.lit(name), F.concat(F.lit(pre), "id", F.lit(post)))]
    stem_map = [
        x for s in fixed.STEMS for x in (F.lit(f"stems/{s}"), F.concat(F.lit("stems/"), "id", F.lit(f"/{s}.mp3")))
    ]
    default = F.when(F.col("_stems") == len(fixed.STEMS), F.create_map(*base, *stem_map)).otherwise(F.create_map(*base))
    given = F.col("assets") if "assets" in sessions.columns else F.lit(None).cast("map<string,string>")
    merged = map_merge(default, F.coalesce(given, F.create_map().cast("map<string,string>")))
    return sessions.join(stems, "id", "left").withColumn("assets", merged).drop("_stems")


def changed_assets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` whose assets differ, the only ones that need rewriting."""

    def flat(name: str) -> Column:
        return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(name))))

    old = before.select("id", flat("assets").alias("_old"))
    return after.join(old, "id").filter(~flat("assets").eqNullSafe(F.col("_old"))).drop("_old")


def map_merge(a: Column, b: Column) -> Column:
    """Union of two maps; ``b`` wins."""
    keys = F.map_keys(b)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(keys, k)), b)


# --- folders -------------------------------------------------------------------------------------------------


def clean_folders(folders: DataFrame, library: DataFrame, folder_pos: str = "folder") -> DataFrame:
    """Drop unknown ids; an id stays only in the first folder that lists it."""
    known = folders.join(library.select("id"), "id", "left_semi")
    columns = [c for c in folders.columns if c not in ("id", folder_pos, "pos")]
    first = known.groupBy("id").agg(F.min(F.struct(folder_pos, "pos", *columns)).alias("_f"))
    return first.select("_f.*", "id").select(*folders.columns)


def root_order(library: DataFrame, saved: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """Unfiled entries: first those with a saved place ``(id, saved_pos)``, then the rest in library order.

    Adds ``rank_group`` and ``rank_pos`` to order by.
    """
    loose = library if folders is None else library.join(folders.select("id").distinct(), "id", "left_anti")
    placed = loose.join(saved.groupBy("id").agg(F.min("saved_pos").alias("saved_pos")), "id", "left")
    return placed.withColumn("rank_group", F.when(F.col("saved_pos").isNull(), 1).otherwise(0)).withColumn(
        "rank_pos", F.coalesce("saved_pos", "position")
    ).drop("saved_pos")


def playback_groups(folders: DataFrame, library: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """``(group_id, group_pos, rank_group, rank_pos, id)``: folders in order, then the unfiled entries.

    ``folders`` may contain unknown and repeated ids; folders without entries have no rows.
    """
    cleaned = clean_folders(folders, library)
    filed = cleaned.select(
        F.col("folder").cast("string").alias("group_id"), F.col("folder").alias("group_pos"),
        F.lit(0).alias("rank_group"), F.col("pos").alias("rank_pos"), "id",
    )
    empty = library.select("id").limit(0).withColumn("saved_pos", F.lit(0).cast("long"))
    rest = root_order(library, empty if saved is None else saved, cleaned).select(
        F.lit(ROOT).alias("group_id"), F.lit(2**31).alias("group_pos"), "rank_group", "rank_pos", "id"
    )
    return filed.unionByName(rest)


def next_in_group(groups: DataFrame) -> DataFrame:
    """Add ``next_id``, the following entry of the same group."""
    placed = positions(groups, ["group_id"], ["rank_group", "rank_pos", "id"], F.col("rank_group") * 2**40 + row_tile("rank_pos"))
    return neighbours(placed, ["group_id"], {"next_id": lambda w: F.lead("id").over(w)}, after=1)


def apply_overrides(folders: DataFrame, settings: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """All folders for every user: flags ``(user, folder, collapsed)`` replace the shared ``collapsed`` for their user.

    ``users`` defaults to those with a stored flag. Every user sees every folder, so the result is their product.
    """
    stored = settings.select("user", "folder", F.col("collapsed").alias("_own"))
    everyone = settings.select("user").distinct() if users is None else users.select("user").distinct()
    joined = everyone.crossJoin(folders).join(stored, ["user", "folder"], "left")
    return joined.withColumn("collapsed", F.coalesce("_own", "collapsed")).drop("_own")


# --- changes -------------------------------------------------------------------------------------------------


def upsert_front(library: DataFrame, entries: DataFrame) -> DataFrame:
    """New and replaced entries go first, in their own order; the others follow in theirs.

    Returns ``rank_group`` and ``rank_pos`` to order by, so no single task renumbers the whole library.
    """
    ahead = entries.withColumn("rank_group", F.lit(0))
    behind = library.join(entries.select("id"), "id", "left_anti").withColumn("rank_group", F.lit(1))
    return ahead.unionByName(behind).withColumn("rank_pos", F.col("position"))


def upsert_in_place(library: DataFrame, entries: DataFrame) -> DataFrame:
    """Replaced entries keep their place; new ones go first."""
    places = library.select("id", F.col("position").alias("_place"))
    updated = entries.join(places, "id", "left").withColumn("rank_group", F.when(F.col("_place").isNull(), 0).otherwise(1))
    updated = updated.withColumn("rank_pos", F.coalesce("_place", "position")).drop("_place")
    others = library.join(entries.select("id"), "id", "left_anti").withColumn("rank_group", F.lit(1))
    return updated.unionByName(others.withColumn("rank_pos", F.col("position")))


def distinct_keep_first(ids: Column) -> Column:
    return F.array_distinct(ids)


def mirror_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """``(name, action)``: copy what the source has, remove what only the target has."""
    s = source.select("name").distinct().withColumn("_s", F.lit(True))
    t = target.select("name").distinct().withColumn("_t", F.lit(True))
    action = F.when(F.col("_s"), "copy").otherwise("remove")
    return s.join(t, "name", "full_outer").select("name", action.alias("action"))


def cascade_delete(
    ids: DataFrame, library: DataFrame, folders: DataFrame, inventory: DataFrame, prefix: str = "sessions"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(library, folders, files to remove) after deleting ``ids``."""
    doomed = ids.select("id").distinct()
    keys = doomed.select(F.explode(asset_keys("id", prefix)).alias("key"))
    return (
        library.join(doomed, "id", "left_anti"),
        folders.join(doomed, "id", "left_anti"),
        inventory.join(keys, "key", "left_semi"),
    )


def practice_stats(plays: DataFrame) -> DataFrame:
    """Plays ``(id, visit, at)``: one per session and page visit counts. Returns ``(id, play_count, last_played)``."""
    once = plays.groupBy("id", "visit").agg(F.max("at").alias("at"))
    return once.groupBy("id").agg(F.count(F.lit(1)).alias("play_count"), F.max("at").alias("last_played"))


def resolve_job_title(jobs: DataFrame, library: DataFrame) -> DataFrame:
    """Add ``title`` to jobs ``(id, display_title, submitted_title)``.

    The job's own title, else that of its session, of the source of a clip, of the first clip by name, or the
    title given at submission. Every lookup is by equality, so the library is never paired with all jobs.
    """
    titled = library.filter(F.coalesce("title", F.lit("")) != "")
    exact = titled.select(F.col("id").alias("_session"), F.col("title").alias("_exact"))
    source = titled.select(F.col("id").alias("_source"), F.col("title").alias("_of_source"))
    clips = (
        titled.filter(F.col("id").contains("-clip-"))
        .groupBy(source_id("id").alias("_source"))
        .agg(F.min_by("title", "id").alias("_of_clip"))
    )
    named = jobs.withColumn("_session", stable_id("id")).withColumn("_source", source_id(F.col("_session")))
    own = F.nullif(F.col("display_title"), F.lit(""))
    title = F.coalesce(own, "_exact", "_of_source", "_of_clip", "submitted_title")
    return (
        named.join(exact, "_session", "left")
        .join(source, "_source", "left")
        .join(clips, "_source", "left")
        .withColumn("title", F.substring(title, 1, 300))
        .drop("_session", "_source", "_exact", "_of_source", "_of_clip")
    )
