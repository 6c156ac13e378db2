"""Sections on the bar axis: placing, closing gaps, relabelling, editing, validating.

Sections are rows ``(s, idx, label, start_bar, end_bar, start_time, end_time)``; bars count from 1, ranges include
both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.functions.scalars import canonical_label, clock, half_even, localize_label
from metrum.operators.tempo import time_to_bar
from metrum.plans.ordered import TILE_ROWS, Scan, neighbours, positions, row_tile, running


def contiguous_bars(sections: DataFrame, total: str = "total_bars", rows: int = TILE_ROWS) -> DataFrame:
    """Ranges without gaps or overlaps covering 1..total. Sessions with more sections than bars stay as they are.

    Every section takes at least one bar, so section i of n ends at i plus its largest reach so far, which may be at
    most total - n + 1.
    """
    raw = F.nullif(F.col("end_bar"), F.lit(0)).cast("long")
    reach = raw - F.col("idx")
    scans = {
        "_n": Scan("count", F.lit(1), whole=True),
        "_max": Scan("max", reach),
        "_before": Scan("max", reach, exclusive=True),
    }
    scanned = running(sections, ["s"], row_tile("idx", rows), ["idx"], scans)
    room = F.col(total) - F.col("_n") + 1

    def upto(best: Column) -> Column:
        return F.when(best.isNull(), F.lit(1)).otherwise(F.greatest(F.lit(1).cast("long"), F.least(room, best)))

    is_last = F.col("idx") == F.col("_n") - 1
    end = F.when(is_last, F.col(total)).otherwise(F.col("idx") + upto(F.col("_max")))
    previous = F.col("idx") + upto(F.col("_before"))
    start = F.when(F.col("idx") == 0, F.lit(1)).otherwise(previous)
    fits = (F.col(total) >= 1) & (room >= 1)
    given = F.col("start_bar") if "start_bar" in sections.columns else F.lit(None)
    kept = [c for c in sections.columns if c not in ("start_bar", "end_bar", "bar_count")]
    return scanned.select(
        *kept,
        F.when(fits, start).otherwise(given).cast("long").alias("start_bar"),
        F.when(fits, end).otherwise(F.col("end_bar")).cast("long").alias("end_bar"),
    ).withColumn("bar_count", F.col("end_bar") - F.col("start_bar") + 1)


def place_sections(sections: DataFrame, downbeats: DataFrame) -> DataFrame:
    """Bars of sections from their times, made contiguous over the session's downbeats."""
    drop = ("start_bar", "end_bar", "bar_count", "total_bars")
    payload = [c for c in sections.columns if c not in ("s", "idx", *drop)]
    edge = F.explode(
        F.array(
            F.struct(F.lit("start").alias("edge"), F.coalesce("start_time", F.lit(0.0)).alias("at")),
            F.struct(F.lit("end").alias("edge"), F.coalesce("end_time", F.lit(0.0)).alias("at")),
        )
    )
    points = sections.select("s", "idx", F.struct(*payload).alias("_payload"), edge.alias("_e")).select(
        "s", "idx", "_payload", "_e.edge", "_e.at"
    )
    bars = time_to_bar(points, downbeats, "at").groupBy("s", "idx").agg(
        F.first("_payload").alias("_payload"),
        F.max(F.when(F.col("edge") == "start", F.col("bar"))).alias("start_bar"),
        F.max(F.when(F.col("edge") == "end", F.col("bar"))).alias("_end"),
    )
    totals = downbeats.groupBy("s").agg(F.count(F.lit(1)).alias("total_bars"))
    placed = (
        bars.join(totals, "s", "left")
        .withColumn("total_bars", F.coalesce("total_bars", F.lit(0).cast("long")))
        .select(
            "s",
            "idx",
            *[F.col(f"_payload.{c}").alias(c) for c in payload],
            "total_bars",
            "start_bar",
            F.greatest("start_bar", F.col("_end") - 1).alias("end_bar"),
        )
    )
    return contiguous_bars(placed)


def bar_to_time(sections: DataFrame, downbeats: DataFrame, durations: DataFrame) -> DataFrame:
    """Set start_time and end_time from the bars; outside the grid the duration or the last downbeat is used."""
    last = downbeats.groupBy("s").agg(F.max_by("t", "idx").alias("_last"))
    limits = durations.select("s", "duration").join(last, "s", "full_outer")
    limit = F.coalesce(F.nullif(F.col("duration"), F.lit(0.0)), F.col("_last"), F.lit(0.0))
    kept = [c for c in sections.columns if c not in ("start_time", "end_time")]
    starts = downbeats.select("s", (F.col("idx") + 1).alias("start_bar"), F.col("t").alias("_start"))
    ends = downbeats.select("s", F.col("idx").alias("end_bar"), F.col("t").alias("_end"))
    joined = (
        sections.select(*kept)
        .join(starts, ["s", "start_bar"], "left")
        .join(ends, ["s", "end_bar"], "left")
        .join(limits.select("s", limit.alias("_limit")), "s", "left")
    )
    outside = F.coalesce("_limit", F.lit(0.0))
    return joined.select(
        *kept, F.coalesce("_start", outside).alias("start_time"), F.coalesce("_end", outside).alias("end_time")
    )


def segments_to_sections(
    segments: DataFrame, beats: DataFrame, downbeats: DataFrame, rows: int = TILE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Model segments ``(s, idx, label, start, end)`` as sections, and the duration per session.

    A segment ends where the next one starts; the last one at its own end, or at the duration if it has none.
    """
    last_beat = beats.groupBy("s").agg(F.max("t").alias("_beat"))
    last_down = downbeats.groupBy("s").agg(F.max("t").alias("_down"))
    last_end = segments.groupBy("s").agg(F.max_by(F.coalesce("end", F.lit(0.0)), "idx").alias("_end"))
    durations = last_end.join(last_beat, "s", "left").join(last_down, "s", "left").select(
        "s", F.greatest(F.coalesce("_beat", F.lit(0.0)), "_end", F.coalesce("_down", F.lit(0.0))).alias("duration")
    )
    chained = neighbours(segments, ["s"], {"_next": lambda w: F.lead("start").over(w)}, after=1, rows=rows)
    end = F.coalesce("_next", F.nullif(F.col("end"), F.lit(0.0)), "duration")
    timed = chained.join(durations, "s").select("s", "idx", "label", F.col("start").alias("start_time"), end.alias("end_time"))
    edges = timed.select(
        "s", "idx", "label", "start_time", "end_time", F.explode(F.array("start_time", "end_time")).alias("_at"),
    )
    bars = time_to_bar(edges, downbeats, "_at").groupBy("s", "idx", "label", "start_time", "end_time").agg(
        F.max(F.when(F.col("_at") == F.col("start_time"), F.col("bar"))).alias("start_bar"),
        F.max(F.when(F.col("_at") == F.col("end_time"), F.col("bar"))).alias("_end"),
    )
    placed = bars.withColumn("end_bar", F.greatest("start_bar", F.col("_end") - 1))
    sections = placed.select(
        "s", "idx", "label", "start_bar", "end_bar", (F.col("end_bar") - F.col("start_bar") + 1).alias("bar_count"),
        half_even("start_time", 2).alias("start_time"), half_even("end_time", 2).alias("end_time"),
        clock("start_time").alias("start_time_str"),
    )
    return sections, durations.withColumn("duration", half_even("duration", 2))


def relabel_runs(sections: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """The last of two or more verses directly before a chorus becomes a pre-chorus.

    Adds ``new_label``, ``changed`` and ``reason``.
    """
    named = sections.withColumn("_label", canonical_label("label"))
    seen = neighbours(
        named,
        ["s"],
        {"_before": lambda w: F.lag("_label").over(w), "_after": lambda w: F.lead("_label").over(w)},
        before=1,
        after=1,
        rows=rows,
    )
    hit = F.coalesce(
        (F.col("_label") == "verse") & (F.col("_before") == "verse") & (F.col("_after") == "chorus"), F.lit(False)
    )
    return (
        seen.withColumn("changed", hit)
        .withColumn("new_label", F.when(F.col("changed"), "pre-chorus").otherwise(F.col("label")))
        .withColumn("reason", F.when(F.col("changed"), "consecutive-verse-before-chorus"))
        .drop("_label", "_before", "_after")
    )


def _picked(sections: DataFrame, picked: DataFrame) -> DataFrame:
    return sections.join(picked.select("s", "idx").distinct(), ["s", "idx"])


def selection_range(sections: DataFrame, picked: DataFrame, localized: bool = False) -> DataFrame:
    """Range from the first to the last picked section ``(s, idx)``, one row per session, with the labels in order.

    The labels are those of one user's selection, so the list stays as short as the selection; :func:`selection_labels`
    gives them as rows.
    """
    label = localize_label("label") if localized else F.col("label")
    return _picked(sections, picked).groupBy("s").agg(
        F.min_by("start_time", "idx").alias("start"),
        F.max_by("end_time", "idx").alias("end"),
        F.transform(F.sort_array(F.collect_list(F.struct("idx", label.alias("label")))), lambda r: r["label"]).alias("labels"),
    )


def selection_labels(sections: DataFrame, picked: DataFrame, localized: bool = False, rows: int = TILE_ROWS) -> DataFrame:
    """``(s, place, label)``: the labels of the picked sections, numbered in their order; as rows, for any number of them."""
    chosen = _picked(sections, picked).select("s", "idx", (localize_label("label") if localized else F.col("label")).alias("label"))
    return positions(chosen, ["s"], ["idx"], row_tile("idx", rows), "place").select("s", "place", "label")


def edit_sections(sections: DataFrame, edits: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Apply one edit per session: ``(s, at_idx, action, value)``.

    split: at the middle bar. merge: with the next section. delete: the previous one takes the bars, or the next one
    if there is none. boundary: the section ends at bar ``value`` and the next one follows. Impossible edits change
    nothing. Positions are dense again afterwards.
    """
    columns = [c for c in sections.columns if c not in ("s", "idx", "start_bar", "end_bar")]
    total = running(sections, ["s"], row_tile("idx", rows), ["idx"], {"_n": Scan("count", F.lit(1), whole=True)})
    near = neighbours(
        total.join(edits, "s", "left"),
        ["s"],
        {
            "_next_end": lambda w: F.lead("end_bar").over(w),
            "_prev_start": lambda w: F.lag("start_bar").over(w),
        },
        before=1,
        after=1,
        rows=rows,
    )
    at, idx, action = F.col("at_idx"), F.col("idx"), F.col("action")
    here, has_next = idx == at, at < F.col("_n") - 1
    split = here & (action == "split") & (F.col("start_bar") < F.col("end_bar"))
    middle = F.floor((F.col("start_bar") + F.col("end_bar")) / 2).cast("long")
    merge, delete, boundary = (action == "merge") & has_next, (action == "delete") & (F.col("_n") > 1), action == "boundary"
    value = F.col("value").cast("long")
    moved_end = F.greatest(F.col("start_bar"), F.least(F.col("_next_end") - 1, value))
    moved_start = F.greatest(F.col("_prev_start"), F.least(F.col("end_bar") - 1, value)) + 1
    gone = (merge & (idx == at + 1)) | (delete & here)
    before_deleted = delete & (at > 0) & (idx == at - 1)
    end = (
        F.when(merge & here, F.col("_next_end"))
        .when(before_deleted, F.col("_next_end"))
        .when(boundary & here & has_next, moved_end)
        .otherwise(F.col("end_bar"))
    )
    start = (
        F.when(delete & (at == 0) & (idx == 1), F.col("_prev_start"))
        .when(boundary & (idx == at + 1), moved_start)
        .otherwise(F.col("start_bar"))
    )
    whole = F.array(F.struct(F.lit(0).alias("part"), start.alias("start_bar"), end.alias("end_bar")))
    halves = F.array(
        F.struct(F.lit(0).alias("part"), F.col("start_bar").alias("start_bar"), middle.alias("end_bar")),
        F.struct(F.lit(1).alias("part"), (middle + 1).alias("start_bar"), F.col("end_bar").alias("end_bar")),
    )
    edited = near.filter(~F.coalesce(gone, F.lit(False))).select(
        "s", F.col("idx").alias("_idx"), *columns, F.inline(F.when(F.coalesce(split, F.lit(False)), halves).otherwise(whole))
    )
    placed = positions(edited, ["s"], ["_idx", "part"], row_tile("_idx", rows))
    return placed.select("s", "idx", *columns, F.col("start_bar").cast("long"), F.col("end_bar").cast("long"))


def validate_sections(edits: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split edited sections ``(s, label, start_bar, end_bar)`` into those of valid sessions and rejects.

    Valid: ordered by start, the first starts at 1, no gap or overlap, the last ends at ``total_bars``, labels not
    blank. Rejects are ``(s, reason)``. Accepted rows get a dense ``idx`` and labels of at most 80 characters.
    """
    known = edits.join(sessions.select("s", "total_bars"), "s", "left")
    # A valid session has at most one section per start bar, so ties only occur in sessions that are rejected.
    placed = positions(known, ["s"], ["start_bar", "end_bar", "label"], row_tile("start_bar"))
    chained = neighbours(placed, ["s"], {"_before": lambda w: F.lag("end_bar").over(w)}, before=1)
    label = F.trim(F.coalesce("label", F.lit("")))
    starts_right = F.col("start_bar") == F.coalesce("_before", F.lit(0)) + 1
    row_ok = starts_right & (F.col("end_bar") >= F.col("start_bar")) & (F.col("end_bar") <= F.col("total_bars"))
    verdict = chained.groupBy("s").agg(
        F.max("total_bars").alias("_total"),
        F.bool_and(label != "").alias("_labels"),
        F.bool_and(F.coalesce(row_ok, F.lit(False))).alias("_rows"),
        F.max("end_bar").alias("_end"),
    )
    reason = (
        F.when(F.coalesce("_total", F.lit(0)) < 1, "no bars")
        .when(~F.col("_labels"), "blank label")
        .when(~F.col("_rows"), "gap or overlap")
        .when(F.col("_end") != F.col("_total"), "not to the last bar")
    )
    judged = verdict.select("s", reason.alias("reason"))
    good = judged.filter("reason is null").select("s")
    accepted = chained.join(good, "s", "left_semi").select(
        "s", "idx", F.substring(label, 1, 80).alias("label"), "start_bar", "end_bar",
        (F.col("end_bar") - F.col("start_bar") + 1).alias("bar_count"),
    )
    return accepted, judged.filter("reason is not null")


def save_sections(
    edits: DataFrame, sessions: DataFrame, downbeats: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Validate edits, then give accepted sections their times and time text."""
    accepted, rejected = validate_sections(edits, sessions)
    timed = bar_to_time(accepted, downbeats, sessions)
    end = F.greatest("start_time", "end_time")
    text = clock("start_time")
    return (
        timed.withColumn("start_time_str", text)
        .withColumn("end_time", half_even(end, 2))
        .withColumn("start_time", half_even("start_time", 2)),
        rejected,
    )


def restore_sections(sessions: DataFrame) -> DataFrame:
    """Put ``automatic_sections`` back where present and clear the edit marks; ``restored`` tells which rows had one."""
    has = F.coalesce(F.size("automatic_sections") > 0, F.lit(False))
    return (
        sessions.withColumn("restored", has)
        .withColumn("sections", F.when(has, F.col("automatic_sections")).otherwise(F.col("sections")))
        .withColumn("sections_edited_at", F.when(~has, F.col("sections_edited_at")))
        .withColumn("automatic_sections", F.when(~has, F.col("automatic_sections")))
    )


def store_edit(sessions: DataFrame, new_sections: str, edited_at: Column) -> DataFrame:
    """Replace ``sections``; the first edit keeps the automatic version aside."""
    return (
        sessions.withColumn("automatic_sections", F.coalesce("automatic_sections", "sections"))
        .withColumn("sections", F.col(new_sections))
        .withColumn("sections_edited_at", edited_at)
    )
