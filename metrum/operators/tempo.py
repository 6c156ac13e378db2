"""Beats, downbeats and tempo repair.

Beats and downbeats are rows ``(s, idx, t)`` with dense ``idx`` from 0 and ascending ``t`` in seconds; sessions are
rows ``(s, bpm)``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.functions.scalars import half_even, half_even_int
from metrum.plans.durable import durable
from metrum.plans.ordered import (
    TILE_ROWS,
    TILE_SECONDS,
    Scan,
    asof,
    exact_median,
    halo,
    nearest,
    neighbours,
    once,
    positions,
    row_tile,
    running,
)
from metrum.plans.rank import in_order, range_of


def intervals(beats: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Add ``iv``, the time to the next beat; null on the last beat."""
    return neighbours(beats, ["s"], {"iv": lambda w: F.lead("t").over(w) - F.col("t")}, after=1, rows=rows)


# --- lookups in time -----------------------------------------------------------------------------------------


def time_to_bar(
    points: DataFrame, downbeats: DataFrame, at: str = "t", tolerance: float = 0.1, seconds: float = TILE_SECONDS
) -> DataFrame:
    """Add ``bar``: one plus the index of the first downbeat at or after ``at - tolerance``, else the last bar.

    Sessions without downbeats get bar 0.
    """
    found = asof(
        points,
        downbeats,
        ["s"],
        at=F.col(at) - tolerance,
        t=F.col("t"),
        take={"_idx": F.col("idx")},
        tie=F.col("idx"),
        seconds=seconds,
        count_as="_bars",
    )
    bar = F.coalesce(F.col("_idx") + 1, F.col("_bars"), F.lit(0)).cast("long")
    return found.withColumn("bar", bar).drop("_idx", "_bars")


def next_beat(
    points: DataFrame, beats: DataFrame, at: str = "t", tolerance: float = 0.02, seconds: float = TILE_SECONDS
) -> DataFrame:
    """Add ``next_idx``: index of the first beat at or after ``at - tolerance``, else the number of beats."""
    hit = asof(
        points, beats, ["s"], F.col(at) - tolerance, F.col("t"), {"_idx": F.col("idx")}, F.col("idx"), seconds,
        count_as="_n",
    )
    return hit.withColumn("next_idx", F.coalesce("_idx", "_n", F.lit(0)).cast("long")).drop("_idx", "_n")


def beats_due(points: DataFrame, beats: DataFrame, lookahead: float, seconds: float = TILE_SECONDS) -> DataFrame:
    """Beats with ``point``, the first clock reading that is within ``lookahead`` of them. Later beats are left out."""
    due = asof(
        beats,
        points,
        ["s"],
        at=F.col("t"),
        t=F.col("t") + F.lit(lookahead),
        take={"point": F.col("idx")},
        tie=F.col("idx"),
        seconds=seconds,
    )
    return due.filter(F.col("point").isNotNull())


def section_at(points: DataFrame, sections: DataFrame, at: str = "t", seconds: float = TILE_SECONDS, rows: int = TILE_ROWS) -> DataFrame:
    """Add ``section``: the smallest index of a section with start <= t < end, else null.

    Where sections begin in the order of their index, the first whose end, or that of one before it, lies behind the
    point is the one, if it has begun: a search in the running maximum of ends. Sessions with sections in another order
    are cut into pieces first, see :func:`first_open`.
    """
    spans = sections.select("s", F.col("idx").alias("section"), F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time")).where("start_time < end_time")
    reached = durable(running(
        spans, ["s"], row_tile("section", rows), ["section"],
        {"_end": Scan("max", F.col("end_time")), "_before": Scan("max", F.col("start_time"), exclusive=True)},
    ))
    timed = points.where(F.col(at).isNotNull())
    found = asof(
        timed, reached, ["s"], F.col(at), F.col("_end"), {"_section": F.col("section"), "_start": F.col("start_time")}, F.col("section"), seconds, strict=True
    )
    result = found.withColumn("section", F.when(F.col("_start") <= F.col(at), F.col("_section"))).drop("_section", "_start")
    untimed = points.where(F.col(at).isNull()).withColumn("section", F.lit(None).cast(result.schema["section"].dataType))
    mixed = reached.where("_before > start_time").select("s").distinct()
    if mixed.isEmpty():
        return result.unionByName(untimed)
    pieces = first_open(reached.select(*spans.columns).join(mixed, "s", "left_semi"), rows)
    cut = asof(timed.join(mixed, "s", "left_semi"), pieces, ["s"], F.col(at), F.col("t"), {"section": F.col("section")}, F.lit(0), seconds, ahead=False)
    return result.join(mixed, "s", "left_anti").unionByName(cut.select(*result.columns)).unionByName(untimed)


def first_open(spans: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """``(s, t, section)``: the smallest section open from each edge on until the next, null where none is.

    The edges of a session are numbered. A span of edges is the union of at most two blocks of each power of two, as in
    a segment tree; each block keeps its smallest section, and an edge asks the blocks it lies in, one for each power.
    """
    edges = spans.select("s", F.explode(F.array("start_time", "end_time")).alias("t")).distinct()
    placed = in_order(edges, [F.col("s").asc(), F.col("t").asc()])
    numbered = durable(positions(placed, ["s"], ["_place"], range_of(), "r").select("s", "t", "r"))
    low = numbered.select("s", F.col("t").alias("start_time"), F.col("r").alias("_a"))
    high = numbered.select("s", F.col("t").alias("end_time"), F.col("r").alias("_b"))
    spread = spans.join(low, ["s", "start_time"]).join(high, ["s", "end_time"])
    levels = F.sequence(F.lit(0), F.length(F.bin(F.col("_b") - F.col("_a"))) - 1)
    at = spread.select("s", "section", "_a", "_b", F.explode(levels).alias("l"))
    a, b = F.expr("shiftright(_a + shiftleft(1L, l) - 1, l)"), F.expr("shiftright(_b, l)")
    ends = at.select("s", "section", "l", a.alias("a"), b.alias("b")).where("a < b")
    blocks = ends.select("s", "section", "l", F.explode(F.array_compact(F.array(F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)))).alias("k"))
    least = blocks.groupBy("s", "l", "k").agg(F.min("section").alias("section"))
    size = numbered.groupBy("s").agg(F.max("r").alias("_n"))
    asked = numbered.join(size, "s").select("s", "t", "r", F.explode(F.sequence(F.lit(0), F.length(F.bin("_n")) - 1)).alias("l"))
    hit = asked.withColumn("k", F.expr("shiftright(r, l)")).join(least, ["s", "l", "k"], "left")
    return hit.groupBy("s", "t").agg(F.min("section").alias("section"))


def nearest_beat(points: DataFrame, beats: DataFrame, at: str = "t", seconds: float = TILE_SECONDS) -> DataFrame:
    """Add ``nearest_idx`` and ``distance`` of the closest beat; the first of equally close ones."""
    return nearest(
        points, beats, ["s"], F.col(at), F.col("t"), {"nearest_idx": F.col("idx")}, F.col("idx"), seconds
    )


def nearest_within(
    points: DataFrame, anchors: DataFrame, at: str, limit: float = 28, seconds: float = TILE_SECONDS
) -> DataFrame:
    """Points that have an anchor within ``limit``, with the closest one."""
    return nearest_beat(points, anchors, at, seconds).filter(F.col("distance") <= limit)


# --- grid repair ---------------------------------------------------------------------------------------------


def median_of_eight(gaps: DataFrame, out: str, rows: int = TILE_ROWS) -> DataFrame:
    """Add the median of each interval ``iv`` and the seven after it; null where fewer follow."""
    spread, window, owned = halo(gaps, ["s"], after=7, rows=rows)
    eight = F.array_sort(F.array(*[F.lead("iv", k).over(window) for k in range(8)]))
    middle = F.when(eight[7].isNotNull(), eight[3] * 0.5 + eight[4] * 0.5)
    return spread.withColumn(out, middle).filter(owned)


def double_time_flag(beats: DataFrame, sessions: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Per session ``double_time``: at least four eight-interval windows lie near half the expected interval."""
    medians = median_of_eight(intervals(beats, rows), "_median", rows)
    expected = F.lit(60.0) / F.col("bpm")
    short = F.col("_median").isNotNull() & (F.col("_median") >= expected * 0.35) & (F.col("_median") <= expected * 0.65)
    counted = (
        medians.join(sessions.select("s", "bpm"), "s")
        .groupBy("s")
        .agg(F.count(F.lit(1)).alias("_beats"), F.count_if((F.col("bpm") > 0) & short).alias("_short"))
    )
    flag = (F.col("_beats") >= 24) & (F.col("_short") >= 4)
    return sessions.select("s").join(counted, "s", "left").select("s", F.coalesce(flag, F.lit(False)).alias("double_time"))


def expand_beats(beats: DataFrame, target: Column, rows: int = TILE_ROWS) -> DataFrame:
    """Fill each gap with equal steps of about ``target`` seconds. Other columns are dropped."""
    gaps = neighbours(
        beats.select("s", "idx", "t", target.alias("_target")),
        ["s"],
        {"_prev": lambda w: half_even(F.lag("t").over(w), 3)},
        before=1,
        rows=rows,
    )
    steps = F.greatest(F.lit(1).cast("long"), half_even_int((F.col("t") - F.col("_prev")) / F.col("_target")))
    counted = gaps.withColumn("_n", F.when(F.col("_prev").isNull(), F.lit(1).cast("long")).otherwise(steps))
    placed = running(counted, ["s"], row_tile("idx", rows), ["idx"], {"_from": Scan("sum", F.col("_n"), exclusive=True)})
    filled = placed.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    moved = F.col("_prev") + (F.col("t") - F.col("_prev")) * F.col("_k") / F.col("_n")
    return filled.select(
        "s",
        (F.coalesce("_from", F.lit(0)) + F.col("_k") - 1).cast("long").alias("idx"),
        half_even(F.coalesce(moved, F.col("t")), 3).alias("t"),
    )


def _first_downbeat(downbeats: DataFrame) -> DataFrame:
    return downbeats.groupBy("s").agg(F.min_by("t", "idx").alias("_reference"))


def anchor_index(beats: DataFrame, downbeats: DataFrame) -> DataFrame:
    """Per session ``anchor``: the beat nearest the first downbeat, 0 without downbeats."""
    with_reference = beats.join(_first_downbeat(downbeats), "s", "left")
    distance = F.abs(F.col("t") - F.col("_reference"))
    return with_reference.groupBy("s").agg(
        F.coalesce(F.min_by("idx", F.when(distance.isNotNull(), F.struct(distance.alias("d"), F.col("idx")))), F.lit(0))
        .cast("long")
        .alias("anchor")
    )


def every_fourth(beats: DataFrame, downbeats: DataFrame, from_anchor: bool = True) -> DataFrame:
    """Downbeats as every fourth beat in phase with the anchor; ``from_anchor`` leaves out those before it."""
    anchored = beats.join(anchor_index(beats, downbeats), "s")
    phase = F.col("anchor") if from_anchor else F.pmod(F.col("anchor"), F.lit(4))
    kept = anchored.filter((F.col("idx") >= phase) & (F.pmod(F.col("idx") - phase, F.lit(4)) == 0))
    return kept.select("s", F.floor((F.col("idx") - phase) / 4).cast("long").alias("idx"), half_even("t", 3).alias("t"))


LEAD_CANDIDATES = 24
LEAD_TAIL = 64
STEADY_ROWS = 12


def _median_of(values: Column) -> Column:
    ordered = F.sort_array(values)
    n = F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    return (low + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _within(value: Column, centre: Column, low: float, high: float) -> Column:
    return (value >= centre * low) & (value <= centre * high)


def stable_transition(beats: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sessions whose grid becomes steady after a sparse lead-in: ``(s, at_idx, at_t, step)``.

    Only the first ninety beats can matter, so a session contributes a short array whatever its length.
    """
    reach = LEAD_CANDIDATES + LEAD_TAIL + 1
    head = (
        beats.filter(F.col("idx") <= reach)
        .groupBy("s")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "t"))), lambda r: r["t"]).alias("_t"))
        .filter(F.size("_t") > STEADY_ROWS + 4)
        .join(sessions.filter(F.col("bpm") > 0).select("s", "bpm"), "s")
    )
    gaps = F.zip_with(F.slice("_t", 2, reach + 1), "_t", lambda b, a: b - a)
    iv = once(head, "_iv", F.filter(gaps, lambda v: v.isNotNull()))
    expected = F.lit(60.0) / F.col("bpm")
    # Necessary for any candidate, and cheap: four long intervals in the lead-in. Long means 1.25 x m with m >= 0.88 x
    # the expected interval, hence at least 1.1 x (less a margin for rounding).
    long_enough = F.filter(F.slice("_iv", 1, LEAD_CANDIDATES), lambda v: v >= expected * 1.0999)
    iv = iv.filter(F.size(long_enough) >= 4)
    candidates = F.sequence(F.lit(4), F.least(F.size("_iv") - STEADY_ROWS, F.lit(LEAD_CANDIDATES)))

    def describe(i: Column) -> Column:
        window = F.slice("_iv", i + 1, STEADY_ROWS)
        return F.struct(i.alias("i"), window.alias("w"), _median_of(window).alias("m"))

    def steady(c: Column) -> Column:
        m = c["m"]
        first_four = F.forall(F.slice(c["w"], 1, 4), lambda v: _within(v, m, 0.9, 1.1))
        enough = F.size(F.filter(c["w"], lambda v: _within(v, m, 0.9, 1.1))) >= STEADY_ROWS - 1
        long_ones = F.size(F.filter(F.slice("_iv", F.lit(1), c["i"]), lambda v: v >= m * 1.25))
        sparse = long_ones >= F.greatest(F.lit(4.0), F.rint(c["i"] * 0.6))
        return first_four & enough & _within(m, expected, 0.88, 1.12) & sparse & (F.get("_t", c["i"]) <= 30.0)

    described = once(iv, "_c", F.transform(candidates, describe))
    chosen = once(described, "_hit", F.get(F.filter("_c", steady), F.lit(0)))
    chosen = chosen.filter(F.col("_hit").isNotNull()).withColumn("_i", F.col("_hit.i"))
    tail = F.filter(F.slice("_iv", F.col("_i") + 1, LEAD_TAIL), lambda v: _within(v, expected, 0.88, 1.12))
    return chosen.select("s", F.col("_i").cast("long").alias("at_idx"), F.get("_t", F.col("_i")).alias("at_t"), _median_of(tail).alias("step"))


def lead_in(beats: DataFrame, downbeats: DataFrame, sessions: DataFrame) -> DataFrame:
    """Per session to repair: ``reference`` time, ``source`` beat index, ``step`` and ``steps`` to go back."""
    shifts = durable(stable_transition(beats, sessions))
    late = downbeats.join(shifts, "s").filter(F.col("t") >= F.col("at_t") - F.col("step") * 0.25)
    reference = late.groupBy("s").agg(F.min("t").alias("reference"))
    known = durable(shifts.join(reference, "s"))
    distance = F.abs(F.col("t") - F.col("reference"))
    source = (
        beats.join(known, "s")
        .groupBy("s")
        .agg(
            F.min_by("idx", F.when(F.col("idx") >= F.col("at_idx"), F.struct(distance.alias("d"), F.col("idx")))).alias("source"),
            F.min_by("t", "idx").alias("_first"),
            F.count(F.lit(1)).alias("_beats"),
        )
        .filter(F.col("_beats") >= 20)
    )
    earliest = F.greatest(F.lit(0.0), F.col("_first") - F.col("step") * 1.05)
    steps = F.greatest(F.lit(0), F.floor((F.col("reference") - earliest) / F.col("step") + 1e-9)).cast("long")
    return known.join(source, "s").select("s", "reference", "source", "step", steps.alias("steps"))


def backfill_lead(beats: DataFrame, downbeats: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuild sparse lead-ins backwards from the first stable downbeat. Returns (beats, downbeats)."""
    return apply_lead(beats, downbeats, durable(lead_in(beats, downbeats, sessions)))


def apply_lead(beats: DataFrame, downbeats: DataFrame, repairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Carry out the repairs that :func:`lead_in` found."""
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps")))
    rebuilt = repairs.withColumn("_k", k).select(
        "s",
        (F.col("steps") - F.col("_k")).alias("idx"),
        half_even(F.col("reference") - F.col("_k") * F.col("step"), 3).alias("t"),
        "steps",
    )
    kept = (
        beats.select("s", "idx", "t")
        .join(repairs, "s", "left")
        .filter(F.col("source").isNull() | (F.col("idx") > F.col("source")))
        .select(
            "s",
            F.coalesce(F.col("steps") + F.col("idx") - F.col("source"), F.col("idx")).alias("idx"),
            F.when(F.col("source").isNull(), F.col("t")).otherwise(half_even("t", 3)).alias("t"),
            "steps",
        )
    )
    merged = kept.unionByName(rebuilt)
    # The reference itself is the last rebuilt beat, so it sits at position ``steps`` and fixes the phase.
    phase = F.pmod(F.col("steps"), F.lit(4))
    repaired_downbeats = merged.filter(F.col("steps").isNotNull() & (F.pmod(F.col("idx"), F.lit(4)) == phase)).select(
        "s", F.floor((F.col("idx") - phase) / 4).cast("long").alias("idx"), "t"
    )
    others = downbeats.select("s", "idx", "t").join(repairs.select("s"), "s", "left_anti")
    return merged.drop("steps"), others.unionByName(repaired_downbeats)


@dataclass(frozen=True)
class Tempo:
    """Tables of a set of sessions that change together."""

    sessions: DataFrame
    beats: DataFrame
    downbeats: DataFrame
    sections: DataFrame | None = None


def normalize_tempo(data: Tempo, rows: int = TILE_ROWS) -> Tempo:
    """Double the tempo where the beats run in double time, then rebuild sparse lead-ins; sections follow.

    The tables between the two repairs are checkpointed, so neither is computed twice.
    Sections keep their bars in sessions that did not change.
    """
    from metrum.operators.sections import place_sections

    flags = durable(double_time_flag(data.beats, data.sessions, rows).filter("double_time").select("s"))
    doubled = data.sessions.join(flags, "s").withColumn("bpm", half_even(F.col("bpm") * 2, 1))
    sessions = data.sessions.join(flags, "s", "left_anti").unionByName(doubled)
    expanded = expand_beats(data.beats.join(doubled.select("s", "bpm"), "s"), F.lit(60.0) / F.col("bpm"), rows)
    expanded = durable(expanded)
    beats = data.beats.select("s", "idx", "t").join(flags, "s", "left_anti").unionByName(expanded)
    regridded = every_fourth(expanded, data.downbeats.join(flags, "s", "left_semi"))
    downbeats = data.downbeats.select("s", "idx", "t").join(flags, "s", "left_anti").unionByName(regridded)
    repairs = durable(lead_in(beats, durable(downbeats), sessions))
    new_beats, new_downbeats = apply_lead(beats, downbeats, repairs)
    sections = data.sections
    if sections is not None:
        changed = flags.unionByName(repairs.select("s")).distinct()
        moved = place_sections(sections.join(changed, "s", "left_semi"), new_downbeats)
        sections = sections.join(changed, "s", "left_anti").unionByName(moved.select(*sections.columns))
    return Tempo(sessions, new_beats, new_downbeats, sections)


# --- changes of tempo ----------------------------------------------------------------------------------------


def factor_steps(factor: float) -> tuple[int, int]:
    """How often to double and then to halve for a tempo factor."""
    if factor <= 0:
        raise ValueError("the tempo factor must be positive")
    doublings = halvings = 0
    while factor > 1:
        doublings, factor = doublings + 1, factor / 2
    while factor < 1:
        halvings, factor = halvings + 1, factor * 2
    return doublings, halvings


def scale_beats(beats: DataFrame, factor: float, rows: int = TILE_ROWS) -> DataFrame:
    """Insert midpoints or drop every other beat until the grid has ``factor`` times the tempo."""
    doublings, halvings = factor_steps(factor)
    out = beats.select("s", "idx", "t")
    for _ in range(doublings):
        pairs = neighbours(out, ["s"], {"_next": lambda w: F.lead("t").over(w)}, after=1, rows=rows)
        middle = F.struct((F.col("idx") * 2 + 1).alias("idx"), half_even((F.col("t") + F.col("_next")) / 2, 3).alias("t"))
        both = F.array(F.struct((F.col("idx") * 2).alias("idx"), F.col("t").alias("t")), middle)
        out = pairs.select("s", F.inline(both)).filter(F.col("t").isNotNull())
    if halvings:
        every = 2**halvings
        out = out.filter(F.col("idx") % every == 0).withColumn("idx", F.floor(F.col("idx") / every).cast("long"))
    return out


def apply_bpm_factor(sessions: DataFrame, beats: DataFrame, sections: DataFrame, factor: float) -> Tempo:
    """Correct the tempo of sessions ``(s, bpm, total_bars)`` with their beats and section ranges."""
    from metrum.functions.scalars import scale_bar, scale_range

    new_beats = scale_beats(beats, factor)
    downbeats = new_beats.filter(F.col("idx") % 4 == 0).withColumn("idx", F.floor(F.col("idx") / 4).cast("long"))
    scaled = sessions.withColumn("bpm", half_even(F.col("bpm") * factor, 1)).withColumn(
        "total_bars", scale_bar("total_bars", F.lit(factor))
    )
    bars = scale_range("start_bar", "end_bar", F.lit(factor))
    moved = sections.withColumn("_bars", bars)
    for name in ("start_bar", "end_bar", "bar_count"):
        moved = moved.withColumn(name, F.col(f"_bars.{name}"))
    return Tempo(scaled, new_beats, downbeats, moved.drop("_bars"))


def half_beat_shift(beats: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Move every beat back by half the session's (upper) median interval, not below zero."""
    gaps = intervals(beats, rows).filter(F.col("iv") > 0)
    typical = exact_median(gaps, ["s"], "iv", "_iv", bucket=F.floor(F.col("iv") * 1000).cast("long"), upper=True)
    shifted = F.greatest(F.lit(0.0), F.col("t") - F.col("_iv") / 2)
    return beats.join(typical, "s", "left").withColumn("t", F.coalesce(shifted, F.col("t"))).drop("_iv")


def four_bar_grid(sections: DataFrame, durations: DataFrame, factor: float = 1.0) -> DataFrame:
    """A line every four bars from the start of each section: ``(s, section, bar_offset, t, share)``."""
    from metrum.functions.scalars import scale_range

    joined = sections.join(durations.select("s", "duration"), "s").filter(F.col("duration") > 0)
    start = F.greatest(F.lit(0.0), F.least("duration", "start_time"))
    end = F.greatest(start, F.least("duration", "end_time"))
    bars = scale_range("start_bar", "end_bar", F.lit(factor))["bar_count"]
    spans = joined.select("s", F.col("idx").alias("section"), "duration", start.alias("_a"), end.alias("_b"), bars.alias("_n"))
    lines = spans.filter("_b > _a and _n >= 1").withColumn(
        "bar_offset", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(4).cast("long")))
    )
    t = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("bar_offset") / F.col("_n")
    return lines.select("s", "section", "bar_offset", t.alias("t"), (t / F.col("duration")).alias("share"))
