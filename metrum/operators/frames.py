"""Frame sequences, measures, barlines, rows and pages."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrum.functions.scalars import half_even_int, mask_share, mask_unmatched
from metrum.operators.folds import group_views
from metrum.plans.ordered import (
    TILE_ROWS,
    Scan,
    covering,
    exact_median,
    halo,
    neighbours,
    positions,
    row_tile,
    running,
)

# --- runs and samples ----------------------------------------------------------------------------------------


def evenly_spaced(rows: DataFrame, limit: int, keys: list[str] | None = None, tile: int = TILE_ROWS) -> DataFrame:
    """At most ``limit`` rows per key at equal distances, the first and last among them. ``idx`` must be dense."""
    keys = keys or ["s"]
    counted = running(rows, keys, row_tile("idx", tile), ["idx"], {"_n": Scan("count", F.lit(1), whole=True)})
    if limit == 1:
        return counted.filter("idx = 0").drop("_n")
    picks = F.transform(
        F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (limit - 1)).cast("long")
    )
    return counted.filter((F.col("_n") <= limit) | F.array_contains(picks, F.col("idx").cast("long"))).drop("_n")


def split_runs(rows: DataFrame, linked: Column, tile: int = TILE_ROWS) -> DataFrame:
    """Add ``run``: a new one wherever a row does not link to its predecessor. ``linked`` is about the row before."""
    first = F.col("idx") == 0
    breaks = F.when(first | ~F.coalesce(linked, F.lit(False)), 1).otherwise(0).cast("long")
    scans = {"run": Scan("sum", breaks)}
    return running(rows, ["s"], row_tile("idx", tile), ["idx"], scans).withColumn("run", F.col("run") - 1)


def merge_close(values: DataFrame, tolerance: float, how: str = "mean", span: float = 4096) -> DataFrame:
    """Runs of distinct values ``(s, value)`` with steps of at most ``tolerance`` as ``(s, run, value, n)``.

    ``how`` is mean (rounded half to even), first or last.
    """
    tiled = values.where("value IS NOT NULL").select("s", "value", F.floor(F.col("value") / span).cast("long").alias("_tile"))
    inside, across = Window.partitionBy("s", "_tile").orderBy("value"), Window.partitionBy("s").orderBy("_tile")
    # Rows are sorted once, by tile: equal values, steps and runs of a tile are told in one go.
    steps = tiled.withColumn("_step", F.col("value") - F.lag("value").over(inside)).where("_step IS NULL OR _step > 0")
    runs = steps.withColumn("_run", F.sum((F.coalesce("_step", F.lit(0)) > tolerance).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = runs.groupBy("s", "_tile").agg(F.min("value").alias("_low"), F.max("value").alias("_high"), F.max("_run").alias("_breaks"))
    # A tile's first value goes on with the run before it, or begins another.
    fresh = F.coalesce(F.col("_low") - F.lag("_high").over(across) > tolerance, F.lit(False)).cast("long")
    begun = ends.select("s", "_tile", "_breaks", fresh.alias("_fresh"))
    first = F.sum(F.col("_fresh") + F.col("_breaks")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_breaks")
    runs = runs.join(begun.select("s", "_tile", first.alias("_first")), ["s", "_tile"]).withColumn("run", F.col("_first") + F.col("_run"))
    pick = {"mean": half_even_int(F.avg("value")), "first": F.min("value"), "last": F.max("value")}[how]
    return runs.groupBy("s", "run").agg(pick.alias("value"), F.count(F.lit(1)).alias("n"))


def regular_groups(
    values: DataFrame, n: int, low: float, high: float, ratio: float, rows: int = TILE_ROWS
) -> DataFrame:
    """Starts ``(s, idx, value)`` of ``n`` consecutive values with gaps in low..high, largest at most ratio x smallest."""
    # The gaps need one row more than the groups, and both the same windows.
    spread, window, owned = halo(values, ["s"], after=n - 1, rows=rows)
    frame = window.rowsBetween(0, n - 2)
    measured = (
        spread.withColumn("_gap", F.lead("value").over(window) - F.col("value"))
        .withColumn("_min", F.min("_gap").over(frame))
        .withColumn("_max", F.max("_gap").over(frame))
        .withColumn("_n", F.count("_gap").over(frame))
        .filter(owned)
    )
    good = (F.col("_n") == n - 1) & (F.col("_min") >= low) & (F.col("_max") <= high) & (F.col("_max") <= ratio * F.col("_min"))
    return measured.filter(good).select("s", "idx", "value")


def last_regular_group(values: DataFrame, n: int, low: float, high: float, ratio: float) -> DataFrame:
    """The last such group of each session."""
    return regular_groups(values, n, low, high, ratio).groupBy("s").agg(
        F.max("idx").alias("idx"), F.max_by("value", "idx").alias("value")
    )


def drop_narrow(values: DataFrame, width: float = 24, rows: int = TILE_ROWS) -> DataFrame:
    """Adjacent pairs ``(s, idx, left, right)`` at least ``width`` apart."""
    pairs = neighbours(values, ["s"], {"right": lambda w: F.lead("x").over(w)}, after=1, rows=rows)
    return pairs.filter(F.col("right") - F.col("x") >= width).select("s", "idx", F.col("x").alias("left"), "right")


# --- motion --------------------------------------------------------------------------------------------------


MOTION = "struct<size:int,difference:double>"


def _stack(masks: pd.Series, chosen: np.ndarray) -> np.ndarray:
    return np.stack([np.asarray(masks.iloc[i], dtype=bool) for i in chosen])


PAIR_CELLS = 1 << 20
"""Cells of masks that are compared at once; a batch of more is cut."""


def _pairwise(match: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Callable:
    """Arrow-batched column function over pairs of masks; pairs of unequal size never match.

    ``match`` sees pairs of one mask size as two matrices and gives sizes and differences, nan for no match.
    """

    def over_batch(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        size = np.full(len(a), np.nan)
        difference = np.full(len(a), np.nan)
        lengths = np.array([len(x) if x is not None and y is not None and len(x) == len(y) else 0 for x, y in zip(a, b)])
        for n in np.unique(lengths[lengths > 0]):
            same = np.flatnonzero(lengths == n)
            step = max(1, PAIR_CELLS // int(n))
            for chosen in (same[k : k + step] for k in range(0, len(same), step)):
                size[chosen], difference[chosen] = match(_stack(a, chosen), _stack(b, chosen))
        found = ~np.isnan(difference)
        sizes = pd.Series(size).where(found).astype("Int32")
        return pd.DataFrame({"size": sizes, "difference": pd.Series(difference).where(found, None)})

    over_batch.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(over_batch, MOTION)


def _without_lines(a: np.ndarray, b: np.ndarray, dense: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of masks (n, rows, width) without the rows that are denser than ``dense`` in either mask of their pair."""
    if dense is None:
        return a, b
    keep = np.maximum(a.mean(axis=2), b.mean(axis=2))[:, :, None] <= dense
    return a & keep, b & keep


def _round(value: float) -> int:
    return int(np.rint(value))


def correlated(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For masks (n, rows, width) and each shift, the number of cells set in ``left`` and in ``right`` moved there.

    A Fourier transform of each row gives all shifts at once; sums over rows are taken before the way back. Counts are
    whole numbers far below what rounding could blur.
    """
    width = left.shape[2]
    size = 1 << (2 * width - 1).bit_length()
    product = np.fft.rfft(left, size) * np.conj(np.fft.rfft(right, size))
    return np.rint(np.fft.irfft(product.sum(axis=1), size)[:, :width]).astype(np.int64)


def _shift_matcher(minimum: int, width: int | None, dense: float | None, limit: float = 0.24):
    def match(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        across = width or a.shape[1]
        left, right = _without_lines(a.reshape(len(a), -1, across), b.reshape(len(b), -1, across), dense)
        # Set cells right of each cut of the left mask, and left of each cut of the right one.
        of_left = np.cumsum(left.sum(axis=1)[:, ::-1], axis=1)[:, ::-1]
        of_right = np.cumsum(right.sum(axis=1), axis=1)
        offsets = np.arange(max(0, across - max(24, _round(across * 0.38))) + 1)
        common = correlated(left, right)[:, offsets]
        union = of_left[:, offsets] + of_right[:, across - 1 - offsets] - common
        least = [max(minimum, _round(left.shape[1] * (across - k) * 0.003)) for k in offsets]
        share = np.where(union < np.array(least), 1.0, (union - common) / np.maximum(union, 1))
        best = share.argmin(axis=1)
        difference = share[np.arange(len(a)), best]
        return best, np.where(difference <= limit, difference, np.nan)

    return match


def _grown(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks grown by one cell to all sides; and without the step to the left, and without that to the right."""
    tall = masks.copy()
    tall[:, 1:] |= masks[:, :-1]
    tall[:, :-1] |= masks[:, 1:]
    from_left, from_right = tall.copy(), tall.copy()
    from_left[:, :, 1:] |= tall[:, :, :-1]
    from_right[:, :, :-1] |= tall[:, :, 1:]
    return from_left | from_right, from_left, from_right


def _overlap_matcher(width: int, low: int, high: int, features: int, dense: float | None, limit: float = 0.22):
    def match(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = _without_lines(a.reshape(len(a), -1, width), b.reshape(len(b), -1, width), dense)
        sizes = np.arange(low, high + 1)
        of_left = np.cumsum(left.sum(axis=1)[:, ::-1], axis=1)[:, sizes - 1]
        of_right = np.cumsum(right.sum(axis=1), axis=1)[:, sizes - 1]
        total = of_left + of_right
        # A crop's edge column has no neighbours beyond the crop: take off what only these would match.
        whole_l, _, inner_l = _grown(left)
        whole_r, inner_r, _ = _grown(right)
        edge_l = np.einsum("nr,nrw->nw", right[:, :, 0].astype(np.int64), (whole_l & ~inner_l).astype(np.int64))[:, width - sizes]
        edge_r = np.einsum("nr,nrw->nw", left[:, :, -1].astype(np.int64), (whole_r & ~inner_r).astype(np.int64))[:, sizes - 1]
        near_left = correlated(left, whole_r)[:, width - sizes] - edge_r
        near_right = correlated(whole_l, right)[:, width - sizes] - edge_l
        table = np.where(total < features, np.inf, (total - near_left - near_right) / np.maximum(total, 1)).T
        best = table.min(axis=0)
        near = table <= np.minimum(limit, best + 0.025)
        # The smallest overlap among those about as good as the best.
        return low + near.argmax(axis=0), np.where(best <= limit, best, np.nan)

    return match


def _with_motion(frames: DataFrame, match, size: str, rows: int) -> DataFrame:
    pairs = neighbours(frames, ["s"], {"_next": lambda w: F.lead("signature").over(w)}, after=1, rows=rows)
    found = pairs.withColumn("_m", _pairwise(match)("signature", "_next"))
    return found.select(*frames.columns, F.col("_m.size").alias(size), F.col("_m.difference").alias("difference"))


LINES = 0.32
"""Share of set cells above which a row of a mask is a line, which matches at any shift."""


def best_shift(
    frames: DataFrame, minimum: int = 20, rows: int = TILE_ROWS, width: int | None = None, dense: float | None = LINES
) -> DataFrame:
    """Add ``offset`` and ``difference`` of the movement to the next frame; null where there is none.

    Masks have rows of ``width`` cells; without ``width`` they are one row, of which no part is a line. Rows denser
    than ``dense`` in either frame of a pair are left out. Shifts keep an overlap of at least 0.38 of the width and 24 cells; a shift counts only
    with enough set cells; above 0.24 there is no match. All shifts of a pair come from one correlation of its masks, so
    pairs are never multiplied into rows, and the cost of one grows with its cells, not with cells times shifts.
    """
    return _with_motion(frames, _shift_matcher(minimum, width, dense if width else None), "offset", rows)


def edge_overlap(
    frames: DataFrame, width: int, minimum: int = 16, maximum: int | None = None, features: int = 30, rows: int = TILE_ROWS,
    dense: float | None = LINES,
) -> DataFrame:
    """Add ``overlap``: how many columns of the next frame repeat the right edge of this one; null where none do.

    Masks have ``width`` columns; rows denser than ``dense`` in either mask of a pair are left out. Among overlaps within 0.025 of the best mismatch (at most 0.22) the smallest wins.
    """
    low = max(minimum, round(width * 0.04))
    high = min(width, maximum if maximum is not None else max(low, round(width * 0.35)))
    return _with_motion(frames, _overlap_matcher(width, low, high, features, dense), "overlap", rows)


def drop_transitions(
    frames: DataFrame, threshold: float = 0.02, minimum: int = 3, evidence: int = 20, width: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(frames kept with their group ``head``, number of rejected frames per session).

    A group shorter than ``minimum`` goes only if it lies on a continuous pan between both neighbours.
    """
    grouped = group_views(frames, threshold)
    spans = grouped.groupBy("s", "head").agg(F.count(F.lit(1)).alias("n"), F.max("idx").alias("last"))
    moving = best_shift(frames, evidence, width=width).filter("offset is not null").select("s", "idx")
    incoming = moving.select("s", (F.col("idx") + 1).alias("head"), F.lit(True).alias("_in"))
    outgoing = moving.select("s", F.col("idx").alias("last"), F.lit(True).alias("_out"))
    judged = spans.join(incoming, ["s", "head"], "left").join(outgoing, ["s", "last"], "left")
    bad = judged.filter((F.col("n") < minimum) & F.col("_in") & F.col("_out"))
    kept = grouped.join(bad.select("s", "head"), ["s", "head"], "left_anti")
    return kept, bad.groupBy("s").agg(F.sum("n").alias("rejected"))


def mask_difference(pairs: DataFrame, a: str, b: str, width: int | None = None) -> DataFrame:
    """Add ``difference``: share of unequal cells or, with a row ``width``, of cells without a counterpart."""
    value = mask_share(a, b) if width is None else mask_unmatched(a, b, width)
    return pairs.withColumn("difference", value)


def pair_frames(selected: DataFrame, analysis: DataFrame) -> DataFrame:
    """Two renderings of the same frame, matched by name."""
    return selected.join(analysis, ["s", "name"])


def percentile_composite(
    frames: DataFrame, values: str = "values", fraction: float = 0.9, limit: int = 9
) -> DataFrame:
    """Per ``(s, group)`` and position the percentile over at most ``limit`` evenly spaced frames.

    A position sees at most ``limit`` values, so each percentile is small.
    """
    placed = positions(frames, ["s", "group"], ["idx"], row_tile("idx"), "_pos")
    ranked = placed.drop("idx").withColumnRenamed("_pos", "idx")
    chosen = evenly_spaced(ranked, limit, ["s", "group"])
    cells = chosen.select("s", "group", F.posexplode(values).alias("pos", "v"))
    return cells.groupBy("s", "group", "pos").agg(F.percentile("v", F.lit(fraction)).alias("value"))


# --- geometry ------------------------------------------------------------------------------------------------


def consensus_extent(lines: DataFrame, minimum: int = 4, spread: float = 8) -> DataFrame:
    """Rounded median start and end of the lines ``(s, start, end)`` of a frame, if they agree."""
    agreed = (
        lines.groupBy("s")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            (F.max("start") - F.min("start")).alias("_a"),
            (F.max("end") - F.min("end")).alias("_b"),
        )
        .filter((F.col("_n") >= minimum) & (F.col("_a") <= spread) & (F.col("_b") <= spread))
        .select("s")
    )
    kept = lines.join(agreed, "s", "left_semi")
    starts = exact_median(kept, ["s"], "start", "start_median")
    ends = exact_median(kept, ["s"], "end", "end_median")
    return starts.join(ends, "s").select(
        "s", half_even_int("start_median").alias("start"), half_even_int("end_median").alias("end")
    )


def median_align(anchors: DataFrame) -> DataFrame:
    """Add ``shift`` of each ``(s, idx, anchor)`` to the rounded median anchor; 0 with fewer than two anchors."""
    typical = exact_median(anchors, ["s"], "anchor", "_median")
    counts = anchors.groupBy("s").agg(F.count("anchor").alias("_n"))
    joined = anchors.join(counts, "s").join(typical, "s", "left")
    shift = half_even_int("_median") - F.col("anchor")
    return joined.withColumn("shift", F.when(F.col("_n") >= 2, F.coalesce(shift, F.lit(0))).otherwise(0).cast("long")).drop(
        "_n", "_median"
    )


def quorum(frames: DataFrame, limit: int = 24, margin: float = 0.038) -> DataFrame:
    """Per session ``complete``: whether the sampled frames show whole rows.

    Frames are ``(s, idx, width, start, end)`` with null extents where none was found.
    """
    sampled = evenly_spaced(frames, limit)
    edge = half_even_int(F.col("width") * margin)
    inside = (F.col("start") >= edge) & (F.col("width") - 1 - F.col("end") >= edge)
    counted = sampled.groupBy("s").agg(
        F.count(F.lit(1)).alias("n"), F.count("start").alias("valid"), F.count_if(inside).alias("whole")
    )
    verdict = (
        (F.col("n") >= 2)
        & (F.col("valid") >= F.greatest(F.lit(2.0), F.rint(F.col("n") * 0.45)))
        & (F.col("whole") >= F.greatest(F.lit(2.0), F.rint(F.col("valid") * 0.75)))
    )
    return counted.withColumn("complete", verdict)


def consensus_positions(lines: DataFrame, tolerance: float = 4, span: float | None = None) -> DataFrame:
    """Positions ``(s, system, x)`` of the first system that another system confirms, as rounded means.

    The nearest position within the tolerance counts once per system. A session with one system keeps its positions.
    """
    systems = lines.groupBy("s").agg(F.min("system").alias("_first"), F.count_distinct("system").alias("_n"))
    tagged = lines.join(systems, "s")
    first = tagged.filter("system = _first").select("s", "x", "_n").distinct()
    alone = first.filter("_n = 1").select("s", F.col("x").cast("long").alias("x"))
    others = tagged.filter("system <> _first").select("s", "system", "x").distinct()
    # A position of another system can only be the nearest one within the tolerance of a first-system position.
    reach = others.select(
        "s", "system", F.col("x").alias("other"), (F.col("x") - tolerance).alias("_a"), (F.col("x") + tolerance + 1e-6).alias("_b")
    )
    # Tiles a few tolerances wide: a position meets only what is near it.
    tile = span or max(1.0, 8.0 * tolerance)
    pairs = covering(first.filter("_n > 1"), reach, ["s"], "x", "_a", "_b", tile, how="inner")
    nearest_per_system = pairs.groupBy("s", "x", "system").agg(
        F.min(F.struct(F.abs(F.col("other") - F.col("x")).alias("d"), "other")).alias("_m")
    )
    agreed = nearest_per_system.groupBy("s", "x").agg(F.sum("_m.other").alias("_sum"), F.count(F.lit(1)).alias("_k"))
    confirmed = agreed.select("s", half_even_int((F.col("x") + F.col("_sum")) / (F.col("_k") + 1)).alias("x"))
    return alone.unionByName(confirmed)


def plausible_joins(pairs: DataFrame, widths: DataFrame, frame_width: float) -> DataFrame:
    """Pairs ``(s, pair, tail, head)`` whose joined width fits the measures around them.

    ``widths (s, pair, width)`` are the neighbouring measures' widths; those below 60 do not count.
    """
    inner = widths.filter("width >= 60")
    typical = exact_median(inner, ["s", "pair"], "width", "_median")
    joined = pairs.join(typical, ["s", "pair"]).withColumn("width", F.col("tail") + F.col("head"))
    fits = F.col("width").between(F.col("_median") * 0.35, F.col("_median") * 2.2) & (F.col("width") <= frame_width)
    return joined.filter(fits).drop("_median")


def run_verdict(offsets: DataFrame, frame_width: float, force: bool = False) -> DataFrame:
    """Per run ``(s, run)`` of scroll offsets: whether it scrolls far and often enough to be stitched."""
    share, count = (0.12, 1) if force else (0.65, 2)
    sums = offsets.groupBy("s", "run").agg(
        F.coalesce(F.sum("offset"), F.lit(0)).alias("total"), F.count_if(F.col("offset") > 0).alias("moves")
    )
    needed = round(frame_width * share)
    return sums.withColumn("stitch", (F.col("total") >= needed) & (F.col("moves") >= count))


def row_layouts(
    rows: DataFrame, audit: DataFrame, per_row: int, measures: DataFrame, simple: bool = True
) -> DataFrame:
    """Boundaries of each row ``(s, idx, width)`` as ``(s, idx, first_measure, boundaries)``.

    Audited boundaries hold if every row of the session has them; else rows divide their width equally among
    ``per_row`` measures, and rows beyond the session's ``measures (s, n)`` are left out.
    """
    usable = audit.filter(F.col("first_measure").isNotNull() & (F.size("boundaries") >= 2)).select(
        "s", "idx", F.col("first_measure").alias("_first"), F.col("boundaries").alias("_bounds")
    )
    joined = rows.join(usable, ["s", "idx"], "left")
    whole = joined.groupBy("s").agg((F.count("_first") == F.count(F.lit(1))).alias("_whole"))
    tagged = joined.join(whole, "s").join(measures.select("s", F.col("n").alias("_n")), "s", "left")
    if not simple:
        tagged = tagged.withColumn("_whole", F.lit(False))
    start = F.col("idx") * per_row
    count = F.least(F.lit(per_row), F.col("_n") - start)
    equal = F.transform(
        F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1).cast("long"), count)), lambda k: half_even_int(F.col("width") * k / count)
    )
    return tagged.filter(F.col("_whole") | (count > 0)).select(
        "s",
        "idx",
        F.when(F.col("_whole"), F.col("_first") - 1).otherwise(start).cast("long").alias("first_measure"),
        F.when(F.col("_whole"), F.col("_bounds").cast("array<bigint>")).otherwise(equal).alias("boundaries"),
    )


# --- numbers -------------------------------------------------------------------------------------------------


def first_numbered(measures: DataFrame) -> DataFrame:
    """Rows of numbered frames in which a number occurs for the first time, and their unnumbered rows."""
    numbered = measures.groupBy("s", "frame_idx").agg((F.count("label") >= 2).alias("_numbered")).filter("_numbered")
    rows = measures.join(numbered.select("s", "frame_idx"), ["s", "frame_idx"], "left_semi")
    firsts = (
        rows.filter("label is not null").groupBy("s", "label").agg(F.min(F.struct("frame_idx", "local_idx")).alias("_f"))
        .select("s", "label", "_f.*")
    )
    kept = firsts.unionByName(rows.filter("label is null").select("s", "label", "frame_idx", "local_idx"))
    return rows.join(kept.select("s", "frame_idx", "local_idx"), ["s", "frame_idx", "local_idx"], "left_semi")


def fill_numbers(measures: DataFrame, rows: int = TILE_ROWS) -> DataFrame:
    """Number unlabelled runs of ``(s, idx, label)`` where both ends fit exactly; adds ``number``.

    A leading run is numbered when it leads up to its successor from 1; a trailing one never is. Sessions without any
    label are numbered from 1.
    """
    mark = F.when(F.col("label").isNotNull(), F.struct("idx", "label"))
    scans = {
        "_prev": Scan("last", mark, (F.col("idx"),)),
        "_next": Scan("last", mark, (-F.col("idx"),), reverse=True),
        "_any": Scan("count", F.col("label"), whole=True),
    }
    seen = running(measures, ["s"], row_tile("idx", rows), ["idx"], scans)
    between = F.col("_next.label") - F.col("_prev.label") == F.col("_next.idx") - F.col("_prev.idx")
    leading = F.col("_prev").isNull() & (F.col("_next.label") == F.col("_next.idx") + 1)
    number = (
        F.when(F.col("_any") == 0, F.col("idx") + 1)
        .when(F.col("label").isNotNull(), F.col("label"))
        .when(between, F.col("_prev.label") + F.col("idx") - F.col("_prev.idx"))
        .when(leading, F.col("idx") + 1)
    )
    return seen.withColumn("number", number).drop("_prev", "_next", "_any")


def infer_numbers(barlines: DataFrame) -> DataFrame:
    """Add ``number`` to ``(s, idx, recognized)``: the index plus the median offset of the recognised ones."""
    known = barlines.filter("recognized is not null").select("s", (F.col("recognized") - F.col("idx")).alias("_offset"))
    typical = exact_median(known, ["s"], "_offset", "_median")
    return barlines.join(typical, "s", "left").withColumn("number", F.col("idx") + half_even_int("_median")).drop("_median")


def terminal_candidate(fragments: DataFrame, kept: DataFrame) -> DataFrame:
    """Per session the edge fragment with the largest number, the first on ties, if beyond every kept number."""
    rest = [c for c in fragments.columns if c not in ("s", "label", "frame_idx", "local_idx")]
    order = F.struct(F.col("label"), -F.col("frame_idx"), -F.col("local_idx"))
    best = fragments.filter("label is not null").groupBy("s").agg(
        F.max_by(F.struct("label", "frame_idx", "local_idx", *rest), order).alias("_b")
    )
    largest = kept.groupBy("s").agg(F.max("label").alias("_max"))
    joined = best.join(largest, "s", "left").filter(F.col("_b.label") > F.coalesce("_max", F.lit(0)))
    return joined.select("s", "_b.*")


def running_numbers(rows: DataFrame, tile: int = TILE_ROWS) -> DataFrame:
    """Add ``first_number`` to ``(s, idx, n)``: one plus the sum of earlier counts, null where ``n`` is 0."""
    summed = running(rows, ["s"], row_tile("idx", tile), ["idx"], {"_sum": Scan("sum", F.col("n"), exclusive=True)})
    return summed.withColumn("first_number", F.when(F.col("n") > 0, F.coalesce("_sum", F.lit(0)) + 1)).drop("_sum")


def chunk_rows(measures: DataFrame, per_row: int, width: int) -> DataFrame:
    """Rows of ``per_row`` (1 to 8) measures: adds ``row``, ``cell`` and ``cell_width``, wider cells first."""
    n = max(1, min(8, per_row))
    base, wider = divmod(width, n)
    cell = F.col("idx") % n
    return (
        measures.withColumn("row", F.floor(F.col("idx") / n).cast("long"))
        .withColumn("cell", cell.cast("long"))
        .withColumn("cell_width", (F.lit(base) + F.when(cell < wider, 1).otherwise(0)).cast("long"))
    )


def dedup_audit(measures: DataFrame, kept: DataFrame, rejected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(totals per session, provenance of every kept measure in long form)."""
    before = measures.groupBy("s").agg(F.count_distinct("frame_idx").alias("input_frames"), F.count(F.lit(1)).alias("_in"))
    after = kept.groupBy("s").agg(F.count(F.lit(1)).alias("output"), F.count_if(F.col("label").isNull()).alias("unresolved"))
    totals = before.join(after, "s", "left")
    if rejected is None:
        totals = totals.withColumn("rejected", F.lit(0).cast("long"))
    else:
        totals = totals.join(rejected.select("s", "rejected"), "s", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)))
    out = F.coalesce("output", F.lit(0))
    summary = totals.select(
        "s", "input_frames", out.alias("output"), (F.col("_in") - out - F.col("rejected")).alias("removed"), "rejected",
        F.coalesce("unresolved", F.lit(0)).alias("unresolved"),
    )
    ordered = positions(kept, ["s"], ["frame_idx", "local_idx"], row_tile("frame_idx"), "_pos")
    sources = ordered.select(
        "s", F.coalesce(F.col("label"), F.col("_pos") + 1).alias("measure"), F.col("label").isNotNull().alias("official"),
        "frame_idx", "local_idx",
    )
    return summary, sources


def best_candidate(scores: DataFrame) -> DataFrame:
    """Per session the row with the highest ``score``, the latest on ties."""
    best = scores.groupBy("s").agg(F.max(F.struct("score", "idx")).alias("_b"))
    return best.select("s", "_b.idx", "_b.score")
