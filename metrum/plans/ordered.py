"""Ordered operators whose unit of work is a tile, not a session.

A plain ``Window.partitionBy(session)`` sends a whole session to one task, which fails once a single session holds
a large share of the rows. Everything ordered in this package goes through one of three forms instead:

``halo``
    windows of bounded reach (lag, lead, eight-row medians). Rows are cut into tiles of consecutive positions and
    the few rows near a cut are copied into the neighbouring tile, so one shuffle by (session, tile) is enough.

``running``
    unbounded running aggregates. Each tile is scanned on its own; one summary row per tile is scanned across the
    session; the carried value is joined back by (session, tile).

``positions``
    dense row numbers, from per-bucket ranks plus carried counts.

``asof`` and ``nearest`` are ``running`` over the union of points and anchors, in tiles of time; a tile with too many
rows is cut at quantiles of its times, so a session whose rows crowd into one second is spread like any other.
``covering`` is an interval join on time tiles.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from metrum.plans.durable import durable

TILE_ROWS = 4096
"""Rows per position tile."""

TILE_SECONDS = 3600.0
"""Seconds per time tile."""

CROWDED = 1 << 20
"""Rows of a time tile from which on it is cut."""

PIECES = 64
"""Pieces that a crowded tile is cut into at once."""


def as_columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in items]


def row_tile(idx: str | Column, rows: int = TILE_ROWS) -> Column:
    """Tile number of a dense position."""
    position = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(position / F.lit(rows)).cast("long")


def time_tile(t: str | Column, seconds: float = TILE_SECONDS) -> Column:
    """Tile number of a time in seconds."""
    moment = F.col(t) if isinstance(t, str) else t
    return F.floor(moment / F.lit(seconds)).cast("long")


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is evaluated once however often later expressions refer to it.

    The optimizer copies a projected expression into each place that uses it, but not across a generator.
    """
    return df.withColumn(name, F.explode(F.array(value)))


@dataclass(frozen=True)
class Scan:
    """One running aggregate.

    ``op`` is sum, count, max, min or last (last non-null). ``order`` lists ascending sort expressions; with
    ``reverse`` the tiles are visited from the last to the first, and ``order`` must sort rows that way too.
    ``exclusive`` leaves the current row out. ``whole`` gives the aggregate of the entire session instead.
    """

    op: str
    value: Column
    order: tuple[Column, ...] = field(default=())
    reverse: bool = False
    exclusive: bool = False
    whole: bool = False


def _aggregate(op: str, value: Column, order: Sequence[Column]) -> Column:
    if op == "last":
        return F.max_by(value, F.when(value.isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])))
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[op](value)


def _windowed(op: str, value: Column) -> Column:
    if op == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}[op](value)


def _combine(op: str, carried: Column, local: Column) -> Column:
    if op in ("sum", "count"):
        return F.when(carried.isNull(), local).when(local.isNull(), carried).otherwise(carried + local)
    if op == "max":
        return F.greatest(carried, local)
    if op == "min":
        return F.least(carried, local)
    return F.coalesce(local, carried)


def running(
    df: DataFrame, keys: Sequence[str], tile: Column, order: Sequence[str | Column], scans: dict[str, Scan]
) -> DataFrame:
    """Add running aggregates to ``df``. ``tile`` must be monotone in ``order``; ``order`` must be total per key."""
    tiled = df.withColumn("_tile", tile)
    return _scanned(tiled, _totals(tiled, keys, order, scans), keys, order, scans)


def running_in_time(
    df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str | Column], scans: dict[str, Scan],
    seconds: float = TILE_SECONDS, crowded: int = CROWDED,
) -> DataFrame:
    """``running`` in tiles of time, where no tile holds more than ``crowded`` rows unless they are of one moment."""
    return _scanned(*uncrowded(df, keys, t, order, scans, seconds, crowded), keys, order, scans)


def uncrowded(df, keys, t, order, scans, seconds, crowded) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_tile``, the time their tile begins at, and the totals of the tiles, with ``_rows``, their size.

    The totals are needed in any case, and tell which tiles are crowded. These are cut at quantiles of their times, in
    rounds: each makes a crowded tile about ``PIECES`` times smaller. Crowded tiles are few, by ``crowded`` times.
    """
    group = [*keys, "_tile"]
    tiled, largest = df.withColumn("_tile", F.floor(F.col(t) / seconds) * F.lit(float(seconds))), None
    while True:
        extra = [F.count(F.lit(1)).alias("_rows"), (F.min(t) < F.max(t)).alias("_splits")]
        totals = durable(_totals(tiled, keys, order, scans, extra))
        found = totals.where((F.col("_rows") > crowded) & F.col("_splits"))
        most = found.agg(F.max("_rows")).first()[0]
        # The times of a tile may be so alike that cuts no longer help.
        if most is None or largest is not None and most >= largest:
            return tiled, totals
        largest = most
        steps = F.percentile_approx(t, [k / PIECES for k in range(1, PIECES)], 1000)
        cuts = durable(tiled.join(found.select(*group), group, "left_semi").groupBy(*group).agg(steps.alias("_cuts")))
        inner = F.array_max(F.filter("_cuts", lambda c: c <= F.col(t)))
        tiled = tiled.join(cuts, group, "left").withColumn("_tile", F.coalesce(inner, "_tile")).drop("_cuts")


def _order_of(scan: Scan, order: Sequence[str | Column]) -> tuple[Column, ...]:
    return scan.order or tuple(as_columns(order))


def _totals(tiled: DataFrame, keys, order, scans: dict[str, Scan], extra: Sequence[Column] = ()) -> DataFrame:
    """One row for each key and tile."""
    return tiled.groupBy(*keys, "_tile").agg(
        *[_aggregate(s.op, s.value, _order_of(s, order)).alias(f"_total_{name}") for name, s in scans.items()], *extra
    )


def _scanned(tiled: DataFrame, totals: DataFrame, keys, order, scans: dict[str, Scan]) -> DataFrame:
    """Scan tiles, and the summaries across them, and put both together."""
    group = [*keys, "_tile"]
    summary_op = {"count": "sum"}
    carries = list(group)
    for name, scan in scans.items():
        across = Window.partitionBy(*keys)
        if scan.whole:
            frame = across
        else:
            direction = F.col("_tile").desc() if scan.reverse else F.col("_tile").asc()
            frame = across.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
        op = summary_op.get(scan.op, scan.op)
        carries.append(_windowed(op, F.col(f"_total_{name}")).over(frame).alias(f"_carry_{name}"))
    carried = totals.select(*carries)

    local = tiled
    for name, scan in scans.items():
        if not scan.whole:
            last = -1 if scan.exclusive else 0
            frame = Window.partitionBy(*group).orderBy(*_order_of(scan, order)).rowsBetween(Window.unboundedPreceding, last)
            local = local.withColumn(f"_local_{name}", _windowed(scan.op, scan.value).over(frame))

    joined = local.join(carried, group)
    outputs = [F.col(c) for c in tiled.columns if c != "_tile" and c not in scans]
    for name, scan in scans.items():
        carry = F.col(f"_carry_{name}")
        value = carry if scan.whole else _combine(scan.op, carry, F.col(f"_local_{name}"))
        outputs.append(value.alias(name))
    return joined.select(*outputs)


def positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], bucket: Column, out: str = "idx"
) -> DataFrame:
    """Add a dense zero-based position per key. ``bucket`` is any monotone coarsening of ``order``."""
    ranked = running(df, keys, bucket, order, {out: Scan("count", F.lit(1))})
    return ranked.withColumn(out, F.col(out) - 1)


def halo(
    df: DataFrame, keys: Sequence[str], idx: str = "idx", before: int = 0, after: int = 0, rows: int = TILE_ROWS
) -> tuple[DataFrame, WindowSpec, Column]:
    """Copy rows near tile cuts into the tiles that look at them.

    Returns the spread rows, the window over them, and a predicate for the rows a tile owns. ``idx`` must be dense;
    window frames may reach ``before`` rows back and ``after`` rows ahead.
    """
    position = F.col(idx).cast("long")
    first = F.floor(F.greatest(position - after, F.lit(0)) / rows).cast("long")
    last = F.floor((position + before) / rows).cast("long")
    spread = df.withColumn("_tile", F.explode(F.sequence(first, last)))
    window = Window.partitionBy(*keys, "_tile").orderBy(idx)
    return spread, window, F.col("_tile") == row_tile(idx, rows)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    idx: str = "idx",
    before: int = 0,
    after: int = 0,
    rows: int = TILE_ROWS,
) -> DataFrame:
    """Add lag/lead expressions, given as functions of the halo window."""
    spread, window, owned = halo(df, keys, idx, before, after, rows)
    for name, build in columns.items():
        spread = spread.withColumn(name, build(window))
    return spread.filter(owned).drop("_tile")


def asof(
    points: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    at: Column,
    t: Column,
    take: dict[str, Column],
    tie: Column,
    seconds: float = TILE_SECONDS,
    ahead: bool = True,
    count_as: str | None = None,
    strict: bool = False,
    crowded: int = CROWDED,
) -> DataFrame:
    """For each point the first anchor at or after it (``ahead``) or the last one at or before it.

    Among anchors at one time the smallest ``tie`` wins. ``count_as`` adds the number of anchors in the session. With
    ``strict`` an anchor at the point's own time doesn't count.
    """
    marked = _union(points, anchors, keys, at, t, take, tie, point_first=ahead != strict)
    if ahead:
        order = (-F.col("_t"), -F.col("_kind"), -F.col("_tie"))
    else:
        order = (F.col("_t"), F.col("_kind"), -F.col("_tie"))
    scans = {"_hit": Scan("last", F.col("_take"), order, reverse=ahead)}
    if count_as:
        scans[count_as] = Scan("count", F.col("_take"), whole=True)
    found = running_in_time(marked, keys, "_t", [*order], scans, seconds, crowded).filter(F.col("_row").isNotNull())
    return found.select(
        *keys,
        *[F.col(f"_row.{c}").alias(c) for c in points.columns if c not in keys],
        *[F.col(f"_hit.{name}").alias(name) for name in take],
        *([count_as] if count_as else []),
    )


def nearest(
    points: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    at: Column,
    t: Column,
    take: dict[str, Column],
    tie: Column,
    seconds: float = TILE_SECONDS,
    distance: str = "distance",
    crowded: int = CROWDED,
) -> DataFrame:
    """For each point the anchor closest in time; of equally close ones the smallest ``tie`` wins."""
    marked = _union(points, anchors, keys, at, t, take, tie, point_first=False)
    scans = {
        "_prev": Scan("last", F.struct("_t", "_tie", "_take"), (F.col("_t"), F.col("_kind"), -F.col("_tie"))),
        "_next": Scan(
            "last", F.struct("_t", "_tie", "_take"), (-F.col("_t"), -F.col("_kind"), -F.col("_tie")), reverse=True
        ),
    }
    anchor_only = {
        name: Scan(s.op, F.when(F.col("_row").isNull(), s.value), s.order, s.reverse) for name, s in scans.items()
    }
    order = [F.col("_t"), F.col("_kind"), -F.col("_tie")]
    found = running_in_time(marked, keys, "_t", order, anchor_only, seconds, crowded).filter(F.col("_row").isNotNull())
    back = F.abs(F.col("_t") - F.col("_prev._t"))
    forth = F.abs(F.col("_next._t") - F.col("_t"))
    use_prev = F.col("_next").isNull() | (back < forth) | ((back == forth) & (F.col("_prev._tie") < F.col("_next._tie")))
    best = F.when(use_prev, F.col("_prev")).otherwise(F.col("_next"))
    return found.withColumn("_best", best).select(
        *keys,
        *[F.col(f"_row.{c}").alias(c) for c in points.columns if c not in keys],
        *[F.col(f"_best._take.{name}").alias(name) for name in take],
        F.abs(F.col("_t") - F.col("_best._t")).alias(distance),
    )


def _union(points, anchors, keys, at, t, take, tie, point_first):
    payload = [c for c in points.columns if c not in keys]
    marked_points = points.select(
        *keys,
        at.cast("double").alias("_t"),
        F.lit(0 if point_first else 1).alias("_kind"),
        F.struct(*payload).alias("_row"),
    )
    marked_anchors = anchors.select(
        *keys,
        t.cast("double").alias("_t"),
        F.lit(1 if point_first else 0).alias("_kind"),
        tie.cast("double").alias("_tie"),
        F.struct(*[c.alias(name) for name, c in take.items()]).alias("_take"),
    )
    return marked_points.unionByName(marked_anchors, allowMissingColumns=True)


def covering(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    seconds: float = TILE_SECONDS,
    how: str = "left",
) -> DataFrame:
    """Join points to the intervals with ``start <= at < end``, matched by (session, time tile)."""
    tiles = F.sequence(time_tile(start, seconds), time_tile(end, seconds))
    spread = intervals.filter(F.col(start) < F.col(end)).withColumn("_tile", F.explode(tiles))
    placed = points.withColumn("_tile", time_tile(at, seconds))
    p, i = placed.alias("p"), spread.alias("i")
    on = [F.col(f"p.{k}") == F.col(f"i.{k}") for k in [*keys, "_tile"]]
    on += [F.col(f"p.{at}") >= F.col(f"i.{start}"), F.col(f"p.{at}") < F.col(f"i.{end}")]
    extra = [c for c in intervals.columns if c not in keys]
    return p.join(i, on, how).select(
        *[F.col(f"p.{c}") for c in points.columns], *[F.col(f"i.{c}").alias(f"{c}_right" if c in points.columns else c) for c in extra]
    )


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str, fraction: float = 0.5, bucket: Column | None = None,
    upper: bool = False,
) -> DataFrame:
    """Exact percentile per key with linear interpolation, without holding a key's values in one task.

    Equal values are counted first; the running count over distinct values locates the two middle ranks. ``bucket``
    is a monotone coarsening of the value. ``upper`` takes the element at ``floor(n * fraction)`` instead.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(
        counted,
        keys,
        bucket if bucket is not None else F.floor(F.col(value)).cast("long"),
        [value],
        {"_upto": Scan("sum", F.col("_n")), "_all": Scan("sum", F.col("_n"), whole=True)},
    )
    below = F.col("_upto") - F.col("_n")

    def holds(rank: Column) -> Column:
        return (below <= rank) & (rank < F.col("_upto"))

    if upper:
        rank = F.floor(F.col("_all") * fraction)
        return ranked.filter(holds(rank)).select(*keys, F.col(value).alias(out))
    exact = (F.col("_all") - 1) * F.lit(fraction)
    low, high = F.floor(exact), F.ceil(exact)
    part = exact - low
    near = ranked.withColumn("_low", holds(low)).withColumn("_high", holds(high)).filter("_low or _high")
    return near.groupBy(*keys).agg(
        (
            F.max(F.when(F.col("_low"), F.col(value) * (1 - part)))
            + F.max(F.when(F.col("_high"), F.col(value) * part))
        ).alias(out)
    )
