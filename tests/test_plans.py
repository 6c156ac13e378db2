"""The building blocks against plain loops, with tiles far smaller than a session and one session that dominates."""

import bisect
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from metrum.plans import ordered as O
from metrum.plans.fold import fold, fold_expr
from metrum.plans.strips import deal_packed, packed_positions


@pytest.fixture(scope="module")
def skewed(spark):
    """Session 0 holds two thirds of the rows."""
    random.seed(5)
    out = []
    for s, n in ((0, 400), (1, 90), (2, 60), (3, 37), (4, 1)):
        t = 0.0
        for i in range(n):
            out.append((s, i, round(t, 3), random.randint(-20, 50)))
            t += random.choice([0.0, 0.25, 0.5, 0.5, 3.0])
    return out


@pytest.fixture
def table(spark, skewed):
    return spark.createDataFrame(skewed, "s long, idx long, t double, v long").repartition(7)


def by_session(data):
    out = {}
    for s, idx, t, v in data:
        out.setdefault(s, []).append((idx, t, v))
    return out


def test_running_matches_loop(table, skewed):
    even = F.when(F.col("v") % 2 == 0, F.col("v"))
    scans = {
        "sum": O.Scan("sum", F.col("v")),
        "before": O.Scan("sum", F.col("v"), exclusive=True),
        "top": O.Scan("max", F.col("v")),
        "low_after": O.Scan("min", F.col("v"), (-F.col("idx"),), reverse=True),
        "last_even": O.Scan("last", even),
        "next_even": O.Scan("last", even, (-F.col("idx"),), reverse=True, exclusive=True),
        "n": O.Scan("count", F.lit(1), whole=True),
    }
    got = {(r.s, r.idx): r for r in O.running(table, ["s"], O.row_tile("idx", 8), ["idx"], scans).collect()}
    assert len(got) == len(skewed)
    for s, items in by_session(skewed).items():
        values = [v for _, _, v in items]
        for i, v in enumerate(values):
            r = got[s, i]
            evens = [x for x in values[: i + 1] if x % 2 == 0]
            later = [x for x in values[i + 1 :] if x % 2 == 0]
            assert r["sum"] == sum(values[: i + 1])
            assert (r.before or 0) == sum(values[:i])
            assert r.top == max(values[: i + 1])
            assert r.low_after == min(values[i:])
            assert r.last_even == (evens[-1] if evens else None)
            assert r.next_even == (later[0] if later else None)
            assert r.n == len(values)


def test_positions_match_row_number(table):
    placed = O.positions(table.drop("idx"), ["s"], ["t", "v"], O.time_tile("t", 10), "p")
    w = Window.partitionBy("s").orderBy("t", "v")
    bad = placed.withColumn("q", F.row_number().over(w) - 1)
    # Equal (t, v) pairs may swap; the multiset of positions per (s, t, v) must not.
    left = bad.groupBy("s", "t", "v").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sort_array(F.collect_list("q")).alias("q"))
    assert left.filter("cast(p as string) <> cast(q as string)").count() == 0


def test_halo_windows_cross_tiles(table, skewed):
    spread, w, owned = O.halo(table, ["s"], before=2, after=3, rows=4)
    got = spread.withColumn("x", F.sum("v").over(w.rowsBetween(-2, 3))).filter(owned)
    got = {(r.s, r.idx): r.x for r in got.collect()}
    for s, items in by_session(skewed).items():
        values = [v for _, _, v in items]
        for i in range(len(values)):
            assert got[s, i] == sum(values[max(0, i - 2) : i + 4])


@pytest.mark.parametrize("ahead", [True, False])
def test_asof_matches_bisect(spark, table, skewed, ahead):
    points = [(s, k, x * 0.37) for s in (0, 1, 2, 3, 4, 9) for k, x in enumerate(range(-3, 120))]
    df = spark.createDataFrame(points, "s long, k long, x double")
    found = O.asof(df, table, ["s"], F.col("x"), F.col("t"), {"hit": F.col("idx")}, F.col("idx"), 7.0, ahead, "n")
    data = by_session(skewed)
    got = found.collect()
    assert len(got) == len(points)
    for r in got:
        times = [t for _, t, _ in data.get(r.s, [])]
        if ahead:
            i = bisect.bisect_left(times, r.x)
            assert r.hit == (i if i < len(times) else None)
        else:
            i = bisect.bisect_right(times, r.x) - 1
            # The first of equal times.
            assert r.hit == (bisect.bisect_left(times, times[i]) if i >= 0 else None)
        assert (r.n or 0) == len(times)


def test_nearest_matches_min(spark, table, skewed):
    points = [(s, k, x * 0.37) for s in (0, 1, 2, 3, 4) for k, x in enumerate(range(-3, 120))]
    df = spark.createDataFrame(points, "s long, k long, x double")
    data = by_session(skewed)
    found = O.nearest(df, table, ["s"], F.col("x"), F.col("t"), {"hit": F.col("idx")}, F.col("idx"), 7.0)
    for r in found.collect():
        times = [t for _, t, _ in data[r.s]]
        assert r.hit == min(range(len(times)), key=lambda i: (abs(times[i] - r.x), i))


@pytest.fixture(scope="module")
def dense():
    """Session 0 has nearly all rows within one second, many of them of one moment; session 1 is spread out."""
    draw = random.Random(9)
    times = sorted([1000 + draw.random() for _ in range(900)] + [1000.5] * 60)
    return [(0, i, t) for i, t in enumerate(times)] + [(1, i, i * 40.0) for i in range(50)]


def test_crowded_tiles_are_cut(spark, dense):
    anchors = spark.createDataFrame(dense, "s long, idx long, t double")
    scans = {"n": O.Scan("count", F.lit(1))}
    tiled, totals = O.uncrowded(anchors, ["s"], "t", ["t", "idx"], scans, 3600.0, 80)
    sizes = {(r.s, r._tile): r._rows for r in totals.collect()}
    # No tile is above the bound, but for that of the one moment.
    assert sum(sizes.values()) == len(dense) and sorted(sizes.values())[-2] <= 80 and max(sizes.values()) <= 2 * 80
    assert {(r.s, r._tile): r["count"] for r in tiled.groupBy("s", "_tile").count().collect()} == sizes
    spans = tiled.groupBy("s", "_tile").agg(F.min("t").alias("a"), F.max("t").alias("b")).orderBy("s", "_tile").collect()
    assert all(x.b < y.a for x, y in zip(spans, spans[1:]) if x.s == y.s) and all(x._tile <= x.a for x in spans)
    ranked = O.running_in_time(anchors, ["s"], "t", ["t", "idx"], scans, 3600.0, 80).collect()
    assert all(r.n == r.idx + 1 for r in ranked) and len(ranked) == len(dense)


@pytest.mark.parametrize(("ahead", "strict"), [(True, False), (True, True), (False, False), (False, True)])
def test_asof_in_a_crowded_second(spark, dense, ahead, strict):
    draw = random.Random(4)
    points = [(s, k, draw.choice([1000 + draw.random(), 1000.5, 999.0, 1002.0, draw.randrange(50) * 40.0])) for s in (0, 1, 2) for k in range(300)]
    df = spark.createDataFrame(points, "s long, k long, x double")
    anchors = spark.createDataFrame(dense, "s long, idx long, t double")
    found = O.asof(df, anchors, ["s"], F.col("x"), F.col("t"), {"hit": F.col("idx")}, F.col("idx"), ahead=ahead, strict=strict, crowded=64).collect()
    assert len(found) == len(points)
    for r in found:
        times = [t for s, _, t in dense if s == r.s]
        if ahead:
            i = (bisect.bisect_right if strict else bisect.bisect_left)(times, r.x)
            assert r.hit == (i if i < len(times) else None)
        else:
            i = (bisect.bisect_left if strict else bisect.bisect_right)(times, r.x) - 1
            assert r.hit == (bisect.bisect_left(times, times[i]) if i >= 0 else None)


def test_nearest_in_a_crowded_second(spark, dense):
    points = [(0, k, 999.9 + k / 400) for k in range(500)]
    df = spark.createDataFrame(points, "s long, k long, x double")
    anchors = spark.createDataFrame(dense, "s long, idx long, t double")
    times = [t for s, _, t in dense if s == 0]
    found = O.nearest(df, anchors, ["s"], F.col("x"), F.col("t"), {"hit": F.col("idx")}, F.col("idx"), crowded=64).collect()
    assert len(found) == 500
    for r in found:
        assert r.hit == min(range(len(times)), key=lambda i: (abs(times[i] - r.x), i))


def test_covering_finds_all_intervals(spark, table, skewed):
    spans = [(s, k, a, a + w) for s in (0, 1, 2) for k, (a, w) in enumerate([(0, 30), (5, 0), (10.5, 1), (20, 200)])]
    df = spark.createDataFrame([(s, k, float(a), float(b)) for s, k, a, b in spans], "s long, k long, a double, b double")
    got = O.covering(table, df, ["s"], "t", "a", "b", 7.0, how="inner").select("s", "idx", "k").collect()
    want = {(s, i, k) for s, i, t, _ in skewed for q, k, a, b in spans if q == s and a <= t < b}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_exact_median(table, skewed):
    data = by_session(skewed)
    middle = {r.s: r.m for r in O.exact_median(table, ["s"], "v", "m").collect()}
    high = {r.s: r.m for r in O.exact_median(table, ["s"], "v", "m", 0.9).collect()}
    upper = {r.s: r.m for r in O.exact_median(table, ["s"], "v", "m", upper=True).collect()}
    for s, items in data.items():
        values = sorted(v for _, _, v in items)
        assert middle[s] == statistics.median(values)
        assert high[s] == pytest.approx(float(np.percentile(values, 90)))
        assert upper[s] == values[len(values) // 2]


def greedy(values, gap):
    kept, last = [], None
    for i, v in values:
        if last is None or v - last >= gap:
            kept.append(i)
            last = v
    return kept


@pytest.mark.parametrize("rows", [25, 4096])
def test_folds_equal_the_sequential_fold(table, skewed, rows):
    """A greedy thinning whose state is the last kept time, as pandas step and as expressions."""

    def step(pdf, state, last):
        prev = None if state is None else state[0]
        out = []
        for i, t in zip(pdf["idx"], pdf["t"]):
            if prev is None or t - prev >= 1.7:
                out.append(i)
                prev = t
        return pd.DataFrame({"idx": pd.Series(out, dtype="int64")}), [prev]

    def expr(state, row):
        keep = state.isNull() | (row["t"] - state >= 1.7)
        return F.when(keep, row["t"]).otherwise(state), F.when(keep, F.struct(row["idx"].alias("idx")))

    by_pandas = fold(table, ["s"], "idx", step, "idx long", rows)
    by_expr = fold_expr(table, ["s"], "idx", ["t"], "double", "struct<idx:bigint>", expr, rows=rows)
    want = {(s, i) for s, items in by_session(skewed).items() for i in greedy([(i, t) for i, t, _ in items], 1.7)}
    assert {tuple(r) for r in by_pandas.collect()} == want
    assert {tuple(r) for r in by_expr.collect()} == want


SMALL_JOINS = {"spark.sql.autoBroadcastJoinThreshold": "100k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.mark.parametrize("rows", [16, 4096])
def test_a_fold_of_scattered_sessions(spark, rows):
    """Sessions that lie in all partitions, with entries so few that Spark turns their join into a broadcast as it runs."""
    from metrum.operators import folds

    for name, value in SMALL_JOINS.items():
        spark.conf.set(name, value)
    idx = F.floor(F.col("id") / 500)
    bars = spark.range(500 * 40).select((F.col("id") % 500).alias("s"), idx.alias("idx"), (idx * 20.0).alias("x"), F.lit(None).cast("long").alias("recognized"))
    kept = folds.drop_close(bars, 60, rows)
    got = sorted(tuple(r) for r in kept.select("s", "idx", "x").collect())
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    for name in SMALL_JOINS:
        spark.conf.unset(name)
    assert got == [(s, i, i * 20.0) for s in range(500) for i in range(0, 40, 3)]
    # What is folded was dealt by tile right before, once, and sorted once.
    dealt = plan.split("Union")[0]
    assert dealt.count("Exchange hashpartitioning") == 1 and dealt.count("Sort [") == 1


def test_last_row_of_a_fold_comes_once(table, skewed):
    """``finish`` runs on the last tile only, with the state of the whole session."""

    def step(state, row):
        return F.coalesce(state, F.lit(0).cast("bigint")) + 1, F.lit(None).cast("struct<n:bigint>")

    counted = fold_expr(
        table, ["s"], "idx", ["v"], "bigint", "struct<n:bigint>", step, finish=lambda s: F.struct(s.alias("n")), rows=60
    )
    assert {r.s: r.n for r in counted.collect()} == {s: len(i) for s, i in by_session(skewed).items()}


def test_tiles_are_units_of_work(table):
    """The window of a running sum is partitioned by session and tile, never by session alone over raw rows."""
    df = O.running(table, ["s"], O.row_tile("idx", 8), ["idx"], {"x": O.Scan("sum", F.col("v"))})
    plan = df._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    by_session_alone = [line for line in exchanges if "_tile" not in line]
    # Only the one-row-per-tile summary is gathered by session.
    assert len(by_session_alone) == 1 and "HashAggregate" in plan.split(by_session_alone[0])[1]


@pytest.mark.parametrize("tiles", [1, 64])
def test_a_constant_session_settles_in_a_few_rounds(spark, monkeypatch, tiles):
    """Views that never change, pages of equal height and beats of equal distance, over many tiles of one session."""
    from metrum.operators import folds
    from metrum.plans import fold as plan

    rounds = []
    monkeypatch.setattr(plan, "durable", lambda df, real=plan.durable: rounds.append(1) or real(df))
    size = 10 * tiles
    frames = spark.range(size).select(F.lit(0).alias("s"), F.col("id").alias("idx"), F.array([F.lit(True)] * 8).alias("signature"))
    assert {(r.idx, r.head) for r in folds.group_views(frames, rows=10).collect()} == {(i, 0) for i in range(size)}
    # Three tables for each round of runs and two for each doubling; six doublings span 64 tiles.
    assert len(rounds) <= (2 if tiles == 1 else 3 + 2 * 3 + 2 * 7)
    rounds.clear()
    lines = spark.range(size).select(F.lit(0).alias("s"), F.col("id").alias("idx"), F.lit(1.0).alias("height"))
    pages = {r.idx: r.page_start for r in folds.pack_pages(lines, 3.0, rows=10).collect()}
    assert pages == {i: i - i % 3 for i in range(size)}
    assert len(rounds) <= (2 if tiles == 1 else 3 + 2 * 5 + 2 * 7)
    rounds.clear()
    bars = spark.range(size).select(F.lit(0).alias("s"), F.col("id").alias("idx"), (F.col("id") * 20.0).alias("x"), F.lit(None).cast("string").alias("recognized"))
    kept = sorted(r.idx for r in folds.drop_close(bars, 60, rows=10).collect())
    assert kept == list(range(0, size, 3)) and len(rounds) <= (2 if tiles == 1 else 3 + 2 * 5 + 2 * 7)


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("kind", ["long", "double", "int"])
def test_packed_positions_are_positions(spark, frame, kind, batch):
    """Rows of any place and value, null ones too; those of unknown place come last."""
    rng = random.Random(3)
    value = (lambda: rng.random() - 0.5) if kind == "double" else (lambda: rng.choice([0, -1, 300, -(2**31), 2**31 - 1] + [2**62 + 1] * (kind == "long")))
    data = [
        (s, track, rng.choice([rng.randint(0, 5000), -7, None]), n, None if rng.random() < 0.2 else value())
        for s, size in ((1, 700), (2, 1), (-5, 90)) for track in "ab" for n in range(size)
    ]
    rng.shuffle(data)
    rows = frame([*data, (None, "a", 1, 1, value())], f"s long, track string, at long, n long, v {kind}").repartition(5)
    bucket = O.row_tile("at", 100)
    want, sizes = [], {}
    for s, track, at, n, v in sorted(data, key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3])):
        want.append((s, track, sizes.get((s, track), 0), v))
        sizes[s, track] = want[-1][2] + 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        packed = packed_positions(rows, ["s", "track"], ["at", "n"], bucket, "v")
        got = sorted(packed.collect(), key=lambda r: r[:3])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [tuple(r) for r in got] == want


def test_packed_rows_are_dealt_whole(spark, frame):
    """All rows arrive, of any type, and those of a key in one partition."""
    rows = spark.range(30_000).selectExpr("id", "id % 97 AS k", "if(id % 5 = 0, null, cast(id as string)) AS name", "id / 7 AS part", "date_add(DATE'2020-01-01', int(id % 900)) AS day")
    dealt = deal_packed(rows, ["k"])
    assert dealt.schema == rows.schema and dealt.exceptAll(rows).isEmpty() and dealt.count() == 30_000
    places = dealt.select("k", F.spark_partition_id().alias("p")).distinct()
    assert places.count() == 97
