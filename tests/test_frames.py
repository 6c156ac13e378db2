"""Frames, measures, harmony and signals on literal fixtures and against loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrum.functions import scalars as X
from metrum.functions.fixed import MAJOR_PROFILE, MINOR_PROFILE
from metrum.operators import folds as D
from metrum.operators import frames as R
from metrum.operators import harmony as H
from metrum.operators import ranges as G
from metrum.operators import signal as S
from tests.conftest import rows


def masks(n, seed=0, cells=64, density=0.5):
    rng = np.random.default_rng(seed)
    return [[bool(x) for x in rng.random(cells) < density] for _ in range(n)]


def similar_run(seed, lengths, cells=64):
    """Runs of equal masks, with one cell flipped now and then."""
    rng = random.Random(seed)
    out = []
    for mask, n in zip(masks(len(lengths), seed, cells), lengths):
        for _ in range(n):
            copy = list(mask)
            if rng.random() < 0.3:
                k = rng.randrange(cells)
                copy[k] = not copy[k]
            out.append(copy)
    return out


def frames_of(frame, *sessions):
    return frame([(s, i, m) for s, seq in enumerate(sessions) for i, m in enumerate(seq)], "s long, idx long, signature array<boolean>")


def heads(sequence, threshold):
    out, head = [], 0
    for i, m in enumerate(sequence):
        if i and (len(m) != len(sequence[head]) or np.mean(np.array(m) != np.array(sequence[head])) > threshold):
            head = i
        out.append(head)
    return out


@pytest.mark.parametrize("tile", [8, 2048])
def test_views_match_a_loop(frame, tile):
    sessions = [similar_run(k, [3, 1, 9, 2, 14, 1, 5], 64) for k in range(3)] + [masks(40, 7), masks(3, 1) + masks(2, 2, 60) + masks(3, 1)]
    got = {}
    for r in D.group_views(frames_of(frame, *sessions), 0.02, tile).orderBy("s", "idx").collect():
        got.setdefault(r.s, []).append(r.head)
    assert got == {s: heads(seq, 0.02) for s, seq in enumerate(sessions)}
    kept = D.keep_distinct(frames_of(frame, *sessions), 0.02, tile)
    assert kept.count() == sum(len(set(h)) for h in got.values())


def pan(n, step=6, width=64):
    strip = np.random.default_rng(4).random(width + step * n) < 0.5
    return [[bool(x) for x in strip[k * step : k * step + width]] for k in range(n)]


def test_a_frame_in_motion_is_dropped(frame):
    moving = pan(3)
    sequence = [moving[0]] * 3 + [moving[1]] + [moving[2]] * 3
    kept, rejected = R.drop_transitions(frames_of(frame, sequence))
    assert sorted(r.idx for r in kept.collect()) == [0, 1, 2, 4, 5, 6]
    assert rows(rejected) == [(0, 1)]
    still = [moving[0]] * 3 + masks(1, 99) + [moving[2]] * 3
    assert R.drop_transitions(frames_of(frame, still))[1].count() == 0


def test_best_shift_finds_the_pan(frame):
    out = R.best_shift(frames_of(frame, pan(4), masks(3, 5))).orderBy("s", "idx").collect()
    assert [(r.offset, r.difference) for r in out if r.s == 0] == [(6, 0.0)] * 3 + [(None, None)]
    assert all(r.offset is None for r in out if r.s == 1)


@pytest.mark.parametrize("pan", [0, 5, 20, 35, 40])
def test_best_shift_of_tall_masks(frame, pan):
    """Rows move together; a row that is a line in one of the frames says nothing; cells don't run into the next row."""
    rng = np.random.default_rng(pan)
    strip = rng.random((12, 110)) < 0.2
    left, right = strip[:, :64].copy(), strip[:, pan : pan + 64].copy()
    left[1] = True
    right[2] = rng.random(64) < 0.9
    sequence = [[bool(x) for x in m.ravel()] for m in (left, right)]
    out = R.best_shift(frames_of(frame, sequence), width=64).orderBy("idx").collect()
    assert (out[0].offset, out[0].difference) == (pan, 0.0) and out[1].offset is None


def test_edge_overlap_prefers_the_smallest_good_width(frame):
    rng = np.random.default_rng(2)
    strip = rng.random((8, 120)) < 0.12
    left, right = strip[:, :70], strip[:, 50:120]
    flat = lambda m: [bool(x) for x in m.ravel()]
    out = R.edge_overlap(frames_of(frame, [flat(left), flat(right)]), 70, minimum=10, maximum=30, features=8).orderBy("idx").collect()
    width = 70

    def unmatched(size):
        a, b = left[:, width - size :], right[:, :size]
        return D.unmatched_np(a, b, 8)

    scores = {k: unmatched(k) for k in range(10, 31)}
    best = min(scores.values())
    want = min(k for k, v in scores.items() if v <= min(0.22, best + 0.025))
    assert out[0].overlap == want and out[0].difference == pytest.approx(best)
    assert out[1].overlap is None


def overlap_loop(frames, width, vertical=False):
    kept = []
    for measures in frames:
        drop = 0
        for count in range(min(4 if vertical else 6, len(kept), len(measures)), 0 if vertical else 1, -1):
            d = [D.unmatched_np(np.array(a).reshape(-1, width), np.array(b).reshape(-1, width)) for (_, _, a), (_, _, b) in zip(kept[-count:], measures)]
            limit = 0.18 if vertical else 0.075 if count == 2 else 0.12
            if max(d) <= limit and (vertical or np.mean(d) <= 0.8 * limit):
                drop = count
                break
        kept += measures[drop:]
    return [(f, i) for f, i, _ in kept]


@pytest.mark.parametrize("tile", [3, 2048])
@pytest.mark.parametrize("vertical", [False, True])
def test_overlaps_match_a_loop(frame, tile, vertical):
    rng = random.Random(8)
    # Sparse masks: dense ones all count as equal once each cell may move by one.
    pool = masks(40, 21, 256, 0.08)
    data, want = [], {}
    for s in range(3):
        at, frames = 0, []
        for f in range(10):
            frames.append([(f, i, pool[(at + i) % 40]) for i in range(4)])
            at += rng.choice([0, 1, 2, 3, 4, 6])
        want[s] = overlap_loop(frames, 16, vertical)
        data += [(s, f, i, None, m) for part in frames for f, i, m in part]
    df = frame(data, "s long, frame_idx long, local_idx long, label long, signature array<boolean>")
    got = {}
    for r in D.drop_overlap(df, 16, vertical, tile).orderBy("s", "frame_idx", "local_idx").collect():
        got.setdefault(r.s, []).append((r.frame_idx, r.local_idx))
    assert got == want


def test_printed_numbers_remove_repeats(frame):
    pool = masks(12, 3)
    data = [(0, f, i, n, pool[n]) for f, part in enumerate([(1, 2, 3, 4), (3, 4, 5, 6)]) for i, n in enumerate(part)]
    df = frame(data, "s long, frame_idx long, local_idx long, label long, signature array<boolean>")
    kept = D.drop_overlap(df, 8)
    assert sorted(r.label for r in kept.collect()) == [1, 2, 3, 4, 5, 6]
    summary, sources = R.dedup_audit(df, kept)
    assert summary.first().removed == 2 and sources.count() == 6


def test_number_signatures_come_first(frame):
    """Measures look different, but the numbers above them repeat in the first two of the second frame."""
    looks, numbers = masks(8, 31, 256, 0.08), masks(6, 32, 256, 0.06)
    shown = [(0, 0, 0), (0, 1, 1), (0, 2, 2), (0, 3, 3), (1, 0, 2), (1, 1, 3), (1, 2, 4), (1, 3, 5)]
    data = [(0, f, i, None, looks[k], numbers[n]) for k, (f, i, n) in enumerate(shown)]
    schema = "s long, frame_idx long, local_idx long, label long, signature array<boolean>, number_signature array<boolean>"
    df = frame(data, schema)
    kept = D.drop_overlap(df, 16, rows=1)
    assert rows(kept.select("frame_idx", "local_idx"), "frame_idx", "local_idx") == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]
    assert D.drop_overlap(df.drop("number_signature"), 16).count() == 8


def test_numbers_are_filled_only_when_they_fit(frame):
    labels = [None, None, 3, None, None, 6, None, 9, None]
    df = frame([(0, i, n) for i, n in enumerate(labels)] + [(1, i, None) for i in range(3)], "s long, idx long, label long")
    got = R.fill_numbers(df, rows=2).orderBy("s", "idx").collect()
    assert [r.number for r in got if r.s == 0] == [1, 2, 3, 4, 5, 6, None, 9, None]
    assert [r.number for r in got if r.s == 1] == [1, 2, 3]


def close_loop(lines, width):
    lines = list(lines)
    while True:
        for i, ((a, known_a), (b, known_b)) in enumerate(zip(lines, lines[1:])):
            if b - a < width:
                del lines[i if known_b and not known_a else i + 1]
                break
        else:
            return [x for x, _ in lines]


@pytest.mark.parametrize("tile", [4, 4096])
def test_close_barlines_match_a_loop(frame, tile):
    rng = random.Random(6)
    data, want = [], {}
    for s in range(8):
        xs = sorted(rng.sample(range(1200), rng.randint(1, 25)))
        known = [rng.random() < 0.4 for _ in xs]
        data += [(s, i, float(x), 1 if k else None) for i, (x, k) in enumerate(zip(xs, known))]
        want[s] = close_loop(zip(xs, known), 60)
    df = frame(data, "s long, idx long, x double, recognized long")
    got = {}
    for r in D.drop_close(df, 60, tile).orderBy("s", "x").collect():
        got.setdefault(r.s, []).append(r.x)
    assert got == want


@pytest.mark.parametrize("tile", [5, 4096])
def test_pages_match_a_loop(frame, tile):
    rng = random.Random(2)
    heights = [[rng.choice([30.0, 80.0, 500.0]) for _ in range(n)] for n in (33, 1, 12)]
    want = {}
    for s, hs in enumerate(heights):
        page, used, pages = 0, 0.0, []
        for i, h in enumerate(hs):
            if i and used + h > 200:
                page, used = page + 1, 0.0
            pages.append(page)
            used += h
        want[s] = pages
    df = frame([(s, i, h) for s, hs in enumerate(heights) for i, h in enumerate(hs)], "s long, idx long, height double")
    got = {}
    for r in D.pack_pages(df, 200, rows=tile).orderBy("s", "idx").collect():
        got.setdefault(r.s, []).append(r.page)
    assert got == want


def test_pages_of_odd_heights_are_folded_once(frame):
    """Rows of no or unknown height, in pages of three at most; pages are numbered by the scan that fills in their starts."""
    heights = [5.0, 5.0, 1.0, None, 9.0, 9.0, 9.0, float("nan"), 1.0, 2.0, 50.0, 1.0]
    df = frame([(0, i, h) for i, h in enumerate(heights)], "s long, idx long, height double")
    packed = D.pack_pages(df, 10.0, 3, rows=4)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    got = [(r.page_start, r.page, r.sheet) for r in packed.orderBy("idx").collect()]
    starts = [0, 0, 2, 2, 2, 5, 6, 7, 8, 8, 10, 11]
    assert [p for p, _, _ in got] == starts
    numbers = {p: k for k, p in enumerate(sorted(set(starts)))}
    assert [(n, t) for _, n, t in got] == [(numbers[p], numbers[p] // 2) for p in starts]
    assert packed.columns == ["s", "page_start", "idx", "page", "sheet"] and "collect_list" not in plan


def test_regular_groups_deal_rows_once(frame):
    values = [0, 10, 20, 31, 70, 80, 90, 100, 105, 118]
    df = frame([(0, i, v) for i, v in enumerate(values)], "s long, idx long, value long")
    for tile in (2, 4096):
        groups = R.regular_groups(df, 4, 6, 36, 1.6, rows=tile)
        plan = groups._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.idx for r in groups.collect()) == [0, 4] and plan.count("hashpartitioning(") == 1


def cut_loop(ink, marks, frame_width):
    width = len(ink)
    quiet = np.convolve(np.array(ink, dtype=float), np.ones(7), mode="same")
    pieces, start, out = max(1, int(np.rint(width / frame_width))), 0, []
    for part in range(pieces):
        left = pieces - part
        target = int(np.rint((width - start) / left))
        ideal = min(width, start + target)
        near = [x for x in marks if start + np.rint(target * 0.65) <= x <= start + np.rint(target * 1.08)]
        if left == 1:
            end = width
        elif near:
            end = min(near, key=lambda x: abs(x - ideal))
        elif ideal >= width:
            end = width
        else:
            low = min(ideal, start + max(32, int(np.rint(target * 0.82))))
            high = min(width - 1, start + target)
            end = low + int(np.argmin(quiet[low : high + 1]))
        end = end if end > start else min(width, start + target)
        out.append((start, int(end)))
        start = end
    return out


@pytest.mark.parametrize("tile", [97, 1 << 16])
def test_cuts_match_a_loop(frame, tile):
    rng = random.Random(4)
    ink_rows, mark_rows, want = [], [], {}
    for s, width in enumerate((900, 130, 610)):
        ink = [rng.randint(0, 9) for _ in range(width)]
        marks = sorted(rng.sample(range(width), 4 if s else 0))
        ink_rows += [(s, i, a) for i, a in enumerate(ink)]
        mark_rows += [(s, x) for x in marks]
        want[s] = cut_loop(ink, marks, 150)
    out = D.split_at_boundaries(frame(ink_rows, "s long, idx long, amount long"), frame(mark_rows, "s long, x long"), 150, tile)
    got = {}
    for r in out.orderBy("s", "part").collect():
        got.setdefault(r.s, []).append((r.start, r.end))
    assert got == want


@pytest.mark.parametrize("batch", [7, 10_000])
@pytest.mark.parametrize("kind", ["negative", "wide", "double", "null"])
def test_cuts_of_packed_columns(spark, frame, monkeypatch, kind, batch):
    """Amounts of any size, sign and kind, in no order; columns without one count nothing, and last where none near has one."""
    rng = random.Random(9)
    draw = {
        "negative": lambda i: rng.randint(-300, 100), "wide": lambda i: rng.choice([-1, 1]) * rng.randint(0, 2**40),
        "double": lambda i: rng.randint(0, 80) / 8, "null": lambda i: None if 120 < i < 200 or rng.random() < 0.3 else rng.randint(0, 9),
    }[kind]
    rows, mark_rows, want = [], [(0, None), (0, -1), (0, 900), (0, 5000), (None, 3), (7, 4)], {}
    for s, width in enumerate((900, 131, 48)):
        ink, marks = [draw(i) for i in range(width)], sorted(rng.sample(range(width), 3)) if s else []
        quiet = [[a for a in ink[max(0, i - 3) : i + 4] if a is not None] for i in range(width)]
        with monkeypatch.context() as patch:
            # Exact sums, of known amounts only.
            patch.setattr(np, "convolve", lambda *_, mode: np.array([sum(q) if q else np.inf for q in quiet]))
            want[s] = cut_loop(ink, marks, 150)
        rows += [(s, i, a) for i, a in enumerate(ink)]
        mark_rows += [(s, x) for x in marks * 2]
    rng.shuffle(rows)
    ink, marks = frame(rows, f"s long, idx long, amount {'double' if kind == 'double' else 'long'}"), frame(mark_rows, "s long, x long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for tile in (97, 1 << 16):
            got = {}
            for r in D.split_at_boundaries(ink, marks, 150, tile).orderBy("s", "part").collect():
                got.setdefault(r.s, []).append((r.start, r.end))
            assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# --- harmony -------------------------------------------------------------------------------------------------


def test_key_of_a_rolled_profile(frame):
    data = [(0, (k + 2) % 12, w) for k, w in enumerate(MAJOR_PROFILE)] + [(1, (k + 9) % 12, w) for k, w in enumerate(MINOR_PROFILE)]
    data += [(2, k, 1.0) for k in range(12)] + [(3, 0, 0.0)]
    out = {r.s: r for r in H.estimate_key(frame(data, "s long, pitch_class long, weight double")).collect()}
    assert out[0].key == "D Major" and out[0].scale == "D Major / B Natural Minor"
    assert out[1].key == "A Minor" and out[1].scale == "A Natural Minor / C Major"
    assert out[2].key is None and out[2].confidence == 0.0 and out[3].key is None


def test_chords(frame):
    shapes = [{0: 2, 1: 3, 2: 2, 3: 0, 4: 0, 5: 2}, {0: 3, 1: 0, 2: 0, 4: 2, 5: 3}, {0: 3}]
    data = [(s, string, fret) for s, shape in enumerate(shapes) for string, fret in shape.items()]
    out = {r.s: r for r in H.infer_chords(frame(data, "s long, string long, fret long")).collect()}
    assert out[0].label == "D/F#" and out[0].confidence > 0.4
    assert out[1].label == "G" and out[2].label is None and out[2].confidence == 0.0


def test_degrees_in_g(frame):
    chords = frame([(c,) for c in ("G", "Am", "Bm", "C", "D", "Em", "F#dim", "N.C.")], "c string")
    got = [r[0] for r in chords.select(X.degree("c", F.lit(7))).collect()]
    assert got == ["I", "ii", "iii", "IV", "V", "vi", "vii°", None]


# --- signals and ranges --------------------------------------------------------------------------------------


def test_peaks(frame):
    samples = [0, 0.1, -0.2, 0.4, -0.8, 0.2, -0.1, 0]
    df = frame([(0, "x", i, float(v)) for i, v in enumerate(samples)], "s long, track string, idx long, sample double")
    peaks = [r.peak for r in S.waveform_peaks(df, 4).orderBy("bucket").collect()]
    assert max(peaks) == 1.0 and peaks[2] > peaks[0]
    more = S.waveform_peaks(df, 20).count()
    assert more == 20


def test_mix(frame):
    tracks = frame([(0, t, i, 1.0) for t in ("vocals", "bass", "drums") for i in range(40)], "s long, track string, idx long, sample double")
    gains = frame([("vocals", 0.8), ("bass", 0.5), ("drums", 0.0)], "track string, gain double")
    out = S.mix_tracks(tracks, gains, rate=2.0, start=12.5, end=20.0, limit=2.0)
    assert out.count() == 15 and out.agg(F.min("idx"), F.max("idx")).first()[0] == 0
    assert out.filter("abs(sample - 1.3) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        S.mix_tracks(tracks, gains, start=2.0, end=1.0)


def test_mix_does_not_deal_samples_by_track(spark, frame):
    """Two tracks would be two tasks."""
    tracks = frame([(s, t, i, 0.5) for s in range(3) for t in "ab" for i in range(4)], "s long, track string, idx long, sample double")
    gains = tracks.select("track").distinct().withColumn("gain", F.lit(0.5))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        loud = S.mix_tracks(tracks, gains)
        plan = loud._jdf.queryExecution().executedPlan().toString()
        assert [r.sample for r in loud.collect()] == [0.5] * 12
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_ranges_and_ids(frame):
    df = frame([("abc123", 30.5, 95.0), ("abc123", 0.0, None), ("abc123", 60.0, 30.0), ("x", -1.0, None)], "id string, start_sec double, end_sec double")
    good, bad = G.normalize_ranges(df)
    assert sorted(r[0] for r in good.select(X.session_id("id", "start_sec", "end_sec")).collect()) == ["abc123", "abc123-clip-30500-95000"]
    assert sorted(r.reason for r in bad.collect()) == ["empty", "negative"]


def test_trimming_keeps_at_least_one_row(frame):
    df = frame([(0, i) for i in range(5)] + [(1, 0), (1, 1)], "s long, idx long")
    kept, rejected = G.trim_edges(df, 1, 1, tile=2)
    assert rows(kept.select("s", "idx"), "idx") == [(0, 1), (0, 2), (0, 3)] and rows(rejected) == [(1,)]


def test_settings(frame):
    df = frame([(0, {"loop": "1", "secret": "x", "bpmFactor:a": "2"}), (1, {"stemMix": "y" * 300_000})], "id long, settings map<string,string>")
    kept, rejected = G.filter_settings(df)
    assert kept.first().settings == {"loop": "1", "bpmFactor:a": "2"} and rejected.first().id == 1


def test_texts(frame):
    df = frame([(1536.0, 59.6, "ok")], "n double, x double, t string")
    row = df.select(
        X.human_bytes("n").alias("b"), X.clock_long("x").alias("c"), X.duration_text(F.lit(3725.0)).alias("d"),
        X.video_id(F.lit("https://youtu.be/abc")).alias("v"), X.video_id(F.lit("https://m.youtube.com/watch?v=q&x=1")).alias("w"),
        X.localize_label(F.lit("Verse 2")).alias("l"), X.parse_time(F.lit("1:02:03.5")).alias("p"), X.safe_export_name(F.lit("a/b.MP3")).alias("e"),
    ).first()
    assert (row.b, row.c, row.d, row.v, row.w, row.l, row.e) == ("1.50 KB", "1:00", "1時間 2分 5秒", "abc", "q", "Aメロ 2", "a b.MP3")
    assert row.p.seconds == 3723.5 and not row.p.error


def test_views_of_any_size(spark):
    """Heads of runs of masks of 0 to 200 cells, sizes mixed, over small tiles, against a loop."""
    import random

    draw = random.Random(8)
    masks, mask = [], [False] * 70
    for k in range(120):
        if draw.random() < 0.15:
            mask = [draw.random() < 0.5 for _ in range(draw.choice([0, 1, 63, 64, 65, 128, 200, len(mask)]))]
        mask = [not x if draw.random() < 0.02 else x for x in mask]
        masks.append(mask)
    rows = [(s, k, m) for s in (0, 1) for k, m in enumerate(masks if s == 0 else masks[:1])]
    got = {(r.s, r.idx): r.head for r in D.group_views(spark.createDataFrame(rows, "s long, idx long, signature array<boolean>"), 0.05, 16).collect()}
    head = 0
    for k, m in enumerate(masks):
        held = masks[head]
        share = sum(a != b for a, b in zip(m, held)) / max(1, len(held)) if len(m) == len(held) else 1.0
        head = k if share > 0.05 else head
        assert got[0, k] == head
    assert got[1, 0] == 0 and len(got) == 121


def test_correlations_equal_slices():
    """All shifts and all edge overlaps at once, against crops compared one by one."""
    draw = np.random.default_rng(3)
    for _ in range(40):
        n, rows, width = draw.integers(1, 6), draw.integers(1, 9), draw.integers(26, 90)
        view = draw.random((n, rows, 2 * width)) < draw.choice([0.02, 0.1, 0.4])
        a, b = view[:, :, :width], view[:, :, (at := draw.integers(0, width)) : at + width]
        common = np.stack([np.count_nonzero(a[:, :, k:] & b[:, :, : width - k], axis=(1, 2)) for k in range(width)], axis=1)
        assert (R.correlated(a, b) == common).all()
        shares = []
        for size in range(4, width + 1):
            left, right = a[:, :, width - size :], b[:, :, :size]
            total = left.sum(axis=(1, 2)) + right.sum(axis=(1, 2))
            alone = (left & ~D.dilate_np(right)).sum(axis=(1, 2)) + (right & ~D.dilate_np(left)).sum(axis=(1, 2))
            shares.append(np.where(total < 3, np.inf, alone / np.maximum(total, 1)))
        table = np.stack(shares)
        best = table.min(axis=0)
        sizes, difference = R._overlap_matcher(int(width), 4, int(width), 3, None, 0.9)(a.reshape(n, -1), b.reshape(n, -1))
        found = best <= 0.9
        assert (sizes == 4 + (table <= np.minimum(0.9, best + 0.025)).argmax(axis=0))[found].all()
        assert (difference == best)[found].all() and np.isnan(difference[~found]).all()


def test_merge_close_over_many_tiles(frame):
    """Runs across small tiles, equal and missing values, against a loop; rows are shuffled by tile and by run only."""
    draw = random.Random(5)
    data = [(s, draw.choice([None, *range(-200, 200, 1 + s)])) for s in range(3) for _ in range(60 + 300 * s)]
    got = R.merge_close(frame(data, "s long, value long"), 4, "last", span=16)
    want = []
    for s in range(3):
        held = []
        for x in sorted({x for k, x in data if k == s and x is not None}):
            if held and x - held[-1][-1] <= 4:
                held[-1].append(x)
            else:
                held.append([x])
        want += [(s, k, run[-1], len(run)) for k, run in enumerate(held)]
    assert rows(got.select("s", "run", "value", "n"), "s", "run") == want
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 5
