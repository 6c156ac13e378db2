"""Tempo and section operators on literal fixtures and against loops."""

import random

import pytest
from pyspark.sql import functions as F

from metrum.operators import folds as D
from metrum.operators import sections as S
from metrum.operators import tempo as T
from tests.conftest import rows


def beats_of(frame, *sessions):
    data = [(s, i, float(t)) for s, times in enumerate(sessions) for i, t in enumerate(times)]
    return frame(data, "s long, idx long, t double")


def times(df, s=0):
    return [r.t for r in df.filter(F.col("s") == s).orderBy("idx").collect()]


def steps(start, *parts):
    out, t = [start], start
    for n, step in parts:
        for _ in range(n):
            t = round(t + step, 3)
            out.append(t)
    return out


def test_contiguous_ranges(frame):
    raw = frame([(0, 0, 1, 2), (0, 1, 1, 8), (0, 2, 10, 11)], "s long, idx long, start_bar long, end_bar long")
    out = S.contiguous_bars(raw.withColumn("total_bars", F.lit(12).cast("long")))
    assert rows(out.select("start_bar", "end_bar", "bar_count"), "start_bar") == [(1, 2, 2), (3, 8, 6), (9, 12, 4)]


@pytest.mark.parametrize("tile", [3, 4096])
def test_contiguous_ranges_match_a_loop(frame, tile):
    random.seed(3)
    data, want = [], {}
    for s in range(40):
        n, total = random.randint(1, 14), random.randint(1, 30)
        raw = [random.choice([None, 0, random.randint(1, 35)]) for _ in range(n)]
        data += [(s, i, None, e, total) for i, e in enumerate(raw)]
        if n > total:
            want[s] = [(None, e) for e in raw]
            continue
        start, ranges = 1, []
        for i, e in enumerate(raw):
            end = total if i == n - 1 else max(start, min(total - (n - i - 1), e or start))
            ranges.append((start, end))
            start = end + 1
        want[s] = ranges
        assert ranges[-1][1] == total
    df = frame(data, "s long, idx long, start_bar long, end_bar long, total_bars long")
    got = {}
    for r in S.contiguous_bars(df, rows=tile).orderBy("s", "idx").collect():
        got.setdefault(r.s, []).append((r.start_bar, r.end_bar))
    assert got == want


def test_double_time_is_promoted(frame):
    slow_then_fast = steps(0.0, (12, 0.68), (24, 0.34))
    data = T.Tempo(frame([(0, 88.0)], "s long, bpm double"), beats_of(frame, slow_then_fast), beats_of(frame, slow_then_fast[::4]))
    out = T.normalize_tempo(data)
    assert out.sessions.first().bpm == 176.0
    t = times(out.beats)
    assert max(abs(b - a - 0.34) for a, b in zip(t, t[1:])) < 0.0015


def test_steady_grid_is_left_alone(frame):
    steady = steps(0.0, (16, 0.68))
    data = T.Tempo(frame([(0, 88.0)], "s long, bpm double"), beats_of(frame, steady), beats_of(frame, steady[::4]))
    out = T.normalize_tempo(data)
    assert times(out.beats) == steady and out.sessions.first().bpm == 88.0


def test_sparse_lead_in_is_rebuilt(frame):
    sparse = steps(3.54, (10, 1.02), (24, 0.61))
    first_stable = sparse[10]
    data = T.Tempo(frame([(0, 98.0)], "s long, bpm double"), beats_of(frame, sparse), beats_of(frame, [first_stable + k * 4 * 0.61 for k in range(6)]))
    out = T.normalize_tempo(data)
    t = times(out.beats)
    assert all(abs(b - a - 0.61) < 0.0021 for a, b in zip(t, t[1:]))
    assert t[0] >= 3.54 - 0.61 * 1.05 - 1e-9 and t[0] - 0.61 < 3.54 - 0.61 * 1.05
    downbeats = times(out.downbeats)
    assert min(abs(d - first_stable) for d in downbeats) < 1e-6
    assert downbeats == t[t.index(downbeats[0]) :: 4]


def test_late_change_of_tempo_is_no_lead_in(frame):
    late = steps(0.0, (40, 0.9), (29, 0.61))
    data = T.Tempo(frame([(0, 98.0)], "s long, bpm double"), beats_of(frame, late), beats_of(frame, late[::4]))
    assert times(T.normalize_tempo(data).beats) == late


def test_expanding_keeps_every_beat(frame):
    random.seed(9)
    sessions = []
    for _ in range(12):
        t, out = 0.0, []
        for _ in range(random.randint(1, 60)):
            out.append(round(t, 3))
            t += random.choice([0.25, 0.5, 0.77, 2.0])
        sessions.append(out)
    filled = T.expand_beats(beats_of(frame, *sessions), F.lit(0.25), rows=7)
    for s, original in enumerate(sessions):
        want = [original[0]]
        for b in original[1:]:
            p, n = want[-1], max(1, round((b - want[-1]) / 0.25))
            want += [p + (b - p) * k / n for k in range(1, n + 1)]
        got = times(filled, s)
        assert got == pytest.approx(want, abs=0.00051)
        assert set(original) <= set(got)


def test_thinning(frame):
    grid = [float(x) for x in range(9)] + [8.5 + 0.5 * k for k in range(8)]
    beats, downbeats = D.thin_beats(beats_of(frame, grid), beats_of(frame, grid[:9:4]))
    assert times(beats) == [float(x) for x in range(13)]
    assert times(downbeats) == [0.0, 4.0, 8.0, 12.0]
    placed = S.place_sections(
        frame([(0, 0, "a", 0.0, 8.0), (0, 1, "b", 8.0, 12.0)], "s long, idx long, label string, start_time double, end_time double"),
        downbeats,
    )
    assert rows(placed.select("start_bar", "end_bar", "bar_count"), "start_bar") == [(1, 2, 2), (3, 4, 2)]


def test_thinning_across_tiles(frame):
    random.seed(1)
    grid = steps(0.0, (90, 1.0), (200, 0.5))
    whole = times(D.thin_beats(beats_of(frame, grid), beats_of(frame, [0.0]))[0])
    tiled = times(D.thin_beats(beats_of(frame, grid), beats_of(frame, [0.0]), rows=16)[0])
    assert whole == tiled and len(whole) < len(grid)


def test_bpm_factor_on_sections(frame):
    sections = frame([(0, 0, 1, 4), (0, 1, 5, 8)], "s long, idx long, start_bar long, end_bar long")
    sessions = frame([(0, 60.0, 8)], "s long, bpm double, total_bars long")
    beats = beats_of(frame, [float(x) for x in range(32)])
    double = T.apply_bpm_factor(sessions, beats, sections, 2.0)
    assert rows(double.sections.select("start_bar", "end_bar"), "start_bar") == [(1, 8), (9, 16)]
    assert double.sessions.first().total_bars == 16 and double.sessions.first().bpm == 120.0
    assert len(times(double.beats)) == 63 and times(double.beats)[:3] == [0.0, 0.5, 1.0]
    half = T.apply_bpm_factor(sessions, beats, sections.replace({4: 8, 5: 9, 8: 16}, subset=["start_bar", "end_bar"]), 0.5)
    assert rows(half.sections.select("start_bar", "end_bar"), "start_bar") == [(1, 4), (5, 8)]
    with pytest.raises(ValueError):
        T.apply_bpm_factor(sessions, beats, sections, 0)
    assert T.factor_steps(3) == (2, 1)


def labelled(frame, *labels):
    return frame([(0, i, l) for i, l in enumerate(labels)], "s long, idx long, label string")


def test_relabelling(frame):
    out = S.relabel_runs(labelled(frame, "intro", "verse", "Aメロ", "chorus"), rows=2)
    assert [r.new_label for r in out.orderBy("idx").collect()] == ["intro", "verse", "pre-chorus", "chorus"]
    assert [r.idx for r in out.filter("changed").collect()] == [2]
    same = S.relabel_runs(labelled(frame, "verse", "verse", "bridge"))
    assert same.filter("changed").count() == 0


def test_editing(frame):
    one = frame([(0, 0, "verse", 1, 4)], "s long, idx long, label string, start_bar long, end_bar long")
    edit = lambda at, what, value=0: frame([(0, at, what, value)], "s long, at_idx long, action string, value long")
    two = S.edit_sections(one, edit(0, "split"))
    assert rows(two.select("start_bar", "end_bar"), "start_bar") == [(1, 2), (3, 4)]
    assert rows(S.edit_sections(two, edit(0, "merge")).select("start_bar", "end_bar")) == [(1, 4)]
    assert rows(S.edit_sections(two, edit(0, "delete")).select("idx", "start_bar", "end_bar")) == [(0, 1, 4)]
    assert rows(S.edit_sections(two, edit(1, "delete")).select("start_bar", "end_bar")) == [(1, 4)]
    assert rows(S.edit_sections(two, edit(0, "boundary", 9)).select("start_bar", "end_bar"), "start_bar") == [(1, 3), (4, 4)]


def test_saving_sections(frame):
    edits = frame(
        [(0, " intro ", 1, 2), (0, "chorus", 3, 4), (1, "late", 2, 4)], "s long, label string, start_bar long, end_bar long"
    )
    sessions = frame([(0, 4, 4.0), (1, 4, 4.0)], "s long, total_bars long, duration double")
    saved, rejected = S.save_sections(edits, sessions, beats_of(frame, [0, 1, 2, 3], [0, 1, 2, 3]))
    got = rows(saved.select("label", "bar_count", "start_time", "end_time", "start_time_str"), "start_time")
    assert got == [("intro", 2, 0.0, 2.0, "00:00"), ("chorus", 2, 2.0, 4.0, "00:02")]
    assert rows(rejected) == [(1, "gap or overlap")]


def test_restore_and_first_edit(frame):
    schema = "s long, sections array<string>, automatic_sections array<string>, sections_edited_at string, new array<string>"
    fresh = frame([(0, ["a"], None, None, ["b"])], schema)
    edited = S.store_edit(fresh, "new", F.lit("now"))
    first = edited.first()
    assert first.sections == ["b"] and first.automatic_sections == ["a"]
    again = S.restore_sections(edited).first()
    assert again.sections == ["a"] and again.automatic_sections is None and again.sections_edited_at is None


def test_half_beat_shift_uses_the_upper_median(frame):
    out = T.half_beat_shift(beats_of(frame, [0.0, 1.0, 3.0]), rows=2)
    assert times(out) == [0.0, 0.0, 2.0]


def test_first_open_section(spark):
    """Sections in order, nested, overlapping, in no order, empty or without times, against a loop."""
    draw = random.Random(12)
    sections = [(0, k, float(k * 10), float(k * 10 + 10)) for k in range(6)]
    sections += [(1, 0, 0.0, 100.0), (1, 1, 10.0, 20.0), (1, 2, 30.0, 130.0), (1, 3, 40.0, 40.0), (1, 4, 150.0, 140.0), (1, 5, None, 9.0)]
    sections += [(2, k, *sorted((draw.randrange(60) / 2, draw.randrange(60) / 2))) for k in range(40)]
    sections += [(3, k, float(100 - k), float(101 - k)) for k in range(33)]
    points = [(s, i, t / 4) for s in range(5) for i, t in enumerate(range(-8, 640, 3))] + [(1, 999, None)]
    got = T.section_at(spark.createDataFrame(points, "s long, idx long, t double"), spark.createDataFrame(sections, "s long, idx long, start_time double, end_time double")).collect()
    want = {(s, i): next((k for q, k, a, b in sections if q == s and None not in (a, b, t) and a <= t < b), None) for s, i, t in points}
    assert len(got) == len(points) and {(r.s, r.idx): r.section for r in got} == want
