"""Beats, bars and sections on the event and conversation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrum.operators import sections as S
from metrum.operators import tempo as T
from metrum.queries.registry import query
from metrum.queries.views import Views

# --- lookups -------------------------------------------------------------------------------------------------


@query("intervals", "SELECT s, idx, t, lead(t) OVER (PARTITION BY s ORDER BY idx) - t AS iv FROM v_grid")
def _(v: Views):
    return T.intervals(v.grid)


def bar_sql(points: str, at: str, downbeats: str = "v_downbeats") -> str:
    """Bar numbers of ``points(s, pid, at)``."""
    return f"""
        SELECT p.s, p.pid, coalesce(min(d.idx) + 1, max(n.n), 0) AS bar
        FROM {points} p
        LEFT JOIN {downbeats} d ON d.s = p.s AND d.t >= p.{at} - 0.1
        LEFT JOIN (SELECT s, count(*) AS n FROM {downbeats} GROUP BY s) n ON n.s = p.s
        GROUP BY p.s, p.pid"""


@query(
    "time_to_bar",
    f"""
    WITH points AS (SELECT s, idx AS pid, t * 1.03 + 0.2 AS t FROM v_grid),
    found AS ({bar_sql('points', 't')})
    SELECT p.s, p.pid, p.t, f.bar FROM points p JOIN found f ON f.s = p.s AND f.pid = p.pid""",
)
def _(v: Views):
    points = v.grid.select("s", F.col("idx").alias("pid"), (F.col("t") * 1.03 + 0.2).alias("t"))
    return T.time_to_bar(points, v.downbeats)


@query(
    "next_beat",
    """
    WITH points AS (SELECT s, idx AS pid, t * 1.01 + 0.013 AS t FROM v_downbeats),
    n AS (SELECT s, count(*) AS n FROM v_grid GROUP BY s)
    SELECT p.s, p.pid, p.t, coalesce(min(b.idx), max(n.n)) AS next_idx
    FROM points p LEFT JOIN v_grid b ON b.s = p.s AND b.t >= p.t - 0.02 JOIN n ON n.s = p.s
    GROUP BY p.s, p.pid, p.t""",
)
def _(v: Views):
    points = v.downbeats.select("s", F.col("idx").alias("pid"), (F.col("t") * 1.01 + 0.013).alias("t"))
    return T.next_beat(points, v.grid)


@query(
    "beats_due",
    """
    WITH points AS (SELECT s, idx, t FROM v_downbeats)
    SELECT b.s, b.idx, b.t, min(p.idx) AS point
    FROM v_grid b JOIN points p ON p.s = b.s AND p.t + 0.055 >= b.t GROUP BY b.s, b.idx, b.t""",
)
def _(v: Views):
    return T.beats_due(v.downbeats, v.grid, 0.055)


@query(
    "section_at",
    """
    SELECT b.s, b.idx, b.t, min(c.idx) AS section
    FROM v_grid b LEFT JOIN v_timed_sections c ON c.s = b.s AND b.t >= c.start_time AND b.t < c.end_time
    GROUP BY b.s, b.idx, b.t""",
)
def _(v: Views):
    return T.section_at(v.grid, v.timed_sections)


@query(
    "nearest",
    """
    WITH points AS (SELECT s, idx, t * 1.07 AS t FROM v_downbeats)
    SELECT p.s, p.idx, p.t, min_by(b.idx, {'d': abs(b.t - p.t), 'i': b.idx}) AS nearest_idx,
           min(abs(b.t - p.t)) AS distance
    FROM points p JOIN v_grid b ON b.s = p.s GROUP BY p.s, p.idx, p.t""",
)
def _(v: Views):
    return T.nearest_beat(v.downbeats.withColumn("t", F.col("t") * 1.07), v.grid)


@query(
    "nearest_within",
    """
    WITH points AS (SELECT s, idx, t FROM v_grid),
    best AS (SELECT p.s, p.idx, p.t, min_by(b.idx, {'d': abs(b.t - p.t), 'i': b.idx}) AS nearest_idx,
                    min(abs(b.t - p.t)) AS distance
             FROM points p JOIN v_downbeats b ON b.s = p.s GROUP BY p.s, p.idx, p.t)
    SELECT * FROM best WHERE distance <= 0.6""",
)
def _(v: Views):
    return T.nearest_within(v.grid, v.downbeats, "t", 0.6)


# --- repair --------------------------------------------------------------------------------------------------

FLAG_SQL = """
    flag_iv AS (SELECT s, idx, lead(t) OVER (PARTITION BY s ORDER BY idx) - t AS iv FROM v_grid),
    flag_med AS (SELECT s, idx, median(iv) OVER w AS m, count(iv) OVER w AS c FROM flag_iv
                 WINDOW w AS (PARTITION BY s ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    flags AS (SELECT s, count(*) >= 24 AND count(*) FILTER (c = 8 AND m BETWEEN 0.5 * 0.35 AND 0.5 * 0.65) >= 4
                     AS double_time FROM flag_med GROUP BY s)"""


@query("double_time_flag", f"WITH {FLAG_SQL} SELECT s, double_time FROM flags")
def _(v: Views):
    return T.double_time_flag(v.grid, v.tempo)


def expand_sql(name: str, beats: str, target: str) -> str:
    """CTEs that end in ``name(s, idx, t)``; ``target`` may use columns of ``beats``."""
    return f"""
    {name}_gap AS (SELECT s, idx, t, {target} AS g, round_even(lag(t) OVER (PARTITION BY s ORDER BY idx), 3) AS p
                   FROM {beats}),
    {name}_n AS (SELECT *, CASE WHEN p IS NULL THEN 1
                 ELSE greatest(1, CAST(round_even((t - p) / g, 0) AS BIGINT)) END AS n FROM {name}_gap),
    {name}_k AS (SELECT *, unnest(range(1, n + 1)) AS k FROM {name}_n),
    {name} AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY idx, k) - 1 AS idx,
               round_even(CASE WHEN p IS NULL THEN t ELSE p + (t - p) * k / n END, 3) AS t FROM {name}_k)"""


@query("expand_beats", f"WITH {expand_sql('filled', 'v_grid', '0.25')} SELECT * FROM filled")
def _(v: Views):
    return T.expand_beats(v.grid, F.lit(0.25))


def fourth_sql(name: str, beats: str, downbeats: str) -> str:
    return f"""
    {name}_ref AS (SELECT s, min_by(t, idx) AS ref FROM {downbeats} GROUP BY s),
    {name}_anchor AS (SELECT b.s, coalesce(min_by(b.idx, {{'d': abs(b.t - r.ref), 'i': b.idx}})
                      FILTER (r.ref IS NOT NULL), 0) AS anchor
                      FROM {beats} b LEFT JOIN {name}_ref r ON r.s = b.s GROUP BY b.s),
    {name} AS (SELECT b.s, (b.idx - a.anchor) // 4 AS idx, round_even(b.t, 3) AS t
               FROM {beats} b JOIN {name}_anchor a ON a.s = b.s
               WHERE b.idx >= a.anchor AND (b.idx - a.anchor) % 4 = 0)"""


@query("every_fourth", f"WITH {fourth_sql('quarter', 'v_grid', 'v_downbeats')} SELECT * FROM quarter")
def _(v: Views):
    return T.every_fourth(v.grid, v.downbeats)


@query(
    "every_fourth_in_phase",
    f"""
    WITH {fourth_sql('quarter', 'v_grid', 'v_downbeats')},
    phase AS (SELECT s, anchor % 4 AS p FROM quarter_anchor)
    SELECT b.s, (b.idx - p) // 4 AS idx, round_even(b.t, 3) AS t
    FROM v_grid b JOIN phase ON phase.s = b.s WHERE b.idx >= p AND (b.idx - p) % 4 = 0""",
)
def _(v: Views):
    return T.every_fourth(v.grid, v.downbeats, from_anchor=False)


def transition_sql(name: str, beats: str, sessions: str) -> str:
    """CTEs that end in ``name(s, at_idx, at_t, step)``."""
    return f"""
    {name}_iv AS (SELECT s, idx, t, lead(t) OVER (PARTITION BY s ORDER BY idx) - t AS iv,
                  count(*) OVER (PARTITION BY s) - 1 AS n FROM {beats}),
    {name}_cand AS (SELECT b.s, b.idx AS i, b.t AS at_t, median(w.iv) AS m, list(w.iv ORDER BY w.idx) AS w,
                    60.0 / any_value(q.bpm) AS e
                    FROM {name}_iv b JOIN {name}_iv w ON w.s = b.s AND w.idx BETWEEN b.idx AND b.idx + 11
                    JOIN {sessions} q ON q.s = b.s AND q.bpm > 0
                    WHERE b.idx BETWEEN 4 AND least(b.n - 12, 24) GROUP BY b.s, b.idx, b.t),
    {name}_long AS (SELECT c.s, c.i, count(*) FILTER (l.iv >= c.m * 1.25) AS longs
                    FROM {name}_cand c JOIN {name}_iv l ON l.s = c.s AND l.idx < c.i GROUP BY c.s, c.i),
    {name}_hit AS (SELECT c.s, min_by(struct_pack(i := c.i, t := c.at_t, e := c.e), c.i) AS h
                   FROM {name}_cand c JOIN {name}_long l ON l.s = c.s AND l.i = c.i
                   WHERE len(list_filter(c.w[1:4], lambda x: x BETWEEN c.m * 0.9 AND c.m * 1.1)) = 4
                     AND len(list_filter(c.w, lambda x: x BETWEEN c.m * 0.9 AND c.m * 1.1)) >= 11
                     AND c.m BETWEEN c.e * 0.88 AND c.e * 1.12
                     AND l.longs >= greatest(4, round_even(c.i * 0.6, 0)) AND c.at_t <= 30.0 GROUP BY c.s),
    {name} AS (SELECT h.s, h.h.i AS at_idx, h.h.t AS at_t, median(w.iv) AS step
               FROM {name}_hit h JOIN {name}_iv w ON w.s = h.s AND w.idx BETWEEN h.h.i AND h.h.i + 63
                    AND w.iv BETWEEN h.h.e * 0.88 AND h.h.e * 1.12
               GROUP BY h.s, h.h.i, h.h.t)"""


SESSIONS_SQL = "sessions AS (SELECT DISTINCT user_id AS s, 120.0::DOUBLE AS bpm FROM events)"


@query(
    "stable_transition",
    f"WITH {SESSIONS_SQL}, {transition_sql('hit', 'v_grid', 'sessions')} SELECT s, at_idx, at_t, step FROM hit",
)
def _(v: Views):
    return T.stable_transition(v.grid, v.tempo)


def backfill_sql(name: str, beats: str, downbeats: str, sessions: str) -> str:
    """CTEs that end in ``name(s, idx, t)`` and ``name_down(s, idx, t)``; ``name_plan`` lists the repairs."""
    return f"""
    {transition_sql(f'{name}_tr', beats, sessions)},
    {name}_ref AS (SELECT d.s, min(d.t) AS reference FROM {downbeats} d JOIN {name}_tr r ON r.s = d.s
                   WHERE d.t >= r.at_t - r.step * 0.25 GROUP BY d.s),
    {name}_src AS (SELECT b.s, min_by(b.idx, {{'d': abs(b.t - f.reference), 'i': b.idx}})
                   FILTER (b.idx >= r.at_idx) AS source, min_by(b.t, b.idx) AS first_t, count(*) AS n
                   FROM {beats} b JOIN {name}_tr r ON r.s = b.s JOIN {name}_ref f ON f.s = b.s GROUP BY b.s),
    {name}_plan AS (SELECT r.s, f.reference, c.source, r.step,
                    CAST(greatest(0, floor((f.reference - greatest(0.0, c.first_t - r.step * 1.05)) / r.step + 1e-9))
                         AS BIGINT) AS steps
                    FROM {name}_tr r JOIN {name}_ref f ON f.s = r.s JOIN {name}_src c ON c.s = r.s WHERE c.n >= 20),
    {name}_lead AS (SELECT s, steps, reference, step, unnest(range(0, steps + 1)) AS k FROM {name}_plan),
    {name}_all AS (
        SELECT s, steps - k AS idx, round_even(reference - k * step, 3) AS t, steps FROM {name}_lead
        UNION ALL
        SELECT b.s, coalesce(p.steps + b.idx - p.source, b.idx),
               CASE WHEN p.s IS NULL THEN b.t ELSE round_even(b.t, 3) END, p.steps
        FROM {beats} b LEFT JOIN {name}_plan p ON p.s = b.s WHERE p.s IS NULL OR b.idx > p.source),
    {name} AS (SELECT s, idx, t FROM {name}_all),
    {name}_down AS (
        SELECT s, (idx - steps % 4) // 4 AS idx, t FROM {name}_all WHERE steps IS NOT NULL AND idx % 4 = steps % 4
        UNION ALL
        SELECT s, idx, t FROM {downbeats} WHERE s NOT IN (SELECT s FROM {name}_plan))"""


BACKFILL = f"WITH {SESSIONS_SQL}, {backfill_sql('fixed', 'v_grid', 'v_downbeats', 'sessions')}"


@query("backfill_lead", f"{BACKFILL} SELECT s, idx, t FROM fixed")
def _(v: Views):
    return T.backfill_lead(v.grid, v.downbeats, v.tempo)[0]


@query("backfill_lead_downbeats", f"{BACKFILL} SELECT s, idx, t FROM fixed_down")
def _(v: Views):
    return T.backfill_lead(v.grid, v.downbeats, v.tempo)[1]


def contiguous_sql(name: str, sections: str) -> str:
    """CTE ``name`` with contiguous ranges over ``sections(s, idx, label, end_bar, total_bars, ...)``."""
    return f"""
    {name}_scan AS (SELECT *, count(*) OVER (PARTITION BY s) AS n,
                    max(nullif(end_bar, 0) - idx) OVER (PARTITION BY s ORDER BY idx) AS reach FROM {sections}),
    {name}_end AS (SELECT *, CASE WHEN idx = n - 1 THEN total_bars
                   WHEN reach IS NULL THEN idx + 1
                   ELSE idx + greatest(1, least(total_bars - n + 1, reach)) END AS new_end
                   FROM {name}_scan),
    {name} AS (SELECT * EXCLUDE (n, reach, new_end, end_bar),
               CASE WHEN total_bars >= 1 AND n <= total_bars
                    THEN lag(new_end, 1, 0) OVER (PARTITION BY s ORDER BY idx) + 1 END AS from_bar,
               CASE WHEN total_bars >= 1 AND n <= total_bars THEN new_end ELSE end_bar END AS to_bar
               FROM {name}_end)"""


@query(
    "contiguous_bars",
    f"""
    WITH {contiguous_sql('fixed', 'v_sections')}
    SELECT s, idx, label, total_bars, from_bar AS start_bar, to_bar AS end_bar, to_bar - from_bar + 1 AS bar_count
    FROM fixed""",
)
def _(v: Views):
    return S.contiguous_bars(v.sections.drop("start_time", "end_time"))


def place_sql(name: str, sections: str, downbeats: str) -> str:
    return f"""
    {name}_from AS ({bar_sql(f"(SELECT s, idx AS pid, start_time FROM {sections})", "start_time", downbeats)}),
    {name}_to AS ({bar_sql(f"(SELECT s, idx AS pid, end_time FROM {sections})", "end_time", downbeats)}),
    {name}_raw AS (SELECT c.s, c.idx, c.label, c.start_time, c.end_time, f.bar AS start_bar,
                   greatest(f.bar, t.bar - 1) AS end_bar, coalesce(n.n, 0) AS total_bars
                   FROM {sections} c JOIN {name}_from f ON f.s = c.s AND f.pid = c.idx
                   JOIN {name}_to t ON t.s = c.s AND t.pid = c.idx
                   LEFT JOIN (SELECT s, count(*) AS n FROM {downbeats} GROUP BY s) n ON n.s = c.s),
    {contiguous_sql(f'{name}_c', f'{name}_raw')},
    {name} AS (SELECT c.s, c.idx, c.label, c.start_time, c.end_time, c.total_bars,
               coalesce(c.from_bar, c.start_bar) AS start_bar, c.to_bar AS end_bar FROM {name}_c c)"""


@query(
    "place_sections",
    f"""
    WITH {place_sql('placed', 'v_timed_sections', 'v_downbeats')}
    SELECT *, end_bar - start_bar + 1 AS bar_count FROM placed""",
)
def _(v: Views):
    return S.place_sections(v.timed_sections, v.downbeats)


def _tempo_input(v: Views) -> T.Tempo:
    sections = v.timed_sections.select(
        "s", "idx", "label", "start_time", "end_time", F.lit(0).cast("long").alias("start_bar"), "end_bar"
    )
    return T.Tempo(v.tempo, v.grid, v.downbeats, sections)


NORMALIZE = f"""
    WITH {SESSIONS_SQL}, {FLAG_SQL},
    flagged AS (SELECT s FROM flags WHERE double_time),
    flagged_beats AS (SELECT * FROM v_grid WHERE s IN (SELECT s FROM flagged)),
    flagged_down AS (SELECT * FROM v_downbeats WHERE s IN (SELECT s FROM flagged)),
    {expand_sql('dense', 'flagged_beats', '60.0 / 240.0')},
    {fourth_sql('dense_down', 'dense', 'flagged_down')},
    s2 AS (SELECT s, CASE WHEN s IN (SELECT s FROM flagged) THEN bpm * 2 ELSE bpm END AS bpm FROM sessions),
    b2 AS (SELECT s, idx, t FROM v_grid WHERE s NOT IN (SELECT s FROM flagged)
           UNION ALL SELECT s, idx, t FROM dense),
    d2 AS (SELECT s, idx, t FROM v_downbeats WHERE s NOT IN (SELECT s FROM flagged)
           UNION ALL SELECT s, idx, t FROM dense_down),
    {backfill_sql('fixed', 'b2', 'd2', 's2')},
    changed AS (SELECT s FROM flagged UNION SELECT s FROM fixed_plan),
    moving AS (SELECT s, idx, label, start_time, end_time FROM v_timed_sections WHERE s IN (SELECT s FROM changed)),
    {place_sql('moved', 'moving', 'fixed_down')}"""


@query("normalize_tempo", f"{NORMALIZE} SELECT s, idx, t FROM fixed")
def _(v: Views):
    return T.normalize_tempo(_tempo_input(v)).beats


@query("normalize_tempo_downbeats", f"{NORMALIZE} SELECT s, idx, t FROM fixed_down")
def _(v: Views):
    return T.normalize_tempo(_tempo_input(v)).downbeats


@query(
    "normalize_tempo_sections",
    f"""{NORMALIZE}
    SELECT s, idx, label, start_time, end_time, start_bar, end_bar FROM moved
    UNION ALL
    SELECT s, idx, label, start_time, end_time, 0, end_bar FROM v_timed_sections
    WHERE s NOT IN (SELECT s FROM changed)""",
)
def _(v: Views):
    return T.normalize_tempo(_tempo_input(v)).sections


@query("normalize_tempo_bpm", f"{NORMALIZE} SELECT s, round_even(bpm, 1) AS bpm FROM s2")
def _(v: Views):
    return T.normalize_tempo(_tempo_input(v)).sessions


# --- factors -------------------------------------------------------------------------------------------------

DOUBLED_SQL = """
    pairs AS (SELECT s, idx, t, lead(t) OVER (PARTITION BY s ORDER BY idx) AS nx FROM v_grid),
    doubled AS (SELECT s, idx * 2 AS idx, t FROM pairs
                UNION ALL SELECT s, idx * 2 + 1, round_even((t + nx) / 2, 3) FROM pairs WHERE nx IS NOT NULL)"""


@query("scale_beats_up", f"WITH {DOUBLED_SQL} SELECT s, idx, t FROM doubled")
def _(v: Views):
    return T.scale_beats(v.grid, 2.0)


@query("scale_beats_down", "SELECT s, idx // 2 AS idx, t FROM v_grid WHERE idx % 2 = 0")
def _(v: Views):
    return T.scale_beats(v.grid, 0.5)


@query("scale_beats_one_and_a_half", f"WITH {DOUBLED_SQL} SELECT s, idx // 2 AS idx, t FROM doubled WHERE idx % 2 = 0")
def _(v: Views):
    return T.scale_beats(v.grid, 1.5)


def _bar_sessions(v: Views):
    return v.bars.groupBy("s").agg(F.max("total_bars").alias("total_bars")).withColumn("bpm", 90.0 + F.col("s") % 7)


@query(
    "apply_bpm_factor",
    """
    SELECT s, idx, label, total_bars, greatest(1, CAST(round_even((start_bar - 1) * 1.5::DOUBLE, 0) AS BIGINT) + 1) AS start_bar,
           greatest(greatest(1, CAST(round_even((start_bar - 1) * 1.5::DOUBLE, 0) AS BIGINT) + 1),
                    CAST(round_even(end_bar * 1.5::DOUBLE, 0) AS BIGINT)) AS end_bar,
           greatest(greatest(1, CAST(round_even((start_bar - 1) * 1.5::DOUBLE, 0) AS BIGINT) + 1),
                    CAST(round_even(end_bar * 1.5::DOUBLE, 0) AS BIGINT))
           - greatest(1, CAST(round_even((start_bar - 1) * 1.5::DOUBLE, 0) AS BIGINT) + 1) + 1 AS bar_count
    FROM v_bars""",
)
def _(v: Views):
    return T.apply_bpm_factor(_bar_sessions(v), v.grid, v.bars, 1.5).sections


@query(
    "apply_bpm_factor_sessions",
    """
    SELECT s, round_even((90.0::DOUBLE + s % 7) * 1.5, 1) AS bpm,
           greatest(1, CAST(round_even(max(total_bars) * 1.5::DOUBLE, 0) AS BIGINT)) AS total_bars
    FROM v_bars GROUP BY s""",
)
def _(v: Views):
    return T.apply_bpm_factor(_bar_sessions(v), v.grid, v.bars, 1.5).sessions


@query(
    "half_beat_shift",
    """
    WITH iv AS (SELECT s, lead(t) OVER (PARTITION BY s ORDER BY idx) - t AS iv FROM v_grid),
    lists AS (SELECT s, list(iv ORDER BY iv) AS l FROM iv WHERE iv > 0 GROUP BY s)
    SELECT b.s, b.idx, coalesce(greatest(0.0, b.t - l.l[len(l.l) // 2 + 1] / 2), b.t) AS t
    FROM v_grid b LEFT JOIN lists l ON l.s = b.s""",
)
def _(v: Views):
    return T.half_beat_shift(v.grid)


@query(
    "four_bar_grid",
    """
    WITH d AS (SELECT s, last_t * 0.9 AS duration FROM v_last_beat WHERE last_t > 0),
    spans AS (SELECT c.s, c.idx AS section, d.duration, greatest(0.0, least(d.duration, c.start_time)) AS a,
                     greatest(greatest(0.0, least(d.duration, c.start_time)), least(d.duration, c.end_time)) AS b,
                     w.end_bar - w.start_bar + 1 AS n
              FROM v_timed_sections c JOIN v_bars w ON w.s = c.s AND w.idx = c.idx JOIN d ON d.s = c.s),
    lines AS (SELECT *, unnest(range(0, n, 4)) AS bar_offset FROM spans WHERE b > a AND n >= 1)
    SELECT s, section, bar_offset, a + (b - a) * bar_offset / n AS t, (a + (b - a) * bar_offset / n) / duration AS share
    FROM lines""",
)
def _(v: Views):
    bars = v.bars.select("s", "idx", "start_bar", "end_bar")
    sections = v.timed_sections.select("s", "idx", "start_time", "end_time").join(bars, ["s", "idx"])
    durations = v.grid.groupBy("s").agg((F.max("t") * 0.9).alias("duration"))
    return T.four_bar_grid(sections, durations)


# --- sections ------------------------------------------------------------------------------------------------


@query(
    "bar_to_time",
    """
    WITH last AS (SELECT s, max_by(t, idx) AS t FROM v_downbeats GROUP BY s)
    SELECT b.s, b.idx, b.label, b.total_bars, b.start_bar, b.end_bar,
           coalesce(d1.t, nullif(CASE WHEN b.s % 2 = 0 THEN 30.0 ELSE 0.0 END, 0.0), l.t, 0.0) AS start_time,
           coalesce(d2.t, nullif(CASE WHEN b.s % 2 = 0 THEN 30.0 ELSE 0.0 END, 0.0), l.t, 0.0) AS end_time
    FROM v_bars b LEFT JOIN v_downbeats d1 ON d1.s = b.s AND d1.idx = b.start_bar - 1
    LEFT JOIN v_downbeats d2 ON d2.s = b.s AND d2.idx = b.end_bar LEFT JOIN last l ON l.s = b.s""",
)
def _(v: Views):
    durations = v.bars.select("s").distinct().withColumn("duration", F.when(F.col("s") % 2 == 0, 30.0).otherwise(0.0))
    return S.bar_to_time(v.bars, v.downbeats, durations)


SEGMENTS_SQL = """
    segments AS (SELECT s, idx, label, start_time AS "start", CASE WHEN s % 3 = 0 THEN 0.0 ELSE end_time END AS "end"
                 FROM v_timed_sections),
    durations AS (SELECT g.s, greatest(coalesce(b.last_t, 0), max_by(coalesce(g."end", 0.0), g.idx),
                                       coalesce(max(d.t), 0)) AS duration
                  FROM segments g LEFT JOIN v_last_beat b ON b.s = g.s LEFT JOIN v_downbeats d ON d.s = g.s
                  GROUP BY g.s, b.last_t)"""


def _segments(v: Views):
    return v.timed_sections.select(
        "s", "idx", "label", F.col("start_time").alias("start"),
        F.when(F.col("s") % 3 == 0, F.lit(0.0)).otherwise(F.col("end_time")).alias("end"),
    )


@query(
    "segments_to_sections",
    f"""
    WITH {SEGMENTS_SQL},
    timed AS (SELECT g.s, g.idx, g.label, g."start" AS start_time,
                     coalesce(lead(g."start") OVER (PARTITION BY g.s ORDER BY g.idx), nullif(g."end", 0.0), d.duration) AS end_time
              FROM segments g JOIN durations d ON d.s = g.s),
    f AS ({bar_sql('(SELECT s, idx AS pid, start_time FROM timed)', 'start_time')}),
    e AS ({bar_sql('(SELECT s, idx AS pid, end_time FROM timed)', 'end_time')})
    SELECT t.s, t.idx, t.label, f.bar AS start_bar, greatest(f.bar, e.bar - 1) AS end_bar,
           greatest(f.bar, e.bar - 1) - f.bar + 1 AS bar_count, round_even(t.start_time, 2) AS start_time,
           round_even(t.end_time, 2) AS end_time,
           printf('%02d:%02d', CAST(floor(t.start_time) AS BIGINT) // 60, CAST(floor(t.start_time) AS BIGINT) % 60)
               AS start_time_str
    FROM timed t JOIN f ON f.s = t.s AND f.pid = t.idx JOIN e ON e.s = t.s AND e.pid = t.idx""",
)
def _(v: Views):
    return S.segments_to_sections(_segments(v), v.grid, v.downbeats)[0]


@query("segment_durations", f"WITH {SEGMENTS_SQL} SELECT s, round_even(duration, 2) AS duration FROM durations")
def _(v: Views):
    return S.segments_to_sections(_segments(v), v.grid, v.downbeats)[1]


@query(
    "relabel_runs",
    """
    WITH n AS (SELECT *, lag(label) OVER w AS b, lead(label) OVER w AS a FROM v_labels
               WINDOW w AS (PARTITION BY s ORDER BY idx)),
    h AS (SELECT s, idx, label, coalesce(label = 'verse' AND b = 'verse' AND a = 'chorus', false) AS changed FROM n)
    SELECT s, idx, label, changed, CASE WHEN changed THEN 'pre-chorus' ELSE label END AS new_label,
           CASE WHEN changed THEN 'consecutive-verse-before-chorus' END AS reason FROM h""",
)
def _(v: Views):
    return S.relabel_runs(v.labels)


def _selection(v: Views):
    return v.timed_sections.filter((F.col("idx") + F.col("s")) % 3 != 1)


@query(
    "selection_range",
    """
    SELECT s, min_by(start_time, idx) AS start, max_by(end_time, idx) AS "end",
           string_agg(label, '|' ORDER BY idx) AS labels
    FROM v_timed_sections WHERE (idx + s) % 3 <> 1 GROUP BY s""",
)
def _(v: Views):
    return S.selection_range(v.timed_sections, _selection(v)).withColumn("labels", F.array_join("labels", "|"))


@query(
    "selection_labels",
    """
    SELECT s, row_number() OVER (PARTITION BY s ORDER BY idx) - 1 AS place, label
    FROM v_timed_sections WHERE (idx + s) % 3 <> 1""",
)
def _(v: Views):
    return S.selection_labels(v.timed_sections, _selection(v))


@query(
    "edit_sections",
    """
    WITH e AS (SELECT DISTINCT s, s % 4 AS at_idx, ['split', 'merge', 'delete', 'boundary'][s % 4 + 1] AS action,
                      s % 9 + 2 AS v FROM v_bars),
    b AS (SELECT c.*, e.at_idx, e.action, e.v, count(*) OVER (PARTITION BY c.s) AS n,
                 lead(end_bar) OVER w AS next_end, lag(start_bar) OVER w AS prev_start
          FROM v_bars c JOIN e ON e.s = c.s WINDOW w AS (PARTITION BY c.s ORDER BY idx)),
    kept AS (SELECT * FROM b WHERE NOT (action = 'merge' AND at_idx < n - 1 AND idx = at_idx + 1)
                             AND NOT (action = 'delete' AND n > 1 AND idx = at_idx)),
    moved AS (SELECT s, idx, 0 AS part, label, total_bars, action, at_idx, start_bar AS s0, end_bar AS e0,
        CASE WHEN action = 'delete' AND n > 1 AND at_idx = 0 AND idx = 1 THEN prev_start
             WHEN action = 'boundary' AND idx = at_idx + 1 THEN greatest(prev_start, least(end_bar - 1, v)) + 1
             ELSE start_bar END AS start_bar,
        CASE WHEN action = 'merge' AND at_idx < n - 1 AND idx = at_idx THEN next_end
             WHEN action = 'delete' AND n > 1 AND at_idx > 0 AND idx = at_idx - 1 THEN next_end
             WHEN action = 'boundary' AND idx = at_idx AND at_idx < n - 1 THEN greatest(start_bar, least(next_end - 1, v))
             ELSE end_bar END AS end_bar FROM kept),
    parts AS (
        SELECT s, idx, part, label, total_bars, start_bar,
               CASE WHEN action = 'split' AND idx = at_idx AND s0 < e0 THEN (s0 + e0) // 2 ELSE end_bar END AS end_bar
        FROM moved
        UNION ALL
        SELECT s, idx, 1, label, total_bars, (s0 + e0) // 2 + 1, e0 FROM moved
        WHERE action = 'split' AND idx = at_idx AND s0 < e0)
    SELECT s, row_number() OVER (PARTITION BY s ORDER BY idx, part) - 1 AS idx, label, total_bars, start_bar, end_bar
    FROM parts""",
)
def _(v: Views):
    kind = F.pmod(F.col("s"), F.lit(4))
    action = F.element_at(F.array(*[F.lit(a) for a in ("split", "merge", "delete", "boundary")]), kind.cast("int") + 1)
    edits = v.bars.select("s").distinct().select(
        "s", kind.alias("at_idx"), action.alias("action"), (F.col("s") % 9 + 2).alias("value")
    )
    return S.edit_sections(v.bars, edits)


def _edits(v: Views):
    """Section ranges of which some sessions are broken on purpose."""
    third = F.col("s") % 5
    return v.bars.select(
        "s",
        F.when((third == 1) & (F.col("idx") == 1), F.lit("  ")).otherwise(F.col("label")).alias("label"),
        F.when((third == 2) & (F.col("idx") == 1), F.col("start_bar") + 1).otherwise(F.col("start_bar")).alias("start_bar"),
        "end_bar",
    )


def _edit_sessions(v: Views):
    total = F.max("total_bars") + F.when(F.col("s") % 5 == 3, 1).otherwise(0)
    return v.bars.groupBy("s").agg(total.alias("total_bars")).withColumn("duration", F.lit(0.0))


EDITS_SQL = """
    edits AS (SELECT s, CASE WHEN s % 5 = 1 AND idx = 1 THEN '  ' ELSE label END AS label,
                     CASE WHEN s % 5 = 2 AND idx = 1 THEN start_bar + 1 ELSE start_bar END AS start_bar, end_bar
              FROM v_bars),
    totals AS (SELECT s, max(total_bars) + CASE WHEN s % 5 = 3 THEN 1 ELSE 0 END AS total_bars FROM v_bars GROUP BY s),
    chained AS (SELECT e.*, t.total_bars, row_number() OVER (PARTITION BY e.s ORDER BY start_bar, end_bar, label) - 1 AS idx,
                       lag(end_bar, 1, 0) OVER (PARTITION BY e.s ORDER BY start_bar, end_bar, label) AS before
                FROM edits e JOIN totals t ON t.s = e.s),
    judged AS (SELECT s, CASE WHEN max(total_bars) < 1 THEN 'no bars' WHEN NOT bool_and(trim(label) <> '') THEN 'blank label'
                      WHEN NOT bool_and(start_bar = before + 1 AND end_bar >= start_bar AND end_bar <= total_bars) THEN 'gap or overlap'
                      WHEN max(end_bar) <> max(total_bars) THEN 'not to the last bar' END AS reason
               FROM chained GROUP BY s)"""


@query(
    "validate_sections",
    f"""
    WITH {EDITS_SQL}
    SELECT c.s, c.idx, trim(c.label) AS label, c.start_bar, c.end_bar, c.end_bar - c.start_bar + 1 AS bar_count
    FROM chained c JOIN judged j ON j.s = c.s WHERE j.reason IS NULL""",
)
def _(v: Views):
    return S.validate_sections(_edits(v), _edit_sessions(v))[0]


@query("rejected_sections", f"WITH {EDITS_SQL} SELECT s, reason FROM judged WHERE reason IS NOT NULL")
def _(v: Views):
    return S.validate_sections(_edits(v), _edit_sessions(v))[1]


@query(
    "save_sections",
    f"""
    WITH {EDITS_SQL},
    last AS (SELECT s, max_by(t, idx) AS t FROM v_downbeats GROUP BY s),
    timed AS (SELECT c.s, c.idx, trim(c.label) AS label, c.start_bar, c.end_bar, c.end_bar - c.start_bar + 1 AS bar_count,
                     coalesce(a.t, l.t, 0.0) AS st, coalesce(b.t, l.t, 0.0) AS et
              FROM chained c JOIN judged j ON j.s = c.s AND j.reason IS NULL
              LEFT JOIN v_downbeats a ON a.s = c.s AND a.idx = c.start_bar - 1
              LEFT JOIN v_downbeats b ON b.s = c.s AND b.idx = c.end_bar LEFT JOIN last l ON l.s = c.s)
    SELECT s, idx, label, start_bar, end_bar, bar_count, round_even(st, 2) AS start_time,
           round_even(greatest(st, et), 2) AS end_time,
           printf('%02d:%02d', CAST(floor(st) AS BIGINT) // 60, CAST(floor(st) AS BIGINT) % 60) AS start_time_str
    FROM timed""",
)
def _(v: Views):
    return S.save_sections(_edits(v), _edit_sessions(v), v.downbeats)[0]


@query(
    "restore_sections",
    """
    SELECT s, s % 3 <> 0 AS restored, CASE WHEN s % 3 <> 0 THEN 'auto' || s ELSE 'edited' || s END AS sections,
           CASE WHEN s % 3 = 0 THEN 'day' || s END AS sections_edited_at
    FROM (SELECT DISTINCT s FROM v_bars)""",
)
def _(v: Views):
    sessions = v.bars.select("s").distinct().select(
        "s",
        F.array(F.concat(F.lit("edited"), "s")).alias("sections"),
        F.when(F.col("s") % 3 != 0, F.array(F.concat(F.lit("auto"), "s"))).alias("automatic_sections"),
        F.concat(F.lit("day"), "s").alias("sections_edited_at"),
    )
    out = S.restore_sections(sessions)
    return out.select("s", "restored", F.array_join("sections", ",").alias("sections"), "sections_edited_at")
