"""Frames, measures, harmony and signals on the embedding and line item tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrum.functions import fixed
from metrum.functions import scalars as X
from metrum.operators import folds as D
from metrum.operators import frames as R
from metrum.operators import harmony as H
from metrum.operators import ranges as G
from metrum.operators import signal as S
from metrum.queries.registry import query
from metrum.queries.views import Views


def share_sql(a: str, b: str) -> str:
    return f"(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] <> {b}[i])::INT)) / len({a}))"


# --- folds ---------------------------------------------------------------------------------------------------

HEADS_SQL = f"""
    WITH RECURSIVE h(s, idx, head) AS (
        SELECT s, idx, idx FROM v_frames WHERE idx = 0
        UNION ALL
        SELECT n.s, n.idx, CASE WHEN {share_sql('r.signature', 'n.signature')} <= 0.45 THEN h.head ELSE n.idx END
        FROM h JOIN v_frames n ON n.s = h.s AND n.idx = h.idx + 1 JOIN v_frames r ON r.s = h.s AND r.idx = h.head)"""


@query("group_views", f"{HEADS_SQL} SELECT s, idx, head FROM h")
def _(v: Views):
    return D.group_views(v.frames, 0.45)


@query("keep_distinct", f"{HEADS_SQL} SELECT s, idx FROM h WHERE idx = head")
def _(v: Views):
    return D.keep_distinct(v.frames, 0.45)


THIN_SQL = """
    WITH RECURSIVE iv AS (SELECT s, idx, t, lead(t) OVER (PARTITION BY s ORDER BY idx) - t AS iv,
                                 count(*) OVER (PARTITION BY s) - 1 AS n FROM v_grid),
    base AS (SELECT s, median(iv) AS b FROM iv WHERE n >= 11 AND idx < greatest(8, least(128, n // 2)) GROUP BY s),
    med AS (SELECT s, idx, median(iv) OVER w AS m, count(iv) OVER w AS c FROM iv
            WINDOW w AS (PARTITION BY s ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
    plan AS (SELECT m.s, min(m.idx) AS at_idx, any_value(b.b) AS b FROM med m JOIN base b ON b.s = m.s AND b.b > 0
             WHERE m.c = 8 AND m.m < b.b * 0.65 GROUP BY m.s),
    f(s, idx, prev, kept) AS (
        SELECT g.s, g.idx, g.t, true FROM v_grid g JOIN plan p ON p.s = g.s WHERE g.idx = p.at_idx
        UNION ALL
        SELECT f.s, g.idx, CASE WHEN g.t - f.prev >= p.b * 0.75 THEN g.t ELSE f.prev END, g.t - f.prev >= p.b * 0.75
        FROM f JOIN v_grid g ON g.s = f.s AND g.idx = f.idx + 1 JOIN plan p ON p.s = f.s),
    kept AS (SELECT g.s, g.idx, g.t FROM v_grid g JOIN plan p ON p.s = g.s AND g.idx < p.at_idx
             UNION ALL SELECT g.s, g.idx, g.t FROM v_grid g JOIN f ON f.s = g.s AND f.idx = g.idx WHERE f.kept),
    changed AS (SELECT k.s FROM (SELECT s, count(*) AS a FROM kept GROUP BY s) k
                JOIN (SELECT s, count(*) AS b FROM v_grid GROUP BY s) g ON g.s = k.s WHERE k.a < g.b),
    thin AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY idx) - 1 AS idx, round_even(t, 3) AS t FROM kept
             WHERE s IN (SELECT s FROM changed)),
    ref AS (SELECT s, min_by(t, idx) AS r FROM v_downbeats GROUP BY s),
    phase AS (SELECT g.s, coalesce(min_by(g.idx, {'d': abs(g.t - r.r), 'i': g.idx}) FILTER (r.r IS NOT NULL), 0) % 4 AS p
              FROM v_grid g LEFT JOIN ref r ON r.s = g.s GROUP BY g.s)"""


@query(
    "thin_beats",
    f"{THIN_SQL} SELECT s, idx, t FROM thin UNION ALL SELECT s, idx, t FROM v_grid WHERE s NOT IN (SELECT s FROM changed)",
)
def _(v: Views):
    return D.thin_beats(v.grid, v.downbeats)[0]


@query(
    "thin_beats_downbeats",
    f"""{THIN_SQL}
    SELECT t.s, (t.idx - p.p) // 4 AS idx, t.t FROM thin t JOIN phase p ON p.s = t.s WHERE t.idx % 4 = p.p
    UNION ALL SELECT s, idx, t FROM v_downbeats WHERE s NOT IN (SELECT s FROM changed)""",
)
def _(v: Views):
    return D.thin_beats(v.grid, v.downbeats)[1]


@query(
    "drop_close",
    """
    WITH RECURSIVE f(s, idx, hx, hi, known, out_x, out_i) AS (
        SELECT s, idx, x, idx, recognized IS NOT NULL, NULL::BIGINT, NULL::BIGINT FROM v_barlines WHERE idx = 0
        UNION ALL
        SELECT b.s, b.idx,
            CASE WHEN b.x - f.hx >= 60 OR (b.recognized IS NOT NULL AND NOT f.known) THEN b.x ELSE f.hx END,
            CASE WHEN b.x - f.hx >= 60 OR (b.recognized IS NOT NULL AND NOT f.known) THEN b.idx ELSE f.hi END,
            CASE WHEN b.x - f.hx >= 60 THEN b.recognized IS NOT NULL ELSE f.known OR b.recognized IS NOT NULL END,
            CASE WHEN b.x - f.hx >= 60 THEN f.hx END, CASE WHEN b.x - f.hx >= 60 THEN f.hi END
        FROM f JOIN v_barlines b ON b.s = f.s AND b.idx = f.idx + 1),
    ends AS (SELECT s, max_by(hx, idx) AS x, max_by(hi, idx) AS idx FROM f GROUP BY s)
    SELECT s, out_i AS idx, CAST(out_x AS DOUBLE) AS x FROM f WHERE out_x IS NOT NULL
    UNION ALL SELECT s, idx, CAST(x AS DOUBLE) FROM ends""",
)
def _(v: Views):
    return D.drop_close(v.barlines, 60)


@query(
    "pack_pages",
    """
    WITH RECURSIVE r AS (SELECT s, idx, CAST(20 + value % 90 AS DOUBLE) AS height FROM v_lines),
    f(s, idx, page_start, used, n, page) AS (
        SELECT s, idx, idx, height, 1, 0 FROM r WHERE idx = 0
        UNION ALL
        SELECT r.s, r.idx, CASE WHEN f.used + r.height > 400 OR f.n >= 6 THEN r.idx ELSE f.page_start END,
               CASE WHEN f.used + r.height > 400 OR f.n >= 6 THEN r.height ELSE f.used + r.height END,
               CASE WHEN f.used + r.height > 400 OR f.n >= 6 THEN 1 ELSE f.n + 1 END,
               CASE WHEN f.used + r.height > 400 OR f.n >= 6 THEN f.page + 1 ELSE f.page END
        FROM f JOIN r ON r.s = f.s AND r.idx = f.idx + 1)
    SELECT s, idx, page_start, CAST(page AS BIGINT) AS page, CAST(page // 2 AS BIGINT) AS sheet FROM f""",
)
def _(v: Views):
    lines = v.lines.select("s", "idx", (20 + F.col("value") % 90).cast("double").alias("height"))
    return D.pack_pages(lines, 400.0, 6)


GAPS = [(7, 24)] * 4 + [(18, 72)] + [(9, 32)] * 3


@query(
    "match_gap_pattern",
    f"""
    WITH RECURSIVE g AS (SELECT s, idx, value, {', '.join(f'lead(value, {k + 1}) OVER w - lead(value, {k}) OVER w AS g{k}' for k in range(8))}
               FROM v_lines WINDOW w AS (PARTITION BY s ORDER BY idx)),
    c AS (SELECT s, idx, value, row_number() OVER (PARTITION BY s ORDER BY idx) AS n FROM g
          WHERE {' AND '.join(f'g{k} BETWEEN {a} AND {b}' for k, (a, b) in enumerate(GAPS))}),
    f(s, n, kept, free) AS (
        SELECT s, n, true, idx + 9 FROM c WHERE n = 1
        UNION ALL
        SELECT c.s, c.n, c.idx >= f.free, CASE WHEN c.idx >= f.free THEN c.idx + 9 ELSE f.free END
        FROM f JOIN c ON c.s = f.s AND c.n = f.n + 1)
    SELECT c.s, c.idx, c.value FROM c JOIN f ON f.s = c.s AND f.n = c.n WHERE f.kept""",
)
def _(v: Views):
    return D.match_gap_pattern(v.lines, GAPS)


def _sparse_measures(v: Views):
    """Measures with sparse masks: in dense ones every cell has a neighbour, so all would look alike."""
    e = v.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x > 0.1).alias("signature"))
    return v.measures.drop("signature").join(e, "vec_id").drop("vec_id")


@query("drop_overlap")
def _(v: Views):
    return D.drop_overlap(_sparse_measures(v), width=8).drop("signature")


@query("drop_overlap_vertical")
def _(v: Views):
    plain = _sparse_measures(v).withColumn("label", F.lit(None).cast("long"))
    return D.drop_overlap(plain, width=8, vertical=True).drop("signature")


@query(
    "split_at_boundaries",
    """
    WITH RECURSIVE ink AS (SELECT s || '/' || track AS s, idx, abs(level) + idx % 3 AS amount FROM v_tracks),
    marks AS (SELECT DISTINCT t.s || '/' || t.track AS s, l.value // 9 AS x FROM (SELECT DISTINCT s, track FROM v_tracks) t JOIN v_lines l ON l.s = t.s),
    sizes AS (SELECT s, max(idx) + 1 AS width, greatest(1, CAST(round_even((max(idx) + 1) / 60.0, 0) AS BIGINT)) AS pieces FROM ink GROUP BY s),
    cols AS (SELECT i.s, i.idx, sum(amount) OVER (PARTITION BY i.s ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS quiet, m.x IS NOT NULL AS mark
             FROM ink i LEFT JOIN marks m ON m.s = i.s AND m.x = i.idx),
    cuts(s, width, pieces, part, start) AS (
        SELECT s, width, pieces, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM sizes
        UNION ALL
        SELECT s, width, pieces, part + 1, CASE WHEN stop > start THEN stop ELSE least(width, start + target) END FROM (
            SELECT g.s, g.width, g.pieces, g.part, g.start, g.target, coalesce(
                (min({'d': abs(c.idx - g.ideal), 'x': c.idx}) FILTER (c.mark AND c.idx BETWEEN g.start + g.low AND g.start + g.high)).x,
                CASE WHEN g.ideal >= g.width THEN g.width ELSE
                    coalesce((min({'d': c.quiet, 'x': c.idx}) FILTER (c.idx BETWEEN g.q_low AND least(g.width - 1, g.start + g.target))).x, -1) END) AS stop
            FROM (
                SELECT *, least(ideal, start + greatest(32, CAST(target * 0.82::DOUBLE AS BIGINT))) AS q_low,
                    CAST(target * 0.65::DOUBLE AS BIGINT) AS low, CAST(target * 1.08::DOUBLE AS BIGINT) AS high
                FROM (SELECT *, least(width, start + target) AS ideal FROM (
                    SELECT *, CAST(round_even((width - start) / CAST(pieces - part AS DOUBLE), 0) AS BIGINT) AS target FROM cuts WHERE part + 1 < pieces))) g
            LEFT JOIN cols c ON c.s = g.s AND c.idx >= g.start GROUP BY g.s, g.width, g.pieces, g.part, g.start, g.target, g.ideal, g.q_low, g.low, g.high))
    SELECT s, part, start, coalesce(lead(start) OVER (PARTITION BY s ORDER BY part), width) AS "end" FROM cuts""",
)
def _(v: Views):
    panorama = F.concat_ws("/", "s", "track").alias("s")
    # Tracks are read once, so they needn't be stored; marks need neither order nor number.
    ink = v.packed_tracks.select(panorama, "idx", (F.abs("level") + F.col("idx") % 3).alias("amount"))
    marks = v.line_values.select("s", F.floor(F.col("value") / 9).cast("long").alias("x"))
    marks = v.track_names.join(marks, "s").select(panorama, "x")
    return D.split_at_boundaries(ink, marks, 60)


# --- runs and samples ----------------------------------------------------------------------------------------


@query(
    "evenly_spaced",
    """
    WITH n AS (SELECT s, count(*) AS n FROM v_frames GROUP BY s)
    SELECT f.s, f.idx, f.vec_id FROM v_frames f JOIN n ON n.s = f.s
    WHERE n.n <= 9 OR f.idx IN (SELECT i * (n.n - 1) // 8 FROM range(0, 9) r(i))""",
)
def _(v: Views):
    return R.evenly_spaced(v.frames.drop("signature"), 9)


@query(
    "split_runs",
    """
    WITH b AS (SELECT s, idx, label, CASE WHEN lag(label) OVER w IS NOT DISTINCT FROM label AND idx > 0 THEN 0 ELSE 1 END AS b
               FROM v_labels WINDOW w AS (PARTITION BY s ORDER BY idx))
    SELECT s, idx, label, CAST(sum(b) OVER (PARTITION BY s ORDER BY idx) - 1 AS BIGINT) AS run FROM b""",
)
def _(v: Views):
    from metrum.plans.ordered import neighbours

    near = neighbours(v.labels, ["s"], {"_same": lambda w: F.lag("label").over(w) == F.col("label")}, before=1)
    return R.split_runs(near, F.col("_same")).drop("_same")


def merge_sql(tolerance: int, pick: str) -> str:
    return f"""
    WITH b AS (SELECT s, value, CASE WHEN value - lag(value) OVER w <= {tolerance} THEN 0 ELSE 1 END AS b FROM v_lines
               WINDOW w AS (PARTITION BY s ORDER BY value)),
    r AS (SELECT s, value, CAST(sum(b) OVER (PARTITION BY s ORDER BY value) - 1 AS BIGINT) AS run FROM b)
    SELECT s, run, {pick} AS value, count(*) AS n FROM r GROUP BY s, run"""


@query("merge_close", merge_sql(5, "CAST(round_even(avg(value), 0) AS BIGINT)"))
def _(v: Views):
    return R.merge_close(v.lines, 5)


@query("merge_close_first", merge_sql(10, "min(value)"))
def _(v: Views):
    return R.merge_close(v.lines, 10, "first")


REGULAR_SQL = """
    WITH g AS (SELECT s, idx, value, lead(value) OVER (PARTITION BY s ORDER BY idx) - value AS g FROM v_lines),
    m AS (SELECT s, idx, value, min(g) OVER w AS lo, max(g) OVER w AS hi, count(g) OVER w AS n FROM g
          WINDOW w AS (PARTITION BY s ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
    r AS (SELECT s, idx, value FROM m WHERE n = 3 AND lo >= 6 AND hi <= 36 AND hi <= 1.6 * lo)"""


@query("regular_groups", f"{REGULAR_SQL} SELECT * FROM r")
def _(v: Views):
    return R.regular_groups(v.lines, 4, 6, 36, 1.6)


@query("last_regular_group", f"{REGULAR_SQL} SELECT s, max(idx) AS idx, max_by(value, idx) AS value FROM r GROUP BY s")
def _(v: Views):
    return R.last_regular_group(v.lines, 4, 6, 36, 1.6)


@query(
    "drop_narrow",
    """
    WITH p AS (SELECT s, idx, x AS "left", lead(x) OVER (PARTITION BY s ORDER BY idx) AS "right" FROM v_barlines)
    SELECT * FROM p WHERE "right" - "left" >= 24""",
)
def _(v: Views):
    return R.drop_narrow(v.barlines, 24)


# --- motion --------------------------------------------------------------------------------------------------

SHIFT_SQL = """
    p AS (SELECT s, idx, signature AS a, lead(signature) OVER (PARTITION BY s ORDER BY idx) AS b FROM mf),
    c AS (SELECT s, idx, o, list_sum(list_transform(range(1, len(a) - o + 1), lambda i: (a[i + o] <> b[i])::INT)) AS d,
                 list_sum(list_transform(range(1, len(a) - o + 1), lambda i: (a[i + o] OR b[i])::INT)) AS u
          FROM p, range(0, 41) r(o) WHERE b IS NOT NULL),
    m AS (SELECT s, idx, min({'d': CASE WHEN u < 20 THEN 1.0 ELSE d / u END, 'o': o}) AS m FROM c GROUP BY s, idx)"""

MOVING_SQL = """
    mf AS (SELECT label AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
                  list_transform(range(1, 65), lambda i: (i + 5 * vec_id) % 17 < 6 OR (i + 5 * vec_id) % 23 < 3) AS signature
           FROM embeddings)"""


def _moving(v: Views):
    """A pattern that scrolls by five cells per vector id."""
    cell = lambda i: ((i + 5 * F.col("vec_id")) % 17 < 6) | ((i + 5 * F.col("vec_id")) % 23 < 3)
    return v.frames.select("s", "idx", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(64).cast("long")), cell).alias("signature"))


@query(
    "best_shift",
    f"""
    WITH {MOVING_SQL}, {SHIFT_SQL}
    SELECT p.s, p.idx, CASE WHEN m.m.d <= 0.24 THEN m.m.o END AS "offset", CASE WHEN m.m.d <= 0.24 THEN m.m.d END AS difference
    FROM p LEFT JOIN m ON m.s = p.s AND m.idx = p.idx""",
)
def _(v: Views):
    return R.best_shift(_moving(v)).select("s", "idx", F.col("offset").cast("long").alias("offset"), "difference")


TALL_SQL = """
    sparse AS (SELECT label AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
                      [(i + 5 * vec_id) % 29 < 4 OR (i + 5 * vec_id) % 31 < 2 FOR i IN range(1, 65)] AS sig FROM embeddings),
    rows4 AS (SELECT s, idx, [sig[1:48], [true FOR i IN range(48)], sig[7:54], sig[10:57]] AS a,
                     lead([sig[1:48], [true FOR i IN range(48)], sig[7:54], sig[10:57]]) OVER (PARTITION BY s ORDER BY idx) AS b FROM sparse)"""


@query(
    "best_shift_tall",
    f"""
    WITH {TALL_SQL},
    dense AS (SELECT s, idx, r, len([x FOR x IN a[r] IF x]) <= 0.32 * 48 AND len([x FOR x IN b[r] IF x]) <= 0.32 * 48 AS keep
              FROM rows4, range(1, 5) q(r)),
    c AS (SELECT s, idx, o, keep AND a[r][i + o] AS x, keep AND b[r][i] AS y
          FROM rows4 JOIN dense USING (s, idx), range(0, 25) q(o), range(1, 49) t(i) WHERE i <= 48 - o AND b IS NOT NULL),
    d AS (SELECT s, idx, o, count(*) FILTER (x OR y) AS u, count(*) FILTER (x <> y) AS d FROM c GROUP BY s, idx, o),
    m AS (SELECT s, idx, min({{'d': CASE WHEN u < 20 THEN 1.0 ELSE d / u END, 'o': o}}) AS m FROM d GROUP BY s, idx)
    SELECT p.s, p.idx, CASE WHEN m.m.d <= 0.24 THEN m.m.o END AS "offset", CASE WHEN m.m.d <= 0.24 THEN m.m.d END AS difference
    FROM rows4 p LEFT JOIN m ON m.s = p.s AND m.idx = p.idx""",
)
def _(v: Views):
    """Masks of four rows, the second a line."""
    cell = lambda i: ((i + 5 * F.col("vec_id")) % 29 < 4) | ((i + 5 * F.col("vec_id")) % 31 < 2)
    sparse = v.frames.select("s", "idx", F.transform(F.sequence(F.lit(1).cast("long"), F.lit(64).cast("long")), cell).alias("sig"))
    parts = [F.slice("sig", 1, 48), F.array_repeat(F.lit(True), 48), F.slice("sig", 7, 48), F.slice("sig", 10, 48)]
    tall = sparse.select("s", "idx", F.concat(*parts).alias("signature"))
    return R.best_shift(tall, width=48).select("s", "idx", F.col("offset").cast("long").alias("offset"), "difference")


def _near_cell(mask: str, first: str) -> str:
    """Whether the cell (r, k) of a crop of ``z`` columns that begins at column ``first`` has a set cell within one."""
    near = []
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            inside = f"r + {dr} BETWEEN 0 AND 3 AND k + {dc} BETWEEN 0 AND z - 1"
            near.append(f"({inside} AND coalesce({mask}[(r + {dr}) * 48 + {first} + k + {dc} + 1], false))")
    return "(" + " OR ".join(near) + ")"


@query(
    "edge_overlap",
    f"""
    WITH {MOVING_SQL},
    tall AS (SELECT s, idx, signature[1:48] || signature[4:51] || signature[7:54] || signature[10:57] AS sig FROM mf),
    p AS (SELECT s, idx, sig AS a, lead(sig) OVER (PARTITION BY s ORDER BY idx) AS b FROM tall),
    c AS (SELECT s, idx, z, a[r * 48 + 48 - z + k + 1] AS x, b[r * 48 + k + 1] AS y,
                 {_near_cell('a', '48 - z')} AS near_x, {_near_cell('b', '0')} AS near_y
          FROM p, range(8, 41) t(z), range(0, 4) u(r), range(0, 40) w(k) WHERE k < z AND b IS NOT NULL),
    d AS (SELECT s, idx, z, count(*) FILTER (x) + count(*) FILTER (y) AS total,
                 count(*) FILTER (x AND NOT near_y) + count(*) FILTER (y AND NOT near_x) AS alone FROM c GROUP BY s, idx, z),
    e AS (SELECT s, idx, z, alone / total AS diff, min(alone / total) OVER (PARTITION BY s, idx) AS best FROM d WHERE total >= 20),
    f AS (SELECT s, idx, any_value(best) AS best, min(z) FILTER (diff <= least(0.22, best + 0.025)) AS z FROM e GROUP BY s, idx)
    SELECT p.s, p.idx, CASE WHEN f.best <= 0.22 THEN f.z END AS "overlap", CASE WHEN f.best <= 0.22 THEN f.best END AS difference
    FROM p LEFT JOIN f ON f.s = p.s AND f.idx = p.idx""",
)
def _(v: Views):
    moving = _moving(v)
    tall = moving.withColumn("signature", F.concat(*[F.slice("signature", 1 + 3 * k, 48) for k in range(4)]))
    return R.edge_overlap(tall, 48, minimum=8, maximum=40, features=20, dense=None).select("s", "idx", "overlap", "difference")


@query(
    "drop_transitions",
    f"""
    WITH RECURSIVE {MOVING_SQL}, {SHIFT_SQL},
    h(s, idx, head) AS (
        SELECT s, idx, idx FROM mf WHERE idx = 0
        UNION ALL
        SELECT n.s, n.idx, CASE WHEN {share_sql('r.signature', 'n.signature')} <= 0.35 THEN h.head ELSE n.idx END
        FROM h JOIN mf n ON n.s = h.s AND n.idx = h.idx + 1 JOIN mf r ON r.s = h.s AND r.idx = h.head),
    mv AS (SELECT s, idx FROM m WHERE m.m.d <= 0.24),
    g AS (SELECT s, head, count(*) AS n, max(idx) AS last FROM h GROUP BY s, head),
    bad AS (SELECT g.s, g.head FROM g JOIN mv a ON a.s = g.s AND a.idx = g.head - 1 JOIN mv b ON b.s = g.s AND b.idx = g.last
            WHERE g.n < 3)
    SELECT h.s, h.head, h.idx FROM h LEFT JOIN bad ON bad.s = h.s AND bad.head = h.head WHERE bad.s IS NULL""",
)
def _(v: Views):
    return R.drop_transitions(_moving(v), 0.35)[0]


@query(
    "mask_difference",
    f"""
    SELECT a.s, a.idx, {share_sql('a.signature', 'b.signature')} AS difference
    FROM v_frames a JOIN v_frames b ON b.s = a.s AND b.idx = a.idx + 1""",
)
def _(v: Views):
    after = v.frames.select("s", (F.col("idx") - 1).alias("idx"), F.col("signature").alias("after"))
    pairs = v.frames.select("s", "idx", "signature").join(after, ["s", "idx"])
    return R.mask_difference(pairs, "signature", "after").drop("signature", "after")


def _near(mask: str) -> str:
    """Whether the cell i (1-based, rows of eight) of a mask has a set cell within one cell."""
    near = []
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            inside = f"((i - 1) % 8 + {dc}) BETWEEN 0 AND 7 AND (i + {dr * 8 + dc}) BETWEEN 1 AND 64"
            near.append(f"({inside} AND coalesce({mask}[i + {dr * 8 + dc}], false))")
    return "(" + " OR ".join(near) + ")"


@query(
    "mask_difference_dilated",
    f"""
    WITH p AS (SELECT x.s, x.idx, x.signature AS a, y.signature AS b
               FROM v_frames x JOIN v_frames y ON y.s = x.s AND y.idx = x.idx + 1),
    cells AS (SELECT s, idx, a[i] AS x, b[i] AS y, {_near('a')} AS xa, {_near('b')} AS yb FROM p, range(1, 65) r(i))
    SELECT s, idx, (count(*) FILTER (x AND NOT yb) + count(*) FILTER (y AND NOT xa))
           / (count(*) FILTER (x) + count(*) FILTER (y)) AS difference
    FROM cells GROUP BY s, idx""",
)
def _(v: Views):
    after = v.frames.select("s", (F.col("idx") - 1).alias("idx"), F.col("signature").alias("after"))
    pairs = v.frames.select("s", "idx", "signature").join(after, ["s", "idx"])
    return R.mask_difference(pairs, "signature", "after", width=8).drop("signature", "after")


@query(
    "pair_frames",
    """
    SELECT a.s, a.name, a.idx, b.vec_id FROM (SELECT s, idx, 'f' || idx AS name FROM v_frames WHERE idx % 3 <> 0) a
    JOIN (SELECT s, vec_id, 'f' || idx AS name FROM v_frames WHERE idx % 4 <> 0) b ON b.s = a.s AND b.name = a.name""",
)
def _(v: Views):
    name = F.concat(F.lit("f"), "idx").alias("name")
    return R.pair_frames(v.frames.filter("idx % 3 <> 0").select("s", name, "idx"), v.frames.filter("idx % 4 <> 0").select("s", name, "vec_id"))


@query(
    "percentile_composite",
    """
    WITH e AS (SELECT label AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, embedding FROM embeddings),
    g AS (SELECT s, idx // 12 AS "group", idx % 12 AS i, embedding, count(*) OVER (PARTITION BY s, idx // 12) AS n FROM e),
    k AS (SELECT * FROM g WHERE n <= 9 OR i IN (SELECT j * (n - 1) // 8 FROM range(0, 9) r(j))),
    c AS (SELECT s, "group", unnest(range(0, 64)) AS pos, unnest(embedding) AS v FROM k)
    SELECT s, "group", pos, round_even(quantile_cont(CAST(v AS DOUBLE), 0.9), 6) AS value FROM c GROUP BY ALL""",
)
def _(v: Views):
    e = v.table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("values"))
    frames = v.frames.select("s", "idx", "vec_id", F.floor(F.col("idx") / 12).cast("long").alias("group")).join(e, "vec_id")
    out = R.percentile_composite(frames.select("s", "group", "idx", "values"))
    return out.withColumn("value", X.half_even("value", 6)).withColumn("pos", F.col("pos").cast("long"))


# --- geometry ------------------------------------------------------------------------------------------------


def _extents(v: Views):
    return v.table("lineitem").select(
        F.col("l_orderkey").alias("s"), (F.floor("l_quantity").cast("long") % 10 + 5).alias("start"),
        (900 + F.floor("l_extendedprice").cast("long") % 9).alias("end"),
    )


EXTENTS_SQL = """
    ext AS (SELECT l_orderkey AS s, CAST(floor(l_quantity) AS BIGINT) % 10 + 5 AS a, 900 + CAST(floor(l_extendedprice) AS BIGINT) % 9 AS b
            FROM lineitem)"""


@query(
    "consensus_extent",
    f"""
    WITH {EXTENTS_SQL}
    SELECT s, CAST(round_even(median(a), 0) AS BIGINT) AS "start", CAST(round_even(median(b), 0) AS BIGINT) AS "end"
    FROM ext GROUP BY s HAVING count(*) >= 4 AND max(a) - min(a) <= 8 AND max(b) - min(b) <= 8""",
)
def _(v: Views):
    return R.consensus_extent(_extents(v))


@query(
    "median_align",
    """
    WITH a AS (SELECT s, idx, CASE WHEN idx % 3 <> 1 THEN x END AS anchor FROM v_barlines),
    m AS (SELECT s, CAST(round_even(median(anchor), 0) AS BIGINT) AS m, count(anchor) AS n FROM a GROUP BY s)
    SELECT a.s, a.idx, a.anchor, CASE WHEN m.n >= 2 THEN coalesce(m.m - a.anchor, 0) ELSE 0 END AS shift
    FROM a JOIN m ON m.s = a.s""",
)
def _(v: Views):
    anchors = v.barlines.select("s", "idx", F.when(F.col("idx") % 3 != 1, F.col("x")).alias("anchor"))
    return R.median_align(anchors)


@query(
    "quorum",
    """
    WITH f AS (SELECT s, idx, 1000 AS width, CASE WHEN value % 3 <> 0 THEN value % (30 + s) END AS a,
                      CASE WHEN value % 3 <> 0 THEN 999 - value % 50 END AS b, count(*) OVER (PARTITION BY s) AS n FROM v_lines),
    k AS (SELECT * FROM f WHERE n <= 24 OR idx IN (SELECT j * (n - 1) // 23 FROM range(0, 24) r(j))),
    c AS (SELECT s, count(*) AS n, count(a) AS valid, count(*) FILTER (a >= 38 AND 999 - b >= 38) AS whole FROM k GROUP BY s)
    SELECT s, n, valid, whole, n >= 2 AND valid >= greatest(2, round_even(n * 0.45, 0))
           AND whole >= greatest(2, round_even(valid * 0.75, 0)) AS complete FROM c""",
)
def _(v: Views):
    found = F.col("value") % 3 != 0
    frames = v.lines.select(
        "s", "idx", F.lit(1000).alias("width"), F.when(found, F.col("value") % (30 + F.col("s"))).alias("start"),
        F.when(found, 999 - F.col("value") % 50).alias("end"),
    )
    return R.quorum(frames)


@query(
    "consensus_positions",
    """
    WITH l AS (SELECT DISTINCT l_suppkey AS s, l_linenumber AS system, 5 * l_partkey AS x FROM lineitem),
    n AS (SELECT s, min(system) AS f, count(DISTINCT system) AS n FROM l GROUP BY s),
    a AS (SELECT l.s, l.x, n.n FROM l JOIN n ON n.s = l.s AND l.system = n.f),
    near AS (SELECT a.s, a.x, l.system, min({'d': abs(l.x - a.x), 'o': l.x}) AS m
             FROM a JOIN n ON n.s = a.s JOIN l ON l.s = a.s AND l.system <> n.f AND abs(l.x - a.x) <= 40 WHERE a.n > 1
             GROUP BY a.s, a.x, l.system)
    SELECT s, CAST(x AS BIGINT) AS x FROM a WHERE n = 1
    UNION ALL SELECT s, CAST(round_even((x + sum(m.o)) / (count(*) + 1), 0) AS BIGINT) FROM near GROUP BY s, x""",
)
def _(v: Views):
    lines = (
        v.table("lineitem")
        .select(F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("system"), (5 * F.col("l_partkey")).alias("x")).distinct()
    )
    return R.consensus_positions(lines, 40)


@query(
    "plausible_joins",
    """
    WITH w AS (SELECT l_suppkey AS s, l_orderkey AS pair, CAST(floor(l_extendedprice) AS BIGINT) % 400 AS width, l_quantity AS q FROM lineitem),
    m AS (SELECT s, pair, median(width) AS m FROM w WHERE width >= 60 GROUP BY s, pair),
    p AS (SELECT s, pair, CAST(max(q) AS BIGINT) * 3 AS tail, CAST(min(q) AS BIGINT) AS head FROM w GROUP BY s, pair)
    SELECT p.s, p.pair, tail, head, tail + head AS width FROM p JOIN m ON m.s = p.s AND m.pair = p.pair
    WHERE tail + head BETWEEN m.m * 0.35 AND m.m * 2.2 AND tail + head <= 180""",
)
def _(v: Views):
    w = v.table("lineitem").select(
        F.col("l_suppkey").alias("s"), F.col("l_orderkey").alias("pair"),
        (F.floor("l_extendedprice").cast("long") % 400).alias("width"), F.col("l_quantity").alias("q"),
    )
    pairs = w.groupBy("s", "pair").agg((F.max("q").cast("long") * 3).alias("tail"), F.min("q").cast("long").alias("head"))
    return R.plausible_joins(pairs, w.select("s", "pair", "width"), 180)


@query(
    "run_verdict",
    """
    SELECT l_suppkey AS s, l_partkey % 40 AS run, CAST(sum(l_linenumber * 9 - 18) AS BIGINT) AS total,
           count(*) FILTER (l_linenumber > 2) AS moves,
           sum(l_linenumber * 9 - 18) >= 260 AND count(*) FILTER (l_linenumber > 2) >= 2 AS stitch
    FROM lineitem GROUP BY ALL""",
)
def _(v: Views):
    offsets = v.table("lineitem").select(
        F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 40).alias("run"), (F.col("l_linenumber") * 9 - 18).alias("offset")
    )
    return R.run_verdict(offsets, 400)


@query(
    "row_layouts",
    """
    WITH r AS (SELECT s, idx, 800 + s % 7 AS width FROM v_barlines),
    n AS (SELECT s, 3 * count(*) - 1 AS n FROM v_barlines GROUP BY s)
    SELECT r.s, r.idx, CASE WHEN r.s % 2 = 0 THEN r.idx * 2 ELSE r.idx * 4 END AS first_measure,
           CASE WHEN r.s % 2 = 0 THEN '0|' || r.width
                ELSE array_to_string([CAST(round_even(r.width * k / least(4, n.n - r.idx * 4), 0) AS BIGINT)
                                      for k in range(0, least(4, n.n - r.idx * 4) + 1)], '|') END AS boundaries
    FROM r JOIN n ON n.s = r.s WHERE r.s % 2 = 0 OR n.n - r.idx * 4 > 0""",
)
def _(v: Views):
    rows = v.barlines.select("s", "idx", (800 + F.col("s") % 7).alias("width"))
    # Odd sessions miss the audit of their first row, so the audit does not hold for them.
    audit = rows.filter("s % 2 = 0 or idx > 0").select(
        "s", "idx", (F.col("idx") * 2 + 1).alias("first_measure"), F.array(F.lit(0).cast("long"), "width").alias("boundaries")
    )
    measures = v.barlines.groupBy("s").agg((3 * F.count(F.lit(1)) - 1).alias("n"))
    return R.row_layouts(rows, audit, 4, measures).withColumn("boundaries", F.array_join("boundaries", "|"))


# --- numbers -------------------------------------------------------------------------------------------------

FIRST_SQL = """
    n AS (SELECT s, frame_idx FROM v_measures GROUP BY s, frame_idx HAVING count(label) >= 2),
    r AS (SELECT m.* EXCLUDE (signature) FROM v_measures m JOIN n ON n.s = m.s AND n.frame_idx = m.frame_idx),
    q AS (SELECT *, row_number() OVER (PARTITION BY s, label ORDER BY frame_idx, local_idx) AS k FROM r),
    numbered AS (SELECT s, frame_idx, local_idx, content, label FROM q WHERE k = 1 OR label IS NULL)"""


@query("first_numbered", f"WITH {FIRST_SQL} SELECT * FROM numbered")
def _(v: Views):
    return R.first_numbered(v.measures.drop("signature", "vec_id"))


@query(
    "fill_numbers",
    """
    WITH w AS (SELECT s, idx, label, count(label) OVER (PARTITION BY s) AS n,
        last_value(CASE WHEN label IS NOT NULL THEN {'i': idx, 'l': label} END IGNORE NULLS) OVER (PARTITION BY s ORDER BY idx
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
        first_value(CASE WHEN label IS NOT NULL THEN {'i': idx, 'l': label} END IGNORE NULLS) OVER (PARTITION BY s ORDER BY idx
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM v_sparse)
    SELECT s, idx, label, CASE WHEN n = 0 THEN idx + 1 WHEN label IS NOT NULL THEN label
        WHEN p IS NOT NULL AND q IS NOT NULL AND q.l - p.l = q.i - p.i THEN p.l + idx - p.i
        WHEN p IS NULL AND q.l = q.i + 1 THEN idx + 1 END AS number FROM w""",
)
def _(v: Views):
    return R.fill_numbers(v.sparse)


@query(
    "infer_numbers",
    """
    WITH m AS (SELECT s, median(recognized - idx) AS m FROM v_barlines WHERE recognized IS NOT NULL GROUP BY s)
    SELECT b.s, b.idx, b.x, b.recognized, b.idx + CAST(round_even(m.m, 0) AS BIGINT) AS number
    FROM v_barlines b LEFT JOIN m ON m.s = b.s""",
)
def _(v: Views):
    return R.infer_numbers(v.barlines)


@query(
    "terminal_candidate",
    """
    WITH f AS (SELECT s, frame_idx, local_idx, content, label + 3 AS label FROM v_measures WHERE local_idx IN (0, 3) AND label IS NOT NULL),
    k AS (SELECT s, max(label) AS m FROM v_measures GROUP BY s),
    b AS (SELECT s, max_by(struct_pack(l := label, f := frame_idx, i := local_idx, c := content),
                           struct_pack(l := label, f := -frame_idx, i := -local_idx)) AS b FROM f GROUP BY s)
    SELECT b.s, b.b.l AS label, b.b.f AS frame_idx, b.b.i AS local_idx, b.b.c AS content
    FROM b JOIN k ON k.s = b.s WHERE b.b.l > coalesce(k.m, 0)""",
)
def _(v: Views):
    edges = v.measures.filter("local_idx in (0, 3)").select("s", "frame_idx", "local_idx", "content", (F.col("label") + 3).alias("label"))
    return R.terminal_candidate(edges, v.measures)


@query(
    "running_numbers",
    """
    SELECT s, idx, value % 4 AS n, CASE WHEN value % 4 > 0 THEN CAST(coalesce(sum(value % 4) OVER (PARTITION BY s ORDER BY idx
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + 1 END AS first_number FROM v_lines""",
)
def _(v: Views):
    return R.running_numbers(v.lines.select("s", "idx", (F.col("value") % 4).alias("n")))


@query(
    "chunk_rows",
    """
    SELECT s, idx, idx // 3 AS "row", idx % 3 AS cell, CASE WHEN idx % 3 < 2 THEN 267 ELSE 266 END AS cell_width FROM v_barlines
    """,
)
def _(v: Views):
    return R.chunk_rows(v.barlines.select("s", "idx"), 3, 800)


@query(
    "dedup_audit",
    f"""
    WITH {FIRST_SQL},
    a AS (SELECT s, count(DISTINCT frame_idx) AS input_frames, count(*) AS n FROM v_measures GROUP BY s),
    b AS (SELECT s, count(*) AS output, count(*) FILTER (label IS NULL) AS unresolved FROM numbered GROUP BY s)
    SELECT a.s, a.input_frames, coalesce(b.output, 0) AS output, a.n - coalesce(b.output, 0) AS removed, 0 AS rejected,
           coalesce(b.unresolved, 0) AS unresolved FROM a LEFT JOIN b ON b.s = a.s""",
)
def _(v: Views):
    measures = v.measures.drop("signature", "vec_id")
    return R.dedup_audit(measures, R.first_numbered(measures))[0]


@query(
    "measure_sources",
    f"""
    WITH {FIRST_SQL}
    SELECT s, coalesce(label, row_number() OVER (PARTITION BY s ORDER BY frame_idx, local_idx)) AS measure,
           label IS NOT NULL AS official, frame_idx, local_idx FROM numbered""",
)
def _(v: Views):
    measures = v.measures.drop("signature", "vec_id")
    return R.dedup_audit(measures, R.first_numbered(measures))[1]


@query(
    "best_candidate",
    """
    WITH b AS (SELECT s, max({'score': value % 100, 'idx': idx}) AS b FROM v_lines GROUP BY s)
    SELECT s, b.idx AS idx, b.score AS score FROM b""",
)
def _(v: Views):
    return R.best_candidate(v.lines.select("s", "idx", (F.col("value") % 100).alias("score")))


# --- ranges --------------------------------------------------------------------------------------------------

RANGES_SQL = """
    g AS (SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 0.0 ELSE value - 5 END AS a,
                 CASE WHEN event_id % 3 = 0 THEN NULL ELSE value * 1.5 - event_id % 20 END AS b, value AS duration FROM events)"""


def _ranges(v: Views):
    i, value = F.col("event_id"), F.col("value")
    return v.table("events").select(
        i.alias("id"), F.when(i % 4 == 1, 0.0).when(i % 4 != 0, value - 5).alias("start_sec"),
        F.when(i % 3 != 0, value * 1.5 - i % 20).alias("end_sec"), value.alias("duration"),
    )


@query(
    "normalize_ranges",
    f"""
    WITH {RANGES_SQL}
    SELECT id, CASE WHEN NOT (coalesce(a, 0) = 0 AND b IS NULL) THEN round_even(coalesce(a, 0), 3) END AS start_sec,
           round_even(b, 3) AS end_sec FROM g
    WHERE NOT (coalesce(a, 0) < 0 OR coalesce(b, 0) < 0) AND (b IS NULL OR b > coalesce(a, 0))""",
)
def _(v: Views):
    return G.normalize_ranges(_ranges(v))[0].drop("duration")


@query(
    "rejected_ranges",
    f"""
    WITH {RANGES_SQL}
    SELECT id, CASE WHEN coalesce(a, 0) < 0 OR coalesce(b, 0) < 0 THEN 'negative' ELSE 'empty' END AS reason FROM g
    WHERE coalesce(a, 0) < 0 OR coalesce(b, 0) < 0 OR b <= coalesce(a, 0)""",
)
def _(v: Views):
    return G.normalize_ranges(_ranges(v))[1].select("id", "reason")


@query(
    "clip_ranges",
    f"""
    WITH {RANGES_SQL}, e AS (SELECT id, coalesce(a, 0) AS a, CASE WHEN b IS NULL THEN duration ELSE least(b, duration) END AS b, duration FROM g)
    SELECT id, a AS start_sec, b AS end_sec, duration FROM e WHERE duration > 0 AND a >= 0 AND b >= 0 AND a < duration AND b > a""",
)
def _(v: Views):
    return G.clip_ranges(_ranges(v))[0]


@query(
    "trim_edges",
    """
    SELECT s, idx, x FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM v_barlines) WHERE n > 2 AND idx >= 1 AND idx < n - 1
    """,
)
def _(v: Views):
    return G.trim_edges(v.barlines.select("s", "idx", "x"), 1, 1)[0]


@query("trim_edges_rejects", "SELECT s FROM v_barlines GROUP BY s HAVING count(*) <= 2")
def _(v: Views):
    return G.trim_edges(v.barlines.select("s", "idx", "x"), 1, 1)[1]


@query(
    "effective_options",
    """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END AS legacy,
           coalesce(CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 4 = 0 END,
                    CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 2 = 0 END, true) AS chords FROM orders""",
)
def _(v: Views):
    k = F.col("o_orderkey")
    options = v.table("orders").select(k.alias("id"), F.when(k % 3 != 0, k % 2 == 0).alias("legacy"), F.when(k % 5 != 0, k % 4 == 0).alias("chords"))
    return G.effective_options(options, ["chords"])


@query(
    "clamp_regions",
    """
    WITH r AS (SELECT event_id AS id, 640 AS width, 360 AS height, event_id % 2 = 0 AS custom,
                      CAST(floor(value * 7) AS BIGINT) - 100 AS x, CAST(floor(value * 3) AS BIGINT) AS y, event_id % 3 = 0 AS top,
                      event_id % 120 AS percent FROM events),
    q AS (SELECT *, greatest(0, least(639, x)) AS cx, greatest(0, least(359, y)) AS cy,
                 greatest(1, CAST(round_even(360 * (greatest(5.0, least(90.0, percent)) / 100), 0) AS BIGINT)) AS band FROM r)
    SELECT id, CASE WHEN custom THEN cx ELSE 0 END AS x,
           CASE WHEN custom THEN cy WHEN top THEN 0 ELSE 360 - band END AS y,
           CASE WHEN custom THEN greatest(1, least(640 - cx, 200)) ELSE 640 END AS w,
           CASE WHEN custom THEN greatest(1, least(360 - cy, 150)) ELSE band END AS h FROM q""",
)
def _(v: Views):
    i, value = F.col("event_id"), F.col("value")
    custom = i % 2 == 0
    regions = v.table("events").select(
        i.alias("id"), F.lit(640).alias("width"), F.lit(360).alias("height"),
        F.when(custom, F.floor(value * 7).cast("long") - 100).alias("x"), F.when(custom, F.floor(value * 3).cast("long")).alias("y"),
        F.when(custom, F.lit(200)).alias("w"), F.when(custom, F.lit(150)).alias("h"),
        F.when(i % 3 == 0, "TOP").otherwise("bottom").alias("preset"), (i % 120).cast("double").alias("percent"),
    )
    return G.clamp_regions(regions).select("id", "x", "y", "w", "h")


@query(
    "filter_settings",
    """
    SELECT c_custkey AS id, 1 + (c_custkey % 2)::INT AS kept FROM customer""",
)
def _(v: Views):
    k = F.col("c_custkey")
    settings = F.create_map(
        F.lit("loop"), F.lit("true"), F.lit("password"), F.lit("x"),
        F.when(k % 2 == 1, F.concat(F.lit("bpmFactor:"), k)).otherwise(F.concat(F.lit("other:"), k)), F.lit("2"),
    )
    kept, _ = G.filter_settings(v.table("customer").select(k.alias("id"), settings.alias("settings")))
    return kept.select("id", F.size("settings").alias("kept"))


@query(
    "map_merge",
    """
    SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'right' ELSE 'left' END AS a, 'left' AS b,
           CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END AS entries FROM customer""",
)
def _(v: Views):
    from metrum.operators.library import map_merge

    k = F.col("c_custkey")
    left = F.create_map(F.lit("a"), F.lit("left"), F.lit("b"), F.lit("left"))
    right = F.create_map(F.when(k % 2 == 0, "a").otherwise("c"), F.lit("right"))
    merged = v.table("customer").select(k.alias("id"), map_merge(left, right).alias("m"))
    return merged.select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("entries"))


# --- harmony -------------------------------------------------------------------------------------------------


@query("pitch_histogram", "SELECT s, note % 12 AS pitch_class, count(*) AS weight FROM v_notes GROUP BY ALL")
def _(v: Views):
    return H.pitch_histogram(v.notes)


NOTES_SQL = "[" + ", ".join(f"'{n}'" for n in fixed.NOTES) + "]"
KEY_SQL = f"""
    hist AS (SELECT s, note % 12 AS pc, count(*) AS w FROM v_notes GROUP BY ALL),
    pcs AS (SELECT s, pc, coalesce(w, 0) AS w FROM (SELECT DISTINCT s FROM hist) CROSS JOIN (SELECT unnest(range(0, 12)) AS pc)
            LEFT JOIN hist USING (s, pc)),
    dev AS (SELECT s, pc, 12 * w - sum(w) OVER (PARTITION BY s) AS d FROM pcs),
    prof AS (SELECT 'major' AS mode, unnest({H.profile_deviations(fixed.MAJOR_PROFILE)}) AS p, unnest(range(0, 12)) AS k
             UNION ALL SELECT 'minor', unnest({H.profile_deviations(fixed.MINOR_PROFILE)}), unnest(range(0, 12))),
    rolled AS (SELECT mode, tonic, (k + tonic) % 12 AS pc, p FROM prof, (SELECT unnest(range(0, 12)) AS tonic)),
    scored AS (SELECT h.s, r.tonic, r.mode, CASE WHEN sum(h.d * h.d) > 0 THEN CAST(sum(h.d * r.p) AS DOUBLE)
                   / (sqrt(CAST(sum(h.d * h.d) AS DOUBLE)) * sqrt(CAST(sum(r.p * r.p) AS DOUBLE))) END AS score
               FROM dev h JOIN rolled r ON r.pc = h.pc GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY score DESC, tonic DESC, mode DESC) AS k,
                      lead(score) OVER (PARTITION BY s ORDER BY score DESC, tonic DESC, mode DESC) AS second FROM scored),
    keys AS (SELECT s, CASE WHEN score IS NOT NULL THEN tonic END AS tonic, CASE WHEN score IS NOT NULL THEN mode END AS mode,
                    CASE WHEN score IS NULL THEN 0.0::DOUBLE
                         ELSE CAST(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + (score - second) * 1.8::DOUBLE)) * 1000 AS BIGINT) / 1000.0::DOUBLE END AS confidence
             FROM ranked WHERE k = 1)"""


@query(
    "estimate_key",
    f"""
    WITH {KEY_SQL}, n AS (SELECT {NOTES_SQL} AS n)
    SELECT s, tonic, mode, confidence, n[tonic + 1] || CASE WHEN mode = 'major' THEN ' Major' ELSE ' Minor' END AS key,
           CASE WHEN mode = 'major' THEN n[tonic + 1] || ' Major / ' || n[(tonic + 9) % 12 + 1] || ' Natural Minor'
                ELSE n[tonic + 1] || ' Natural Minor / ' || n[(tonic + 3) % 12 + 1] || ' Major' END AS scale
    FROM keys, n""",
)
def _(v: Views):
    return H.estimate_key(H.pitch_histogram(v.notes)).withColumn("tonic", F.col("tonic").cast("long"))


TEMPLATES_SQL = """
    tpl AS (SELECT root, x.suffix AS suffix, list_transform(x.iv, lambda i: (root + i) % 12) AS tones, ([""" + NOTES_SQL[1:-1] + """])[root + 1] || x.suffix AS label
            FROM (SELECT unnest(range(0, 12)) AS root), (SELECT unnest([""" + ", ".join(
    f"{{'suffix': '{s}', 'iv': {list(i)}}}" for s, i in fixed.CHORDS
) + "]) AS x))"
CHORD_SQL = f"""
    {TEMPLATES_SQL},
    midi AS (SELECT s, ([64, 59, 55, 50, 45, 40])[string + 1] + fret AS note FROM v_frets),
    played AS (SELECT s, list_distinct(list(note % 12)) AS pcs, min(note) % 12 AS bass, count(*) AS n FROM midi GROUP BY s),
    cand AS (SELECT p.s, p.bass, p.pcs, t.root, t.label, len(t.tones) AS size,
        CAST(len(list_filter(t.tones, lambda x: NOT list_contains(p.pcs, x))) AS DOUBLE)
        + len(list_filter(p.pcs, lambda x: NOT list_contains(t.tones, x))) * 0.28::DOUBLE
        + CASE WHEN list_contains(p.pcs, t.root) THEN 0.0::DOUBLE ELSE 0.45::DOUBLE END
        + greatest(0, len(t.tones) - 3) * 0.04::DOUBLE + CASE WHEN t.root = p.bass THEN 0.0::DOUBLE ELSE 0.14::DOUBLE END
        + CASE t.suffix WHEN 'aug' THEN 0.18::DOUBLE WHEN 'dim' THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END AS score
        FROM played p, tpl t WHERE p.n >= 2 AND len(p.pcs) >= 2),
    best AS (SELECT s, min(struct_pack(score := score, size := size, label := label, root := root, bass := bass)) AS b FROM cand GROUP BY s),
    chords AS (SELECT s, CASE WHEN b.bass <> b.root AND NOT ends_with(b.label, '5') THEN b.label || '/' || ({NOTES_SQL})[b.bass + 1]
               ELSE b.label END AS label, greatest(0.0, least(1.0, 1.0 - b.score * 0.22)) AS confidence FROM best)"""


@query(
    "infer_chords",
    f"""
    WITH {CHORD_SQL}
    SELECT p.s, c.label, coalesce(round_even(c.confidence, 6), 0.0) AS confidence, CAST(len(p.pcs) AS BIGINT) AS pitch_classes
    FROM played p LEFT JOIN chords c ON c.s = p.s""",
)
def _(v: Views):
    out = H.infer_chords(v.frets)
    return out.select("s", "label", X.half_even("confidence", 6).alias("confidence"), F.col("pitch_classes").cast("long"))


def _events(v: Views):
    """Chord events: the kind of event is the chord, the visitor the session, the hour the measure."""
    label = F.when(F.col("kind") == "view", "C").when(F.col("kind") == "click", "G").when(F.col("kind") == "purchase", "Am")
    return v.beats.select(
        "s", F.floor(F.col("idx") / 10).cast("long").alias("measure"), "idx", label.alias("label"),
        ((F.col("event_id") % 10) / 10.0).alias("confidence"), "event_id",
    )


EVENTS_SQL = """
    ev AS (SELECT s, idx // 10 AS measure, idx, CASE kind WHEN 'view' THEN 'C' WHEN 'click' THEN 'G' WHEN 'purchase' THEN 'Am' END AS label,
                  (event_id % 10) / 10.0::DOUBLE AS confidence, event_id FROM v_beats),
    strong AS (SELECT *, lag(label) OVER (PARTITION BY s, measure ORDER BY idx) AS p FROM ev WHERE label IS NOT NULL AND confidence >= 0.42),
    changes AS (SELECT s, measure, idx, label, confidence FROM strong WHERE p IS DISTINCT FROM label
                QUALIFY row_number() OVER (PARTITION BY s, measure ORDER BY idx) <= 4)"""


@query("chord_changes", f"WITH {EVENTS_SQL} SELECT * FROM changes")
def _(v: Views):
    return H.chord_changes(_events(v).drop("event_id"))


@query(
    "harmony_rollup",
    f"""
    WITH {EVENTS_SQL},
    m AS (SELECT s, measure, count(label) AS chords, max(event_id % 8) / 8.0::DOUBLE AS confidence FROM ev GROUP BY s, measure)
    SELECT s, count(*) FILTER (chords > 0) AS analyzed, coalesce(round_even(avg(confidence) FILTER (confidence > 0), 3), 0.0) AS confidence
    FROM m GROUP BY s""",
)
def _(v: Views):
    measures = _events(v).groupBy("s", "measure").agg(F.count("label").alias("chords"), (F.max(F.col("event_id") % 8) / 8.0).alias("confidence"))
    return H.harmony_rollup(measures)


# --- signals -------------------------------------------------------------------------------------------------


def _samples(v: Views):
    return v.tracks.select("s", "track", "idx", (F.col("level") / 100.0).alias("sample"))


@query(
    "waveform_peaks",
    """
    WITH n AS (SELECT s, max(idx) + 1 AS n FROM v_tracks GROUP BY s),
    b AS (SELECT s, n, p, CAST(floor(p / 20 * n) AS BIGINT) AS a,
                 greatest(CAST(floor(p / 20 * n) AS BIGINT) + 1, CAST(floor((p + 1) / 20 * n) AS BIGINT)) AS e FROM n, range(0, 20) r(p)),
    k AS (SELECT b.s, b.p AS bucket, max(abs(t.level / 100.0::DOUBLE)) AS peak FROM b JOIN v_tracks t ON t.s = b.s AND t.idx >= b.a AND t.idx < b.e
          AND (t.idx - b.a) % greatest(1, (b.e - b.a) // 4) = 0 GROUP BY b.s, b.p)
    SELECT s, bucket, CASE WHEN max(peak) OVER (PARTITION BY s) > 0 THEN peak / max(peak) OVER (PARTITION BY s) ELSE 0.0 END AS peak FROM k""",
)
def _(v: Views):
    return S.waveform_peaks(_samples(v), 20, 4)


@query(
    "mix_tracks",
    """
    SELECT s, idx - 10 AS idx, round_even(greatest(-0.05, least(0.05, sum(level / 100.0 * CASE track WHEN 'A' THEN 0.8 ELSE 0.5 END))), 6) AS sample
    FROM v_tracks WHERE track IN ('A', 'R') AND idx >= 10 AND idx < 200 GROUP BY s, idx""",
)
def _(v: Views):
    flag = v.table("lineitem").select(F.col("l_returnflag").alias("track")).distinct()
    gains = flag.withColumn("gain", F.when(F.col("track") == "A", 0.8).when(F.col("track") == "R", 0.5).otherwise(0.0))
    mixed = S.mix_tracks(_samples(v), gains, rate=10.0, start=1.0, end=20.0, limit=0.05)
    return mixed.withColumn("sample", X.half_even("sample", 6))


@query(
    "click_series",
    """
    WITH n AS (SELECT s, greatest(1, ceil((max(t) + 0.055) * 400)) AS n FROM v_downbeats GROUP BY s),
    o AS (SELECT o, CAST(round_even(32767 * (80 / 100) * 0.72 * exp(-(o / 400) * 75) * CASE WHEN floor(o * 3600 / 400) % 2 = 0 THEN 1 ELSE -1 END, 0) AS BIGINT) AS v
          FROM range(0, 22) r(o)),
    p AS (SELECT d.s, CAST(round_even(d.t * 400, 0) AS BIGINT) + o.o AS frame, o.v FROM v_downbeats d, o)
    SELECT p.s, p.frame, greatest(-32768, least(32767, CAST(sum(p.v) AS BIGINT))) AS value
    FROM p JOIN n ON n.s = p.s WHERE p.frame < n.n GROUP BY p.s, p.frame""",
)
def _(v: Views):
    return S.click_series(v.downbeats, 80, 400)
