"""Column functions on whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metrum.functions import fixed
from metrum.functions import scalars as X
from metrum.queries.registry import query
from metrum.queries.views import Views

NOTES_SQL = "[" + ", ".join(f"'{n}'" for n in fixed.NOTES) + "]"


def _events(v: Views):
    return v.table("events").select("event_id", "user_id", "value", "event_type")


@query(
    "video_id",
    """
    WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://youtu.be/v' || page_id || '?t=3'
               WHEN 1 THEN 'https://www.youtube.com/watch?list=9&v=w' || page_id
               WHEN 2 THEN url ELSE 'not a link ' || page_id END AS url FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'v' || page_id WHEN 1 THEN 'w' || page_id END AS video FROM u""",
)
def _(v: Views):
    k = F.col("page_id")
    url = (
        F.when(k % 4 == 0, F.concat(F.lit("https://youtu.be/v"), k, F.lit("?t=3")))
        .when(k % 4 == 1, F.concat(F.lit("https://www.youtube.com/watch?list=9&v=w"), k))
        .when(k % 4 == 2, F.col("url"))
        .otherwise(F.concat(F.lit("not a link "), k))
    )
    return v.table("pages").select("page_id", X.video_id(url).alias("video"))


@query(
    "session_id",
    """
    SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'v' || user_id
           ELSE 'v' || user_id || '-clip-' || CAST(round_even(value * 1000, 0) AS BIGINT) || '-'
                || CASE WHEN event_id % 3 = 0 THEN 'end' ELSE CAST(CAST(round_even((value + 9) * 1000, 0) AS BIGINT) AS VARCHAR) END END AS id
    FROM events""",
)
def _(v: Views):
    whole = F.col("event_id") % 5 == 0
    start = F.when(~whole, F.col("value"))
    end = F.when(~whole & (F.col("event_id") % 3 != 0), F.col("value") + 9)
    return _events(v).select("event_id", X.session_id(F.concat(F.lit("v"), "user_id"), start, end).alias("id"))


@query(
    "source_id",
    """
    SELECT o_orderkey AS run, 'v' || o_custkey AS source, 'v' || o_custkey || '-clip-0-end' AS stable FROM orders""",
)
def _(v: Views):
    name = F.concat(F.lit("v"), "o_custkey", F.lit("-clip-0-end"))
    job = F.concat(name, F.lit(":stems:history:"), "o_orderkey")
    return v.table("orders").select(
        F.col("o_orderkey").alias("run"), X.source_id(name).alias("source"), X.stable_id(job).alias("stable")
    )


SECONDS = "abs(value) * 37"


@query(
    "clock",
    f"""
    SELECT event_id, printf('%02d:%02d', CAST(floor({SECONDS}) AS BIGINT) // 60, CAST(floor({SECONDS}) AS BIGINT) % 60) AS text
    FROM events""",
)
def _(v: Views):
    return _events(v).select("event_id", X.clock(F.abs("value") * 37).alias("text"))


@query(
    "clock_long",
    f"""
    WITH t AS (SELECT event_id, CAST(round_even({SECONDS} * 10, 0) AS BIGINT) AS t FROM events)
    SELECT event_id, CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60)
           ELSE printf('%d:%02d', t // 60, t % 60) END AS text FROM t""",
)
def _(v: Views):
    return _events(v).select("event_id", X.clock_long(F.abs("value") * 37 * 10).alias("text"))


@query(
    "duration_text",
    """
    WITH t AS (SELECT o_orderkey AS run, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE (o_orderkey * 7919) % 90000 / 5.0::DOUBLE END AS x FROM orders),
    u AS (SELECT *, CAST(floor(x + 0.5) AS BIGINT) AS t FROM t)
    SELECT run, CASE WHEN x IS NULL THEN '計測なし' WHEN x < 10 THEN printf('%.1f秒', x) WHEN x < 60 THEN printf('%d秒', t)
           WHEN t >= 3600 THEN printf('%d時間 %d分 %d秒', t // 3600, t % 3600 // 60, t % 60)
           ELSE printf('%d分 %d秒', t // 60, t % 60) END AS text FROM u""",
)
def _(v: Views):
    k = F.col("o_orderkey")
    rows = v.table("orders").select(k.alias("run"), F.when(k % 9 != 0, (k * 7919) % 90000 / 5.0).alias("x"))
    return rows.select("run", X.duration_text("x").alias("text"))


@query(
    "parse_time",
    """
    WITH t AS (SELECT event_id, event_id % 6 AS k, CAST(floor(abs(value)) AS BIGINT) AS a, event_id % 75 AS b FROM events)
    SELECT event_id, CASE k WHEN 0 THEN a WHEN 1 THEN CASE WHEN b < 60 THEN a * 60 + b END
           WHEN 2 THEN CASE WHEN b < 60 THEN 3600 * a + 60 * b + 5.5 END END::DOUBLE AS seconds,
           (k IN (1, 2) AND b >= 60) OR k IN (4, 5) AS error FROM t""",
)
def _(v: Views):
    k, a, b = F.col("event_id") % 6, F.floor(F.abs("value")).cast("long").cast("string"), (F.col("event_id") % 75).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit(" "), a))
        .when(k == 1, F.concat(a, F.lit(":"), b))
        .when(k == 2, F.concat(a, F.lit(":"), b, F.lit(":5.5")))
        .when(k == 3, F.lit("  "))
        .when(k == 4, F.concat(a, F.lit(":"), F.lit(":"), b))
        .otherwise(F.concat(a, F.lit("x")))
    )
    parsed = X.parse_time(text)
    return _events(v).select("event_id", parsed["seconds"].alias("seconds"), parsed["error"].alias("error"))


@query(
    "human_bytes",
    """
    WITH b AS (SELECT o_orderkey AS id, o_orderkey * o_orderkey * o_orderkey * 22 + 1 AS n FROM orders),
    u AS (SELECT id, n, CASE WHEN n >= 1099511627776 THEN 4 WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS p FROM b),
    s AS (SELECT id, n, p, n / pow(1024.0, p) AS x FROM u)
    SELECT id, CASE WHEN p = 0 THEN n || ' B' WHEN x >= 10 THEN printf('%.1f ', x) || ['KB', 'MB', 'GB', 'TB'][p]
           ELSE printf('%.2f ', x) || ['KB', 'MB', 'GB', 'TB'][p] END AS text FROM s""",
)
def _(v: Views):
    # Cubes of large keys are beyond 64 bits.
    k = F.col("o_orderkey").cast("decimal(38,0)")
    rows = v.table("orders").select(F.col("o_orderkey").alias("id"), (k * k * k * 22 + 1).alias("n"))
    return rows.select("id", X.human_bytes("n").alias("text"))


LABELS_SQL = """
    l AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' Aメロ ' WHEN 1 THEN 'B_Melo' WHEN 2 THEN 'サビ' WHEN 3 THEN 'Hook'
          WHEN 4 THEN 'Pre_Chorus' WHEN 5 THEN event_type WHEN 6 THEN 'Outro 2' ELSE 'Big Inst' END AS label FROM events)"""


def _labels(v: Views):
    k = F.col("event_id") % 8
    label = F.lit("Big Inst")
    for i, text in ((6, "Outro 2"), (4, "Pre_Chorus"), (3, "Hook"), (2, "サビ"), (1, "B_Melo"), (0, " Aメロ ")):
        label = F.when(k == i, text).otherwise(label)
    return _events(v).select("event_id", F.when(k == 5, F.col("event_type")).otherwise(label).alias("label"))


@query(
    "canonical_label",
    f"""
    WITH {LABELS_SQL}, c AS (SELECT event_id, replace(lower(trim(label)), '_', '-') AS c FROM l)
    SELECT event_id, CASE WHEN c IN ('aメロ', 'a-melo') THEN 'verse' WHEN c IN ('bメロ', 'b-melo') THEN 'pre-chorus'
           WHEN c IN ('サビ', 'hook') THEN 'chorus' ELSE c END AS label FROM c""",
)
def _(v: Views):
    return _labels(v).select("event_id", X.canonical_label("label").alias("label"))


@query(
    "label_class",
    f"""
    WITH {LABELS_SQL}
    SELECT event_id, CASE WHEN contains(lower(label), 'aメロ') THEN 'verse' WHEN contains(lower(label), 'サビ') THEN 'chorus'
           WHEN contains(lower(label), 'chorus') THEN 'chorus' WHEN contains(lower(label), 'outro') THEN 'outro'
           WHEN contains(lower(label), 'inst') THEN 'intro' END AS class,
           CASE WHEN label = 'Outro 2' THEN 'アウトロ 2' WHEN label = 'Big Inst' THEN 'Big 間奏'
                WHEN label = 'Pre_Chorus' THEN 'Pre_サビ' ELSE label END AS name FROM l""",
)
def _(v: Views):
    return _labels(v).select("event_id", X.label_class("label").alias("class"), X.localize_label("label").alias("name"))


ODD_SQL = "odd AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN ' ._ ' ELSE ' <' || source || '/' || lang || ':  x\t' || doc_id || '|?>. ' END AS name FROM documents)"


def _odd(v: Views):
    text = F.concat(F.lit(" <"), "source", F.lit("/"), "lang", F.lit(":  x\t"), "doc_id", F.lit("|?>. "))
    return v.table("documents").select("doc_id", F.when(F.col("doc_id") % 9 == 0, F.lit(" ._ ")).otherwise(text).alias("name"))


@query(
    "safe_name",
    f"""
    WITH {ODD_SQL}
    SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'score' ELSE
           regexp_replace(regexp_replace(regexp_replace(name, '[<>:"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^[ ._]+|[ ._]+$', '', 'g'), '[\\s_]+', '_', 'g')
           END AS score,
           trim(regexp_replace(regexp_replace(name, '[\\\\/:*?"<>|]+', ' ', 'g'), '\\s+', ' ', 'g')) AS download,
           trim(regexp_replace(name, '[\\\\/:*?"<>|\\r\\n]+', ' ', 'g')) || '.mp3' AS export FROM odd""",
)
def _(v: Views):
    return _odd(v).select(
        "doc_id", X.safe_name("name").alias("score"), X.safe_download_name("name").alias("download"), X.safe_export_name("name").alias("export")
    )


@query(
    "mix_name",
    """
    WITH g AS (SELECT event_id, 'Song ' || user_id AS t, event_id % 2 AS v, event_id // 2 % 2 AS d, event_id // 4 % 2 AS b, event_id // 8 % 2 AS o FROM events)
    SELECT event_id, t || CASE v + d + b + o
        WHEN 1 THEN '_only_' || CASE WHEN v = 1 THEN 'vocals' WHEN d = 1 THEN 'drums' WHEN b = 1 THEN 'bass' ELSE 'other' END
        WHEN 2 THEN CASE WHEN v = 1 THEN '_vocals' ELSE '' END || CASE WHEN d = 1 THEN '_drums' ELSE '' END
                 || CASE WHEN b = 1 THEN '_bass' ELSE '' END || CASE WHEN o = 1 THEN '_other' ELSE '' END
        WHEN 3 THEN '_no_' || CASE WHEN v = 0 THEN 'vocals' WHEN d = 0 THEN 'drums' WHEN b = 0 THEN 'bass' ELSE 'other' END
        ELSE '' END || CASE WHEN event_id % 3 = 0 THEN '_selection' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '_click' ELSE '' END || '.mp3' AS name
    FROM g""",
)
def _(v: Views):
    i = F.col("event_id")
    gains = {s: F.floor(i / 2**k).cast("long") % 2 for k, s in enumerate(fixed.STEMS)}
    name = X.mix_name(F.concat(F.lit("Song "), "user_id"), gains, i % 3 == 0, i % 5 == 0)
    return _events(v).select("event_id", name.alias("name"))


@query(
    "normalize_tags",
    """
    SELECT p_partkey AS id, p_brand || '|' || p_type || '|STRASSE' || CASE WHEN lower(p_name) IN (lower(p_brand), lower(p_type)) THEN '' ELSE '|' || p_name END AS tags
    FROM part""",
)
def _(v: Views):
    tags = F.array(
        F.concat(F.lit(" "), "p_brand"), F.lit("  "), F.col("p_type"), F.upper("p_brand"), F.lit("STRASSE"), F.lit("straße"),
        F.concat("p_name", F.lit(" ")), F.lower("p_type"),
    )
    return v.table("part").select(F.col("p_partkey").alias("id"), F.array_join(X.normalize_tags(tags), "|").alias("tags"))


LINES_SQL = """
    lines AS (SELECT event_id, user_id, CASE event_id % 7 WHEN 0 THEN 'Separating track a' || event_id WHEN 1 THEN '=> Found 1 tracks already demixed'
              WHEN 2 THEN '  ' WHEN 3 THEN 'Extracting spectrograms for ' || user_id WHEN 4 THEN ' Analyzing song ' || user_id
              WHEN 5 THEN event_type ELSE '[INFO] Finished all-in-one-fix analysis on cpu.' END AS line FROM events),
    stages AS (SELECT event_id, user_id, line,
        CASE WHEN event_id % 7 IN (0, 1) THEN 'demixing' WHEN event_id % 7 = 3 THEN 'extracting' WHEN event_id % 7 IN (4, 6) THEN 'inferencing' END AS stage,
        CASE event_id % 7 WHEN 0 THEN 'Separating stems' WHEN 1 THEN 'Found 1 tracks already demixed' WHEN 3 THEN 'Extracting spectrograms'
             WHEN 4 THEN 'Analyzing song ' || user_id WHEN 6 THEN '[INFO] Finished all-in-one-fix analysis on cpu.' END AS message FROM lines)"""


def log_lines(v: Views):
    """Analyser output, one line per event."""
    k, user = F.col("event_id") % 7, F.col("user_id")
    line = (
        F.when(k == 0, F.concat(F.lit("Separating track a"), "event_id"))
        .when(k == 1, F.lit("=> Found 1 tracks already demixed"))
        .when(k == 2, F.lit("  "))
        .when(k == 3, F.concat(F.lit("Extracting spectrograms for "), user))
        .when(k == 4, F.concat(F.lit(" Analyzing song "), user))
        .when(k == 5, F.col("event_type"))
        .otherwise(F.lit("[INFO] Finished all-in-one-fix analysis on cpu."))
    )
    return v.table("events").select("event_id", "user_id", "ts", line.alias("line"))


@query("stage_of", f"WITH {LINES_SQL} SELECT event_id, stage, message FROM stages")
def _(v: Views):
    hit = X.stage_of("line")
    return log_lines(v).select("event_id", hit["stage"].alias("stage"), hit["message"].alias("message"))


@query(
    "message_text",
    """
    SELECT event_id, CASE event_id % 5 WHEN 0 THEN '完了しました' WHEN 1 THEN 'AIで曲構成を解析中です（' || user_id || '秒経過）'
           WHEN 2 THEN 'ドラムを変換しています' WHEN 3 THEN 'file' || user_id || '.mp3をクラウドへ送信しています' ELSE event_type END AS text
    FROM events""",
)
def _(v: Views):
    k, user = F.col("event_id") % 5, F.col("user_id")
    raw = (
        F.when(k == 0, "Complete")
        .when(k == 1, F.concat(F.lit("Analyzer running for "), user, F.lit("s")))
        .when(k == 2, F.lit("Encoding Drums"))
        .when(k == 3, F.concat(F.lit("Uploading file"), user, F.lit(".mp3")))
        .otherwise(F.col("event_type"))
    )
    return _events(v).select("event_id", X.message_text(raw).alias("text"))


@query(
    "degree",
    f"""
    WITH c AS (SELECT event_id, event_id % 12 AS root, user_id % 12 AS tonic, ['', 'm7', 'dim', 'aug', 'maj7/G', '?/H'][event_id // 12 % 6 + 1] AS suffix FROM events),
    d AS (SELECT *, (['I', '♭II', 'II', '♭III', 'III', 'IV', '♭V', 'V', '♭VI', 'VI', '♭VII', 'VII'])[(root - tonic + 12) % 12 + 1] AS n FROM c)
    SELECT event_id, ({NOTES_SQL})[root + 1] || suffix AS chord,
           CASE suffix WHEN 'm7' THEN lower(n) WHEN 'dim' THEN lower(n) || '°' WHEN 'aug' THEN n || '+' WHEN '?/H' THEN NULL ELSE n END AS degree
    FROM d""",
)
def _(v: Views):
    suffixes = F.array(*[F.lit(s) for s in ("", "m7", "dim", "aug", "maj7/G", "?/H")])
    suffix = F.element_at(suffixes, (F.floor(F.col("event_id") / 12).cast("long") % 6 + 1).cast("int"))
    chord = F.concat(X.note_name(F.col("event_id") % 12), suffix)
    rows = _events(v).select("event_id", chord.alias("chord"), (F.col("user_id") % 12).alias("tonic"))
    return rows.select("event_id", "chord", X.degree("chord", "tonic").alias("degree"))


@query(
    "key_text",
    f"""
    WITH k AS (SELECT event_id, user_id % 12 AS t, CASE WHEN event_id % 2 = 0 THEN 'major' ELSE 'minor' END AS m, {NOTES_SQL} AS n FROM events)
    SELECT event_id, CASE WHEN m = 'major' THEN '推定キー：' || n[t + 1] || 'メジャー / ' || n[(t + 9) % 12 + 1] || 'マイナー'
           ELSE '推定キー：' || n[t + 1] || 'マイナー / ' || n[(t + 3) % 12 + 1] || 'メジャー' END AS text,
           n[t + 1] || CASE WHEN m = 'major' THEN 'メジャー' ELSE 'マイナー' END AS short FROM k""",
)
def _(v: Views):
    tonic = F.col("user_id") % 12
    mode = F.when(F.col("event_id") % 2 == 0, "major").otherwise("minor")
    return _events(v).select(
        "event_id", X.key_text(tonic, mode).alias("text"), X.localize_key(X.key_name(tonic, mode)).alias("short")
    )


@query(
    "scale_bar",
    """
    WITH f AS (SELECT event_id, event_id % 90 AS a, event_id % 90 + event_id % 7 AS b, [0.5, 1.0, 1.5, 2.0][event_id % 4 + 1]::DOUBLE AS f FROM events),
    g AS (SELECT *, greatest(1, CAST(round_even((a - 1) * f, 0) AS BIGINT) + 1) AS s FROM f)
    SELECT event_id, greatest(1, CAST(round_even(a * f, 0) AS BIGINT)) AS bars, s AS start_bar,
           greatest(s, CAST(round_even(b * f, 0) AS BIGINT)) AS end_bar,
           greatest(s, CAST(round_even(b * f, 0) AS BIGINT)) - s + 1 AS bar_count FROM g""",
)
def _(v: Views):
    i = F.col("event_id")
    factor = F.element_at(F.array(*[F.lit(x) for x in (0.5, 1.0, 1.5, 2.0)]), (i % 4 + 1).cast("int"))
    scaled = X.scale_range(i % 90, i % 90 + i % 7, factor)
    rows = _events(v).select("event_id", X.scale_bar(i % 90, factor).alias("bars"), scaled.alias("r"))
    return rows.select("event_id", "bars", "r.start_bar", "r.end_bar", "r.bar_count")


@query(
    "display_bpm",
    """
    WITH b AS (SELECT event_id, (60 + event_id % 80) * 0.5::DOUBLE * CASE WHEN event_id % 3 = 0 THEN 1.0 ELSE 2.0 END AS b FROM events)
    SELECT event_id, CASE WHEN b = floor(b) THEN CAST(CAST(b AS BIGINT) AS VARCHAR) ELSE printf('%.1f', b) END AS text FROM b""",
)
def _(v: Views):
    i = F.col("event_id")
    factor = F.when(i % 3 == 0, 0.0).otherwise(2.0)
    return _events(v).select("event_id", X.display_bpm((60 + i % 80) * 0.5, factor).alias("text"))


@query("workspace_key", "SELECT s_suppkey, sha256('https://e' || s_nationkey || '|' || s_name || '|sessions') AS key FROM supplier")
def _(v: Views):
    endpoint = F.concat(F.lit("https://e"), "s_nationkey")
    return v.table("supplier").select("s_suppkey", X.workspace_key(endpoint, "s_name", F.lit("sessions")).alias("key"))


@query(
    "revision",
    """
    SELECT id, coalesce(nullif(updated_at, 0), nullif(deleted_at, 0), 0.0) AS at_time, device,
           coalesce(nullif(digest, ''), CASE WHEN deleted THEN 'deleted' ELSE '' END) AS digest FROM v_remote""",
)
def _(v: Views):
    rev = X.revision("updated_at", "deleted_at", "device", "digest", "deleted")
    return v.remote.select("id", rev.alias("r")).select("id", F.col("r.at").alias("at_time"), "r.device", "r.digest")


@query(
    "asset_keys",
    """
    SELECT id, 'sessions/' || id || '/' || unnest(['session.json', 'audio.mp3', 'video.mp4', 'stems/vocals.mp3',
           'stems/drums.mp3', 'stems/bass.mp3', 'stems/other.mp3']) AS key FROM v_library""",
)
def _(v: Views):
    return v.library.select("id", F.explode(X.asset_keys("id")).alias("key"))


@query(
    "relative_position",
    """
    SELECT event_id, round_even(greatest(0.0, least(1.0, (value * 4 - 20) / greatest(1, user_id - 10))), 4) AS x FROM events""",
)
def _(v: Views):
    return _events(v).select("event_id", X.relative_position(F.col("value") * 4, F.lit(20), F.col("user_id") + 10).alias("x"))
