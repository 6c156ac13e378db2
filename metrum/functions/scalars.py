"""Column to Column expressions. All of them run inside generated code; none is a Python function over rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from metrum.functions import fixed

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- numbers -------------------------------------------------------------------------------------------------


def half_even(c: Col, digits: int = 0) -> Column:
    """Round to ``digits`` decimals, ties to even on the scaled double."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def half_even_int(c: Col) -> Column:
    return F.rint(col(c)).cast("long")


def or_default(c: Col, default: Column) -> Column:
    """The value unless it is null or zero."""
    return F.coalesce(F.nullif(col(c), F.lit(0)), default)


def clamp(c: Col, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, col(c)))


def relative_position(x: Col, left: Col, right: Col) -> Column:
    """Where ``x`` lies between two barlines, 0 to 1 in four decimals."""
    width = F.greatest(F.lit(1), col(right) - col(left))
    return half_even(clamp((col(x) - col(left)) / width, F.lit(0.0), F.lit(1.0)), 4)


def scale_bar(bars: Col, factor: Col) -> Column:
    return F.greatest(F.lit(1).cast("long"), half_even_int(col(bars) * col(factor)))


def scale_range(start: Col, end: Col, factor: Col) -> Column:
    """Struct of start_bar, end_bar, bar_count after multiplying a one-based inclusive range."""
    first = F.greatest(F.lit(1).cast("long"), half_even_int((col(start) - 1) * col(factor)) + 1)
    last = F.greatest(first, half_even_int(col(end) * col(factor)))
    return F.struct(first.alias("start_bar"), last.alias("end_bar"), (last - first + 1).alias("bar_count"))


def display_bpm(bpm: Col, factor: Col) -> Column:
    """Tempo text: no decimals for whole numbers, else one."""
    value = F.coalesce(col(bpm), F.lit(0.0)) * F.coalesce(F.nullif(col(factor), F.lit(0)), F.lit(1.0))
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.1f", value))


# --- time texts ----------------------------------------------------------------------------------------------


def clock(seconds: Col) -> Column:
    """``mm:ss``, rounded down."""
    whole = F.floor(col(seconds)).cast("long")
    return F.format_string("%02d:%02d", F.floor(whole / 60).cast("long"), F.pmod(whole, F.lit(60)))


def clock_long(seconds: Col) -> Column:
    """``h:mm:ss`` or ``m:ss``, rounded to the second."""
    total = F.greatest(F.lit(0).cast("long"), half_even_int(seconds))
    hours, minutes, rest = _hms(total)
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(
        F.format_string("%d:%02d", minutes, rest)
    )


def _hms(total: Column) -> tuple[Column, Column, Column]:
    return (
        F.floor(total / 3600).cast("long"),
        F.floor(F.pmod(total, F.lit(3600)) / 60).cast("long"),
        F.pmod(total, F.lit(60)).cast("long"),
    )


def duration_text(seconds: Col) -> Column:
    """Japanese duration text: tenths below ten seconds, seconds below a minute, else hours, minutes, seconds."""
    value = F.greatest(F.lit(0.0), col(seconds))
    total = F.floor(value + 0.5).cast("long")
    hours, minutes, rest = _hms(total)
    return (
        F.when(col(seconds).isNull(), F.lit("計測なし"))
        .when(value < 10, F.format_string("%.1f秒", value))
        .when(value < 60, F.format_string("%d秒", total))
        .when(hours > 0, F.format_string("%d時間 %d分 %d秒", hours, minutes, rest))
        .otherwise(F.format_string("%d分 %d秒", minutes, rest))
    )


def parse_time(text: Col) -> Column:
    """Struct of seconds and error for ``s``, ``m:s`` or ``h:m:s``. Blank gives null and no error."""
    trimmed = F.trim(col(text))
    parts = F.split(trimmed, ":")
    well_formed = trimmed.rlike(r"^\d+(\.\d+)?(:\d+(\.\d+)?){0,2}$")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    small = F.forall(F.slice(numbers, 2, 3), lambda n: n < 60)
    valid = well_formed & small
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, n: acc * 60 + n)
    blank = (trimmed == "") | trimmed.isNull()
    return F.struct(
        F.when(~blank & valid, total).alias("seconds"), (~blank & ~F.coalesce(valid, F.lit(False))).alias("error")
    )


def human_bytes(n: Col) -> Column:
    """Size text with binary units up to TB."""
    value = F.coalesce(col(n), F.lit(0)).cast("double")
    text = F.format_string("%d B", value.cast("long"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), start=1):
        size = value / float(1024**power)
        shown = F.when(size >= 10, F.format_string(f"%.1f {unit}", size)).otherwise(
            F.format_string(f"%.2f {unit}", size)
        )
        text = F.when(value >= float(1024**power), shown).otherwise(text)
    return text


# --- identifiers ---------------------------------------------------------------------------------------------

ID_PATTERN = "^[A-Za-z0-9_-]{1,128}$"
SHA_PATTERN = "^[0-9a-f]{64}$"


def is_valid_id(c: Col) -> Column:
    # \z rather than $: a trailing line break is not part of an id.
    return F.coalesce(col(c).rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False))


def is_sha256(c: Col) -> Column:
    return F.coalesce(col(c).rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def video_id(url: Col) -> Column:
    """Video id of an address: the path on the short host, the ``v`` parameter on the long ones, else null."""
    host = F.lower(F.try_parse_url(col(url), F.lit("HOST")))
    path = F.ltrim(F.try_parse_url(col(url), F.lit("PATH")), F.lit("/"))
    query = F.try_parse_url(col(url), F.lit("QUERY"), F.lit("v"))
    return F.when(host.isin(*fixed.SHORT_HOSTS), F.nullif(path, F.lit(""))).when(
        host.isin(*fixed.QUERY_HOSTS), F.nullif(query, F.lit(""))
    )


def session_id(video: Col, start: Col, end: Col) -> Column:
    """Session id of a (normalised) range of a video."""
    first = half_even_int(F.coalesce(col(start), F.lit(0.0)) * 1000).cast("string")
    last = F.coalesce(half_even_int(col(end) * 1000).cast("string"), F.lit("end"))
    clip = F.concat(col(video), F.lit("-clip-"), first, F.lit("-"), last)
    return F.when(col(start).isNull() & col(end).isNull(), col(video)).otherwise(clip)


def source_id(c: Col) -> Column:
    return F.substring_index(col(c), "-clip-", 1)


def stable_id(c: Col) -> Column:
    """Session id behind a job id: no archive suffix, no operation suffix."""
    base = F.substring_index(col(c), ":history:", 1)
    return F.regexp_replace(base, "(?s):(?:stems|stem-export|score-preview|score-extract).*$", "")


def workspace_key(endpoint: Col, bucket: Col, prefix: Col) -> Column:
    return F.sha2(F.concat_ws("|", col(endpoint), col(bucket), col(prefix)), 256)


def asset_names() -> list[str]:
    return ["session.json", "audio.mp3", "video.mp4", *[f"stems/{stem}.mp3" for stem in fixed.STEMS]]


def asset_keys(c: Col, prefix: str = "sessions") -> Column:
    """The seven object keys of a session."""
    return F.array(*[F.concat(F.lit(f"{prefix}/"), col(c), F.lit(f"/{name}")) for name in asset_names()])


def revision(updated: Col, deleted_at: Col, device: Col, digest: Col, deleted: Col) -> Column:
    """Comparable version of a remote entry."""
    mark = F.when(F.coalesce(col(deleted), F.lit(False)), F.lit("deleted")).otherwise(F.lit(""))
    return F.struct(
        or_default(updated, or_default(deleted_at, F.lit(0.0))).cast("double").alias("at"),
        F.coalesce(col(device), F.lit("")).alias("device"),
        F.coalesce(F.nullif(col(digest), F.lit("")), mark).alias("digest"),
    )


def revision_text(of: Col) -> Column:
    """A revision as stored: time, device and digest, separated by bars."""
    r = col(of)
    return F.when(r.isNotNull(), F.concat_ws("|", r["at"].cast("string"), r["device"], r["digest"]))


def parse_revision(c: Col) -> Column:
    """The revision in a stored text; null for null, empty or malformed text. A device may hold bars itself."""
    parts = F.split(col(c), r"\|", -1)
    n = F.size(parts)
    at = parts[0].try_cast("double")
    device = F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(0))), "|")
    return F.when((n >= 3) & at.isNotNull(), F.struct(at.alias("at"), device.alias("device"), F.element_at(parts, -1).alias("digest")))


# --- labels and names ----------------------------------------------------------------------------------------


def canonical_label(c: Col) -> Column:
    label = F.replace(F.lower(F.trim(F.coalesce(col(c), F.lit("")))), F.lit("_"), F.lit("-"))
    out = label
    for name, aliases in fixed.LABEL_ALIASES.items():
        out = F.when(label.isin(*aliases), F.lit(name)).otherwise(out)
    return out


def _first_contained(c: Col, pairs) -> Column:
    lowered = F.lower(F.coalesce(col(c), F.lit("")))
    head, *tail = [(lowered.contains(key), F.lit(value)) for key, value in pairs]
    return reduce(lambda chain, pair: chain.when(*pair), tail, F.when(*head))


def label_class(c: Col) -> Column:
    """Colour class of a section label, null when no alias occurs in it."""
    return _first_contained(c, fixed.LABEL_CLASSES)


def localize_label(c: Col) -> Column:
    """Label with the first known English name replaced by the Japanese one."""
    key = _first_contained(c, [(key, key) for key, _ in fixed.LABEL_NAMES])
    name = _first_contained(c, fixed.LABEL_NAMES)
    raw = F.coalesce(col(c), F.lit(""))
    at = F.instr(F.lower(raw), key)
    changed = F.concat(F.substring(raw, F.lit(1), at - 1), name, F.substring(raw, at + F.length(key), F.length(raw)))
    return F.when(key.isNull(), raw).otherwise(changed)


def safe_name(c: Col, fallback: str = "score") -> Column:
    """File name for a printed score: separators and control characters become single underscores."""
    marked = F.regexp_replace(col(c), r'[<>:"/\\|?*\x00-\x1f]', "_")
    joined = F.regexp_replace(F.btrim(marked, F.lit(" ._")), r"\s+", "_")
    clean = F.btrim(F.regexp_replace(joined, "_+", "_"), F.lit("_"))
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback)), 1, 80)


def safe_download_name(c: Col, fallback: str = "practice") -> Column:
    """File name for a download: separators and runs of blanks become one blank."""
    text = F.coalesce(F.nullif(col(c), F.lit("")), F.lit(fallback))
    blanked = F.regexp_replace(F.regexp_replace(text, r'[\\/:*?"<>|]+', " "), r"\s+", " ")
    return F.coalesce(F.nullif(F.substring(F.trim(blanked), 1, 80), F.lit("")), F.lit(fallback))


def safe_export_name(c: Col) -> Column:
    """File name of an exported mix, always ending in .mp3."""
    clean = F.substring(F.trim(F.regexp_replace(col(c), r'[\\/:*?"<>|\r\n]+', " ")), 1, 160)
    named = F.concat(F.coalesce(F.nullif(clean, F.lit("")), F.lit("stem-mix")), F.lit(".mp3"))
    return F.when(F.lower(clean).endswith(".mp3"), clean).otherwise(named)


def mix_name(title: Col, gains: dict[str, Column], selection: Column, click: Column) -> Column:
    """Name of a mix after the tracks that are on, the range and the click."""
    on = F.filter(F.array(*[F.when(gains[s] > 0, F.lit(s)) for s in fixed.STEMS]), lambda s: s.isNotNull())
    off = F.array_except(F.array(*[F.lit(s) for s in fixed.STEMS]), on)
    suffix = (
        F.when(F.size(on) == 1, F.concat(F.lit("_only_"), on[0]))
        .when(F.size(on) == 2, F.concat(F.lit("_"), F.array_join(on, "_")))
        .when(F.size(off) == 1, F.concat(F.lit("_no_"), off[0]))
        .otherwise(F.lit(""))
    )
    return F.concat(
        safe_download_name(title),
        suffix,
        F.when(selection, F.lit("_selection")).otherwise(F.lit("")),
        F.when(click, F.lit("_click")).otherwise(F.lit("")),
        F.lit(".mp3"),
    )


def casefold(c: Col) -> Column:
    return F.replace(F.lower(col(c)), F.lit("ß"), F.lit("ss"))


def normalize_tags(tags: Col) -> Column:
    """Trimmed to 40 characters, blanks dropped, the first of equal tags kept (ignoring case), at most 20."""
    cut = F.transform(col(tags), lambda t: F.substring(F.trim(t), 1, 40))
    some = F.filter(cut, lambda t: t != "")
    folded = F.transform(some, lambda t: casefold(t))
    kept = F.filter(
        F.transform(some, lambda t, i: F.struct(t.alias("tag"), (F.array_position(folded, casefold(t)) == i + 1).alias("keep"))),
        lambda e: e["keep"],
    )
    return F.slice(F.transform(kept, lambda e: e["tag"]), 1, 20)


def stage_of(line: Col) -> Column:
    """Struct of stage and message for a known log line, else null."""
    text = F.trim(col(line))
    plain = F.replace(text, F.lit("=> "), F.lit(""))
    chain = None
    for how, probe, stage, message in fixed.LOG_STAGES:
        test = text.startswith(probe) if how == "starts" else text.contains(probe)
        shown = F.lit(message) if message else (plain if how == "contains" else text)
        hit = F.struct(F.lit(stage).alias("stage"), shown.alias("message"))
        chain = F.when(test, hit) if chain is None else chain.when(test, hit)
    return chain


def message_text(message: Col) -> Column:
    """Japanese text of a job message; unknown messages stay as they are."""
    raw = F.coalesce(col(message), F.lit(""))
    table = F.create_map(*[F.lit(x) for pair in fixed.MESSAGES.items() for x in pair])
    elapsed = F.regexp_extract(raw, r"(\d+)s$", 1)
    running = F.concat(F.lit("AIで曲構成を解析中です（"), elapsed, F.lit("秒経過）"))
    stem = F.lower(F.regexp_replace(raw, "(?i)^Encoding ", ""))
    stems = F.create_map(*[F.lit(x) for pair in fixed.STEM_NAMES_JA.items() for x in pair])
    return (
        F.when(F.try_element_at(table, raw).isNotNull(), F.try_element_at(table, raw))
        .when(raw.rlike("(?i)^Starting WSL analyzer on "), F.lit("曲構成の解析を開始しています"))
        .when(raw.rlike(r"(?i)^Analyzer running for (\d+)s$"), running)
        .when(raw.rlike(r"(?i)^Analyzer still running; no output for (\d+)s$"), running)
        .when(raw.rlike("(?i)^Encoding "), F.concat(F.coalesce(F.try_element_at(stems, stem), stem), F.lit("を変換しています")))
        .when(
            raw.rlike("(?i)^Uploading "),
            F.concat(F.regexp_replace(raw, "(?i)^Uploading ", ""), F.lit("をクラウドへ送信しています")),
        )
        .otherwise(raw)
    )


# --- harmony -------------------------------------------------------------------------------------------------


def note_name(pitch_class: Col) -> Column:
    names = F.array(*[F.lit(n) for n in fixed.NOTES])
    return F.element_at(names, F.pmod(col(pitch_class), F.lit(12)).cast("int") + 1)


def key_name(tonic: Col, mode: Col) -> Column:
    return F.concat(note_name(tonic), F.when(col(mode) == "major", F.lit(" Major")).otherwise(F.lit(" Minor")))


def scale_name(tonic: Col, mode: Col) -> Column:
    """Scale with its relative: "D Major / B Natural Minor"."""
    major = F.concat(note_name(tonic), F.lit(" Major / "), note_name(col(tonic) + 9), F.lit(" Natural Minor"))
    minor = F.concat(note_name(tonic), F.lit(" Natural Minor / "), note_name(col(tonic) + 3), F.lit(" Major"))
    return F.when(col(mode) == "major", major).otherwise(minor)


def key_text(tonic: Col, mode: Col) -> Column:
    """Japanese key estimate for a printed score; null when the key is unknown."""
    major = F.concat(F.lit("推定キー："), note_name(tonic), F.lit("メジャー / "), note_name(col(tonic) + 9), F.lit("マイナー"))
    minor = F.concat(F.lit("推定キー："), note_name(tonic), F.lit("マイナー / "), note_name(col(tonic) + 3), F.lit("メジャー"))
    known = col(tonic).between(0, 11)
    return F.when(known & (col(mode) == "major"), major).when(known & (col(mode) == "minor"), minor)


def localize_key(text: Col) -> Column:
    """Japanese ending of a key name."""
    minor = F.regexp_replace(F.coalesce(col(text), F.lit("")), " Natural Minor$", "マイナー")
    return F.regexp_replace(F.regexp_replace(minor, " Major$", "メジャー"), " Minor$", "マイナー")


CHORD_PATTERN = r"^([A-G](?:#|b)?)([^/]*)(?:/[A-G](?:#|b)?)?$"


def degree(chord: Col, tonic: Col) -> Column:
    """Roman-numeral degree of a chord in a key; null for texts that are no chord."""
    text = col(chord)
    root = F.regexp_extract(text, CHORD_PATTERN, 1)
    suffix = F.regexp_extract(text, CHORD_PATTERN, 2)
    classes = {name: i for i, name in enumerate(fixed.NOTES)} | fixed.FLATS
    pitch = F.try_element_at(F.create_map(*[F.lit(x) for pair in classes.items() for x in pair]), root)
    numerals = F.array(*[F.lit(d) for d in fixed.DEGREES])
    numeral = F.element_at(numerals, F.pmod(pitch - col(tonic), F.lit(12)).cast("int") + 1)
    dim = suffix.startswith("dim")
    lowered = (suffix.startswith("m") & ~suffix.startswith("maj")) | dim
    sign = F.when(dim, F.lit("°")).when(suffix.startswith("aug"), F.lit("+")).otherwise(F.lit(""))
    # Lower-casing leaves the flat sign in front untouched.
    return F.when(
        text.rlike(CHORD_PATTERN) & pitch.isNotNull(),
        F.concat(F.when(lowered, F.lower(numeral)).otherwise(numeral), sign),
    )


# --- masks ---------------------------------------------------------------------------------------------------


def mask_share(a: Col, b: Col) -> Column:
    """Share of unequal cells of two masks; 1.0 when they differ in size."""
    unequal = F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(col(a)) == F.size(col(b)), unequal / F.size(col(a))).otherwise(F.lit(1.0))


def dilate(mask: Col, width: int | Column) -> Column:
    """Every cell within one cell of a set cell, in rows of ``width``."""
    width = F.lit(width) if isinstance(width, int) else width
    cells = F.transform(F.sequence(F.lit(0), F.size(col(mask)) - 1), lambda i: i)

    def grown(i: Column) -> Column:
        row, column = F.floor(i / width), F.pmod(i, width)
        near = F.lit(False)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                inside = (column + dc).between(0, width - 1) & ((row + dr) >= 0)
                cell = F.get(col(mask), (i + dr * width + dc).cast("int"))
                near = near | F.coalesce(inside & cell, F.lit(False))
        return near

    return F.transform(cells, grown)


def mask_unmatched(a: Col, b: Col, width: int | Column) -> Column:
    """Set cells without a counterpart within one cell, over all set cells; 1.0 below 20 set cells."""

    def ones(mask: Column) -> Column:
        return F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int"))

    total = ones(col(a)) + ones(col(b))
    alone = ones(F.zip_with(col(a), dilate(b, width), lambda x, y: x & ~y)) + ones(
        F.zip_with(col(b), dilate(a, width), lambda x, y: x & ~y)
    )
    return F.when(total < 20, F.lit(1.0)).otherwise(F.try_divide(alone, total))
