"""Pitch histograms, keys and chords."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrum.functions import fixed
from metrum.functions.scalars import degree, half_even, key_name, note_name, scale_name
from metrum.plans.ordered import TILE_ROWS, Scan, positions, row_tile, running


def pitch_histogram(notes: DataFrame) -> DataFrame:
    """``(s, pitch_class, weight)`` from notes ``(s, note)``."""
    return notes.groupBy("s", F.pmod("note", F.lit(12)).alias("pitch_class")).agg(F.count(F.lit(1)).alias("weight"))


def profile_deviations(profile: tuple[float, ...]) -> list[int]:
    """Twelve times each value's distance from the mean, in hundredths: whole numbers, so sums over them are exact."""
    hundredths = [round(100 * p) for p in profile]
    return [12 * p - sum(hundredths) for p in hundredths]


def estimate_key(histogram: DataFrame) -> DataFrame:
    """Best key per session by correlation with the 24 rolled key profiles.

    The histogram becomes one array of twelve weights, so the profiles are constants of one expression and nothing is
    joined. Ties prefer the higher tonic, then minor. An empty or flat histogram has no key and confidence 0. Weights
    and profiles enter as twelve times their distance from the mean; for counts (up to 10 million of a class) all sums
    are whole numbers, so that equal correlations are equal however they are added up.
    """
    weights = [F.sum(F.when(F.col("pitch_class") == k, F.col("weight")).otherwise(0)).cast("double") for k in range(12)]
    wide = histogram.groupBy("s").agg(F.array(*weights).alias("_w"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    summed = wide.withColumn("_sum", total(F.col("_w")))
    energy = summed.withColumn("_e", F.transform("_w", lambda x: x * 12 - F.col("_sum")))
    shares = energy.withColumn("_spread", F.sqrt(total(F.transform("_e", lambda x: x * x))))
    # One parsed literal: building it from hundreds of columns would take longer than the query.
    rolled = [
        f"named_struct('p', array({', '.join(f'{own[(k - tonic) % 12]}D' for k in range(12))}), 'norm', {math.sqrt(sum(x * x for x in own))!r}D, 'tonic', {tonic}, 'mode', '{mode}')"
        for mode, own in (("major", profile_deviations(fixed.MAJOR_PROFILE)), ("minor", profile_deviations(fixed.MINOR_PROFILE)))
        for tonic in range(12)
    ]
    profiles = F.expr(f"array({', '.join(rolled)})")

    def score(profile: Column) -> Column:
        fit = total(F.zip_with("_e", profile["p"], lambda x, y: x * y))
        return F.struct(F.try_divide(fit, F.col("_spread") * profile["norm"]).alias("score"), profile["tonic"].alias("tonic"), profile["mode"].alias("mode"))

    ranked = shares.withColumn("_c", F.sort_array(F.transform(profiles, score), asc=False))
    known = F.col("_spread") > 1e-8
    best, second = F.col("_c")[0], F.col("_c")[1]
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + (best["score"] - second["score"]) * 1.8))
    tonic, mode = F.when(known, best["tonic"]), F.when(known, best["mode"])
    keyed = ranked.select(
        "s", tonic.alias("tonic"), mode.alias("mode"),
        F.when(known, half_even(confidence, 3)).otherwise(F.lit(0.0)).alias("confidence"),
    )
    named = F.col("tonic").isNotNull()
    return keyed.withColumn("key", F.when(named, key_name("tonic", "mode"))).withColumn(
        "scale", F.when(named, scale_name("tonic", "mode"))
    )


def _bits(intervals: tuple[int, ...], root: int) -> int:
    return sum(1 << ((root + i) % 12) for i in intervals)


def infer_chords(frets: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Best chord for the frets ``(s, string, fret)`` struck together: ``(s, label, confidence, notes)``.

    Pitch classes are a 12-bit mask, so a chord is one aggregated row. The best template depends on the mask and the
    bass alone: the 4096 x 12 combinations are scored once and broadcast, a table whose size never grows.
    """
    keys = keys or ["s"]
    tuning = F.array(*[F.lit(n) for n in fixed.TUNING])
    midi = F.element_at(tuning, F.col("string").cast("int") + 1) + F.col("fret")
    struck = frets.withColumn("_note", midi.cast("long"))
    bit = _bit(F.pmod("_note", F.lit(12)))
    chord = struck.groupBy(*keys).agg(
        F.bit_or(bit).alias("mask"),
        F.pmod(F.min("_note"), F.lit(12)).cast("int").alias("bass"),
        F.count(F.lit(1)).alias("_strings"),
    )
    named = chord.join(F.broadcast(chord_table(frets.sparkSession)), ["mask", "bass"], "left")
    usable = (F.col("_strings") >= 2) & (F.bit_count("mask") >= 2)
    return named.select(
        *keys,
        F.when(usable, F.col("label")).alias("label"),
        F.when(usable, F.col("confidence")).otherwise(0.0).alias("confidence"),
        F.bit_count("mask").alias("pitch_classes"),
    )


def _bit(pitch: Column) -> Column:
    return F.element_at(F.array(*[F.lit(1 << k) for k in range(12)]), pitch.cast("int") + 1)


def chord_table(spark: SparkSession) -> DataFrame:
    """``(mask, bass, label, confidence)`` for every set of pitch classes and every bass note in it."""
    combos = spark.range(4096 * 12).select(
        F.floor(F.col("id") / 12).cast("int").alias("mask"), (F.col("id") % 12).cast("int").alias("bass")
    )
    mask, bass = F.col("mask"), F.col("bass")
    rare = {"aug": 0.18, "dim": 0.10}
    built = [
        f"named_struct('bits', {_bits(intervals, root)}, 'root', {root}, 'size', {len(intervals)}, "
        f"'label', '{fixed.NOTES[root]}{suffix}', 'rare', {rare.get(suffix, 0.0)}D)"
        for root in range(12)
        for suffix, intervals in fixed.CHORDS
    ]
    templates = F.expr(f"array({', '.join(built)})")

    def score(t: Column) -> Column:
        missing = F.bit_count(t["bits"].bitwiseAND(F.bitwise_not(mask)))
        extra = F.bit_count(mask.bitwiseAND(F.bitwise_not(t["bits"])))
        has_root = F.getbit(mask, t["root"]) == 1
        total = (
            missing
            + extra * 0.28
            + F.when(has_root, 0.0).otherwise(0.45)
            + F.greatest(F.lit(0), t["size"] - 3) * 0.04
            + F.when(t["root"] == bass, 0.0).otherwise(0.14)
            + t["rare"]
        )
        return F.struct(total.alias("score"), t["size"].alias("size"), t["label"].alias("label"), t["root"].alias("root"))

    possible = combos.filter((F.getbit(mask, bass) == 1) & (F.bit_count(mask) >= 2))
    ranked = possible.withColumn("_best", F.array_min(F.transform(templates, score)))
    label = F.col("_best.label")
    slash = (bass != F.col("_best.root")) & ~label.endswith("5")
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.col("_best.score") * 0.22))
    return ranked.select(
        "mask", "bass", F.when(slash, F.concat(label, F.lit("/"), note_name(bass))).otherwise(label).alias("label"),
        confidence.alias("confidence"),
    )


def chord_changes(events: DataFrame, minimum: float = 0.42, per_measure: int = 4) -> DataFrame:
    """Chord events ``(s, measure, idx, label, confidence)`` that change the chord, at most four per measure.

    Weak events are ignored; an event equal to the last strong one of its measure is no change.
    """
    strong = events.filter(F.col("label").isNotNull() & (F.col("confidence") >= minimum))
    keys = ["s", "measure"]
    seen = running(strong, keys, row_tile("idx"), ["idx"], {"_prev": Scan("last", F.col("label"), exclusive=True)})
    changed = seen.filter(F.col("_prev").isNull() | (F.col("_prev") != F.col("label"))).drop("_prev")
    ranked = positions(changed, keys, ["idx"], row_tile("idx"), "_rank")
    return ranked.filter(F.col("_rank") < per_measure).drop("_rank")


def with_degrees(chords: DataFrame, keys: DataFrame) -> DataFrame:
    """Add the Roman-numeral ``degree`` of each chord in its session's key."""
    return chords.join(keys.select("s", "tonic"), "s", "left").withColumn("degree", degree("label", "tonic")).drop("tonic")


def harmony_rollup(measures: DataFrame) -> DataFrame:
    """Per session from ``(s, measure, chords, confidence)``: measures with chords, mean positive confidence."""
    mean = F.avg(F.when(F.col("confidence") > 0, F.col("confidence")))
    return measures.groupBy("s").agg(
        F.count_if(F.col("chords") > 0).alias("analyzed"), F.coalesce(half_even(mean, 3), F.lit(0.0)).alias("confidence")
    )
