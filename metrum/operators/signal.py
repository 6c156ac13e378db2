"""Sampled tracks: peaks, mixes and click series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metrum.functions.scalars import half_even_int


def waveform_peaks(samples: DataFrame, buckets: int, stride: int = 96) -> DataFrame:
    """``(s, bucket, peak)`` from ``(s, track, idx, sample)``, relative to the session's strongest bucket.

    Buckets follow floor boundaries; of a bucket about ``stride`` samples are looked at. Samples are filtered and
    reduced where they are read, so only one row per bucket is shuffled; the last window sees ``buckets`` rows.
    """
    length = samples.groupBy("s").agg((F.max("idx") + 1).alias("_n"))
    n, w = F.col("_n"), F.lit(buckets)

    def start(p):
        return F.floor(p / w * n).cast("long")

    def end(p):
        return F.greatest(start(p) + 1, F.floor((p + 1) / w * n).cast("long"))

    idx = F.col("idx")
    first = F.greatest(F.lit(0).cast("long"), F.floor(idx * buckets / n).cast("long") - 1)
    last = F.least(F.lit(buckets - 1).cast("long"), F.floor((idx + 1) * buckets / n).cast("long") + 1)
    placed = samples.join(length, "s").withColumn("bucket", F.explode(F.sequence(first, last)))
    p = F.col("bucket")
    step = F.greatest(F.lit(1).cast("long"), F.floor((end(p) - start(p)) / stride).cast("long"))
    seen = placed.filter((idx >= start(p)) & (idx < end(p)) & (F.pmod(idx - start(p), step) == 0))
    loud = seen.groupBy("s", "bucket").agg(F.max(F.abs("sample")).alias("_peak"))
    strongest = F.max("_peak").over(Window.partitionBy("s"))
    return loud.select("s", "bucket", F.when(strongest > 0, F.col("_peak") / strongest).otherwise(F.lit(0.0)).alias("peak"))


def mix_tracks(
    samples: DataFrame, gains: DataFrame, rate: float = 1.0, start: float | None = None, end: float | None = None,
    limit: float = 1.0,
) -> DataFrame:
    """Sum of gain x sample over the tracks that are on, clamped; a time range is cut out first.

    ``gains (track, gain)`` or ``(s, track, gain)``. Indexes start at 0 again after a cut. Gains of tracks alone are few,
    and so are tracks: they are sent to the samples, which a join by track would send to as few tasks.
    """
    kept = samples
    offset = 0
    if start is not None and end is not None:
        if end <= start:
            raise ValueError("the range must have a positive length")
        offset, stop = round(start * rate), round(end * rate)
        kept = kept.filter((F.col("idx") >= offset) & (F.col("idx") < stop))
    audible = gains.filter("gain > 0")
    loud = kept.join(audible, ["s", "track"]) if "s" in gains.columns else kept.join(F.broadcast(audible), "track")
    mixed = loud.groupBy("s", (F.col("idx") - offset).alias("idx")).agg(F.sum(F.col("sample") * F.col("gain")).alias("sample"))
    return mixed.withColumn("sample", F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("sample"))))


CLICK_SECONDS = 0.055
CLICK_DECAY = 75.0
CLICK_LEVEL = 0.72
CLICK_STEPS = 3600


def click_series(times: DataFrame, volume: float, rate: int = 44100) -> DataFrame:
    """Sixteen-bit click track ``(s, frame, value)`` for click times ``(s, t)``; silent frames are left out.

    A click is a decaying square wave; overlapping clicks add up and the sum is clamped once.
    """
    frames = math.ceil(CLICK_SECONDS * rate)
    peak = 32767 * (volume / 100) * CLICK_LEVEL
    length = times.groupBy("s").agg(F.greatest(F.lit(1.0), F.ceil((F.max("t") + CLICK_SECONDS) * rate)).alias("_n"))
    spread = times.join(length, "s").withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(frames - 1))))
    offset = F.col("_o")
    square = F.when(F.floor(offset * CLICK_STEPS / rate) % 2 == 0, 1).otherwise(-1)
    pulse = half_even_int(F.lit(peak) * F.exp(-(offset / rate) * CLICK_DECAY) * square)
    placed = spread.select("s", (half_even_int(F.col("t") * rate) + offset).alias("frame"), pulse.alias("_v"), "_n")
    summed = placed.filter(F.col("frame") < F.col("_n")).groupBy("s", "frame").agg(F.sum("_v").alias("_v"))
    return summed.select("s", "frame", F.greatest(F.lit(-32768), F.least(F.lit(32767), F.col("_v"))).cast("long").alias("value"))
