"""Time ranges, regions and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.functions import fixed
from metrum.functions.scalars import half_even, half_even_int
from metrum.plans.ordered import TILE_ROWS, Scan, row_tile, running


def split_rejects(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, rows with one)."""
    judged = df.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def normalize_ranges(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges ``(start_sec, end_sec)`` in three decimals; a whole recording is (null, null). Second: rejects."""
    start = F.coalesce("start_sec", F.lit(0.0))
    reason = F.when((F.col("start_sec") < 0) | (F.col("end_sec") < 0), "negative").when(F.col("end_sec") <= start, "empty")
    good, bad = split_rejects(ranges, reason)
    whole = (start == 0) & F.col("end_sec").isNull()
    return (
        good.withColumns({"start_sec": F.when(~whole, half_even(start, 3)), "end_sec": half_even("end_sec", 3)}),
        bad,
    )


def clip_ranges(ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges within ``duration``, the whole of it by default. Second: rejects."""
    start = F.coalesce("start_sec", F.lit(0.0))
    end = F.when(F.col("end_sec").isNull(), F.col("duration")).otherwise(F.least("end_sec", "duration"))

    def finite(c: Column) -> Column:
        return ~F.isnan(c) & (F.abs(c) < float("inf"))

    reason = (
        F.when(~finite(F.coalesce("duration", F.lit(0.0))) | (F.coalesce("duration", F.lit(0.0)) <= 0), "no duration")
        .when(~finite(start) | ~finite(end) | (start < 0) | (end < 0), "not a time")
        .when(start >= F.col("duration"), "starts after the end")
        .when(end <= start, "empty")
    )
    good, bad = split_rejects(ranges, reason)
    return good.withColumns({"start_sec": start, "end_sec": end}), bad


def trim_edges(rows: DataFrame, head: int, tail: int, tile: int = TILE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows ``(s, idx)`` without the first and last ones; sessions that would lose all rows are rejects ``(s)``."""
    first, last = max(0, head), max(0, tail)
    counted = running(rows, ["s"], row_tile("idx", tile), ["idx"], {"_n": Scan("count", F.lit(1), whole=True)})
    enough = F.col("_n") > first + last
    kept = counted.filter(enough & (F.col("idx") >= first) & (F.col("idx") < F.col("_n") - last)).drop("_n")
    return kept, counted.filter(~enough).select("s").distinct()


def effective_options(df: DataFrame, options: list[str], legacy: str = "legacy") -> DataFrame:
    """Each option: its own value, else the legacy one, else true."""
    return df.withColumns({o: F.coalesce(F.col(o), F.col(legacy), F.lit(True)) for o in options})


def clamp_regions(df: DataFrame) -> DataFrame:
    """Box ``(x, y, w, h)`` clamped into a frame ``(width, height)``, or a band of ``percent`` at ``preset``."""
    width, height = F.col("width"), F.col("height")
    x = F.greatest(F.lit(0), F.least(width - 1, F.col("x")))
    y = F.greatest(F.lit(0), F.least(height - 1, F.col("y")))
    percent = F.greatest(F.lit(5.0), F.least(F.lit(90.0), F.coalesce("percent", F.lit(30.0)))) / 100
    band = F.greatest(F.lit(1), half_even_int(height * percent))
    top = F.lower(F.coalesce("preset", F.lit("bottom"))) == "top"
    custom = F.col("x").isNotNull()
    return df.withColumns({
        "x": F.when(custom, x).otherwise(0).cast("long"),
        "y": F.when(custom, y).when(top, 0).otherwise(height - band).cast("long"),
        "w": F.when(custom, F.greatest(F.lit(1), F.least(width - x, F.col("w")))).otherwise(width).cast("long"),
        "h": F.when(custom, F.greatest(F.lit(1), F.least(height - y, F.col("h")))).otherwise(band).cast("long"),
    })


def filter_settings(df: DataFrame, column: str = "settings") -> tuple[DataFrame, DataFrame]:
    """Settings maps with allowed keys only; rows above the size limit are rejects."""
    allowed = F.map_filter(
        F.coalesce(column, F.create_map().cast("map<string,string>")),
        lambda k, v: v.isNotNull() & (k.isin(*fixed.SETTING_KEYS) | k.startswith(fixed.SETTING_PREFIXES[0]) | k.startswith(fixed.SETTING_PREFIXES[1])),
    )
    kept = df.withColumn(column, allowed)
    return split_rejects(kept, F.when(F.octet_length(F.to_json(column)) > fixed.SETTING_BYTES, "too large"))
