"""Reports over files and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.functions import fixed


def storage_report(inventory: DataFrame, categories: Sequence[str] = fixed.STORAGE_CATEGORIES) -> DataFrame:
    """Bytes and files per category, empty ones included, and a row for the total with a null category."""
    used = inventory.groupBy("category").agg(F.sum("length").alias("_bytes"), F.count(F.lit(1)).alias("_files"))
    spark = inventory.sparkSession
    listed = spark.createDataFrame([(c,) for c in categories], "category string")
    rows = listed.join(used, "category", "left").select(
        "category", F.coalesce("_bytes", F.lit(0)).alias("bytes"), F.coalesce("_files", F.lit(0)).alias("files")
    )
    total = rows.agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    return rows.unionByName(total.select(F.lit(None).cast("string").alias("category"), "bytes", "files"))


def repair_summary(before: DataFrame, after: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(one row of totals, changed sessions with their number of changed labels) from sections before and after."""
    b = before.select("s", "idx", F.col(label).alias("_before"))
    a = after.select("s", "idx", F.col(label).alias("_after"))
    changed = b.join(a, ["s", "idx"], "full_outer").groupBy("s").agg(
        F.count_if(~F.col("_before").eqNullSafe(F.col("_after"))).alias("label_changes")
    )
    totals = changed.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("label_changes") > 0).alias("changed"),
        F.coalesce(F.sum("label_changes"), F.lit(0)).alias("label_changes"),
    )
    return totals, changed.filter("label_changes > 0")


def retention(
    inventory: DataFrame,
    now: Column,
    max_age: int = 86400,
    categories: Sequence[str] = fixed.CLEARABLE_CATEGORIES,
    protected: Sequence[str] = fixed.PROTECTED_NAMES,
) -> DataFrame:
    """Files older than ``max_age`` seconds in the given categories, except under protected names."""
    parts = F.split("path", "/")
    kept = F.exists(parts, lambda p: p.isin(*protected)) if protected else F.lit(False)
    old = F.col("modified") < now - max_age
    return inventory.filter(F.col("category").isin(*categories) & old & ~kept)


def clear_categories(inventory: DataFrame, requested: Sequence[str]) -> DataFrame:
    """Files that clearing the requested caches removes; asking for any other category is an error."""
    wanted = list(dict.fromkeys(requested))
    if not wanted or any(c not in fixed.CLEARABLE_CATEGORIES for c in wanted):
        raise ValueError("not a category that may be cleared")
    safe = F.exists(F.split("path", "/"), lambda p: p.isin(*fixed.PROTECTED_NAMES)) & (F.col("category") == "work")
    return inventory.filter(F.col("category").isin(*wanted) & ~safe)


def freed(doomed: DataFrame) -> DataFrame:
    return doomed.groupBy("category").agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("files"))
