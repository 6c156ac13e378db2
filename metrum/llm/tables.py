"""The given tables, and the shared folder for what is written in between."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metrum.llm.text import prepare
from metrum.plans.durable import durable, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["durable", "scratch", "table"]
