"""Every registered query against its SQL on the smallest tables."""

import os
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from metrum.operators.sections import selection_range
from metrum.queries.views import Views
from metrum.session import FIRST_PARTITIONS, OWN_PARTITIONS, PARTITIONS, SMALL_TASKS, TASK_BYTES, spread
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    ok, message = compare(spark, name, entry.queries()[name], entry.oracle_sql().get(name), SF, con)
    assert ok, message


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_shuffles_begin_with_many_partitions(spark):
    """With as many as the session has for small tables, a task would grow with large ones."""
    spark.conf.unset(FIRST_PARTITIONS)
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < PARTITIONS
    pairs = entry.queries()["drop_narrow"](spark, SF)
    assert re.search(rf"hashpartitioning\(s#\S+ _tile#\S+ {PARTITIONS}\)", pairs._jdf.queryExecution().executedPlan().toString())
    spark.conf.set(FIRST_PARTITIONS, "7")
    assert spread(spark).conf.get(FIRST_PARTITIONS) == "7"
    spark.conf.unset(FIRST_PARTITIONS)


def test_partitions_follow_the_tables(spark):
    names = [FIRST_PARTITIONS, OWN_PARTITIONS, *SMALL_TASKS]
    for name in names:
        spark.conf.unset(name)
    most = [spread(spark, size).conf.get(FIRST_PARTITIONS) for size in (0, 500 * TASK_BYTES, 900 * TASK_BYTES - 1, TASK_BYTES)]
    assert most == [str(PARTITIONS), "500", "900", "900"] and all(spark.conf.get(n) == v for n, v in SMALL_TASKS.items())
    # What a session names stays.
    for name in names[:1] + names[2:]:
        spark.conf.set(name, "77")
    assert [spread(spark, 900 * TASK_BYTES).conf.get(n) for n in names if n != OWN_PARTITIONS] == ["77"] * 3
    for name in names:
        spark.conf.unset(name)


def test_barlines_are_read_and_grouped_once(spark):
    plan = Views(spark, SF)._make_barlines()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_barlines_of_unknown_place(spark, tmp_path):
    """A line without a price sorts last and counts as close to the one before it, which it replaces if only it is known."""
    rows = [(s, n, 1.0 + (n + s) % 3, price) for s, prices in enumerate([(10.5, None), (30.0, 100.0, None, 170.0), (None, 640.0, 1270.0), (5.0, 70.0)]) for n, price in enumerate(prices)]
    pd.DataFrame(rows, columns=["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]).to_parquet(f"{tmp_path}/lineitem.parquet")
    views = sorted(tuple(r) for r in Views(spark, str(tmp_path)).barlines.select("s", "idx", F.coalesce("x", F.lit(-1))).collect())
    assert views == [(0, 0, 10), (0, 1, -1), (1, 0, 30), (1, 1, 100), (1, 2, 170), (1, 3, -1), (2, 0, 40), (2, 1, 70), (2, 2, -1), (3, 0, 5), (3, 1, 70)]
    for name in ("drop_close", "drop_narrow", "chunk_rows"):
        ok, message = _compared(spark, tmp_path, name)
        assert ok, f"{name}: {message}"


def _compared(spark, folder, name):
    return compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], str(folder), duck(str(folder)))


def test_sizes_beyond_64_bits(spark, tmp_path):
    keys = [1, 748_000, 9_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.id: r.text for r in entry.queries()["human_bytes"](spark, str(tmp_path)).collect()}
    assert got == {1: "23 B"} | {k: f"{(22 * k**3 + 1) / 2**40:.1f} TB" for k in keys[1:]}


def test_panorama_whose_limit_falls_between_columns(spark, tmp_path):
    """0.82 of a target of 75 columns is a hair less than 61.5 as a double."""
    duck("/root/testdata/sf0.1").execute(f"COPY (SELECT * FROM lineitem WHERE l_suppkey = 595) TO '{tmp_path}/lineitem.parquet'")
    ok, message = _compared(spark, tmp_path, "split_at_boundaries")
    assert ok, message


def test_panoramas_without_levels_or_places(spark, tmp_path):
    """A column without a discount has no ink, and sums leave it out; columns of no known order come last."""
    levels = "CASE WHEN l_orderkey % 3 <> 0 THEN l_discount END AS l_discount"
    places = "CASE WHEN l_partkey % 5 <> 0 THEN l_orderkey END AS l_orderkey, CASE WHEN l_partkey % 3 <> 0 THEN l_linenumber END AS l_linenumber"
    duck("/root/testdata/sf0.1").execute(
        f"COPY (SELECT * REPLACE ({levels}, {places}) FROM lineitem WHERE l_suppkey < 40) TO '{tmp_path}/lineitem.parquet'"
    )
    ok, message = _compared(spark, tmp_path, "split_at_boundaries")
    assert ok, message


def _on_disk(spark):
    """Sizes of the session's shuffle and checkpoint files."""
    context = spark.sparkContext._jsc.sc()
    folders = [f.getPath() for f in context.env().blockManager().diskBlockManager().localDirs()]
    if context.getCheckpointDir().isDefined():
        folders.append(context.getCheckpointDir().get().removeprefix("file:"))
    # A file may go meanwhile.
    paths = (os.path.join(d, f) for top in folders for d, _, files in os.walk(top) for f in files)
    return {p: os.path.getsize(p) for p in paths if os.path.exists(p)}


def test_panoramas_take_little_disk(spark):
    """Rows are dealt once, packed, and not stored as rows. With many dealings it was 154 bytes for each while all files stay."""
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").count()
    before = _on_disk(spark)
    assert entry.queries()["split_at_boundaries"](spark, "/root/testdata/sf0.01").count() > 0
    assert sum(size for path, size in _on_disk(spark).items() if path not in before) < 60 * lines


def test_keys_of_equal_score(spark, tmp_path):
    """Sessions whose best tonics are equally good, and flat ones."""
    sets = [(0, 6), (1, 7), (0, 4, 8), (0, 3, 6, 9), (2, 5, 8, 11), (0, 2, 4, 6, 8, 10), (0, 1, 6, 7), range(12)]
    rows = [(s * 10 + n, float(12 + c)) for s, classes in enumerate(sets) for n in (1, 3, 7) for c in classes for _ in range(n)]
    pd.DataFrame(rows, columns=["l_suppkey", "l_quantity"]).to_parquet(f"{tmp_path}/lineitem.parquet")
    ok, message = _compared(spark, tmp_path, "estimate_key")
    assert ok, message
    got = {r.s: r for r in entry.queries()["estimate_key"](spark, str(tmp_path)).collect()}
    # Sets that look alike from several tonics: the highest of these wins, whatever the number of notes.
    for s, period in ((0, 6), (1, 6), (2, 4), (3, 3), (4, 3), (5, 2), (6, 6)):
        assert {got[s * 10 + n].tonic >= 12 - period for n in (1, 3, 7)} == {True}
    assert {(got[70 + n].tonic, got[70 + n].confidence) for n in (1, 3, 7)} == {(None, 0.0)}


def test_selection_with_its_labels(spark):
    sections = spark.createDataFrame([(0, k, x, float(k), k + 1.0) for k, x in enumerate("cabd")], "s long, idx long, label string, start_time double, end_time double")
    assert [tuple(r) for r in selection_range(sections, sections.where("idx <> 1")).collect()] == [(0, 0.0, 4.0, ["c", "b", "d"])]
