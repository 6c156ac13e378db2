"""Exact folds over ordered rows, run tile by tile.

Some operators compare each row with the last row they kept, so no window form exists. A fold is given as a *step*
over the rows of one tile and a small state; the state leaving one tile enters the next. Tiles run in parallel.

A tile's run is a transition from an entry state to an exit state. Every tile first runs on a guess (the state of a
session's start); then each round runs it on those exits of the tile before that it hasn't met. Folds that restart on
clear evidence meet few states: once no tile meets a new one, the transitions hold the true path of every session, and
it is found by composing them over 1, 2, 4, ... tiles. A session of one tile needs no run but the one that emits; with
longer ones the rows are stored once, for all rounds. The result equals the sequential fold, whatever the number of tiles.

The rounds are as many as states met by one tile, so a state should hold what later rows depend on and nothing else:
a number that is only carried along (the head of a group, the start of a page) is left out and filled in afterwards
with :func:`metrum.plans.ordered.running`.

``fold`` takes a step over a pandas frame, ``fold_rows`` one over numpy columns for many small sessions, ``fold_strips``
one over rows that hold many positions each, and ``fold_expr`` one as a column expression, whose tiles never leave the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrum.plans.durable import durable
from metrum.plans.ordered import TILE_ROWS, row_tile

State = "list[float] | bytes | None"
Step = Callable[[pd.DataFrame, State, bool], "tuple[pd.DataFrame, State]"]
"""(rows of a tile in order, entry state, is last tile) -> (output rows, exit state)"""

RowStep = Callable[["dict[str, np.ndarray]", "list[float] | None", bool], "tuple[dict[str, np.ndarray], list[float] | None]"]
"""The same over columns."""

StripStep = Callable[[int, int, "list[tuple]", "list[float] | None", bool], "tuple[list[tuple], list[float] | None]"]
"""(number of a tile, its fact, its strips in order, entry state, is last tile) -> (output rows, exit state)"""

Pass = Callable[[DataFrame, DataFrame], DataFrame]
"""(rows with their tile, entry states of tiles) -> exit states or output rows"""

BATCH = 10_000
"""Output rows that ``fold_strips`` hands over at once, or a tile's, if it has more."""

CHUNK = 64
"""Rows whose outputs ``fold_expr`` appends one by one before they are put aside."""


def _settle(
    tiled: DataFrame, keys: list[str], state_type: str, leave: Pass, emit: Pass, tiles: DataFrame | None = None
) -> DataFrame:
    """Find the true entry state of every tile, then emit.

    Both get the rows and the entries: one row per tile and run with ``_entry``, its hash ``_run`` and ``_last``. ``leave``
    turns them into one row per tile and run with ``_exit``. Where ``tiles`` names the tiles, the rows needn't be read for it.
    """
    group = [*keys, "_tile"]
    across = Window.partitionBy(*keys).orderBy("_tile")
    place = F.row_number().over(across).alias("_k")
    known = tiled.select(*group).distinct() if tiles is None else tiles
    tiles = durable(known.select(*group, place, F.lead("_tile").over(across).isNull().alias("_last")))
    nothing = F.lit(None).cast(state_type)
    run = F.xxhash64("_entry").alias("_run")
    begun = tiles.filter("_k = 1").select(*keys, "_k", nothing.alias("_entry"))
    states = begun.select("*", run)
    due = tiles.filter(~F.col("_last")).select(*group, "_k", nothing.alias("_entry")).select("*", run)
    # What holds where every session is one tile.
    entries = tiles.select(*group, nothing.alias("_entry"), "_last").select("*", run)
    if not due.isEmpty():
        # Rounds come back to the same rows, so they are evaluated once and stored.
        tiled = durable(tiled)
        runs: DataFrame | None = None
        while not due.isEmpty():
            exits = leave(tiled, due.drop("_k").withColumn("_last", F.lit(False)))
            placed = exits.join(tiles.select(*group, "_k"), group).select(*keys, "_k", "_run", "_exit")
            runs = durable(placed if runs is None else runs.unionByName(placed))
            offered = runs.select(*keys, (F.col("_k") + 1).alias("_k"), F.col("_exit").alias("_entry")).select("*", run).dropDuplicates([*keys, "_k", "_run"])
            fresh = offered.join(runs.select(*keys, "_k", "_run"), [*keys, "_k", "_run"], "left_anti")
            due = durable(fresh.join(tiles.filter(~F.col("_last")).drop("_last"), [*keys, "_k"]).select(*group, "_k", "_entry", "_run"))
        jump = durable(runs.select(*keys, "_k", "_run", F.xxhash64("_exit").alias("_to")))
        path, reach = durable(states.select(*keys, "_k", "_run")), 1
        while not jump.isEmpty():
            further = path.join(jump, [*keys, "_k", "_run"]).select(*keys, (F.col("_k") + reach).alias("_k"), F.col("_to").alias("_run"))
            path = durable(path.union(further))
            after = jump.select(*keys, (F.col("_k") - reach).alias("_k"), F.col("_run").alias("_to"), F.col("_to").alias("_end"))
            jump = durable(jump.join(after, [*keys, "_k", "_to"]).select(*keys, "_k", "_run", F.col("_end").alias("_to")))
            reach *= 2
        states = path.join(offered.unionByName(states), [*keys, "_k", "_run"]).dropDuplicates([*keys, "_k"])
        entries = tiles.join(states, [*keys, "_k"]).select(*group, "_entry", "_run", "_last")
    return emit(tiled, entries)


def fold(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    step: Step,
    schema: str,
    rows: int = TILE_ROWS,
    then: Sequence[str] = (),
) -> DataFrame:
    """Run ``step`` over each key's rows in order of ``idx`` and, within one ``idx``, of the columns ``then``.

    ``schema`` describes the output rows without keys. Rows of one ``idx`` never part; tiles hold ``rows`` of them. A
    state is a list of numbers, or bytes.
    """
    keys, order = list(keys), [idx, *then]
    group = [*keys, "_tile"]
    tiled = df.withColumn("_tile", row_tile(idx, rows))
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)

    def emit_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(order, kind="stable", ignore_index=True)
        out, _ = step(ordered, _unpacked(ordered["_entry"].iloc[0]), bool(ordered["_last"].iloc[0]))
        for position, key in enumerate(keys):
            out.insert(position, key, ordered[key].iloc[0])
        return out

    def leave_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(order, kind="stable", ignore_index=True)
        head = ordered.iloc[0]
        _, state = step(ordered, _unpacked(head["_entry"]), False)
        return pd.DataFrame([[*[head[c] for c in group], head["_run"], _packed(state)]], columns=[*group, "_run", "_exit"])

    exit_schema = f"{key_ddl}, _tile long, _run long, _exit binary"
    return _settle(
        tiled,
        keys,
        "binary",
        lambda rows_in, entries: rows_in.join(entries, group).groupBy(*group, "_run").applyInPandas(leave_tile, exit_schema),
        lambda rows_in, entries: rows_in.join(entries, group).groupBy(*group).applyInPandas(emit_tile, f"{key_ddl}, {schema}"),
    )


def _packed(state) -> bytes | None:
    """A state as bytes, marked by what it was."""
    if state is None:
        return None
    return b"b" + state if isinstance(state, bytes) else b"f" + np.asarray(state, np.float64).tobytes()


def _unpacked(value):
    if value is None:
        return None
    value = bytes(value)
    return value[1:] if value[:1] == b"b" else np.frombuffer(value[1:], np.float64).tolist()


def fold_rows(
    df: DataFrame, keys: Sequence[str], idx: str, columns: Sequence[str], step: RowStep, schema: str, rows: int = TILE_ROWS
) -> DataFrame:
    """As ``fold``, for many small sessions: sorted partitions are cut into tiles in Python, without a call for each.

    ``idx`` and ``columns`` are numbers. Entry states come as rows of their own in front of a tile's rows, so all of them
    are dealt and sorted once. They are not joined: Spark may leave out a dealing that repeats a join's, and then read
    the join's rows where they were written, or in parts, which would cut tiles.
    """
    keys = list(keys)
    group, names = [*keys, "_tile"], [idx, *[c for c in columns if c != idx]]
    tiled = df.select(*keys, *names).withColumn("_tile", row_tile(idx, rows)).dropna(subset=group)
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    out_names = [part.split()[0] for part in schema.split(",")]

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames of whole tiles."""
        held: pd.DataFrame | None = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf[group].iloc[-1]
            open_rows = (pdf[group] == last).all(axis=1).to_numpy()
            done = len(pdf) - int(open_rows[::-1].argmin() if not open_rows.all() else len(pdf))
            if done:
                yield pdf.iloc[:done]
            held = pdf.iloc[done:]
        if held is not None and len(held):
            yield held

    def runner(leaving: bool):
        by = [*group, "_run"] if leaving else keys

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in tiles(batches):
                change = (pdf[group].to_numpy()[1:] != pdf[group].to_numpy()[:-1]).any(axis=1)
                cut = [0, *(np.flatnonzero(change) + 1).tolist(), len(pdf)]
                held = {c: pdf[c].to_numpy() for c in dict.fromkeys([*names, *by, "_entry", "_last"])}
                firsts = np.add.reduceat(pdf["_first"].to_numpy().astype(np.int64), cut[:-1]).tolist()
                parts: list[dict] = []
                for low, high, entries in zip(cut[:-1], cut[1:], firsts):
                    begin = low + entries
                    for at in range(low, begin):
                        own = {c: held[c][begin:high] for c in names}
                        out, state = step(own, _unpacked(held["_entry"][at]), bool(held["_last"][at]))
                        if leaving:
                            parts.append({c: [held[c][at]] for c in by} | {"_exit": [_packed(state)]})
                        else:
                            size = len(out[out_names[0]])
                            parts.append({k: np.repeat(held[k][at], size) for k in keys} | out)
                yield pd.DataFrame({c: np.concatenate([p[c] for p in parts]) if not leaving else [p[c][0] for p in parts] for c in parts[0]})

        return run

    def mapped(rows_in: DataFrame, entries: DataFrame, leaving: bool, ddl: str) -> DataFrame:
        carried = ["_entry", "_last", *(["_run"] if leaving else [])]
        blank = [F.lit(0).cast(f.dataType).alias(f.name) for f in rows_in.select(*names).schema.fields]
        firsts = entries.select(*group, *blank, *carried, F.lit(True).alias("_first"))
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) if f.name == "_entry" else F.lit(0).cast(f.dataType).alias(f.name) for f in entries.select(*carried).schema.fields]
        own = rows_in.select(*group, *names, *nothing, F.lit(False).alias("_first"))
        dealt = firsts.unionByName(own).repartition(*group).sortWithinPartitions(*group, F.desc("_first"), idx)
        return dealt.mapInPandas(runner(leaving), ddl)

    return _settle(
        tiled,
        keys,
        "binary",
        # Few sessions have tiles that are due, so the others' rows stay where they are.
        lambda rows_in, entries: mapped(
            rows_in.join(entries.select(*group), group, "left_semi"), entries, True, f"{key_ddl}, _tile long, _run long, _exit binary"
        ),
        lambda rows_in, entries: mapped(rows_in, entries, False, f"{key_ddl}, {schema}"),
    )


def fold_strips(
    strips: DataFrame, tiles: DataFrame, key: str, order: Sequence[str], fact: str, step: StripStep, schema: str
) -> DataFrame:
    """As ``fold_rows``, for rows that hold many positions each: ``strips (key, _tile, ...)``, in order of ``order``.

    ``tiles (key, _tile)`` names all tiles of each key, with a number ``fact`` that their steps get; strips of others are
    left out.
    """
    group, names = [key, "_tile"], [c for c in strips.columns if c not in (key, "_tile")]
    facts = tiles.select(*group, fact)
    key_ddl = f"{key} {strips.schema[key].dataType.simpleString()}"

    def runner(leaving: bool):
        columns = [*group, "_run", "_exit"] if leaving else [key, *(part.split()[0] for part in schema.split(","))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            heads = [*group, "_entry", "_last", "_run", fact]
            rows = (row for pdf in batches for row in zip(*(pdf[c].tolist() for c in [*heads, *names])))
            out: list[tuple] = []
            for (name, tile), of_tile in groupby(rows, key=itemgetter(0, 1)):
                entries, own = [], []
                for row in of_tile:
                    (own if row[4] is None else entries).append(row)
                for _, _, entry, last, run_hash, value in (row[:6] for row in entries):
                    found, state = step(int(tile), int(value), [row[6:] for row in own], _unpacked(entry), bool(last))
                    out.extend([(name, tile, int(run_hash), _packed(state))] if leaving else [(name, *row) for row in found])
                if len(out) >= BATCH:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=columns)

        return run

    def mapped(rows_in: DataFrame, entries: DataFrame, leaving: bool, ddl: str) -> DataFrame:
        # A hash as text is missing in strips, so it tells them from entries.
        firsts = entries.join(facts, group).select(*group, "_entry", "_last", F.col("_run").cast("string").alias("_run"), fact)
        # Dealt by a hash of its own, which no join has dealt by: Spark may leave out a dealing that repeats a join's.
        dealt = firsts.unionByName(rows_in, allowMissingColumns=True).repartition(F.xxhash64(*group))
        return dealt.sortWithinPartitions(*group, *order).mapInPandas(runner(leaving), ddl)

    return _settle(
        strips,
        [key],
        "binary",
        lambda rows_in, entries: mapped(
            rows_in.join(entries.select(*group), group, "left_semi"), entries, True, f"{key_ddl}, _tile long, _run long, _exit binary"
        ),
        lambda rows_in, entries: mapped(rows_in, entries, False, f"{key_ddl}, {schema}"),
        tiles,
    )


def fold_expr(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    columns: Sequence[str],
    state_type: str,
    out_type: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    finish: Callable[[Column], Column] | None = None,
    rows: int = TILE_ROWS,
) -> DataFrame:
    """Fold as expressions. ``step(state, row)`` gives the next state and the row to put out, or null for none.

    ``finish(state)`` gives a last row of the session. A tile is collected as one array of at most ``rows`` structs,
    and folded in chunks, so that what is appended to stays short.
    """
    keys = list(keys)
    group = [*keys, "_tile"]
    tiled = df.select(*keys, idx, *[c for c in columns if c != idx]).withColumn("_tile", row_tile(idx, rows))
    nothing = F.lit(None).cast(out_type)

    def folded(rows_in: DataFrame, by: list[str]) -> DataFrame:
        entry = F.struct(idx, *[c for c in columns if c != idx])
        tiles = rows_in.groupBy(*by).agg(
            F.array_sort(F.collect_list(entry)).alias("_rows"),
            F.first("_entry").alias("_entry"),
            F.bool_and("_last").alias("_last"),
        )

        def merge(acc: Column, row: Column) -> Column:
            state, out = step(acc["state"], row)
            grown = F.when(out.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], out))
            return F.struct(state.cast(state_type).alias("state"), grown.alias("out"))

        def chunk(acc: Column, start: Column) -> Column:
            zero = F.struct(acc["state"].alias("state"), F.array().cast(f"array<{out_type}>").alias("out"))
            own = F.aggregate(F.slice("_rows", start, F.lit(CHUNK)), zero, merge)
            return F.transform(F.array(own), lambda f: F.struct(f["state"].alias("state"), F.array_append(acc["outs"], f["out"]).alias("outs")))[0]

        zero = F.struct(F.col("_entry").alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("outs"))
        starts = F.sequence(F.lit(1), F.size("_rows"), F.lit(CHUNK))
        return tiles.withColumn("_f", F.aggregate(starts, zero, chunk))

    def emit(rows_in: DataFrame, entries: DataFrame) -> DataFrame:
        done = folded(rows_in.join(entries, group), group)
        last = finish(F.col("_f.state")) if finish else nothing
        tail = F.filter(F.array(F.when(F.col("_last"), last)), lambda r: r.isNotNull())
        return done.select(*keys, F.inline(F.concat(F.flatten("_f.outs"), tail)))

    return _settle(
        tiled,
        keys,
        state_type,
        lambda rows_in, entries: folded(rows_in.join(entries, group), [*group, "_run"]).select(*group, "_run", F.col("_f.state").alias("_exit")),
        emit,
    )
