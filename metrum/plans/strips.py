"""Numbers of ordered rows packed into strips, and rows that are dealt as packed columns.

A strip is a run of consecutive positions of one session in one row: a letter for the smallest type that has room for
its numbers, and these; no letter where they are null. A row of a strip takes one or two bytes, and a dealt row of packed
columns about a third of a shuffled one, so tables that are only read once in order need little disk.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrum.plans.durable import durable
from metrum.plans.ordered import as_columns
from metrum.session import FIRST_PARTITIONS, PARTITIONS

PACK_ROWS = 1 << 19
"""Rows that a task packs at once."""

OUT_ROWS = 1 << 16
"""Rows that a task puts out at once."""

PLACES = 4
"""Hash ranges for each partition that packed rows are dealt to."""


def unlike(columns: Sequence[pa.Array]) -> np.ndarray:
    """Rows that differ in some column from the row before; the first one does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for column in columns:
        out[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return out


def packed_runs(fresh: np.ndarray, values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Starts, lengths and strips of the runs that begin where ``fresh`` says, or where numbers become null or known."""
    known = values.is_valid().to_numpy(zero_copy_only=False)
    numbers = values.fill_null(0).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(fresh | np.append(True, known[1:] != known[:-1]))
    ends = np.append(starts[1:], len(numbers))
    if numbers.dtype.kind == "i":
        spans = zip(np.minimum.reduceat(numbers, starts).tolist(), np.maximum.reduceat(numbers, starts).tolist())
        kinds = [np.min_scalar_type(min(low, -high - 1) if low < 0 else high) for low, high in spans]
    else:
        kinds = [numbers.dtype] * len(starts)
    runs = zip(starts.tolist(), ends.tolist(), kinds, known[starts].tolist())
    strips = [kind.char.encode() + numbers[a:b].astype(kind).tobytes() if some else b"" for a, b, kind, some in runs]
    return starts, ends - starts, pa.array(strips, pa.binary())


def unpacked_run(strip: bytes) -> np.ndarray | None:
    return np.frombuffer(strip, strip[:1].decode(), offset=1) if strip else None


def deal_packed(df: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Rows of ``df``, those of equal ``by`` in one partition, sent as blocks of compressed columns.

    A block has the rows of one range of hashes among those that a task packs at once, in order of their hashes.
    """
    spark = df.sparkSession
    parts = max(PARTITIONS, int(spark.conf.get(FIRST_PARTITIONS, None) or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))
    shift = 64 - (PLACES * parts - 1).bit_length()
    names = df.columns

    def blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        hashes = table["_hash"].to_numpy().view(np.uint64)
        order = np.argsort(hashes, kind="stable")
        places = (hashes[order] >> np.uint64(shift)).astype(np.int64)
        cuts = [0, *(np.flatnonzero(places[1:] != places[:-1]) + 1).tolist(), len(places)]
        sorted_rows = table.select(names).take(pa.array(order)).combine_chunks()
        out = []
        for low, high in zip(cuts[:-1], cuts[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, sorted_rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(sorted_rows.slice(low, high - low))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(places[cuts[:-1]]), pa.array(out, pa.binary())], ["_place", "_block"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACK_ROWS:
                yield blocks(held)
                held, size = [], 0
        if size:
            yield blocks(held)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                yield from pa.ipc.open_stream(block.as_buffer()).read_all().to_batches(max_chunksize=OUT_ROWS)

    hashed = df.withColumn("_hash", F.xxhash64(*as_columns(by)))
    sent = hashed.mapInArrow(pack, "_place long, _block binary").repartition("_place")
    return sent.select("_block").mapInArrow(unpack, df.schema)


def packed_positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, value: str) -> DataFrame:
    """As ``positions``, of one column of numbers, ``(keys, idx, value)``: rows are dealt packed and stored as strips.

    ``bucket`` is a monotone coarsening of ``order``, of which nulls come last, as in the SQL. Rows are ranked in their bucket as they pass in order, and strips
    get the counts of the buckets before; rows come out in order, strip by strip.
    """
    keys = list(keys)
    group = [*keys, "_tile"]
    kind = "long" if df.schema[value].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else "double"
    rows = df.select(*dict.fromkeys([*keys, *order]), F.col(value).cast(kind).alias("_value"), F.coalesce(bucket, F.lit(2**63 - 1)).alias("_tile"))
    key_ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys)
    out_keys = [f.name for f in df.schema.fields if f.name in keys]
    number = pa.int64() if kind == "long" else pa.float64()

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, passed = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c) for c in [*out_keys, "_tile"]]
            fresh = unlike(columns)
            # Rows of the batch's first group go on from the batch before.
            if before != (first := [c[0].as_py() for c in columns]):
                passed = 0
            begins = np.flatnonzero(fresh)
            base = begins.copy()
            base[0] = -passed
            starts, sizes, strips = packed_runs(fresh, batch.column("_value"))
            own = np.searchsorted(begins, starts, side="right") - 1
            taken = pa.array(starts)
            arrays = [*(c.take(taken) for c in columns), pa.array(starts - base[own]), pa.array(sizes), strips]
            yield pa.RecordBatch.from_arrays(arrays, [*out_keys, "_tile", "_from", "_n", "_strip"])
            before, passed = [c[-1].as_py() for c in columns], int(batch.num_rows - base[-1])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("_n").to_numpy()
            upto = np.cumsum(sizes)
            low = 0
            while low < len(sizes):
                high = max(low + 1, int(np.searchsorted(upto, upto[low] - sizes[low] + OUT_ROWS, side="right")))
                n = sizes[low:high]
                at = batch.column("_at").to_numpy()[low:high]
                runs = [unpacked_run(x.as_buffer().to_pybytes()) for x in batch.column("_strip")[low:high]]
                nothing = np.repeat([run is None for run in runs], n)
                values = np.concatenate([np.zeros(size, number.to_pandas_dtype()) if run is None else run.astype(number.to_pandas_dtype()) for run, size in zip(runs, n)])
                idx = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
                taken = pa.array(np.repeat(np.arange(low, high), n))
                arrays = [*(batch.column(c).take(taken) for c in out_keys), pa.array(idx), pa.array(values, number, mask=nothing)]
                yield pa.RecordBatch.from_arrays(arrays, [*out_keys, "idx", value])
                low = high

    dealt = deal_packed(rows.dropna(subset=keys), group).sortWithinPartitions(*group, *[F.asc_nulls_last(c) for c in order])
    strips = durable(dealt.mapInArrow(rank, f"{key_ddl}, _tile long, _from long, _n long, _strip binary"))
    across = Window.partitionBy(*keys).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = strips.groupBy(*group).agg(F.sum("_n").alias("_count"))
    carried = counts.select(*group, F.coalesce(F.sum("_count").over(across), F.lit(0)).alias("_before"))
    placed = strips.join(carried, group).select(*out_keys, (F.col("_before") + F.col("_from")).alias("_at"), "_n", "_strip")
    return placed.mapInArrow(spread, f"{key_ddl}, idx long, {value} {kind}")
