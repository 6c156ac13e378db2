"""SHA-256 of the texts of a group in order, whatever the size of the group.

A hash of this kind can only be computed from front to back, so the texts of a group do pass through one task, but as a
stream: neighbours are put together in blocks of bounded size, the blocks of a group are sorted outside memory, and the
hash is fed with one after the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from metrum.plans.rank import in_order

BLOCK_ROWS = 4096


def ordered_digest(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], text: Column, start: str = "", between: str = ",", end: str = "", out: str = "digest",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``keys`` and ``out``: the hash of ``start``, the group's texts in order with ``between`` in between, and ``end``."""
    own = [F.col(k).asc() for k in keys]
    placed = in_order(rows.select(*keys, text.alias("_text"), *[F.struct(o_column).alias(f"_o{i}") for i, o_column in enumerate(order)]), [*own, *[F.col(f"_o{i}").asc() for i in range(len(order))]])
    block = F.floor(F.col("_place") / block_rows).cast("long").alias("_block")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_place", "_text"))), lambda r: r["_text"])
    blocks = placed.groupBy(*keys, block).agg(F.array_join(ordered, between).alias("_text"))
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "_block").select(*keys, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, names = None, hashlib.sha256(), list(keys)

        def finished() -> pa.RecordBatch:
            digest.update(end.encode())
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(last, kinds)] + [pa.array([digest.hexdigest()])], [*names, out])

        for batch in batches:
            kinds = [batch.schema.field(n).type for n in names]
            for *group, part in zip(*[batch.column(n).to_pylist() for n in [*names, "_text"]]):
                if group == last:
                    digest.update(between.encode())
                else:
                    if last is not None:
                        yield finished()
                    last, digest = group, hashlib.sha256(start.encode())
                digest.update(part.encode())
        if last is not None:
            yield finished()

    schema = StructType([*[rows.schema[k] for k in keys], StructField(out, StringType())])
    return dealt.mapInArrow(run, schema)
