"""Exact top-k search by inner product with norm buckets.

Vectors are sorted by length and packed into buckets of about two thousand, so that a bucket has one length bound.
Queries go in groups of bounded size, each sent to the buckets' tasks. For a group, the bucket of the longest vectors
first gives every query a score that its k best reach at least. Then each task goes through its buckets:

*   a query whose length times the bucket's cannot reach its threshold passes the bucket over (length pruning);
*   otherwise the threshold over these lengths is a local cosine threshold. A cosine that high bounds the coordinate in
    which the query is largest; if that bound leaves few of the bucket's vectors, only these are tried (coordinate
    pruning), else those long enough;
*   what is left is verified by exact integer products, and thresholds rise.

Every task returns its own k best for each query, so what is shuffled doesn't depend on a bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrum.llm.tables import durable, table
from metrum.llm.text import prepare

SCALE = 1024
K = 10
BUCKET_ROWS = 2048
GROUP_ROWS = 1 << 15
#: Products of at most this magnitude are sums of doubles without rounding.
EXACT = float(1 << 53)
FEW = 0.02
SLACK = 1 + 1e-9
QUERY_BLOCK = 1024


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): vectors as doubles; those null or with null or non-finite components are left out."""
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(finite)


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """Vectors of a column as rows of floor(1024 x), shorter ones filled up with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    before = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(before, sizes)] = flat
    return out


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", rows, rows))


def buckets(rows: DataFrame, dim: int, count: int) -> DataFrame:
    """Buckets (longest, n, ids, v) of vectors of similar length, longest first within a task."""
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    # Equal lengths are told apart by id and content, so that copies of one vector don't meet in one task.
    spread = rows.select("vec_id", "v", norm.alias("norm"), F.xxhash64("vec_id", "v").alias("mix"))
    parts = max(1, -(-count // (2 * BUCKET_ROWS)))
    ranged = spread.repartitionByRange(parts, F.col("norm").desc(), "mix").sortWithinPartitions(F.col("norm").desc(), "mix")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            for low in range(0, whole.num_rows, BUCKET_ROWS):
                part = whole.slice(low, BUCKET_ROWS)
                values = matrix(part.column("v").combine_chunks(), dim)
                size = lengths(values)
                order = np.argsort(-size, kind="stable")
                ids = part.column("vec_id").to_numpy()[order]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([float(size.max())]), pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([values[order].tobytes()], pa.binary())],
                    ["longest", "n", "ids", "v"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= BUCKET_ROWS:
                yield from made()
                held, size = [], 0
        if held:
            yield from made()

    return ranged.select("vec_id", "v").mapInArrow(pack, "longest double, n long, ids binary, v binary")


class Search:
    """The k best so far for a group of queries."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int, least: np.ndarray | None = None):
        self.ids, self.values, self.k = ids, values, k
        self.size = lengths(values)
        self.unit = values / np.maximum(self.size, 1e-300)[:, None]
        self.focus = np.abs(values).argmax(axis=1) if values.shape[1] else np.zeros(len(ids), np.int64)
        self.top = float(np.abs(values).max()) if values.size else 0.0
        self.least = np.full(len(ids), -np.inf) if least is None else least.copy()
        self.found = [np.zeros(0, np.int64)] * 3  # query, vector, score

    def visit(self, longest: float, ids: np.ndarray, values: np.ndarray) -> None:
        bound = self.size * longest * SLACK
        active = np.flatnonzero((bound >= self.least) | (self.size == 0) & (self.least <= 0))
        if not len(active):
            return
        size = lengths(values)
        exact = self.top * (float(np.abs(values).max()) if values.size else 0.0) * max(1, values.shape[1]) < EXACT
        rest = self._by_coordinate(active, longest, ids, values, size) if exact and values.shape[1] else active
        for low in range(0, len(rest), QUERY_BLOCK):
            own = rest[low : low + QUERY_BLOCK]
            # Length pruning inside the bucket: vectors are sorted, the longest first.
            need = np.where((self.least[own] > 0) & (self.size[own] > 0), self.least[own] / np.maximum(self.size[own] * SLACK, 1e-300), 0)
            reach = max(1, int(np.searchsorted(-size, -need.min(), "right")))
            if exact:
                products = self.values[own] @ values[:reach].T
            else:
                large = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in values[:reach]] for a in self.values[own]]
                products = np.clip(np.array(large, object), -(1 << 63), (1 << 63) - 1)
            self._keep(own, ids[:reach], products)

    def _by_coordinate(self, active: np.ndarray, longest: float, ids: np.ndarray, values: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Try the queries whose feasible range of one coordinate leaves few vectors; return the other queries."""
        cosine = np.clip(self.least[active] / np.maximum(self.size[active] * longest * SLACK, 1e-300), -1, 1)
        able = np.flatnonzero(cosine > 0.5)
        if not len(able):
            return active
        unit = values / np.maximum(size, 1e-300)[:, None]
        q = self.unit[active[able], self.focus[active[able]]]
        c = cosine[able]
        swing = np.sqrt((1 - c * c) * np.maximum(0, 1 - q * q))
        low, high = np.where(q < -c, -1, c * q - swing) - 1e-9, np.where(q > c, 1, c * q + swing) + 1e-9
        tried = np.zeros(len(active), bool)
        for f in np.unique(self.focus[active[able]]):
            order = np.argsort(unit[:, f], kind="stable")
            column = unit[order, f]
            for i in np.flatnonzero(self.focus[active[able]] == f):
                a, b = np.searchsorted(column, low[i]), np.searchsorted(column, high[i], "right")
                if b - a <= FEW * len(column):
                    pick, query = order[a:b], active[able[i] : able[i] + 1]
                    tried[able[i]] = True
                    self._keep(query, ids[pick], self.values[query] @ values[pick].T)
        return active[~tried]

    def _keep(self, queries: np.ndarray, ids: np.ndarray, products: np.ndarray) -> None:
        if not products.size:
            return
        other = ids[None, :] != self.ids[queries][:, None]
        plain = np.where(other, products.astype(np.float64), -np.inf)
        floor = self.least[queries]
        if plain.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(plain, -self.k, axis=1)[:, -self.k])
        row, column = np.nonzero((plain >= floor[:, None]) & other)
        if not len(row):
            return
        score = products[row, column].astype(np.int64)
        merged = [np.concatenate(pair) for pair in zip(self.found, (queries[row], ids[column], score))]
        self.found = best(*merged, self.k)
        query, _, score = self.found
        last = np.flatnonzero(np.append(query[1:] != query[:-1], True))
        full = last[np.diff(np.append(-1, last)) == self.k]
        self.least[query[full]] = np.maximum(self.least[query[full]], score[full])


def best(query: np.ndarray, vector: np.ndarray, score: np.ndarray, k: int) -> list[np.ndarray]:
    """The k highest scores of each query, ties to the smaller vector id, in that order."""
    order = np.lexsort((vector, ~score, query))
    query, vector, score = query[order], vector[order], score[order]
    first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    keep = rank < k
    return [query[keep], vector[keep], score[keep]]


def top(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row where ``queries`` holds, the k highest integer inner products.

    Components are floor(1024 x) of x as double. Candidates are all rows but those of the query's own id; fewer than k
    rows if there are fewer candidates. Ties go to the smaller vec_id. Rows without id or vector, and vectors with a
    null or non-finite component, take no part. Rows that are equal count once; different vectors under one id are
    candidates each, and queries each. Shorter vectors are filled up with zeros. Scores beyond 64 bits are kept at the
    ends of their range. Other columns are not read.
    """
    spark = prepare(vectors.sparkSession)
    rows = usable(vectors, vec_id, vector).distinct()
    total = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.sum(queries.cast("int")).alias("queries")).first()
    kind = "query long, query_id long, vec_id long, score long"
    if not total["n"] or not total["queries"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = int(total["dim"])
    packed = durable(buckets(rows, dim, int(total["n"])))
    head = packed.orderBy(F.col("longest").desc(), F.col("n").desc()).limit(1)
    groups = max(1, -(-int(total["queries"]) // group_rows))
    parts = []
    for group in range(groups):
        own = rows.where(queries)
        if groups > 1:
            own = own.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)) == group)
        asked = own.toArrow().combine_chunks()
        if not asked.num_rows:
            continue
        ids, values = asked.column("vec_id").to_numpy(), matrix(asked.column("v").combine_chunks(), dim)
        first = spark.sparkContext.broadcast((ids, values, None))  # about group_rows vectors
        # The longest vectors give each query a threshold: k scores for each at most come back.
        begun = head.mapInArrow(_search(first, k, dim), kind).toPandas()
        least = np.full(len(ids), -np.inf)
        seen = begun.groupby("query")["score"].agg(["count", "min"])
        seen = seen[seen["count"] == k]
        least[seen.index.to_numpy()] = seen["min"].to_numpy()
        held = spark.sparkContext.broadcast((ids, values, least))
        found = packed.mapInArrow(_search(held, k, dim), kind)
        order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        parts.append(ranked.select("query_id", "rank", "vec_id", "score"))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _search(held, k: int, dim: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values, least = held.value
        state = Search(ids, values, k, least)
        for batch in batches:
            for row in batch.to_pylist():
                state.visit(row["longest"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["v"]).reshape(-1, dim))
        query, vector, score = state.found
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(ids[query]), pa.array(vector), pa.array(score)], ["query", "query_id", "vec_id", "score"])

    return search


def op3_top_k(spark, sf_dir: str) -> DataFrame:
    """The ten best of every hundredth vector against all vectors."""
    return top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH usable AS (
    SELECT DISTINCT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
    FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
