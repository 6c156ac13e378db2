"""The newest row of each key over all batches of a stream, in runs of doubling length.

A batch adds one run that holds its own keys. As in a binary counter, the runs of 1, 2, 4, ... batches that end with it
become one, so after ``n`` batches there are as many runs as ones in the binary form of ``n``: a base and at most log n
others. A row is rewritten at most log n times, so a batch writes about as much as it has keys.

A run's name and contents depend only on the batches it covers. A batch that is retried finds every run it needs (what
it replaced is removed one batch later) and writes the same run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "_batch"


def live_runs(n: int) -> list[tuple[int, int]]:
    """First batch and end of each run after ``n`` batches, the longest first."""
    runs, low = [], 0
    for bit in reversed(range(n.bit_length())):
        if n >> bit & 1:
            runs.append((low, low + (1 << bit)))
            low += 1 << bit
    return runs


class Store:
    """Rows by ``keys`` under ``path``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def _run(self, run: tuple[int, int]) -> str:
        return f"{self.path}/run={run[0]}-{run[1]}"

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> int:
        """How many batches are stored in full."""
        path, files = self._folder()
        if not files.exists(path):
            return 0
        names = [s.getPath() for s in files.listStatus(path)]
        whole = [p.getName() for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max((int(n.rpartition("-")[2]) for n in whole if n.startswith("run=")), default=0)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*self.keys, BATCH)]
        found = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), BATCH).alias("_r"), F.max(BATCH).alias(BATCH))
        return found.select(*self.keys, "_r.*", BATCH)

    def _rows(self, runs: list[tuple[int, int]], ids: DataFrame | None = None) -> DataFrame | None:
        if not runs:
            return None
        rows = self.spark.read.parquet(*map(self._run, runs))
        return rows if ids is None else rows.join(ids, self.keys, "left_semi")

    def read(self, n: int | None = None, ids: DataFrame | None = None) -> DataFrame | None:
        """The newest row of each key (of ``ids``) after the first ``n`` batches, all unless given; None before the first."""
        runs = live_runs(self.batches() if n is None else n)
        rows = self._rows(runs, ids)
        if rows is None:
            return None
        return (self._newest(rows) if len(runs) > 1 else rows).drop(BATCH)

    def write(self, epoch: int, rows: DataFrame, forget: Column | None = None) -> None:
        """Store the rows of a batch, one for each of its keys. Rows that meet ``forget`` go when the base is rewritten."""
        before, after = live_runs(epoch), live_runs(epoch + 1)
        merged = [r for r in before if r not in after]
        fresh = rows.withColumn(BATCH, F.lit(epoch).cast("long"))
        if merged:
            fresh = self._newest(self._rows(merged).select(*fresh.columns).unionByName(fresh))
        if forget is not None and after[-1][0] == 0:
            fresh = fresh.where(~F.coalesce(forget, F.lit(False)))
        fresh.write.mode("overwrite").parquet(self._run(after[-1]))
        path, files = self._folder()
        for run in live_runs(max(epoch - 1, 0)):
            if run not in before and run not in after:
                files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self._run(run)), True)
