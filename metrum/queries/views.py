"""The given tables seen as sessions, libraries, jobs, frames and sync state, in Spark and in SQL.

Every view is derived from whole tables, so its size grows with them. ``Views`` holds the Spark form; ``SQL`` holds
the same definitions as common table expressions.
"""

from __future__ import annotations

import re
from functools import cached_property
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metrum.functions import scalars as X
from metrum.plans.durable import durable
from metrum.plans.ordered import Scan, positions, row_tile, running
from metrum.plans.strips import packed_positions
from metrum.session import spread

SQL = {
    "v_beats": """
        SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
               round_even((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6, 3) AS t,
               event_type AS kind, event_id
        FROM events""",
    "v_grid_ms": """
        SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value
        FROM events""",
    "v_grid_step": """
        SELECT s, idx, CAST(CASE WHEN s % 3 = 0 AND idx >= 24 THEN 250 WHEN s % 3 = 1 AND idx < 8 THEN 800
               ELSE 500 END + CAST(floor(abs(value)) AS BIGINT) % 5 AS BIGINT) AS ms
        FROM v_grid_ms""",
    "v_grid": """
        SELECT s, idx, CAST(coalesce(sum(ms) OVER (PARTITION BY s ORDER BY idx
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) / 1000.0::DOUBLE AS t
        FROM v_grid_step""",
    "v_downbeats": """
        SELECT s, (idx - s % 4) // 4 AS idx, t FROM v_grid WHERE idx % 4 = s % 4""",
    "v_turns": """
        SELECT conv_id AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx,
               CASE role WHEN 'user' THEN 'verse' WHEN 'assistant' THEN 'chorus' ELSE 'intro' END AS label,
               length(text) AS len, 1 + length(text) % 8 AS w
        FROM conversations""",
    "v_section_sums": """
        SELECT *, CAST(sum(w) OVER (PARTITION BY s ORDER BY idx) AS BIGINT) AS upto,
               CAST(sum(w) OVER (PARTITION BY s) AS BIGINT) AS total_w,
               CAST(sum(len) OVER (PARTITION BY s ORDER BY idx) AS BIGINT) AS len_upto,
               CAST(sum(len) OVER (PARTITION BY s) AS BIGINT) AS total_len
        FROM v_turns""",
    "v_last_beat": "SELECT s, max(t) AS last_t FROM v_grid GROUP BY s",
    "v_sections": """
        SELECT a.s, a.idx, a.label, a.upto - 2 * (a.idx % 3) AS end_bar, a.total_w + 2 AS total_bars,
               round_even((a.len_upto - a.len) * b.last_t / a.total_len, 3) AS start_time,
               round_even(a.len_upto * b.last_t / a.total_len, 3) AS end_time
        FROM v_section_sums a LEFT JOIN v_last_beat b USING (s)""",
    "v_timed_sections": "SELECT * FROM v_sections WHERE start_time IS NOT NULL",
    "v_bars": """
        SELECT s, idx, label, upto - w + 1 AS start_bar, upto AS end_bar, total_w AS total_bars FROM v_section_sums""",
    "v_labels": """
        SELECT s, idx, CASE kind WHEN 'view' THEN 'verse' WHEN 'click' THEN 'verse' WHEN 'purchase' THEN 'chorus'
               ELSE 'bridge' END AS label
        FROM v_beats""",
    "v_plays": """
        SELECT l_partkey AS part, count(*) AS n, max(l_shipdate) AS latest, min(l_shipdate) AS earliest
        FROM lineitem GROUP BY l_partkey""",
    "v_library": """
        SELECT 'p' || p.p_partkey AS id, p.p_partkey AS position, p.p_name AS title,
               [p.p_brand, p.p_type] AS tags, 60 + p.p_size * 2.5::DOUBLE AS bpm,
               strftime(v.earliest, '%Y-%m-%d') AS date,
               CASE WHEN p.p_partkey % 3 <> 0 THEN strftime(v.latest, '%Y-%m-%d') END AS last_played,
               CASE WHEN p.p_partkey % 3 <> 0 THEN coalesce(v.n, 0) ELSE 0 END AS play_count
        FROM part p LEFT JOIN v_plays v ON v.part = p.p_partkey""",
    "v_folders": """
        SELECT p_size % 10 AS folder, 2 * p_partkey AS pos, 'p' || p_partkey AS id FROM part WHERE p_partkey % 4 <> 1
        UNION ALL
        SELECT (p_size + 3) % 10, 2 * p_partkey, 'p' || p_partkey FROM part WHERE p_partkey % 7 = 0
        UNION ALL
        SELECT p_size % 10, 2 * p_partkey + 1, 'gone' || p_partkey FROM part WHERE p_partkey % 50 = 0""",
    "v_jobs": """
        SELECT 'c' || o_custkey AS id, o_orderkey AS run,
               CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS started,
               CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400
                   + CAST(floor(o_totalprice) AS BIGINT) % 1000 AS updated,
               o_orderpriority AS kind, o_orderstatus <> 'O' AS done,
               CASE WHEN o_orderstatus = 'P' THEN 'failed' END AS error,
               o_orderstatus = 'F' AND o_orderkey % 7 = 0 AS canceled,
               o_orderkey % 3 <> 0 AS has_spec, o_orderkey % 5 = 0 AS archived
        FROM orders""",
    "v_hash": "SELECT doc_id AS id, sha256(text) AS h, n_chars, source, lang FROM documents",
    "v_local": """
        SELECT id, CASE WHEN id % 3 = 0 THEN h ELSE h || 'L' END AS digest, CAST(n_chars % 100 AS DOUBLE) AS modified_at
        FROM v_hash WHERE id % 4 <> 0""",
    "v_remote": """
        SELECT id, CASE WHEN id % 7 IN (1, 2) THEN h || 'R' WHEN id % 2 = 0 THEN h ELSE h || 'L' END AS digest,
               CAST((37 * id) % 100 AS DOUBLE) AS updated_at, id % 11 = 0 AS deleted,
               CASE WHEN id % 11 = 0 THEN CAST((37 * id) % 100 AS DOUBLE) END AS deleted_at,
               'd' || (id % 3) AS device
        FROM v_hash WHERE id % 5 <> 0""",
    "v_prev": """
        SELECT h.id, CASE WHEN h.id % 13 < 6 THEN h.h || 'L' ELSE h.h END AS local_digest,
               h.id % 9 < 5 AND r.id IS NOT NULL AS same_remote
        FROM v_hash h LEFT JOIN v_remote r ON r.id = h.id WHERE h.id % 6 <> 0""",
    "v_tomb": """
        SELECT id, CAST((53 * id) % 100 AS DOUBLE) AS deleted_at, 'me' AS device FROM v_hash WHERE id % 8 = 0""",
    "v_files": """
        SELECT source || '/' || doc_id || '.txt' AS path, source AS category, n_chars AS length, doc_id,
               1700000000 + (doc_id * 7919) % 200000 AS modified
        FROM documents""",
    "v_index": """
        SELECT 'sessions/' || id || '/session.json' AS key, h AS sha FROM v_hash WHERE id % 5 <> 0
        UNION ALL
        SELECT 'sessions/' || id || '/audio.mp3', h FROM v_hash WHERE id % 5 <> 1
        UNION ALL
        SELECT 'other/' || id || '/notes.txt', 'x' || h FROM v_hash WHERE id % 5 = 2""",
    "v_local_files": """
        SELECT 'sessions/' || id || '/session.json' AS key,
               CASE WHEN id % 3 = 0 THEN sha256(h) ELSE h END AS sha, id FROM v_hash WHERE id % 4 <> 0
        UNION ALL
        SELECT 'sessions/' || id || '/audio.mp3', h, id FROM v_hash WHERE id % 4 <> 3""",
    "v_frames": """
        SELECT label AS s, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx,
               list_transform(embedding, lambda x: x > 0) AS signature, vec_id
        FROM embeddings""",
    "v_measures": """
        SELECT s, idx // 2 - k AS frame_idx, idx % 2 + 2 * k AS local_idx, idx AS content, vec_id,
               CASE WHEN s % 2 = 0 AND idx % 5 <> 4 THEN idx + 1 END AS label, signature
        FROM v_frames, (SELECT unnest([0, 1]) AS k) WHERE idx // 2 - k >= 0""",
    "v_sparse": """
        SELECT s, idx, CASE WHEN s % 3 <> 0 AND vec_id % 3 = 0 THEN idx + 1 + (idx // 20) END AS label FROM v_frames""",
    "v_barlines": """
        SELECT s, row_number() OVER (PARTITION BY s ORDER BY x) - 1 AS idx, x, recognized FROM (
            SELECT l_orderkey AS s, CAST(floor(l_extendedprice) AS BIGINT) % 600 AS x,
                   max(CASE WHEN CAST(l_quantity AS BIGINT) % 3 = 0 THEN l_linenumber + 10 END) AS recognized
            FROM lineitem GROUP BY ALL)""",
    "v_lines": """
        SELECT s, row_number() OVER (PARTITION BY s ORDER BY value) - 1 AS idx, value FROM (
            SELECT DISTINCT l_suppkey AS s, 5 * l_partkey AS value FROM lineitem)""",
    "v_tracks": """
        SELECT l_suppkey AS s, l_returnflag AS track,
               row_number() OVER (PARTITION BY l_suppkey, l_returnflag
                                  ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS idx,
               CAST(round_even(l_discount * 100, 0) AS BIGINT) - 5 AS level
        FROM lineitem""",
    "v_frets": """
        SELECT l_orderkey AS s, (l_linenumber - 1) % 6 AS string,
               CAST(floor(max(l_quantity)) AS BIGINT) % 12 AS fret
        FROM lineitem GROUP BY l_orderkey, (l_linenumber - 1) % 6""",
    "v_notes": "SELECT l_suppkey AS s, CAST(floor(l_quantity) AS BIGINT) AS note FROM lineitem",
}


def with_views(body: str) -> str:
    """Put the views a statement uses, and those they use, in front of it as common table expressions."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in SQL and name not in needed:
                visit(SQL[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in needed)
    stripped = body.strip()
    upper = stripped[:15].upper()
    if upper.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{stripped[14:]}"
    if upper.startswith("WITH"):
        return f"WITH {ctes},\n{stripped[4:]}"
    return f"WITH {ctes}\n{stripped}"


class Views:
    """Spark form of the views over one directory of tables.

    Views that need a shuffle to derive are checkpointed when first used: a deployment would hold them as tables.
    """

    _known: ClassVar[dict[tuple[str, str], Views]] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Views:
        """The views of one directory, shared by the queries of an application."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(spark, sf_dir)
        return cls._known[key]

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        spread(self.spark, int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return table

    @cached_property
    def _events(self) -> DataFrame:
        events = self.table("events").withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
        return events.select(F.col("user_id").alias("s"), "_us", "event_id", F.col("event_type").alias("kind"), "value")

    @staticmethod
    def _hours(us: Column) -> Column:
        return F.floor(us / 3_600_000_000).cast("long")

    @cached_property
    def beats(self) -> DataFrame:
        return durable(self._make_beats())

    def _make_beats(self) -> DataFrame:
        scans = {"idx": Scan("count", F.lit(1)), "_first": Scan("min", F.col("_us"), whole=True)}
        ranked = running(
            self._events.drop("value"), ["s"], self._hours(F.col("_us")), ["_us", "event_id"], scans
        )
        seconds = X.half_even((F.col("_us") - F.col("_first")) / 1e6, 3)
        return ranked.select("s", (F.col("idx") - 1).alias("idx"), seconds.alias("t"), "kind", "event_id")

    @cached_property
    def grid(self) -> DataFrame:
        return durable(self._make_grid())

    def _make_grid(self) -> DataFrame:
        ranked = positions(self._events.select("s", "_us", "event_id", "value"), ["s"], ["_us", "event_id"], self._hours(F.col("_us")))
        base = (
            F.when((F.col("s") % 3 == 0) & (F.col("idx") >= 24), 250)
            .when((F.col("s") % 3 == 1) & (F.col("idx") < 8), 800)
            .otherwise(500)
        )
        steps = ranked.select("s", "idx", (base + F.floor(F.abs("value")).cast("long") % 5).cast("long").alias("ms"))
        summed = running(steps, ["s"], row_tile("idx"), ["idx"], {"_sum": Scan("sum", F.col("ms"), exclusive=True)})
        return summed.select("s", "idx", (F.coalesce("_sum", F.lit(0)) / 1000.0).alias("t"))

    @cached_property
    def downbeats(self) -> DataFrame:
        phase = F.col("s") % 4
        return self.grid.filter(F.col("idx") % 4 == phase).select(
            "s", F.floor((F.col("idx") - phase) / 4).cast("long").alias("idx"), "t"
        )

    @cached_property
    def tempo(self) -> DataFrame:
        """One row per session: its tempo, as the grid views assume it."""
        return self.table("events").select(F.col("user_id").alias("s")).distinct().withColumn("bpm", F.lit(120.0))

    @cached_property
    def _section_sums(self) -> DataFrame:
        return durable(self._make_section_sums())

    def _make_section_sums(self) -> DataFrame:
        turns = self.table("conversations").select(
            F.col("conv_id").alias("s"), "turn", "role", F.length("text").cast("long").alias("len")
        )
        label = F.when(F.col("role") == "user", "verse").when(F.col("role") == "assistant", "chorus").otherwise("intro")
        turns = turns.withColumn("label", label).withColumn("w", 1 + F.col("len") % 8).drop("role")
        scans = {
            "idx": Scan("count", F.lit(1)),
            "upto": Scan("sum", F.col("w")),
            "total_w": Scan("sum", F.col("w"), whole=True),
            "len_upto": Scan("sum", F.col("len")),
            "total_len": Scan("sum", F.col("len"), whole=True),
        }
        summed = running(turns, ["s"], row_tile("turn"), ["turn"], scans)
        return summed.withColumn("idx", F.col("idx") - 1).drop("turn")

    @cached_property
    def sections(self) -> DataFrame:
        return durable(self._make_sections())

    def _make_sections(self) -> DataFrame:
        last_beat = self.grid.groupBy("s").agg(F.max("t").alias("last_t"))
        joined = self._section_sums.join(last_beat, "s", "left")
        scale = F.col("last_t") / F.col("total_len")
        return joined.select(
            "s",
            "idx",
            "label",
            (F.col("upto") - 2 * (F.col("idx") % 3)).alias("end_bar"),
            (F.col("total_w") + 2).alias("total_bars"),
            X.half_even((F.col("len_upto") - F.col("len")) * F.col("last_t") / F.col("total_len"), 3).alias("start_time"),
            X.half_even(F.col("len_upto") * F.col("last_t") / F.col("total_len"), 3).alias("end_time"),
        )

    @cached_property
    def timed_sections(self) -> DataFrame:
        return self.sections.filter(F.col("start_time").isNotNull())

    @cached_property
    def bars(self) -> DataFrame:
        return self._section_sums.select(
            "s", "idx", "label", (F.col("upto") - F.col("w") + 1).alias("start_bar"), F.col("upto").alias("end_bar"),
            F.col("total_w").alias("total_bars"),
        )

    @cached_property
    def labels(self) -> DataFrame:
        label = (
            F.when(F.col("kind").isin("view", "click"), "verse").when(F.col("kind") == "purchase", "chorus").otherwise("bridge")
        )
        return self.beats.select("s", "idx", label.alias("label"))

    @cached_property
    def library(self) -> DataFrame:
        return durable(self._make_library())

    def _make_library(self) -> DataFrame:
        plays = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("p_partkey"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("latest"), F.min("l_shipdate").alias("earliest"))
        )
        part = self.table("part").join(plays, "p_partkey", "left")
        played = F.col("p_partkey") % 3 != 0
        return part.select(
            F.concat(F.lit("p"), "p_partkey").alias("id"),
            F.col("p_partkey").alias("position"),
            F.col("p_name").alias("title"),
            F.array("p_brand", "p_type").alias("tags"),
            (60 + F.col("p_size") * 2.5).alias("bpm"),
            F.date_format("earliest", "yyyy-MM-dd").alias("date"),
            F.when(played, F.date_format("latest", "yyyy-MM-dd")).alias("last_played"),
            F.when(played, F.coalesce("n", F.lit(0))).otherwise(0).cast("long").alias("play_count"),
        )

    @cached_property
    def folders(self) -> DataFrame:
        part = self.table("part").select("p_partkey", "p_size")
        key, size = F.col("p_partkey"), F.col("p_size")

        def listing(where: Column, folder: Column, pos: Column, prefix: str) -> DataFrame:
            return part.filter(where).select(
                folder.cast("long").alias("folder"), pos.alias("pos"), F.concat(F.lit(prefix), key).alias("id")
            )

        return (
            listing(key % 4 != 1, size % 10, 2 * key, "p")
            .unionByName(listing(key % 7 == 0, (size + 3) % 10, 2 * key, "p"))
            .unionByName(listing(key % 50 == 0, size % 10, 2 * key + 1, "gone"))
        )

    @cached_property
    def jobs(self) -> DataFrame:
        o = self.table("orders")
        started = F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + F.col("o_orderkey") % 86400
        return o.select(
            F.concat(F.lit("c"), "o_custkey").alias("id"),
            F.col("o_orderkey").alias("run"),
            started.alias("started"),
            (started + F.floor("o_totalprice").cast("long") % 1000).alias("updated"),
            F.col("o_orderpriority").alias("kind"),
            (F.col("o_orderstatus") != "O").alias("done"),
            F.when(F.col("o_orderstatus") == "P", "failed").alias("error"),
            ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0)).alias("canceled"),
            (F.col("o_orderkey") % 3 != 0).alias("has_spec"),
            (F.col("o_orderkey") % 5 == 0).alias("archived"),
        )

    @cached_property
    def hashes(self) -> DataFrame:
        return durable(self._make_hashes())

    def _make_hashes(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"), "n_chars", "source", "lang"
        )

    @cached_property
    def local(self) -> DataFrame:
        digest = F.when(F.col("id") % 3 == 0, F.col("h")).otherwise(F.concat("h", F.lit("L")))
        return self.hashes.filter("id % 4 <> 0").select(
            "id", digest.alias("digest"), (F.col("n_chars") % 100).cast("double").alias("modified_at")
        )

    @cached_property
    def remote(self) -> DataFrame:
        i = F.col("id")
        at = ((37 * i) % 100).cast("double")
        digest = (
            F.when((i % 7).isin(1, 2), F.concat("h", F.lit("R"))).when(i % 2 == 0, F.col("h")).otherwise(F.concat("h", F.lit("L")))
        )
        return self.hashes.filter("id % 5 <> 0").select(
            "id",
            digest.alias("digest"),
            at.alias("updated_at"),
            (i % 11 == 0).alias("deleted"),
            F.when(i % 11 == 0, at).alias("deleted_at"),
            F.concat(F.lit("d"), (i % 3).cast("string")).alias("device"),
        )

    @cached_property
    def previous(self) -> DataFrame:
        i = F.col("id")
        base = self.hashes.filter("id % 6 <> 0").select(
            "id", F.when(i % 13 < 6, F.concat("h", F.lit("L"))).otherwise(F.col("h")).alias("local_digest")
        )
        revision = X.revision("updated_at", "deleted_at", "device", "digest", "deleted")
        same = self.remote.filter("id % 9 < 5").select("id", revision.alias("remote_revision"))
        return base.join(same, "id", "left")

    @cached_property
    def tombstones(self) -> DataFrame:
        return self.hashes.filter("id % 8 = 0").select(
            "id", ((53 * F.col("id")) % 100).cast("double").alias("deleted_at"), F.lit("me").alias("device")
        )

    @cached_property
    def files(self) -> DataFrame:
        return self.table("documents").select(
            F.concat("source", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"),
            F.col("source").alias("category"),
            F.col("n_chars").alias("length"),
            "doc_id",
            (1700000000 + (F.col("doc_id") * 7919) % 200000).alias("modified"),
        )

    def _keys(self, where: str, prefix: str, name: str, sha: Column) -> DataFrame:
        key = F.concat(F.lit(prefix), F.col("id").cast("string"), F.lit(name))
        return self.hashes.filter(where).select(key.alias("key"), sha.alias("sha"), "id")

    @cached_property
    def index(self) -> DataFrame:
        h = F.col("h")
        return (
            self._keys("id % 5 <> 0", "sessions/", "/session.json", h)
            .unionByName(self._keys("id % 5 <> 1", "sessions/", "/audio.mp3", h))
            .unionByName(self._keys("id % 5 = 2", "other/", "/notes.txt", F.concat(F.lit("x"), h)))
            .drop("id")
        )

    @cached_property
    def local_files(self) -> DataFrame:
        h = F.col("h")
        fresh = F.when(F.col("id") % 3 == 0, F.sha2(h, 256)).otherwise(h)
        return self._keys("id % 4 <> 0", "sessions/", "/session.json", fresh).unionByName(
            self._keys("id % 4 <> 3", "sessions/", "/audio.mp3", h)
        )

    @cached_property
    def frames(self) -> DataFrame:
        return durable(self._make_frames())

    def _make_frames(self) -> DataFrame:
        e = self.table("embeddings").select(F.col("label").cast("long").alias("s"), "vec_id", "embedding")
        placed = positions(e, ["s"], ["vec_id"], row_tile("vec_id"))
        return placed.select("s", "idx", F.transform("embedding", lambda x: x > 0).alias("signature"), "vec_id")

    @cached_property
    def measures(self) -> DataFrame:
        """Frames of four measures of which two repeat the frame before; even sessions carry printed numbers."""
        k = F.explode(F.array(F.lit(0), F.lit(1)))
        spread = self.frames.withColumn("k", k).withColumn("_half", F.floor(F.col("idx") / 2).cast("long"))
        numbered = (F.col("s") % 2 == 0) & (F.col("idx") % 5 != 4)
        return spread.filter("_half - k >= 0").select(
            "s",
            (F.col("_half") - F.col("k")).alias("frame_idx"),
            (F.col("idx") % 2 + 2 * F.col("k")).alias("local_idx"),
            F.col("idx").alias("content"),
            "vec_id",
            F.when(numbered, F.col("idx") + 1).alias("label"),
            "signature",
        )

    @cached_property
    def sparse(self) -> DataFrame:
        known = (F.col("s") % 3 != 0) & (F.col("vec_id") % 3 == 0)
        label = F.col("idx") + 1 + F.floor(F.col("idx") / 20).cast("long")
        return self.frames.select("s", "idx", F.when(known, label).alias("label"))

    @cached_property
    def barlines(self) -> DataFrame:
        return durable(self._make_barlines())

    def _make_barlines(self) -> DataFrame:
        lines = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("s"), (F.floor("l_extendedprice").cast("long") % 600).alias("x"))
            .agg(F.max(F.when(F.col("l_quantity").cast("long") % 3 == 0, F.col("l_linenumber") + 10)).cast("long").alias("recognized"))
        )
        # A session has at most 600 places to either side of nought, so all of it is one small window.
        place = F.row_number().over(Window.partitionBy("s").orderBy(F.asc_nulls_last("x"))) - 1
        return lines.select("s", place.cast("long").alias("idx"), "x", "recognized")

    @cached_property
    def lines(self) -> DataFrame:
        return durable(self._make_lines())

    def _make_lines(self) -> DataFrame:
        return positions(self.line_values, ["s"], ["value"], row_tile("value", 65536)).select("s", "idx", "value")

    @property
    def line_values(self) -> DataFrame:
        """Lines without their number."""
        return self.table("lineitem").select(F.col("l_suppkey").alias("s"), (5 * F.col("l_partkey")).alias("value")).distinct()

    @cached_property
    def tracks(self) -> DataFrame:
        return durable(self._make_tracks())

    @property
    def track_names(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("track")).distinct()

    @property
    def packed_tracks(self) -> DataFrame:
        """Tracks for a query that reads them once, stored as strips only; rows of no known order come last."""
        l, order, bucket = self._track_rows()
        return packed_positions(l, ["s", "track"], order, bucket, "level")

    def _make_tracks(self) -> DataFrame:
        l, order, bucket = self._track_rows()
        placed = positions(l, ["s", "track"], order, bucket)
        return placed.select("s", "track", "idx", "level")

    def _track_rows(self) -> tuple[DataFrame, list[str], Column]:
        """Rows of tracks, their order, and a coarsening of it."""
        l = self.table("lineitem").select(
            F.col("l_suppkey").alias("s"),
            F.col("l_returnflag").alias("track"),
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_extendedprice",
            (X.half_even_int(F.col("l_discount") * 100) - 5).alias("level"),
        )
        return l, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], row_tile("l_orderkey", 65536)

    @cached_property
    def frets(self) -> DataFrame:
        return durable(self._make_frets())

    def _make_frets(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("s"), ((F.col("l_linenumber") - 1) % 6).cast("long").alias("string"))
            .agg((F.floor(F.max("l_quantity")).cast("long") % 12).alias("fret"))
        )

    @cached_property
    def notes(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_suppkey").alias("s"), F.floor("l_quantity").cast("long").alias("note"))
