"""Chat formatting after collapsing cumulative snapshots.

A log that stores a conversation again after every turn holds it many times, each time a little longer. Each turn gets
a hash of its conversation up to it; a conversation whose last hash is an inner hash of another one is a prefix of it.
Anti-joins against the inner hashes, and against equal conversations of smaller id, leave the maximal conversations,
and only these are rendered.

Hashes of a prefix are the exclusive or of its turns' hashes, each taken with the turn's place, so they can be carried
from tile to tile: a conversation of any length is spread over many tasks. It is rendered in parts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metrum.llm.tables import table
from metrum.plans.ordered import positions
from metrum.session import tune

TILE_TURNS = 4096
PART_TURNS = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
HASHES = ("h1", "h2")


def turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, role, text, h1, h2): turns by dense place; h1 and h2 hash place, role and text."""
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text")
    ).where("conv_id IS NOT NULL")
    # Equal rows differ by their number, which no hash depends on.
    own = rows.withColumn("_row", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("_row")]
    placed = positions(own, ["conv_id"], order, F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / TILE_TURNS).cast("long"), "pos")
    said = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    first = F.xxhash64(F.col("pos"), *said)
    digest = F.md5(F.concat_ws("\u0000", F.col("pos").cast("string"), *[s.cast("string") for s in said]))
    second = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return placed.select("conv_id", "pos", "role", "text", first.alias("h1"), second.alias("h2"))


def prefixes(rows: DataFrame) -> DataFrame:
    """Add p1 and p2, the hashes of the conversation up to and with each turn."""
    tiled = rows.withColumn("_tile", F.floor(F.col("pos") / TILE_TURNS).cast("long"))
    totals = tiled.groupBy("conv_id", "_tile").agg(*[F.bit_xor(h).alias(f"t_{h}") for h in HASHES])
    before = Window.partitionBy("conv_id").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "_tile", *[F.coalesce(F.bit_xor(f"t_{h}").over(before), F.lit(0)).alias(f"c_{h}") for h in HASHES])
    within = Window.partitionBy("conv_id", "_tile").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = tiled.select("*", *[F.bit_xor(h).over(within).alias(f"l_{h}") for h in HASHES])
    joined = local.join(carried, ["conv_id", "_tile"])
    return joined.select(*rows.columns, *[F.col(f"l_{h}").bitwiseXOR(F.col(f"c_{h}")).alias(p) for h, p in zip(HASHES, ("p1", "p2"))])


def maximal(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are neither a prefix of a longer one nor equal to one of smaller id."""
    last = F.max_by(F.struct("p1", "p2"), "pos")
    whole = hashed.groupBy("conv_id").agg((F.max("pos") + 1).alias("n_turns"), last.alias("p")).select("conv_id", "n_turns", "p.p1", "p.p2")
    single = whole.groupBy("n_turns", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    # The hash before a turn is that of a prefix that goes on.
    inner = hashed.where("pos > 0").select(F.col("pos").alias("n_turns"), F.col("p1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("p2")).distinct()
    return single.join(inner, ["n_turns", "p1", "p2"], "left_anti").select("conv_id", "n_turns")


def rendered(role: Column, text: Column) -> Column:
    """One turn in chat markup. Markers inside a text are broken up, so that a text can't open or close a turn."""
    def safe(value: Column) -> Column:
        return F.replace(F.replace(value, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))

    return F.concat(F.lit(OPEN), safe(F.coalesce(role, F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(text, F.lit(""))), F.lit(CLOSE + "\n"))


def formatted(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id, part, n_turns, text``: each maximal conversation in parts of ``part_turns`` turns, ``n_turns`` in this part.

    Turns are ordered by turn, then role and text, nulls first; a null role is shown as unknown, a null text as empty,
    and both differ from any text for the comparison. Repeated rows are repeated turns. Rows without a conv_id are left
    out. Other columns are not read.
    """
    tune(conversations.sparkSession)
    hashed = prefixes(turns(conversations, conv_id, turn, role, text))
    kept = hashed.join(maximal(hashed).select("conv_id"), "conv_id", "left_semi")
    lines = kept.select("conv_id", F.floor(F.col("pos") / part_turns).cast("int").alias("part"), "pos", rendered(F.col("role"), F.col("text")).alias("line"))
    grouped = lines.groupBy("conv_id", "part").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("rows"))
    return grouped.select("conv_id", "part", "n_turns", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("text"))


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """The maximal conversations of the whole table, rendered."""
    return formatted(table(spark, sf_dir, "conversations"))


OP7_SQL = """
WITH lists AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
kept AS (
    SELECT a.conv_id, a.said FROM lists a WHERE NOT EXISTS (
        SELECT 1 FROM lists b WHERE (len(b.said) > len(a.said) OR len(b.said) = len(a.said) AND b.conv_id < a.conv_id)
            AND b.said[1] IS NOT DISTINCT FROM a.said[1] AND b.said[1 : len(a.said)] IS NOT DISTINCT FROM a.said)),
parts AS (SELECT conv_id, said, unnest(range(0, (len(said) - 1) // 64 + 1)) AS part FROM kept),
cuts AS (SELECT conv_id, part, said[part * 64 + 1 : part * 64 + 64] AS own FROM parts)
SELECT conv_id, CAST(part AS INTEGER) AS part, CAST(len(own) AS BIGINT) AS n_turns, array_to_string([
    '<|im_start|>' || replace(replace(coalesce(r.role, 'unknown'), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
    || chr(10) || replace(replace(coalesce(r.text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>')
    || '<|im_end|>' || chr(10) FOR r IN own], '') AS text
FROM cuts
"""
