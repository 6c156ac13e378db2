"""The trie of conversation prefixes, and what sharing them saves.

A node is a distinct sequence of first turns. Two hashes of the sequence name it; its smallest member, the smallest
conversation that starts with it, and its depth name it as well. The nodes with one smallest member lie below each other
on its path and form a chain, which hangs from a node of another chain, so the trie is a tree of chains as well, and
there are no more chains than conversations.

Totals of subtrees go upwards by time-forward processing. Chains are sorted outside memory in reverse level order of
their tops; each takes its messages from a priority queue, adds them up and sends the sum to its parent's place in the
order. Messages beyond a bound are written out as sorted runs.

A shard is the subtree of a chain with at most ``shard`` conversations whose parent has more; it is complete, so
shards are worked on apart. Their roots' totals are added up for the chains above, which are fewer by about that
factor, and the next round takes these with shards of ``shard ** 2`` conversations, until the root is reached. Within a
chain, of any length, sums are carried from tile to tile.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.chat import prefixes
from metrum.llm.tables import durable, table
from metrum.plans.ordered import Scan, positions, row_tile, running
from metrum.plans.rank import in_order, range_of
from metrum.session import tune

SHARD = 256
#: Messages that a queue holds in memory.
HELD = 1 << 18
#: Blocks of conversations that share their base, and the most turns taken from it.
BLOCK, MOST = 100, 6
#: Ids of one text that is hashed at once.
IDS = 4096
EMPTY = hashlib.sha256(b"").hexdigest()


class Inbox:
    """A priority queue of (level, chain, leaves, saved) that spills.

    Beyond ``held`` messages the larger half goes to a sorted run, in a file without a name among Spark's own spill
    files: it is this task's alone and ends with it. Runs are merged while they are read.
    """

    RECORD = struct.Struct("<qqqq")

    def __init__(self, held: int = HELD):
        self.heap: list[tuple[int, int, int, int]] = []
        self.runs: list[tuple[tuple[int, int, int, int], int, Iterator]] = []
        self.held, self.spilled = held, 0

    def push(self, message: tuple[int, int, int, int]) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.held:
            self.heap.sort()
            keep = len(self.heap) // 2
            self._spill(self.heap[keep:])
            del self.heap[keep:]

    def _spill(self, messages: list) -> None:
        folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        for m in messages:
            file.write(self.RECORD.pack(*m))
        file.seek(0)
        run = self._read(file)
        self.spilled += 1
        heapq.heappush(self.runs, (next(run), self.spilled, run))

    def _read(self, file) -> Iterator[tuple[int, int, int, int]]:
        with file:
            while block := file.read(self.RECORD.size * 4096):
                yield from self.RECORD.iter_unpack(block)

    def take(self, level: int, chain: int) -> tuple[int, int]:
        """The sums of all messages for a place in the order; earlier places must have been taken."""
        leaves = saved = 0
        place = (level, chain)
        while True:
            if self.heap and self.heap[0][:2] == place:
                m = heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][:2] == place:
                m, number, run = self.runs[0]
                following = next(run, None)
                if following is None:
                    heapq.heappop(self.runs)
                else:
                    heapq.heapreplace(self.runs, (following, number, run))
            else:
                return leaves, saved
            leaves += m[2]
            saved += m[3]

    def __bool__(self) -> bool:
        return bool(self.heap or self.runs)


def upwards(held: int):
    """Rows (shard, top, conv_id, parent, parent_top, leaves, saved), by shard and in reverse level order, to totals of subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inbox, last = Inbox(held), None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "top", "conv_id", "parent", "parent_top", "leaves", "saved")]
            ids, leaf_totals, saved_totals = columns[2], [], []
            for shard, top, chain, parent, parent_top, leaves, saved in zip(*columns):
                if shard != last:
                    assert not inbox, "a shard sent messages outside its order"
                    last = shard
                more_leaves, more_saved = inbox.take(-top, chain)
                leaves, saved = leaves + more_leaves, saved + more_saved
                leaf_totals.append(leaves)
                saved_totals.append(saved)
                if chain != shard:
                    inbox.push((-parent_top, parent, leaves, saved))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, leaf_totals, saved_totals)], ["conv_id", "leaves", "saved"])

    return run


def ordered_turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, pos, c1, c2, size): turns by place, two hashes of role and text, and the text's code points."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), said[0].alias("role"), said[1].alias("text")).where("conv_id IS NOT NULL")
    placed = in_order(rows, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()])
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    hashed = placed.select("conv_id", "_place", F.xxhash64("role", "text").alias("c1"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("c2"), F.length("text").cast("long").alias("size"))
    return positions(hashed, ["conv_id"], ["_place"], range_of(), "pos").select("conv_id", "pos", "c1", "c2", "size")


def shared_turns(conv_id: str = "conv_id") -> Column:
    """How many turns a conversation takes from the first one of its block."""
    return (F.crc32(F.col(conv_id).cast("string").cast("binary")) % MOST).cast("long")


def rebuilt(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Turns with the first ones taken from the conversation's base: all that the base has of the first h, then its own after h."""
    base = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base")
    heads = turns.where((F.col("conv_id") % BLOCK == 0) & (F.col("pos") < MOST)).withColumnRenamed("conv_id", "base")
    known = heads.groupBy("base").agg(F.count("*").alias("n_base"))
    wanted = ids.select("conv_id", base, shared_turns().alias("h"))
    taken = wanted.join(heads, "base").where("pos < h").select("conv_id", "pos", "c1", "c2", "size")
    rest = turns.select("*", base, shared_turns().alias("h")).where("pos >= h").join(known, "base", "left")
    moved = F.col("pos") - F.col("h") + F.least("h", F.coalesce("n_base", F.lit(0)))
    return taken.unionByName(rest.select("conv_id", moved.cast("long").alias("pos"), "c1", "c2", "size"))


def digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of rows (conv_id, depth, member): the members in order, joined by commas.

    Ids are put together in texts of up to ``IDS`` neighbours; a hash is fed with one text after the other.
    """
    texts = ends.groupBy("conv_id", "depth", F.floor(F.col("member") / IDS).cast("long").alias("block")).agg(F.array_join(F.array_sort(F.collect_list("member")).cast("array<string>"), ",").alias("ids"))
    dealt = texts.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, hashlib.sha256()
        for batch in batches:
            done = []
            for chain, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")]):
                if (chain, depth) == last:
                    held.update(b",")
                else:
                    if last is not None:
                        done.append((*last, held.hexdigest()))
                    last, held = (chain, depth), hashlib.sha256()
                held.update(ids.encode())
            if done:
                yield _rows(done)
        if last is not None:
            yield _rows([(*last, held.hexdigest())])

    return dealt.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def _rows(done: list[tuple[int, int, str]]) -> pa.RecordBatch:
    chains, depths, found = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(chains, pa.int64()), pa.array(depths, pa.int64()), pa.array(found)], ["conv_id", "depth", "ends_sha256"])


def subtree_totals(chains: DataFrame, thresholds: list[int], held: int = HELD) -> DataFrame:
    """(conv_id, leaves, saved) of each chain's subtree.

    ``chains``: conv_id, top, parent, parent_top, members (of its top), its own leaves and saved, and for each threshold
    the shard ``s0``, ``s1``, ... it lies in, null while it has more members.
    """
    left, done = chains, None
    for k, most in enumerate(thresholds):
        light = left.where(F.col("members") <= most).withColumn("shard", F.col(f"s{k}"))
        sent = light.select("shard", "top", "conv_id", "parent", "parent_top", "leaves", "saved").repartition("shard").sortWithinPartitions("shard", F.col("top").desc(), "conv_id")
        totals = durable(sent.mapInArrow(upwards(held), "conv_id long, leaves long, saved long"))
        done = totals if done is None else done.unionByName(totals)
        if k + 1 < len(thresholds):
            roots = light.where("conv_id = shard").select("conv_id", "parent").join(totals, "conv_id")
            more = roots.groupBy("parent").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved")).withColumnRenamed("parent", "conv_id")
            heavy = left.where(F.col("members") > most).join(more, "conv_id", "left")
            add = {c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("leaves", "saved")}
            left = durable(heavy.withColumns(add).drop("_leaves", "_saved"))
    return done


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard: int = SHARD, held: int = HELD
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are rebuilt first, see :func:`rebuilt`. Turns are ordered by turn (null first), then role and text;
    a null role or text is empty. Repeated rows are repeated turns. Rows without a conv_id are left out, other columns
    are not read, an empty table has no nodes. A node's sequence is told by 124 bits of hashes.
    """
    spark = tune(conversations.sparkSession)
    turns = durable(ordered_turns(conversations, conv_id, turn, role, text))
    ids = durable(turns.groupBy("conv_id").agg(F.count("*").alias("n")))
    mixed = rebuilt(turns, ids).select("conv_id", "pos", "size", F.xxhash64("pos", "c1", "c2").alias("h1"), F.xxhash64(F.lit(1), "c2", "pos", "c1").alias("h2"))
    hashed = prefixes(mixed)
    paths = durable(hashed.select("conv_id", (F.col("pos") + 1).alias("depth"), "size", "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2")))
    key = ["depth", "p1", "p2"]
    inner = paths.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    zero = F.lit(0).cast("long")
    whole = ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = whole.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("size"), zero.alias("q1"), zero.alias("q2"))
    named = durable(inner.unionByName(root))
    above = named.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    nodes = durable(named.join(above, ["depth", "q1", "q2"], "left").select(*key, "conv_id", "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("size")).alias("own"), (~F.col("parent").eqNullSafe(F.col("conv_id"))).alias("is_top")))

    # Chains: their tops, the end of each, and the shards on the path of their smallest member.
    least, total = whole.first() or (None, 0)
    thresholds = [shard]
    while thresholds[-1] < total:
        thresholds.append(thresholds[-1] * shard)
    tops = nodes.where("is_top")
    passed = paths.join(tops.select(*key, F.col("conv_id").alias("chain"), F.col("n_convs").alias("members")), key).select("conv_id", "depth", "chain", "members")
    # Every path begins at the root.
    begun = ids.select("conv_id", zero.alias("depth"), F.lit(least).cast("long").alias("chain"), F.lit(total).cast("long").alias("members"))
    first = [F.min(F.when(F.col("members") <= most, F.struct("depth", "chain"))).alias(f"s{k}") for k, most in enumerate(thresholds)]
    shards = passed.unionByName(begun).groupBy("conv_id").agg(*first)
    kids = nodes.where("depth > 0").select(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).groupBy("conv_id", "depth").agg(F.count("*").alias("n_children"))
    full = durable(nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = full.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    heads = tops.select("conv_id", F.col("depth").alias("top"), "parent", F.col("n_convs").alias("members"))
    chains = heads.join(heads.select(F.col("conv_id").alias("parent"), F.col("top").alias("parent_top")), "parent", "left").join(own, "conv_id").join(shards, "conv_id")
    totals = subtree_totals(durable(chains.select("conv_id", "top", "parent", "parent_top", "members", "leaves", "saved", *[F.col(f"s{k}.chain").alias(f"s{k}") for k in range(len(thresholds))])), thresholds, held)

    hanging = heads.join(totals, "conv_id").where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    filled = full.join(hanging, ["conv_id", "depth"], "left").withColumns({"leaves": F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long"), "saved": F.coalesce("saved", F.lit(0)) + F.col("own")})
    order = (F.col("depth").desc(),)
    summed = running(filled, ["conv_id"], row_tile("depth"), ["depth"], {"n_leaves": Scan("sum", F.col("leaves"), order, reverse=True), "saved_tokens": Scan("sum", F.col("saved"), order, reverse=True)})

    last = paths.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end")).select(F.col("conv_id").alias("member"), "end.*")
    ended = ids.select(F.col("conv_id").alias("member")).join(last, "member", "left").select("member", *[F.coalesce(c, zero).alias(c) for c in key])
    hashes = digests(ended.join(nodes.select(*key, "conv_id"), key).select("conv_id", "depth", "member"))
    shown = summed.join(hashes, ["conv_id", "depth"], "left")
    return shown.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """The trie of all conversations of the table."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS turns FROM said GROUP BY conv_id),
cut AS (
    SELECT conv_id, turns, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
        [ascii(letter)::BIGINT FOR letter IN string_split(conv_id::VARCHAR, '')]),
        lambda crc, letter: list_reduce(list_prepend(xor(crc, letter), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))),
        4294967295) % 6 AS h
    FROM own),
whole AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1 : c.h], []), coalesce(c.turns[c.h + 1 :], [])) AS turns
    FROM cut c LEFT JOIN own b ON b.conv_id = c.base),
places AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM whole),
paths AS (SELECT conv_id, depth, turns[1 : depth] AS prefix, len(turns) = depth AS ends FROM places),
named AS (
    SELECT conv_id AS member, depth, prefix, ends, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM paths),
nodes AS (
    SELECT node, depth, count(*) AS n_convs, any_value(length(prefix[depth].text)) AS size,
        sha256(coalesce(string_agg(CASE WHEN ends THEN member::VARCHAR END, ',' ORDER BY member), '')) AS ends_sha256
    FROM named GROUP BY node, depth),
above AS (
    SELECT DISTINCT a.node, a.depth, b.node AS parent FROM named a JOIN named b ON b.member = a.member AND b.depth = a.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM above GROUP BY ALL),
full_nodes AS (
    SELECT n.*, a.parent, coalesce(k.n, 0) AS n_children FROM nodes n
    LEFT JOIN above a ON a.node = n.node AND a.depth = n.depth LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth),
sums AS (
    SELECT p.node, p.depth, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * coalesce(f.size, 0)) AS saved
    FROM full_nodes f JOIN named p ON p.member = f.node AND p.depth <= f.depth GROUP BY p.node, p.depth)
SELECT f.node AS conv_id, f.depth, f.parent AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums s ON s.node = f.node AND s.depth = f.depth
"""
