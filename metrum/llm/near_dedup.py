"""Near duplicates by SetSketch registers on word shingles, with links confirmed on full sets.

A document's set is hashed once for each register; a register holds the exponent of the smallest hash on an
exponential scale, truncated to 16 bits. Registers of a union are maxima of registers, and two sets agree in a register
with a probability close to their Jaccard similarity.

1.  Documents with equal sets form one class; only one sketch of a class goes on.
2.  Bands of registers put classes into buckets. Each class of a bucket is checked against one centre, the same in
    every bucket it leads, so a large bucket costs as many checks as it has members.
    Only pairs whose similarity, estimated by maximum likelihood from both sketches, comes near the threshold are
    compared as sets.
3.  What the confirmed links join is one component already. Where a centre's classes form several components, these are
    compared exactly and completely, in blocks of bounded size, between components only. No bucket is cut short.
4.  Components of all confirmed links.

A pair at the threshold (0.85) shares no band with probability (1 - 0.85^5)^24 < 1e-6; its estimate falls below the
margin with a probability of a few 1e-6, and is then still compared in step 3.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.components import components
from metrum.llm.tables import durable, table
from metrum.llm.text import map_arrow, splitmix, whole_windows, windows, word_hashes, words
from metrum.session import tune

SHINGLE = 5
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Scale of the registers: a step is a thousandth, the largest register the truncation at 16 bits.
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 1
MARGIN = 0.15
BLOCK = 256
BLOCK_BYTES = 1 << 20
KEPT_BYTES = 6

_DRAW = np.random.default_rng(20)
_FACTOR = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _DRAW.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: windows of words, or the whole sequence if it is shorter."""
    found = words(column)
    hashes = word_hashes(found, lower=True)
    rolling = windows(hashes, size, seed=size)
    whole = whole_windows(found, size)
    out = []
    for first, last in zip(found.rows[:-1], found.rows[1:]):
        n = last - first
        if n >= size:
            out.append(np.unique(rolling[first : last - size + 1]))
        else:
            out.append(windows(hashes[first:last], int(n), seed=int(n)) if n else hashes[:0])
    assert len(whole) == len(rolling)
    return out


def minima(shingles: np.ndarray, block: int = 1024) -> np.ndarray:
    """The least hash of a set for each register."""
    out = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), block):
        values = np.multiply.outer(_FACTOR, shingles[i : i + block])
        values += _SHIFT[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def registers(least: np.ndarray) -> np.ndarray:
    """Truncated exponents of minima: floor(1 - log_base(x)) for x exponential with the given rate."""
    uniform = (least.astype(np.float64) + 1) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT).astype(np.uint16)


def estimate(equal: np.ndarray, above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs by maximum likelihood, from the numbers of equal, larger and smaller registers."""
    total = size_a + size_b
    u, v = size_a / total, size_b / total

    def probability(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        p, q = probability(u - v * j), probability(v - u * j)
        tiny = 1e-12
        return above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    golden = (5**0.5 - 1) / 2
    for _ in range(24):
        left, right = high - golden * (high - low), low + golden * (high - low)
        better = likelihood(left) >= likelihood(right)
        high, low = np.where(better, right, high), np.where(better, low, left)
    return (low + high) / 2


def copy_name(text: str) -> Column:
    """The same for equal texts; a null text is empty."""
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))


def sketches(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, copy, n, digest, regs) for each row; copy names its text, digest and regs are null without words."""

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, regs = [], [], []
        for own in shingle_sets(batch.column(1)):
            sizes.append(len(own))
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            regs.append(registers(minima(own)).tobytes() if len(own) else None)
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())],
            ["doc_id", "copy", "n", "digest", "regs"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), copy_name(text).alias("copy"))
    return map_arrow(docs, sketch, "doc_id long, copy string, n long, digest binary, regs binary")


def node_key() -> Column:
    """Binary keys in the order of (doc_id, digest)."""
    ordered = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.unhex(ordered), F.col("digest"))


def key_doc(key: Column) -> Column:
    """The doc_id in a key."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(-(1 << 63)))


def bands(nodes: DataFrame) -> DataFrame:
    """(bucket, no) for each band of each class."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        no = batch.column(0).to_numpy()
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(no), BANDS, ROWS).astype(np.uint64)
        key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
        for r in range(ROWS):
            key = splitmix(key * np.uint64(0x9E3779B97F4A7C15) + regs[:, :, r])
        return pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(no, BANDS))], ["bucket", "no"])

    return map_arrow(nodes.select("no", "regs"), cut, "bucket long, no long")


def full_sets(documents: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(no, members) of the wanted classes (no, doc_id), from the whole text of one of their documents."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, members = [], []
        for own in shingle_sets(batch.column(1)):
            digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
            members.append(pack(own))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(members, pa.binary())], ["no", "digest", "members"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = map_arrow(docs.join(wanted, "doc_id").select("no", "text"), make, "no long, digest binary, members binary")
    return made.where(F.xxhash64("digest") == F.col("no")).groupBy("no").agg(F.first("members").alias("members"))


def pack(shingles: np.ndarray) -> bytes:
    """The high bytes of each sorted hash."""
    return shingles.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :KEPT_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEPT_BYTES, 8), np.uint8)
    out[:, 8 - KEPT_BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, KEPT_BYTES)
    return out.view(">u8").reshape(-1).astype(np.uint64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = np.zeros(batch.num_rows, bool)
        for i, (one, other) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            small, large = sorted((len(one), len(other)))
            if 100 * small >= percent * large:
                merged = np.concatenate([unpack(one), unpack(other)])
                merged.sort()
                both = int((merged[1:] == merged[:-1]).sum())
                keep[i] = 100 * both >= percent * (len(merged) - both)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    first = pairs.join(sets.select(F.col("no").alias("a"), F.col("members").alias("one")), "a")
    second = first.join(sets.select(F.col("no").alias("b"), F.col("members").alias("other")), "b")
    return map_arrow(second.select("a", "b", "one", "other"), test, "a long, b long")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity, estimated from both sketches, comes near the threshold."""

    def guess(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [batch.column(c).to_numpy().astype(float) for c in ("n", "m")]
        one, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("one", "other"))
        equal, above = (one == other).sum(axis=1), (one > other).sum(axis=1)
        guessed = estimate(equal, above, REGISTERS - equal - above, *sizes)
        fits = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
        keep = fits & (np.maximum(guessed, equal / REGISTERS) >= percent / 100 - MARGIN)
        return batch.select(["a", "b"]).filter(pa.array(keep))

    first = nodes.select(F.col("no").alias("a"), F.col("n").alias("n"), F.col("regs").alias("one"))
    second = nodes.select(F.col("no").alias("b"), F.col("n").alias("m"), F.col("regs").alias("other"))
    return map_arrow(pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "one", "other"), guess, "a long, b long")


def between_components(families: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components of a family, at least those that join its components.

    ``families``: centre, no, label. Classes of one large component form blocks of their own, all others are mixed; a
    block holds at most about :data:`BLOCK` classes or :data:`BLOCK_BYTES`. Each pair of blocks is one row, so that no
    task holds a family, and blocks of the same component are not paired. A row compares its two blocks exactly.
    """
    several = families.groupBy("centre").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("centre")
    held = durable(families.join(several, "centre").join(sets, "no"))
    large = held.groupBy("centre", "label").agg(F.count("*").alias("k")).where(F.col("k") >= BLOCK // 2).select("centre", "label", F.col("label").alias("own"))
    grouped = held.join(large, ["centre", "label"], "left").withColumn("mixed", F.col("own").isNull()).withColumn("own", F.coalesce("own", F.lit(0)))
    keys = ["centre", "mixed", "own"]
    count = F.greatest(F.count("*") / BLOCK, F.sum(F.length("members")) / BLOCK_BYTES)
    counted = grouped.groupBy(*keys).agg(F.ceil(count).cast("int").alias("blocks"))
    dealt = grouped.join(counted, keys).withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    packed = durable(dealt.groupBy(*keys, "block").agg(F.collect_list(F.struct("no", "label", "members")).alias("rows")).withColumn("id", F.struct("mixed", "own", "block")))
    partners = packed.groupBy("centre").agg(F.collect_list("id").alias("ids"))  # one small entry for a block

    def apart(other: Column) -> Column:
        return (other >= F.col("id")) & (F.col("mixed") | other["mixed"] | (other["own"] != F.col("own")))

    # Blocks are paired by their names first, so that no task gathers the blocks of a family.
    names = packed.select("centre", "mixed", "own", "id").join(partners, "centre")
    named = names.select("centre", "id", F.explode(F.filter("ids", apart)).alias("partner"))
    left = named.join(packed.select("centre", "id", F.col("rows").alias("one")), ["centre", "id"])
    right = packed.select("centre", F.col("id").alias("partner"), F.col("rows").alias("other"))

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: list[tuple[int, int]] = []
        for same, one, other in zip(*(batch.column(c) for c in range(3))):
            found += joining(_block(one.values), _block(other.values), same.as_py(), percent)
        a, b = zip(*found) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    joined = left.join(right, ["centre", "partner"]).select((F.col("id") == F.col("partner")).alias("same"), "one", "other")
    return map_arrow(joined, compare, "a long, b long")


Block = tuple[np.ndarray, np.ndarray, list[np.ndarray]]


def _block(rows: pa.StructArray) -> Block:
    no, label, members = (rows.field(k) for k in ("no", "label", "members"))
    return no.to_numpy(), label.to_numpy(), [unpack(x) for x in members.to_pylist()]


def overlaps(one: list[np.ndarray], other: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: products of 0-1 matrices over the values in two sets or more."""
    both = one + other
    values = np.concatenate(both)
    row = np.repeat(np.arange(len(both)), [len(x) for x in both])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(one), len(other)), np.float64)
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, (low, low + columns))
        table = np.zeros((len(both), columns), np.float32)
        table[row[a:b], column[a:b] - low] = 1
        out += table[: len(one)] @ table[len(one) :].T
    return np.rint(out).astype(np.int64)


def joining(a: Block, b: Block, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between classes of different labels, one for each two labels, less those that close a circle."""
    common = overlaps(a[2], a[2] if same else b[2])
    if same:
        b = a
    sizes = [np.array([len(x) for x in own]) for own in (a[2], b[2])]
    linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    i, j = np.nonzero(linked & (a[1][:, None] != b[1][None, :]))
    if same:
        i, j = i[i < j], j[i < j]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    _, first = np.unique(np.stack([a[1][i], b[1][j]], axis=1), axis=0, return_index=True)
    for k in first.tolist():
        x, y = root(int(a[1][i[k]])), root(int(b[1][j[k]]))
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(a[0][i[k]]), int(b[0][j[k]])))
    return out


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable over links).

    Documents without words, and rows without a doc_id, are linked with nothing; the latter have a null component.
    Each row is a document: repeated rows give repeated result rows of one component, and different texts under one id
    belong to the components of their texts. Other columns are not read.
    """
    return grouped(documents, doc_id, text, percent).select("doc_id", "n_shingles", "component_id")


def grouped(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The columns of :func:`near_duplicates`, with ``copy``, which names the text, and ``group``, the component's key (null: linked with nothing)."""
    tune(documents.sparkSession)  # a group by (centre, label) must not be gathered by centre alone
    sketched = durable(sketches(documents, doc_id, text))
    linkable = sketched.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = linkable.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
    nodes = durable(classes.select(F.xxhash64("digest").alias("no"), node_key().alias("node"), "digest", "doc_id", "n", "regs"))

    dealt = bands(nodes)
    centres = dealt.groupBy("bucket").agg(F.min("no").alias("centre"), F.max("no").alias("last")).where("centre <> last")
    # A family: all classes that share a bucket with its centre, whichever bucket.
    spokes = durable(dealt.join(centres.select("bucket", "centre"), "bucket").where("no <> centre").groupBy("centre", "no").agg(F.count("*").alias("bands")))
    involved = spokes.select("no").union(spokes.select("centre")).distinct()
    sets = durable(full_sets(documents, nodes.join(involved, "no").select("no", "doc_id"), doc_id, text))

    links = durable(confirmed(likely(spokes.select(F.col("no").alias("a"), F.col("centre").alias("b")), nodes, percent), sets, percent))
    grouped = components(links).withColumnRenamed("node", "no")
    families = spokes.select("centre", "no").union(spokes.select("centre", F.col("centre").alias("no")).distinct())
    labelled = families.join(grouped, "no", "left").select("centre", "no", F.coalesce("root", "no").alias("label"))
    every = links.union(between_components(labelled, sets, percent))

    named = nodes.select(F.col("no"), "node")
    edges = every.join(named.select(F.col("no").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("no").alias("b"), F.col("node").alias("y")), "b")
    roots = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")))
    joined = nodes.select("digest", "node", F.col("doc_id").alias("least")).join(roots, "node", "left")
    classes = joined.select("digest", F.coalesce("root", "node").alias("group"), F.coalesce(key_doc(F.col("root")), F.col("least")).alias("component_id"))
    out = sketched.select("doc_id", "copy", "n", "digest").join(classes, "digest", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "copy", F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"), F.when(known, F.col("group")).alias("group"))


def deduplicated(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The rows, with all their columns, that stay when each component keeps one: of the smallest id, then text.

    Different texts under one id stand for themselves: only what is linked goes. Of rows with the same id and text one
    stays, the least by all its columns, so those must have an order. Rows without an id stay.
    """
    found = durable(grouped(documents, doc_id, text, percent).where("doc_id IS NOT NULL").groupBy("doc_id", "copy").agg(F.min("group").alias("group"), F.count("*").alias("rows")))
    linked = found.where("group IS NOT NULL")
    # By document, not by group, so that a group with a third of all rows is spread.
    first = linked.groupBy("group").agg(F.min(F.struct("doc_id", "copy")).alias("first")).select("first.*")
    gone = linked.join(first, ["doc_id", "copy"], "left_anti").select(F.col("doc_id").alias(doc_id), F.col("copy").alias("_copy"))
    again = found.where("rows > 1").select(F.col("doc_id").alias(doc_id), F.col("copy").alias("_copy"))
    key = [doc_id, "_copy"]
    stay = documents.withColumn("_copy", copy_name(text)).join(gone, key, "left_anti")
    if again.isEmpty():
        return stay.select(*documents.columns)
    rest = [c for c in documents.columns if c != doc_id]
    single = stay.join(again, key, "left_anti")
    repeated = stay.join(again, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_row"))
    return single.select(*documents.columns).unionByName(repeated.select(doc_id, "_row.*"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns of :func:`near_duplicates`."""
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


OP6_SQL = r"""
WITH RECURSIVE letters AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS p FROM letters WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[p : p + 4], ' ') AS k FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
    FROM shingles x JOIN shingles y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
links AS (
    SELECT a, b FROM shared JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b
    WHERE 100 * common >= 85 * (s.n + t.n - common)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS seen FROM edges UNION SELECT reach.doc_id, b FROM reach JOIN edges ON seen = a),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
    coalesce(component_id, doc_id) = doc_id AS kept
FROM letters LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
