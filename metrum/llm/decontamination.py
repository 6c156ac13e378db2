"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items, each text scanned once.

The items' windows are learned as strings with one character for each distinct word, so that a text is scanned in as
many steps as it has words; a text's other words share one character. Hits are kept as word ranges and mapped back to
character offsets of the original text.

An automaton holds at most :data:`BLOCK_WINDOWS` windows. A benchmark of more is cut into blocks by hash; each block
scans the texts with its own automaton, and the hits of a text are united. Each automaton sent to the tasks is thus
bounded whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import table
from metrum.llm.text import map_arrow, prepare

WINDOW = 13
SHARE = 20
BLOCK_WINDOWS = 1 << 16
#: Bytes as the contract normalises them: A-Z lower, all but letters, digits and non-ASCII a space.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
OTHER = "\x00"


def split(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, words) for each distinct window of each item."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        items, found = [], []
        for item, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = split(whole)
            runs = {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))} if words else ()
            items += [item] * len(runs)
            found += [run.decode("utf-8", "surrogatepass") for run in runs]
        return pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(found, pa.string())], ["item", "words"])

    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return map_arrow(rows.where("item IS NOT NULL"), cut, "item string, words string").distinct()


class Automaton:
    """Windows of one block, with the items they come from."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.items = sorted({item for item, _ in pairs})
        at = {item: i for i, item in enumerate(self.items)}
        owners: dict[str, list[int]] = {}
        for item, words in pairs:
            owners.setdefault(words, []).append(at[item])
        self.letters: dict[bytes, str] = {}
        self.tree = ahocorasick.Automaton()
        for words, own in owners.items():
            key = [self._letter(word) for word in words.encode("utf-8", "surrogatepass").split(b" ")]
            self.tree.add_word("".join(key), (len(key), own))
        if owners:
            self.tree.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            code = len(self.letters) + 1
            self.letters[word] = chr(code if code < 0xD800 else code + 0x800)  # surrogates are no characters
        return self.letters[word]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged word ranges (end exclusive) inside windows, and the items of these windows."""
        if not self.letters or not words:
            return [], []
        get = self.letters.get
        ranges: list[tuple[int, int]] = []
        items: set[int] = set()
        for end, (length, own) in self.tree.iter("".join([get(word, OTHER) for word in words])):
            ranges.append((end + 1 - length, end + 1))
            items.update(own)
        return merge(ranges), [self.items[i] for i in sorted(items)]


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


_BUILT: dict[str, Automaton] = {}


def _automaton(name: str, pairs) -> Automaton:
    """Built once in each Python worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(pairs.value)
    return _BUILT[name]


SCHEMA = "doc_id long, n_words long, n_hit long, items array<string>, ranges array<struct<start:int,end:int>>, spans array<struct<start:int,end:int>>"
SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _row(text: str | None, words: list[bytes], ranges: list[tuple[int, int]]) -> tuple[int, int, list[dict], list[dict]]:
    spans = []
    if ranges:
        places = [m.span() for m in WORD.finditer(text)]
        spans = [{"start": places[low][0], "end": places[high - 1][1]} for low, high in ranges]
    return len(words), sum(high - low for low, high in ranges), [{"start": a, "end": b} for a, b in ranges], spans


def contamination(
    documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_hit, items, ranges`` (word ranges), ``spans`` (character offsets).

    A null or empty text has no words. Items without words or without id have no windows; with an empty benchmark
    nothing is hit. Equal items count by their ids. Repeated document rows give repeated result rows. Other columns
    of either table are not read.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = _blocks(documents, benchmark, item_id, item_text, window, block_windows)
    if len(blocks) == 1:
        return _scan(docs, *blocks[0]).drop("key")

    def unite(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, whole, ranges, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "ranges", "items"))):
            rows.append((doc, *_row(whole, split(whole), merge([(r["start"], r["end"]) for r in ranges or ()])), items or []))
        return _batch(rows)

    joined = docs.withColumn("key", _key("text")).join(_hits(docs, blocks), "key", "left")
    return map_arrow(joined.select("doc_id", "text", "ranges", "items"), unite, SCHEMA)


def decontaminated(
    documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = SHARE, block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The rows, with all their columns, of which less than one word in ``share`` lies in windows of the benchmark."""
    blocks = _blocks(documents, benchmark, item_id, item_text, window, block_windows)

    def clean(n: int, ranges: list[tuple[int, int]]) -> bool:
        hit = sum(high - low for low, high in ranges)
        return hit == 0 or share * hit < n

    if len(blocks) == 1:
        name, pairs = blocks[0]

        def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
            tree = _automaton(name, pairs)
            own = (split(whole) for whole in batch.column(text).to_pylist())
            return batch.filter(pa.array([clean(len(words), tree.scan(words)[0]) for words in own]))

        return map_arrow(documents, scan, documents.schema)

    columns = documents.columns

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = ([(r["start"], r["end"]) for r in ranges or ()] for ranges in batch.column("_hit_ranges").to_pylist())
        keep = [clean(len(split(whole)), merge(ranges)) for whole, ranges in zip(batch.column(text).to_pylist(), found)]
        return batch.select(columns).filter(pa.array(keep))

    hits = _hits(documents.select(F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), blocks)
    joined = documents.withColumn("_hit_key", _key(text)).join(hits.select(F.col("key").alias("_hit_key"), F.col("ranges").alias("_hit_ranges")), "_hit_key", "left")
    return map_arrow(joined.drop("_hit_key"), judge, documents.schema)


def _blocks(documents: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, window: int, block_windows: int) -> list[tuple]:
    """A name and the broadcast windows of each block, about ``block_windows`` of them."""
    spark = prepare(documents.sparkSession)
    found = item_windows(benchmark, item_id, item_text, window)
    count = max(1, -(-found.count() // block_windows))
    out = []
    for block in range(count):
        own = found if count == 1 else found.where(F.pmod(F.xxhash64("words"), F.lit(count)) == block)
        pairs = spark.sparkContext.broadcast([tuple(row) for row in own.collect()])
        out.append((f"{spark.sparkContext.applicationId}:{pairs._jbroadcast.id()}", pairs))
    return out


def _hits(docs: DataFrame, blocks: list[tuple]) -> DataFrame:
    """(key, ranges, items) of the texts that are hit, over all blocks; equal texts have one key and one row."""
    every = None
    for name, pairs in blocks:
        part = _scan(docs, name, pairs).where("n_hit > 0").select("key", "ranges", "items")
        every = part if every is None else every.union(part)
    once = every.distinct()  # a text repeated in many rows is hit alike in each
    items = F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return once.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), items.alias("items"))


def _key(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _batch(rows: list[tuple], keys: pa.Array | None = None) -> pa.RecordBatch:
    doc, n, hit, ranges, spans, items = zip(*rows)
    columns = [pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(ranges, SPAN), pa.array(spans, SPAN)]
    names = ["doc_id", "n_words", "n_hit", "items", "ranges", "spans"]
    if keys is not None:
        columns, names = [*columns, keys], [*names, "key"]
    return pa.RecordBatch.from_arrays(columns, names)


def _scan(docs: DataFrame, name: str, pairs) -> DataFrame:
    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        tree = _automaton(name, pairs)
        rows = []
        keys = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            words = split(text)
            ranges, items = tree.scan(words)
            rows.append((doc, *_row(text, words, ranges), items))
            keys.append(hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest() if ranges else None)
        return _batch(rows, pa.array(keys, pa.string()))

    return map_arrow(docs, scan, SCHEMA + ", key string")


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`contamination`: contaminated if a twentieth of the words is hit."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP1_SQL = r"""
WITH letters AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark WHERE item_id IS NOT NULL),
cuts AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS p FROM items WHERE len(w) > 0),
patterns AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p : p + 12], ' ') AS k FROM cuts),
sizes AS (SELECT DISTINCT n FROM patterns),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM letters, sizes WHERE len(w) >= n),
hits AS (
    SELECT doc_id, places.n, p, item_id FROM
        (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM places) places
        JOIN patterns ON places.n = patterns.n AND places.k = patterns.k),
covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS item_list
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(item_list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM letters LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
