"""Substring dedup by fixed-block anchors.

A repeat of 13 words holds, wherever it starts, one whole block of 7 words of its reference document, cut at every
seventh word. So the index holds only those blocks, and every rolling window of 7 words of every document probes it:

1.  Documents are packed into chunks of a few megabytes. Each chunk deals the hashes of its rolling windows, and which
    of them are blocks, into buckets by hash: four bytes a window, sorted, once for each chunk.
2.  A bucket finds the hashes that are a block somewhere and occur in two documents, and returns them to the chunks
    they came from. These are the anchors.
3.  Around its anchors a chunk extends to windows of 13 words and deals these, with the smallest document they start
    in, by a 96-bit hash; a bucket returns one bit for each, whether a smaller document holds it too.
4.  Each chunk unites the windows found to be repeats into maximal runs of words and takes these out.

Neither a common passage nor a group of copies makes a bucket large: a chunk sends each hash once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import durable, table
from metrum.llm.text import map_arrow, row_of, view, whole_windows, windows, word_hashes, words_in

WINDOW = 13
CHUNK_BYTES = 8 << 20
BUCKET_WORDS = 1 << 20
CHUNK = "chunk long, n_bytes long, ids binary, offsets binary, blob binary"
LOW = np.uint64(0xFFFFFFFF)


def chunks(documents: DataFrame, doc_id: str, text: str, chunk_bytes: int) -> DataFrame:
    """Documents packed in rows: their ids, offsets and compressed texts. A null id is kept as a flag bit."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    made = {"partition": -1, "count": 0}

    def pack(batch: pa.RecordBatch) -> pa.Table:
        part = TaskContext.get().partitionId()
        if made["partition"] != part:
            made.update(partition=part, count=0)
        data, offsets = view(batch.column("text"))
        ids = batch.column("doc_id")
        plain = ids.fill_null(0).to_numpy()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        rows, first = [], 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
            part_bytes = data[offsets[first] : offsets[last]].tobytes()
            held = np.concatenate([plain[first:last], known[first:last].astype(np.int64)])
            rows.append((part << 32 | made["count"], len(part_bytes), held.tobytes(), (offsets[first : last + 1] - offsets[first]).tobytes(), pa.compress(part_bytes, "zstd", asbytes=True)))
            made["count"] += 1
            first = last
        columns = list(zip(*rows))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["chunk", "n_bytes", "ids", "offsets", "blob"])

    return map_arrow(docs, pack, CHUNK)


class Chunk:
    """One chunk's words, and the anchors and windows derived from them."""

    def __init__(self, row: dict, window: int, bits: int):
        held = np.frombuffer(row["ids"], np.int64)
        n = len(held) // 2
        self.ids, self.known = held[:n], held[n:].astype(bool)
        self.offsets = np.frombuffer(row["offsets"], np.int64)
        self.raw = pa.decompress(row["blob"], row["n_bytes"], "zstd", asbytes=True) if row["n_bytes"] else b""
        self.words = words_in(np.frombuffer(self.raw, np.uint8), self.offsets)
        self.window, self.block, self.bits = window, (window + 1) // 2, bits
        self.hashes = word_hashes(self.words)
        self.doc = row_of(self.words.rows)

    def rolling(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all rolling windows of a block's length, and where they start. A key has 32 bits below the bucket."""
        at = np.flatnonzero(whole_windows(self.words, self.block) & self.known[self.doc[: max(0, len(self.doc) - self.block + 1)]])
        keys = windows(self.hashes, self.block)[at] >> np.uint64(32 - self.bits)
        return keys, at

    def probes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys; whether one is a block of the index; whether it occurs in two documents here."""
        keys, at = self.rolling()
        block = (at - self.words.rows[self.doc[at]]) % self.block == 0
        order = np.argsort(keys, kind="stable")
        keys, doc, block = keys[order], self.doc[at[order]], block[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        if not len(keys):
            return keys, block, block
        ids = self.ids[doc]  # repeated rows: both ends of a run may have one id and another be between
        return keys[first], np.logical_or.reduceat(block, first), np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)

    def candidates(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows around anchors: starts in order of hash, two hashes, the window's number among the distinct, its first place."""
        keys, at = self.rolling()
        hit = np.zeros(len(self.hashes) + 1, np.int64)
        if len(anchors) and len(keys):
            place = np.minimum(np.searchsorted(anchors, keys), len(anchors) - 1)
            hit[at[anchors[place] == keys] + 1] = 1
        total = np.cumsum(hit)
        whole = np.flatnonzero(whole_windows(self.words, self.window) & self.known[self.doc[: max(0, len(self.doc) - self.window + 1)]])
        start = whole[total[whole + self.window - self.block + 1] > total[whole]]
        one = windows(self.hashes, self.window)[start]
        two = windows(word_hashes(self.words, seed=2), self.window, seed=2)[start] & LOW if len(start) else one
        order = np.lexsort((self.ids[self.doc[start]], two, one))
        start, one, two = start[order], one[order], two[order]
        new = np.ones(len(start), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        return start, one, two, np.cumsum(new) - 1, np.flatnonzero(new)


def _slices(keys: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of sorted keys and the offsets of their runs."""
    own = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    buckets, first = np.unique(own, return_index=True)
    return buckets, np.append(first, len(keys))


def _rows(batch: pa.RecordBatch | pa.Table) -> list[dict]:
    return batch.to_pylist()


def _probe(window: int, bits: int):
    def probe(batch: pa.RecordBatch) -> pa.Table:
        out: list[tuple] = []
        for row in _rows(batch):
            keys, block, several = Chunk(row, window, bits).probes()
            buckets, cut = _slices(keys, 32)
            for bucket, low, high in zip(buckets, cut[:-1], cut[1:]):
                flags = np.packbits(np.concatenate([block[low:high], several[low:high]]))
                out.append((int(bucket), row["chunk"], (keys[low:high] & LOW).astype(np.uint32).tobytes(), flags.tobytes()))
        columns = list(zip(*out)) or [(), (), (), ()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "flags"])

    return probe


NOTE = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("note", pa.binary())])


def _notes(chunk: list, kind: int, bucket: int, note: list) -> pa.Table:
    n = len(chunk)
    return pa.table([pa.array(chunk, pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array(note, pa.binary())], schema=NOTE)


def anchors(rows: pa.Table) -> pa.Table:
    """The keys of one bucket that are blocks and occur in two documents, for each chunk that has them."""
    chunk = rows.column("chunk").to_pylist()
    keys, block, several = [], [], []
    for raw, flags in zip(rows.column("keys").to_pylist(), rows.column("flags").to_pylist()):
        own = np.frombuffer(raw, np.uint32)
        bits = np.unpackbits(np.frombuffer(flags, np.uint8), count=2 * len(own)).astype(bool)
        keys.append(own)
        block.append(bits[: len(own)])
        several.append(bits[len(own) :])
    sizes = np.array([len(k) for k in keys])
    merged = np.sort(np.concatenate(keys).astype(np.uint64) << np.uint64(32) | np.arange(sizes.sum(), dtype=np.uint64))
    value, at = merged >> np.uint64(32), (merged & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    run = np.diff(np.append(first, len(value)))
    good = np.logical_or.reduceat(np.concatenate(block)[at], first) & ((run > 1) | np.logical_or.reduceat(np.concatenate(several)[at], first))
    mark = np.zeros(len(value), bool)
    mark[at[np.repeat(good, run)]] = True
    cut = np.concatenate([[0], np.cumsum(sizes)])
    picked = [(c, k[mark[low:high]].tobytes()) for c, k, low, high in zip(chunk, keys, cut[:-1], cut[1:]) if mark[low:high].any()]
    return _notes([c for c, _ in picked], 0, rows.column("bucket")[0].as_py(), [k for _, k in picked])


def _held(notes: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return sorted((r["bucket"], r["note"]) for r in notes.to_pylist() if r["kind"] == kind)


def _anchors(notes: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(note, np.uint32).astype(np.uint64) | np.uint64(bucket << 32) for bucket, note in _held(notes, 0)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _extend(window: int, bits: int):
    def extend(one: pa.Table, notes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for row in _rows(one):
            own = Chunk(row, window, bits)
            start, h1, h2, _, first = own.candidates(_anchors(notes))
            h1, h2, doc = h1[first], h2[first], own.ids[own.doc[start[first]]]
            buckets, cut = _slices(h1, 64 - bits)
            for bucket, low, high in zip(buckets, cut[:-1], cut[1:]):
                out.append((int(bucket), row["chunk"], h1[low:high].tobytes(), h2[low:high].astype(np.uint32).tobytes(), doc[low:high].tobytes()))
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "chunk", "one", "two", "docs"])

    return extend


def smaller(rows: pa.Table) -> pa.Table:
    """For each chunk's windows in one bucket, a bit: does a smaller document than its own smallest hold it?"""
    parts = [[np.frombuffer(x, kind) for x in rows.column(c).to_pylist()] for c, kind in (("one", np.uint64), ("two", np.uint32), ("docs", np.int64))]
    sizes = np.array([len(x) for x in parts[0]])
    one, two, docs = (np.concatenate(x) for x in parts)
    order = np.lexsort((docs, two, one))
    new = np.ones(len(order), bool)
    new[1:] = (one[order[1:]] != one[order[:-1]]) | (two[order[1:]] != two[order[:-1]])
    least = docs[order[np.flatnonzero(new)]][np.cumsum(new) - 1]
    found = np.zeros(len(order), bool)
    found[order] = least < docs[order]
    cut = np.concatenate([[0], np.cumsum(sizes)])
    return _notes(rows.column("chunk").to_pylist(), 1, rows.column("bucket")[0].as_py(), [np.packbits(found[low:high]).tobytes() for low, high in zip(cut[:-1], cut[1:])])


RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
RESULT = "doc_id long, n_words long, n_removed long, kept string, ranges array<struct<start:int,end:int>>"


def _finish(window: int, bits: int):
    def finish(one: pa.Table, notes: pa.Table) -> pa.Table:
        tables = []
        for row in _rows(one):
            own = Chunk(row, window, bits)
            start, h1, _, number, first = own.candidates(_anchors(notes))
            elsewhere = np.zeros(len(first), bool)
            buckets, cut = _slices(h1[first], 64 - bits)
            bit = dict(_held(notes, 1))
            for bucket, low, high in zip(buckets, cut[:-1], cut[1:]):
                elsewhere[low:high] = np.unpackbits(np.frombuffer(bit[int(bucket)], np.uint8), count=high - low).astype(bool)
            doc = own.ids[own.doc[start]]
            gone = start[elsewhere[number] | (doc[first][number] < doc)] if len(start) else start
            edge = np.zeros(len(own.hashes) + 1, np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + window, -1)
            tables.append(_result(own, np.cumsum(edge)[:-1] > 0))
        return pa.concat_tables(tables)

    return finish


def _result(own: Chunk, removed: np.ndarray) -> pa.Table:
    rows = own.words.rows
    kept, ranges = [], []
    for r, (low, high) in enumerate(zip(rows[:-1], rows[1:])):
        parts = own.raw[own.offsets[r] : own.offsets[r + 1]].split()
        gone = removed[low:high]
        spans = []
        if gone.any():
            change = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
            spans = [{"start": int(a), "end": int(b)} for a, b in zip(change[::2], change[1::2])]
            parts = [w for w, g in zip(parts, gone.tolist()) if not g]
        kept.append(b" ".join(parts).decode("utf-8", "surrogatepass"))
        ranges.append(spans)
    total = np.concatenate([[0], np.cumsum(removed)])
    return pa.table(
        [pa.array(own.ids, mask=~own.known), pa.array(np.diff(rows).astype(np.int64)), pa.array((total[rows[1:]] - total[rows[:-1]]).astype(np.int64)), pa.array(kept, pa.string()), pa.array(ranges, RANGES)],
        ["doc_id", "n_words", "n_removed", "kept", "ranges"])


def without_repeats(
    documents: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_words: int = BUCKET_WORDS
) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_removed, kept, ranges``.

    A word is removed if a window of ``window`` words that covers it also starts in a document with a smaller id.
    ``kept`` joins the other words by one space, ``ranges`` are the removed maximal runs of words (end exclusive).
    A null text has no words; a row with a null id is smaller than nothing and loses nothing. Repeated rows of one id
    don't remove each other's words. Other columns are not read.
    """
    packed = durable(chunks(documents, doc_id, text, chunk_bytes))
    size = packed.agg(F.sum("n_bytes")).first()[0] or 0
    bits = max(0, int(size // 6 // bucket_words).bit_length())
    dealt = map_arrow(packed, _probe(window, bits), "bucket long, chunk long, keys binary, flags binary")
    note = "chunk long, kind int, bucket long, note binary"
    found = durable(dealt.groupBy("bucket").applyInArrow(anchors, note))
    ends = "bucket long, chunk long, one binary, two binary, docs binary"
    extended = packed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_extend(window, bits), ends)
    answers = extended.groupBy("bucket").applyInArrow(smaller, note)
    return packed.groupBy("chunk").cogroup(found.union(answers).groupBy("chunk")).applyInArrow(_finish(window, bits), RESULT)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`without_repeats`."""
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH letters AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM letters WHERE len(w) >= 13),
cuts AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS k FROM places),
owned AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS least FROM cuts),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM owned WHERE least < doc_id),
listed AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE
        [w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(qs, i)] END, ' ')) AS kept_sha256
FROM letters LEFT JOIN listed USING (doc_id)
"""
