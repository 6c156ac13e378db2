"""Alignment of two tokenizers by the bytes their tokens cover.

Each text, behind one space, is cut by a byte-level BPE (A) and by a sentence-piece BPE (B). Where both end a token
the text falls into groups; two tokens are linked if they share a byte. How often an id of A is linked to an id of B
over all texts says which of them mean the same.

1.  A batch of texts becomes two list columns of ids. They are flattened, with the parent index of each token; sums of
    token lengths within a document give the ends of its tokens. An end and its document are one key, on which an Acero
    hash join meets the ends of A with those of B: these are the cuts between groups.
2.  ``Table.group_by`` counts the pairs of each document, and those of the batch. A batch is written once, compressed,
    with one row for each of its distinct pairs.
3.  Spark sums the batches' counts and finds the highest of each id of B; each batch gets back two values for each of
    its distinct pairs, from which it fills in its documents.

No pair makes a task large: a batch sends it once, and there are at most as many pairs as ids of A for one id of B.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.pieces import MODEL
from metrum.llm.tables import durable, scratch, table
from metrum.llm.text import map_arrow, view

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text whose tokens are held as arrays at once.
SLICE_BYTES = 1 << 20
#: Cuts a text into the words of the byte-level BPE (fixed value, of the public vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and digits of these scripts are old enough to be the same in every release of Unicode.
UNSETTLED = re.compile("[^\\x00-\\u024f\\u0400-\\u045f\\u3041-\\u3096\\u4e00-\\u9fa5]|\\s{500}")
PACKED = "chunk long, docs binary, pairs array<long>, counts array<long>"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SHIFT = 32


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def token_table(values: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    return pa.array(values, pa.binary()), np.array([len(v) for v in values], np.int64)


@dataclass
class Pair:
    """Both tokenizers, and the bytes of their tokens."""

    whole: tokenizers.Tokenizer
    quick: tiktoken.Encoding | None
    pieces: sentencepiece.SentencePieceProcessor
    a_bytes: pa.Array
    a_sizes: np.ndarray
    b_bytes: pa.Array
    b_sizes: np.ndarray
    shown: pa.Array
    ids: int

    @classmethod
    def load(cls, byte_bpe: str = BYTE_BPE, piece_bpe: str = MODEL) -> Pair:
        whole = tokenizers.Tokenizer.from_file(byte_bpe)
        whole.encode_special_tokens = True
        model, letters = json.loads(whole.to_str())["model"], byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token)}
        values = [b""] * whole.get_vocab_size()
        for token, i in whole.get_vocab().items():
            values[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
        own = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in range(pieces.vocab_size())]
        # Merging by the smallest id is the same as by the order of merges only if ids were given in that order.
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        specials = {t.content for t in whole.get_added_tokens_decoder().values()}
        ordered = made == list(range(256, 256 + len(made))) and not specials & {t for t in model["vocab"] if len(t) == 1}
        for token in specials:
            ranks.pop(token.encode(), None)
        quick = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        n = max(len(values), len(own))
        # Every id with every sign that can follow it: in A, within B, and at B's ends.
        shown = pa.array([f"{i}{sign}".encode() for sign in (",", "|", ";", "") for i in range(n)], pa.binary())
        return cls(whole, quick, pieces, *token_table(values), *token_table(own), shown, n)

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of A for texts with their leading space, and of B for the texts without it."""
        first: list = [None] * len(texts)
        slow = [i for i, t in enumerate(texts) if self.quick is None or UNSETTLED.search(t)]
        for i, found in zip(slow, self.whole.encode_batch([" " + texts[i] for i in slow], add_special_tokens=False) if slow else ()):
            first[i] = found.ids
        for i, t in enumerate(texts):
            if first[i] is None:
                first[i] = self.quick.encode_ordinary(" " + t)
        kind = pa.list_(pa.int32())
        return pa.array(first, kind), pa.array(self.pieces.encode(texts, num_threads=1), kind)


@cache
def loaded(byte_bpe: str, piece_bpe: str) -> Pair:
    pa.set_cpu_count(1)
    return Pair.load(byte_bpe, piece_bpe)


def starts_of(tokens: pa.ListArray) -> np.ndarray:
    """Number of tokens before each row, and in total."""
    return np.concatenate([[0], np.cumsum(pc.list_value_length(tokens).to_numpy())]).astype(np.int64)


def faithful(tokens: pa.ListArray, values: pa.Array, sizes: np.ndarray, expected: list[bytes]) -> np.ndarray:
    """True for each row whose tokens' bytes, joined, are the expected ones."""
    flat = pc.list_flatten(tokens)
    ends = np.concatenate([[0], np.cumsum(sizes[flat.to_numpy()])])[starts_of(tokens)]
    data, _ = view(values.take(flat))
    raw = data.tobytes()
    return np.array([raw[low:high] == text for low, high, text in zip(ends[:-1], ends[1:], expected)], bool)


def ends_of(tokens: pa.ListArray, sizes: np.ndarray) -> pa.Table:
    """(key, place, doc): the end of each token. A key is the document's start in the slice plus the end within it."""
    flat = pc.list_flatten(tokens).to_numpy()
    return pa.table({"key": np.cumsum(sizes[flat]), "place": np.arange(len(flat)), "doc": pc.list_parent_indices(tokens)})


def aligned(both: Pair, texts: list[str], raw: list[bytes]) -> tuple[pa.Table, pa.Table]:
    """A row of figures for each text, and (doc, pair, n): how many links of a text join a pair of ids."""
    n = len(texts)
    a, b = both.encode(texts) if n else (pa.array([], pa.list_(pa.int32())),) * 2
    expected = [b" " + r for r in raw]
    good = np.array([bool(r) for r in raw], bool) & faithful(a, both.a_bytes, both.a_sizes, expected) & faithful(b, both.b_bytes, both.b_sizes, expected)
    rows = np.flatnonzero(good)
    a, b = a.filter(pa.array(good)), b.filter(pa.array(good))
    a_ids, b_ids = pc.list_flatten(a).to_numpy().astype(np.int64), pc.list_flatten(b).to_numpy().astype(np.int64)
    a_ends, b_ends = ends_of(a, both.a_sizes), ends_of(b, both.b_sizes)
    cuts = a_ends.join(b_ends.drop_columns("doc"), "key", join_type="inner", right_suffix="_b", use_threads=False)
    cut_a, cut_b = np.sort(cuts["place"].to_numpy()), np.sort(cuts["place_b"].to_numpy())
    a_key, b_key, a_doc, b_doc = a_ends["key"].to_numpy(), b_ends["key"].to_numpy(), a_ends["doc"].to_numpy(), b_ends["doc"].to_numpy()

    # An end of A links its token to the one of B over the same byte; so does an end of B where A has none.
    last_a, last_b = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    last_a[cut_a], last_b[cut_b] = True, True
    lone = np.flatnonzero(~last_b)
    link_a = np.concatenate([a_ids, a_ids[np.searchsorted(a_key, b_key[lone])]])
    link_b = np.concatenate([b_ids[np.searchsorted(b_key, a_key)], b_ids[lone]])
    link_doc = rows[np.concatenate([a_doc, b_doc[lone]])] if len(rows) else np.zeros(0, np.int64)
    links = pa.table({"doc": link_doc, "pair": link_a << SHIFT | link_b})
    pairs = links.group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["doc", "pair", "n"])

    # In each group the ids of A, then those of B: a token moves back by the tokens of the other side before it.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    final = np.zeros(len(b_ids), bool)
    final[starts_of(b)[1:] - 1] = True
    codes = np.empty(len(a_ids) + len(b_ids), np.int64)
    codes[np.arange(len(a_ids)) + np.concatenate([[0], cut_b + 1])[group_a]] = a_ids + both.ids * last_a
    codes[np.arange(len(b_ids)) + (cut_a + 1)[group_b]] = b_ids + both.ids * (2 * last_b.astype(np.int64) + final)
    text, offsets = view(both.shown.take(pa.array(codes)))
    bounds, shown = offsets[starts_of(a) + starts_of(b)], memoryview(text)
    digests = [""] * n
    for row, low, high in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist()):
        digests[row] = hashlib.sha256(shown[low:high]).hexdigest()
    counts = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups")}
    counts["n_a"][rows], counts["n_b"][rows] = np.diff(starts_of(a)), np.diff(starts_of(b))
    counts["n_groups"][rows] = np.bincount(a_doc[cut_a], minlength=len(rows)) if len(rows) else 0
    figures = pa.table(counts | {"n_links": counts["n_a"] + counts["n_b"] - counts["n_groups"], "groups_sha256": pa.array(digests, pa.string())})
    return figures, pairs


def slices(raw: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    low = 0
    while low < len(raw):
        high, held = low + 1, len(raw[low])
        while high < len(raw) and held + len(raw[high]) <= size:
            held += len(raw[high])
            high += 1
        yield low, high
        low = high


def packed(byte_bpe: str, piece_bpe: str, slice_bytes: int):
    """One row for each Arrow batch: its documents with their pairs by number, compressed, and its distinct pairs with counts."""
    made = {"partition": -1, "count": 0}

    def pack(batch: pa.RecordBatch) -> pa.Table:
        part = TaskContext.get().partitionId()
        if made["partition"] != part:
            made.update(partition=part, count=0)
        data, offsets = view(batch.column("text"))
        joined = data.tobytes()
        raw = [joined[low:high] for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        both, figures, pairs = loaded(byte_bpe, piece_bpe), [], []
        for low, high in slices(raw, slice_bytes):
            # Bytes that are no UTF-8 come back changed, so such a text has no tokens.
            one, two = aligned(both, [r.decode("utf-8", "replace") for r in raw[low:high]], raw[low:high])
            figures.append(one)
            pairs.append(two.set_column(0, "doc", pc.add(two["doc"], low)))
        held = pa.concat_tables(pairs).combine_chunks()
        totals = held.group_by("pair", use_threads=False).aggregate([("n", "sum")])
        order = np.argsort(totals["pair"].to_numpy())
        known = totals["pair"].to_numpy()[order]
        number = np.searchsorted(known, held["pair"].to_numpy())
        doc = held["doc"].to_numpy()
        by_doc = np.lexsort((number, doc))
        number, doc = number[by_doc], doc[by_doc]
        gaps = np.diff(number, prepend=0)
        first = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        begins = first[:-1][first[:-1] < first[1:]]
        gaps[begins] = number[begins]
        lists = pa.array(first.astype(np.int32))
        rows = pa.concat_tables(figures).combine_chunks().add_column(0, "doc_id", batch.column("doc_id"))
        for name, values in (("gaps", gaps), ("n", held["n"].to_numpy()[by_doc])):
            rows = rows.append_column(name, pa.ListArray.from_arrays(lists, pa.array(values.astype(np.int32))))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd", use_threads=False)) as out:
            out.write_table(rows)
        chunk, made["count"] = part << 32 | made["count"], made["count"] + 1
        one = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(known, pa.int64()))
        two = pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), pa.array(totals["n_sum"].to_numpy()[order], pa.int64()))
        return pa.table([pa.array([chunk]), pa.array([sink.getvalue().to_pybytes()]), one, two], ["chunk", "docs", "pairs", "counts"])

    return pack


def finished(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a batch, with the counts of its pairs over all batches."""
    out = []
    number = answers["number"].to_numpy()
    count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    count[number], best[number] = answers["count"].to_numpy(), answers["best"].to_numpy()
    for held in chunks["docs"].to_pylist():
        rows = pa.ipc.open_stream(held).read_all().combine_chunks()
        first = starts_of(rows["gaps"].combine_chunks())
        gaps, n = (pc.list_flatten(rows[c].combine_chunks()).to_numpy().astype(np.int64) for c in ("gaps", "n"))
        # Gaps start anew in each document: take off the sum before it.
        total = np.concatenate([[0], np.cumsum(gaps)])
        local = total[1:] - np.repeat(total[first[:-1]], np.diff(first))
        sums = [np.concatenate([[0], np.cumsum(n * value[local])])[first] for value in (best, count)]
        values = {"n_best": np.diff(sums[0]), "count_sum": np.diff(sums[1])}
        rows = rows.drop_columns(["gaps", "n"])
        for name, value in values.items():
            rows = rows.append_column(name, pa.array(value, pa.int64()))
        out.append(rows.select(["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
    return pa.concat_tables(out)


@dataclass
class Alignment:
    """``documents``: one row for each document; ``pairs``: (a, b, count, best) for each linked pair of ids."""

    documents: DataFrame
    pairs: DataFrame


def align(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str = BYTE_BPE, piece_bpe: str = MODEL, slice_bytes: int = SLICE_BYTES) -> Alignment:
    """Align both tokenizers over all documents.

    Special tokens' strings are ordinary text. A text that is null or empty, or whose tokens' bytes (of A or of B) are
    not a space and the text, has no tokens: zeros and an empty digest. Rows of one id are rows of their own, a null
    id stays; other columns are not read. An empty table gives none. The paths must exist on every executor.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    folder = scratch(spark)
    map_arrow(docs, packed(byte_bpe, piece_bpe, slice_bytes), PACKED).write.parquet(folder)
    chunks = spark.read.schema(PACKED).parquet(folder)
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "counts"))).select("chunk", F.col("pos").alias("number"), F.col("col.pairs").alias("pair"), F.col("col.counts").alias("n"))
    b = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    counts = durable(rows.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", b))
    highest = counts.groupBy("b").agg(F.max("count").alias("top"))
    judged = durable(counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("top")).cast("int").alias("best")))
    answers = rows.select("chunk", "number", "pair").join(judged, "pair").select("chunk", "number", "count", "best")
    held = spark.read.schema(PACKED).parquet(folder).select("chunk", "docs")
    result = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finished, RESULT)
    return Alignment(result, judged.select(F.shiftright("pair", SHIFT).alias("a"), b.alias("b"), "count", (F.col("best") == 1).alias("best")))


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """The figures of every document of the whole table."""
    return align(table(spark, sf_dir, "documents")).documents
