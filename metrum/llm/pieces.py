"""SentencePiece encoding and decoding in numpy, batches of equal-length words at a time.

A batch of texts is one array of characters. It is cut wherever no piece holds both neighbours, which leaves words (and
runs of spaces); distinct words of one length form a matrix. Prefix hashes give the hash of each substring, which probes
the sorted hashes of the pieces. On that lattice

*   a unigram model is solved by Viterbi: all words of a length advance together, and the best piece that ends at a
    position is kept as its backpointer;
*   a BPE model is solved by merging: in each round every word merges the neighbouring pair of the best score, the
    leftmost of equals. (The best sum of scores, which Viterbi finds, is not what such a model means: its scores are
    ranks of merges.)

Characters without a piece become bytes, or the unknown piece if the model has no bytes. Only models without a
normalisation table, user-defined symbols and whitespace removal are taken; others are refused with an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import table
from metrum.llm.text import map_arrow, splitmix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581
UNIGRAM, BPE = 1, 2
#: Longer words are merged one by one with a heap, so that no word costs the square of its length.
LONG = 96
#: Characters held as arrays at once.
CHUNK = 1 << 20
FACTOR = np.uint64(0x9E3779B97F4A7C15)
NONE = np.float32(-np.inf)


def messages(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields (number, value) of one protocol-buffer message; fixed-width values are passed over."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            value |= (data[at] & 0x7F) << shift
            shift += 7
            at += 1
            if data[at - 1] < 0x80:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        else:
            at += 4 if key & 7 == 5 else 8


def hashed(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of characters: (rows, length + 1)."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    mixed = splitmix(codes.astype(np.uint64) + np.uint64(1))
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * FACTOR + mixed[:, i]
    return out


def powers(n: int) -> np.ndarray:
    """Powers 0 to n of the hash's factor."""
    out = np.full(n + 1, FACTOR, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@dataclass
class Vocabulary:
    """What encoding needs of a model; a few megabytes, as a model file is."""

    kind: int
    prefix: bool
    unknown: int
    first_byte: int | None
    texts: list[str]
    scores: np.ndarray
    normal: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls.of(model)

    @classmethod
    def of(cls, model: sentencepiece.SentencePieceProcessor) -> Vocabulary:
        top = {k: v for k, v in messages(model.serialized_model_proto()) if k in (2, 3)}
        trainer, normalizer = dict(messages(top.get(2, b""))), dict(messages(top.get(3, b"")))
        n = model.vocab_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(n)])
        bytes_at = [i for i in range(n) if model.is_byte(i)]
        if normalizer.get(2) or normalizer.get(4, 1) or trainer.get(3, 1) not in (UNIGRAM, BPE) or any(model.is_unused(i) for i in range(n)):
            raise ValueError("only unigram and BPE models that leave texts as they are can be used")
        if bytes_at and bytes_at != list(range(bytes_at[0], bytes_at[0] + 256)):
            raise ValueError("byte pieces are expected in order")
        scores = np.array([model.get_score(i) for i in range(n)], np.float32)
        return cls(trainer.get(3, 1), bool(normalizer.get(3, 1)), model.unk_id(), bytes_at[0] if bytes_at else None, texts, scores, ~special)

    def __post_init__(self):
        self.ids = {t: i for i, t in enumerate(self.texts) if self.normal[i]}
        self.longest = max(map(len, self.ids), default=1)
        keys = np.zeros(len(self.ids), np.uint64)
        owner = np.zeros(len(self.ids), np.int32)
        k = 0
        by_length: dict[int, list[int]] = {}
        for text, i in self.ids.items():
            by_length.setdefault(len(text), []).append(i)
        for length, own in by_length.items():
            codes = np.array([[ord(c) for c in self.texts[i]] for i in own])
            keys[k : k + len(own)] = hashed(codes)[:, -1]
            owner[k : k + len(own)] = own
            k += len(own)
        order = np.argsort(keys)
        self.keys, self.owner = keys[order], owner[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        pairs = {(a, b) for t in self.ids for a, b in zip(t, t[1:])}
        self.letters = np.zeros(0x110000, np.int16)
        for i, c in enumerate(sorted({c for pair in pairs for c in pair})):
            self.letters[ord(c)] = i + 1
        self.joined = np.zeros((int(self.letters.max()) + 1,) * 2, bool)
        for a, b in pairs:
            self.joined[self.letters[ord(a)], self.letters[ord(b)]] = True
        # Decoding: the bytes of each piece, then again without a leading space for the first of a text.
        plain = [bytes([i - self.first_byte]) if self.first_byte is not None and 0 <= i - self.first_byte < 256 else (t.replace(chr(SPACE), " ").encode() if self.normal[i] else b"") for i, t in enumerate(self.texts)]
        plain[self.unknown] = " ⁇ ".encode()
        heads = [p[1:] if self.prefix and p[:1] == b" " and self.normal[i] else p for i, p in enumerate(plain)]
        self.surface = np.frombuffer(b"".join(plain + heads), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(p) for p in plain + heads])])

    def lattice(self, codes: np.ndarray) -> np.ndarray:
        """Piece ids (words, start, length - 1) of all substrings, -1 where there is none."""
        words, n = codes.shape
        sums = hashed(codes)
        out = np.full((words, n, min(n, self.longest)), -1, np.int32)
        for length, power in enumerate(powers(out.shape[2])[1:], 1):
            keys = sums[:, length:] - sums[:, : n - length + 1] * power
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            out[:, : n - length + 1, length - 1] = np.where(self.keys[at] == keys, self.owner[at], -1)
        return out

    def viterbi(self, codes: np.ndarray) -> np.ndarray:
        """For each word and position, the start of the piece that ends there on the best path; -1 where none does."""
        words, n = codes.shape
        found = self.lattice(codes)
        unknown = self.scores[self.normal].min() - np.float32(10)
        score = np.where(found >= 0, self.scores[found], NONE)
        score[:, :, 0] = np.where(found[:, :, 0] >= 0, score[:, :, 0], unknown)
        best = np.full((words, n + 1), NONE, np.float32)
        best[:, 0] = 0
        back = np.zeros((words, n + 1), np.int32)
        for end in range(1, n + 1):
            starts = np.arange(max(0, end - score.shape[2]), end)
            sums = best[:, starts] + score[:, starts, end - starts - 1]
            pick = sums.argmax(axis=1)  # of equals the longest piece
            best[:, end] = sums[np.arange(words), pick]
            back[:, end] = starts[pick]
        ends = np.zeros((words, n), np.int32)  # for each start on the path its end
        at = np.full(words, n)
        alive = np.arange(words)
        while len(alive):
            start = back[alive, at[alive]]
            ends[alive, start] = at[alive]
            at[alive] = start
            alive = alive[start > 0]
        return ends

    def merges(self, codes: np.ndarray) -> np.ndarray:
        """For each start of a symbol its end, after all merges; 0 elsewhere."""
        words, n = codes.shape
        ends = np.tile(np.arange(1, n + 1, dtype=np.int32), (words, 1))
        if n == 1:
            return ends
        found = self.lattice(codes)
        score = np.full((words, n + 1, n + 1), NONE, np.float32)  # by start and end
        for length in range(2, found.shape[2] + 1):
            ids = found[:, : n - length + 1, length - 1]
            score[:, np.arange(n - length + 1), np.arange(length, n + 1)] = np.where(ids >= 0, self.scores[ids], NONE)
        rows = np.arange(words)
        here = np.arange(n)
        while len(rows):
            own = ends[rows]
            follow = np.where((own > 0) & (own < n), own, n)
            after = np.where(follow < n, np.take_along_axis(own, np.minimum(follow, n - 1), axis=1), n)
            value = np.where((own > 0) & (follow < n), score[rows[:, None], here[None, :], after], NONE)
            pick = value.argmax(axis=1)  # of equals the leftmost
            good = value[np.arange(len(rows)), pick] > NONE
            rows, pick = rows[good], pick[good]
            second = ends[rows, pick]
            ends[rows, pick] = ends[rows, second]
            ends[rows, second] = 0
        return ends

    def merge_long(self, word: str) -> list[int]:
        """Ends of symbols by start for one long word, by a heap of pairs; a pair that has changed since is passed over."""
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids, scores = self.ids, self.scores
        heap: list[tuple[float, int, int, int]] = []

        def offer(left: int) -> None:
            middle = end[left]
            if middle < n:
                piece = ids.get(word[left : end[middle]]) if end[middle] - left <= self.longest else None
                if piece is not None:
                    heapq.heappush(heap, (-float(scores[piece]), left, middle, end[middle]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if end[left] != middle or end[middle] != right:
                continue
            end[left], end[middle] = right, 0
            if right < n:
                before[right] = left
                offer(left)
            if before[left] >= 0:
                offer(before[left])
        return end

    def segment(self, codes: np.ndarray) -> np.ndarray:
        """Ends by start of words of one length."""
        if self.kind == UNIGRAM:
            step = max(1, (1 << 24) // (codes.shape[1] * self.longest * 8))
            return np.concatenate([self.viterbi(codes[i : i + step]) for i in range(0, len(codes), step)])
        if codes.shape[1] > LONG:
            return np.array([self.merge_long("".join(map(chr, row))) for row in codes.tolist()], np.int32)
        step = max(1, (1 << 22) // (codes.shape[1] + 1) ** 2)
        return np.concatenate([self.merges(codes[i : i + step]) for i in range(0, len(codes), step)])

    def tokens(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, one after the other, and how many each has."""
        ends = self.segment(codes)
        word, start = np.nonzero(ends)
        length = ends[word, start] - start
        sums = hashed(codes)
        keys = sums[word, start + length] - sums[word, start] * powers(codes.shape[1])[length]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        ids = np.where(self.keys[at] == keys, self.owner[at], -1)
        counts = np.bincount(word, minlength=len(codes))
        missing = np.flatnonzero(ids < 0)
        if not len(missing):
            return ids, counts
        if self.first_byte is None:
            ids[missing] = self.unknown
            return ids, counts
        made, size = [], np.ones(len(ids), np.int64)
        for i in missing.tolist():
            own = chr(codes[word[i], start[i]]).encode("utf-8", "surrogatepass")
            made.append(np.frombuffer(own, np.uint8).astype(np.int32) + self.first_byte)
            size[i] = len(own)
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = np.concatenate(made)
        return out, np.bincount(np.repeat(word, size), minlength=len(codes))


def segments(text: str, size: int = CHUNK) -> list[str]:
    """The text cut where a space follows another character, which no piece spans, every ``size`` characters or so."""
    out, at = [], 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1] in (" ", chr(SPACE)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def encode(vocabulary: Vocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after the other, and the offsets of texts. A null or empty text has no ids.

    At most about :data:`CHUNK` characters are held as arrays at once.
    """
    head = " " if vocabulary.prefix else ""
    counts = np.zeros(len(texts), np.int64)
    parts: list[np.ndarray] = [np.zeros(0, np.int32)]
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        ids, offsets = _encode(vocabulary, held)
        np.add.at(counts, owners, np.diff(offsets))
        parts.append(ids)
        held.clear()
        owners.clear()

    for i, text in enumerate(texts):
        for part in segments(head + text) if text else ():
            held.append(part)
            owners.append(i)
            size += len(part)
            if size >= CHUNK:
                flush()
                size = 0
    if held:
        flush()
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def _encode(vocabulary: Vocabulary, own: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in own])])
    codes[codes == 32] = SPACE
    letter = vocabulary.letters[codes]
    cut = np.ones(len(codes) + 1, bool)
    cut[1:-1] = ~vocabulary.joined[letter[:-1], letter[1:]]
    cut[bounds] = True
    starts = np.flatnonzero(cut[:-1])
    sizes = np.diff(np.append(starts, len(codes)))
    counts = np.zeros(len(starts), np.int64)
    parts: list[np.ndarray] = []
    origin = np.zeros(len(starts), np.int64)
    total = 0
    for n in np.unique(sizes):
        which = np.flatnonzero(sizes == n)
        matrix = codes[starts[which][:, None] + np.arange(n)]
        _, first, inverse = np.unique(hashed(matrix)[:, -1], return_index=True, return_inverse=True)
        if (matrix != matrix[first][inverse]).any():  # two words share a hash
            _, first, inverse = np.unique(matrix, axis=0, return_index=True, return_inverse=True)
        ids, made = vocabulary.tokens(matrix[first])
        at = np.concatenate([[0], np.cumsum(made)])[:-1] + total
        counts[which], origin[which] = made[inverse], at[inverse]
        parts.append(ids)
        total += len(ids)
    before = np.concatenate([[0], np.cumsum(counts)])
    table = np.concatenate(parts).astype(np.int32)
    ids = table[np.arange(before[-1]) + np.repeat(origin - before[:-1], counts)]
    offsets = before[np.searchsorted(starts, bounds)]
    if vocabulary.first_byte is None:  # neighbouring unknown characters are one piece
        again = (ids[1:] == vocabulary.unknown) & (ids[:-1] == vocabulary.unknown)
        inner = np.ones(len(ids) + 1, bool)
        inner[offsets] = False
        keep = np.ones(len(ids), bool)
        keep[1:] = ~(again & inner[1:-1])
        kept = np.concatenate([[0], np.cumsum(keep)])
        return ids[keep], kept[offsets]
    return ids, offsets


def decode(vocabulary: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of texts. The space in front of a text's first piece is taken off."""
    heads = offsets[:-1][np.diff(offsets) > 0]
    lengths = np.diff(vocabulary.surface_at)
    first = np.zeros(len(ids), bool)
    first[heads] = True
    out, sizes = [np.zeros(0, np.uint8)], np.zeros(len(ids) + 1, np.int64)
    for low in range(0, len(ids), CHUNK // 2):
        number = ids[low : low + CHUNK // 2] + first[low : low + CHUNK // 2] * np.int32(len(vocabulary.texts))
        own = lengths[number]
        before = np.concatenate([[0], np.cumsum(own)])
        out.append(vocabulary.surface[np.arange(before[-1]) + np.repeat(vocabulary.surface_at[number] - before[:-1], own)])
        sizes[low + 1 : low + 1 + len(own)] = own
    return np.concatenate(out), np.cumsum(sizes)[offsets]


def encoded(documents: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` and ``n_tokens`` of each row, from its whole text, and ``exact``: do the ids decode to the text?

    A null or empty text has no ids and decodes to the empty text. The model's own space mark in a text decodes to a
    space, as the model can't tell them apart; such texts are exact up to that. Other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        ids, offsets = encode(held.value, texts)
        data, at = decode(held.value, ids, offsets)
        raw = data.tobytes()
        exact = [raw[a:b] == (t or "").replace(chr(SPACE), " ").encode("utf-8", "surrogatepass") for a, b, t in zip(at[:-1].tolist(), at[1:].tolist(), texts)]
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(np.diff(offsets)), pa.array(exact)], ["doc_id", "ids", "n_tokens", "exact"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(docs, run, "doc_id long, ids array<int>, n_tokens long, exact boolean")


def decoded(rows: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids. Null ids are an empty text; bytes that are no UTF-8 become U+FFFD."""
    held = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        sizes = lists.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        data, at = decode(held.value, lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]))
        raw = data.tobytes()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.string())], ["doc_id", "text"])

    return map_arrow(rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")), run, "doc_id long, text string")


def op8_pieces(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document's ids by the public model, and whether they decode to its text."""
    return encoded(table(spark, sf_dir, "documents"), Vocabulary.load(model))
