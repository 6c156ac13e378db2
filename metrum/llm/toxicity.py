"""Toxicity behind disguised spelling: restore the text by a noisy channel, then score what was meant.

1.  A character language model (counts of three letters in a row) is gathered from the words of all documents.
2.  A token with signs that stand for letters, repeated letters, or single letters set apart is a lattice: each run of
    one character may mean a letter, a doubled letter, or a break between words, each at a price. Viterbi finds the
    reading of the highest probability under the language model; equal tokens of a batch are read once, and lattices of
    one width advance together in numpy. Other tokens have one path and stay as they are.
3.  Restored words are scored by what they begin with: the classifier holds, for words and their first letters, how
    much likelier they are in toxic texts, less a margin for chance. A text is judged by its two strongest words.

The language model and the classifier hold no more than a bounded number of entries; texts are scored where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import durable, table
from metrum.llm.text import Words, byte_set, map_arrow, row_of, splitmix, view, word_hashes, words_in

#: Signs that are written for letters (fixed values).
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
TOKEN = byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF), *[(ord(s), ord(s)) for s in SIGNS if s.isascii()])
#: Classes of the language model: a break, a-z, and other letters by their number.
CLASSES, OTHERS = 64, 37
#: Signs that also end or open a phrase; at the edge of a token they rather do.
PUNCTUATION = "!|+("
#: Log prices of readings: a sign as a letter or as itself (at the edge of a token, or punctuation there), a doubled letter as one, ...
LEET, LEET_MARK, KEEP, KEEP_EDGE, KEEP_MARK = -2.5, -4.0, -3.0, -2.0, -0.5
TWICE_AS_ONE, MANY_AS_ONE, MANY_AS_TWO, APART = -4.0, -1.0, -1.5, -3.0
#: Single letters in a row that may be one word, and bytes between them.
SINGLES, GAP = 3, 3
#: Characters of one lattice; a longer token is read in parts.
PART = 64
BEGINNINGS = (4, 5, 6)
#: Labelled texts of each class that the classifier is fitted on at most.
SAMPLE_ROWS = 2000
CUTOFF = 0.7
MARGIN = 1.5
KNOWN = 0x20000
ABSENT = np.float32(-1e30)


@cache
def characters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its lower case, its class (0: no letter), and the number of readings as letters."""
    lower, kind, readings = np.arange(KNOWN, dtype=np.uint32), np.zeros(KNOWN, np.int16), np.zeros(KNOWN, np.int8)
    for c in range(KNOWN):
        letter = chr(c)
        if letter.isalpha():
            small = letter.lower()
            lower[c] = ord(small) if len(small) == 1 else c
            kind[c] = lower[c] - 96 if 97 <= lower[c] <= 122 else 27 + int(lower[c]) % OTHERS
    for sign, letters in SIGNS.items():
        readings[ord(sign)] = len(letters)
    return lower, kind, readings


@cache
def written() -> np.ndarray:
    """Letters that each sign may mean, 0 for none."""
    out = np.zeros((KNOWN, 2), np.uint32)
    for sign, letters in SIGNS.items():
        out[ord(sign), : len(letters)] = [ord(x) for x in letters]
    return out


def classes(points: np.ndarray) -> np.ndarray:
    """Class of lower-case code points; beyond the table all are letters of one class."""
    kind = characters()[1]
    return np.where(points < KNOWN, kind[np.minimum(points, KNOWN - 1)], CLASSES - 1)


def sound(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with bytes that are no UTF-8 replaced."""
    raw = data.tobytes()
    try:
        raw.decode()
        return data, offsets
    except UnicodeDecodeError:
        rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


@dataclass
class Tokens:
    """Distinct tokens of a batch: code points ``points[first[i]:first[i + 1]]``; ``apart`` if it is single letters in a row."""

    points: np.ndarray
    first: np.ndarray
    apart: np.ndarray
    counts: np.ndarray
    #: For each occurrence its row, its token and its bytes.
    row: np.ndarray
    token: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Tokens of all rows; a run of single letters counts as one token."""
    found = words_in(data, offsets, TOKEN)
    row, starts, ends = row_of(found.rows), found.starts, found.ends
    single = (ends - starts == 1) | (ends - starts == 2) & (data[starts] >= 0xC0) if len(starts) else np.zeros(0, bool)
    follows = np.zeros(len(starts), bool)
    if len(starts) > 1:
        follows[1:] = single[1:] & single[:-1] & (row[1:] == row[:-1]) & (starts[1:] - ends[:-1] <= GAP)
    heads = np.flatnonzero(~follows)
    sizes = np.diff(np.append(heads, len(starts)))
    long = sizes >= SINGLES
    # Runs that are long enough become one token, others stay single.
    member = np.repeat(long, sizes)
    keep = ~member | ~follows
    last = heads + sizes - 1
    ends = ends.copy()
    ends[heads[long]] = ends[last[long]]
    row, starts, ends, apart = row[keep], starts[keep], ends[keep], member[keep]
    hashes = word_hashes(Words(data, starts, ends, found.rows), lower=True)
    hashes[apart] ^= np.uint64(0x9E3779B97F4A7C15)
    _, where, token, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    size = ends[where] - starts[where]
    bounds = np.concatenate([[0], np.cumsum(size)])
    own = data[np.arange(bounds[-1]) + np.repeat(starts[where] - bounds[:-1], size)]
    points = np.frombuffer(own.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])[bounds]
    lower = characters()[0]
    points = np.where(points < KNOWN, lower[np.minimum(points, KNOWN - 1)], points)
    return Tokens(points, first, apart[where], counts, row, token.reshape(-1), starts, ends)


def language_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often three classes follow each other in the words of these rows that are made of letters only."""
    found = tokens_of(*sound(data, offsets))
    kind = classes(found.points)
    owner = np.repeat(np.arange(len(found.counts)), np.diff(found.first))
    plain = (np.bincount(owner, kind == 0, len(found.counts)) == 0) & ~found.apart
    pick = plain[owner]
    kind, owner = kind[pick].astype(np.int64), owner[pick]
    if not len(kind):
        return np.zeros(CLASSES**3, np.int64)
    sizes = np.bincount(owner, minlength=len(plain))[plain]
    # Two breaks before each word, one behind it.
    starts = np.concatenate([[0], np.cumsum(sizes + 3)])
    line = np.zeros(starts[-1], np.int64)
    line[np.arange(len(kind)) + np.repeat(starts[:-1] + 2 - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)] = kind
    weight = np.repeat(found.counts[plain], sizes + 3)
    valid = np.ones(len(line), bool)
    valid[starts[:-1]] = valid[starts[:-1] + 1] = False
    at = np.flatnonzero(valid)
    return np.bincount((line[at - 2] * CLASSES + line[at - 1]) * CLASSES + line[at], weight[at], CLASSES**3).astype(np.int64)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a class after two others, smoothed by shorter contexts; a break after a break is free."""
    three = counts.reshape(CLASSES, CLASSES, CLASSES).astype(np.float64)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + CLASSES)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
    out = np.log(p3).astype(np.float32)
    out[0, 0, 0] = 0
    return out


@dataclass
class Lattices:
    """Readings of each unit (a run of one character): letter, how often, and whether a break comes first; and its price."""

    letter: np.ndarray
    copies: np.ndarray
    broken: np.ndarray
    price: np.ndarray

    def take(self, rows: np.ndarray, width: int) -> Lattices:
        return Lattices(self.letter[rows, :width], self.copies[rows, :width], self.broken[rows, :width], self.price[rows, :width])


def lattices(point: np.ndarray, count: np.ndarray, edge: np.ndarray, joint: np.ndarray) -> Lattices:
    """All readings of units. ``edge``: no letter on one side; ``joint``: stood apart from the unit before."""
    n = len(point)
    letter, copies = np.zeros((n, 10), np.uint32), np.ones((n, 10), np.int8)
    broken, price = np.zeros((n, 10), bool), np.full((n, 10), ABSENT)
    is_letter, many = classes(point) > 0, count > 1
    mark = edge & np.isin(point, [ord(x) for x in PUNCTUATION])
    letter[:, 0] = np.where(is_letter, point, 0)
    price[:, 0] = np.where(is_letter, np.where(~many, 0, np.where(count == 2, TWICE_AS_ONE, MANY_AS_ONE)), np.where(mark, KEEP_MARK, np.where(edge, KEEP_EDGE, KEEP)))
    letter[:, 1], copies[:, 1] = letter[:, 0], 2
    price[:, 1] = np.where(is_letter & many, np.where(count == 2, 0, MANY_AS_TWO), ABSENT)
    means = np.where((point < KNOWN)[:, None], written()[np.minimum(point, KNOWN - 1)], 0)
    base = np.where(mark, LEET_MARK, LEET)
    no_sign = means.sum(axis=1) == 0
    price[:, 0] = np.where(~is_letter & no_sign, 0, price[:, 0])
    # A sign's readings: as one letter or two, for each of the letters it may mean.
    for k, at in ((0, 1), (1, 3)):
        has = means[:, k] > 0
        for twice, place in ((0, at), (1, at + 1)):
            some = has & (many if twice else True)
            letter[some, place], copies[some, place] = means[some, k], 1 + twice
            price[some, place] = base[some] + (np.where(count[some] == 2, -0.5, MANY_AS_TWO) if twice else np.where(many[some], MANY_AS_ONE, 0))
    # The second half: the same with a break before it.
    letter[:, 5:], copies[:, 5:], broken[:, 5:] = letter[:, :5], copies[:, :5], True
    price[:, 5:] = np.where(joint[:, None] & (price[:, :5] > ABSENT), price[:, :5] + APART, ABSENT)
    return Lattices(letter, copies, broken, price)


def readings(model: np.ndarray, units: Lattices, first: np.ndarray) -> np.ndarray:
    """For each unit the reading on the best path of its lattice (units ``first[i]:first[i + 1]``)."""
    chosen = np.zeros(len(units.price), np.int8)
    sizes = np.diff(first)
    width = 10 - (units.price[:, ::-1] > ABSENT).argmax(axis=1)
    widest = np.maximum.reduceat(width, first[:-1]) if len(sizes) else np.zeros(0, int)
    for most in (2, 5, 10):
        rows = np.flatnonzero((widest <= most) & (widest > {2: 0, 5: 2, 10: 5}[most]))
        rows = rows[np.argsort(-sizes[rows], kind="stable")]
        step = max(1, (1 << 20) // most**3)
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            _solve(model, units, first[part], sizes[part], most, chosen)
    return chosen


def _solve(model: np.ndarray, units: Lattices, first: np.ndarray, sizes: np.ndarray, width: int, chosen: np.ndarray) -> None:
    """Second-order Viterbi over lattices sorted by falling size. A state is the reading of a unit and of the one before."""
    n = len(first)
    score = np.full((n, width, width), ABSENT, np.float32)
    score[:, 0, 0] = 0
    # Class of the last letter, and the class before it where a reading settles both.
    last, before, settled = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64), np.ones((n, width), bool)
    prior = np.zeros((n, width), np.int64)
    back = []
    for i in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -i, "left"))
        at = units.take(first[:live] + i, width)
        kind = classes(at.letter).astype(np.int64)
        twice, broken = at.copies == 2, at.broken
        c2 = np.where(broken[:, None, :], 0, last[:live, :, None])
        # Context before a reading r after q after p; a break clears it.
        settle = settled[:live, None, :, None] | broken[:, None, None, :]
        c1 = np.where(broken[:, None, None, :], 0, np.where(settle, before[:live, None, :, None], prior[:live, :, None, None]))
        step = score[:live, :, :, None] + model[c1, c2[:, None], kind[:, None, None, :]]
        # Where a break comes first, it ends the word that stood before it.
        if broken.any():
            own = np.where(settled[:live, None, :], before[:live, None, :], prior[:live, :, None])
            end = model[own, np.broadcast_to(last[:live, None, :], own.shape), 0]
            step = step + np.where(broken[:, None, None, :], end[..., None], 0)
        best = step.argmax(axis=1).astype(np.int8)
        top = np.take_along_axis(step, best[:, None].astype(np.int64), axis=1)[:, 0]
        top += at.price[:, None, :] + np.where(twice[:, None, :], model[c2, np.broadcast_to(kind[:, None, :], c2.shape), kind[:, None, :]], 0)
        back.append(best)
        score[:live] = np.maximum(top, ABSENT)
        prior[:live] = last[:live]
        gap = kind == 0
        settled[:live] = gap | twice | broken
        before[:live] = np.where(gap, 0, np.where(twice, kind, 0))
        last[:live] = kind
    # The word's end.
    own = np.where(settled[:, None, :], before[:, None, :], prior[:, :, None])
    final = (score + model[own, np.broadcast_to(last[:, None, :], own.shape), 0]).reshape(n, -1).argmax(axis=1)
    p, q = final // width, final % width
    for i in range(int(sizes[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sizes, -i, "left"))
        chosen[first[:live] + i] = q[:live]
        p[:live], q[:live] = back[i][np.arange(live), p[:live], q[:live]], p[:live].copy()


def restore(model: np.ndarray, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Restored code points of all tokens, 0 between words, and where each token's begin."""
    points, n = found.points, len(found.counts)
    owner = np.repeat(np.arange(n), np.diff(found.first))
    kind = classes(points)
    signs = characters()[2][np.minimum(points, KNOWN - 1)] * (points < KNOWN)
    # What stands between single letters only parts them.
    filler = found.apart[owner] & (kind == 0) & (signs == 0) & ~((points >= 48) & (points <= 57))
    real = np.flatnonzero(~filler)
    point, own, is_letter = points[real], owner[real], kind[real] > 0
    joint = np.zeros(len(real), bool)
    joint[1:] = found.apart[own[1:]] & (own[1:] == own[:-1])
    head = np.ones(len(real), bool)
    head[1:] = (point[1:] != point[:-1]) | (own[1:] != own[:-1])
    head |= (np.arange(len(real)) - np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])[own]) % PART == 0
    at = np.flatnonzero(head)
    count = np.diff(np.append(at, len(real)))
    point, own, letter, joint = point[at], own[at], is_letter[at], joint[at]
    sides = np.zeros((2, len(at)), bool)
    sides[0, 1:] = letter[:-1] & (own[1:] == own[:-1])
    sides[1, :-1] = letter[1:] & (own[1:] == own[:-1])
    signed = signs[real][at] > 0
    letters = np.bincount(own, letter, n) > 0
    unclear = letters & (found.apart | (np.bincount(own, signed | letter & (count > 1), n) > 0))
    pick = unclear[own]
    out_letter, out_copies, out_break = np.where(letter, point, 0), np.minimum(count, np.where(letter, count, 1)), np.zeros(len(at), bool)
    if pick.any():
        rows = np.flatnonzero(pick)
        units = lattices(point[rows], count[rows], ~(sides[0] & sides[1])[rows], joint[rows])
        # A lattice is a token, or a part of a long one.
        place = at[rows]
        begins = np.ones(len(rows), bool)
        begins[1:] = own[rows][1:] != own[rows][:-1]
        offset = place - np.concatenate([[0], np.cumsum(np.bincount(owner[real], minlength=n))])[own[rows]]
        begins[1:] |= offset[1:] // PART != offset[:-1] // PART
        first = np.append(np.flatnonzero(begins), len(rows))
        took = readings(model, units, first).astype(np.int64)
        index = np.arange(len(rows))
        out_letter[rows], out_copies[rows], out_break[rows] = units.letter[index, took], units.copies[index, took], units.broken[index, took]
    sizes = out_copies + out_break
    ends = np.cumsum(sizes)
    made = np.repeat(out_letter, sizes)
    made[(ends - sizes)[out_break]] = 0
    return made.astype(np.uint32), np.concatenate([[0], ends])[np.searchsorted(own, np.arange(n + 1))]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    return splitmix(np.arange(1, 1 << 16, dtype=np.uint64)), draw.integers(0, 1 << 64, 1 << 12, dtype=np.uint64, endpoint=False) | np.uint64(1)


def features(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token, hash) of each restored word and of its beginnings."""
    inside = points > 0
    before = np.zeros(len(points), bool)
    before[1:] = inside[:-1]
    before[first[:-1][first[:-1] < len(points)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(points), bool)
    after[:-1] = inside[1:]
    cuts = first[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    token = np.searchsorted(first, starts, "right") - 1
    sizes = ends - starts
    letters, places = _letters()
    index = np.zeros(len(points), np.int64)
    index[inside] = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = letters[points % (len(letters) - 1)] * places[index % len(places)] * inside
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    some = sizes > 1
    out = [(token[some], splitmix(sums[ends[some]] - sums[starts[some]] + sizes[some].astype(np.uint64)))]
    for k in BEGINNINGS:
        longer = sizes > k
        out.append((token[longer], splitmix(sums[starts[longer] + k] - sums[starts[longer]] + np.uint64((1000 + k) * 0x9E3779B97F4A7C15 % (1 << 64)))))
    return np.concatenate([t for t, _ in out]), np.concatenate([h for _, h in out])


def weighed(known: np.ndarray, worth: np.ndarray, found: Tokens, model: np.ndarray) -> np.ndarray:
    """(2, rows): the two highest worths among the distinct tokens of each row, 0 where there are fewer."""
    rows = int(found.row[-1]) + 1 if len(found.row) else 0
    out = np.zeros((2, rows))
    if not rows or not len(known):
        return out
    token, hashes = features(*restore(model, found))
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    value = np.zeros(len(found.counts))
    np.maximum.at(value, token, np.where(known[at] == hashes, worth[at], 0))
    some = np.flatnonzero(value[found.token] > 0)
    row, token = found.row[some], found.token[some]
    order = np.lexsort((token, -value[token], row))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
    row, token = row[new], token[new]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    for k in (0, 1):
        out[k, row[rank == k]] = value[token[rank == k]]
    return out


@dataclass
class Model:
    """``language``: the log model; ``known``: sorted hashes with their ``worth``; ``weights``: see :func:`inputs`."""

    language: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    worth: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -4.0]))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        signs = np.zeros((2, len(offsets) - 1))
        found = weighed(self.known, self.worth, tokens_of(*sound(data, offsets)), self.language)
        signs[:, : found.shape[1]] = found
        return 1 / (1 + np.exp(-np.clip(inputs(signs) @ self.weights, -40, 40)))


def language_model(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all documents, added up in each task, then by Spark; at most ``CLASSES ** 3`` sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            total += language_counts(*view(batch.column(0)))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    sums = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES**3, np.int64)
    counts[sums["cell"].to_numpy()] = sums["n"].to_numpy()
    return log_model(counts)


def sample(documents: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(label, half, text) of at most ``rows`` labelled documents a class, by the order of a hash of their id; and how many there are."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    single = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in single.groupBy("label").count().collect()}
    parts = [single.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for k in (0, 1)]
    # At most two times ``rows`` ids.
    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int")
    return durable(docs.join(chosen, "doc_id").select("label", half.alias("half"), "text")), counts


def _marks(model: np.ndarray):
    """(label, half, feature), once for each text."""

    def run(batch: pa.RecordBatch) -> pa.Table:
        found = tokens_of(*sound(*view(batch.column("text"))))
        token, hashes = features(*restore(model, found))
        order = np.argsort(token, kind="stable")
        token, hashes = token[order], hashes[order]
        first = np.searchsorted(token, np.arange(len(found.counts) + 1))
        pairs = np.unique(found.row.astype(np.int64) * len(found.counts) + found.token)
        row, own = pairs // max(1, len(found.counts)), pairs % max(1, len(found.counts))
        sizes = first[own + 1] - first[own]
        place = np.arange(int(sizes.sum())) + np.repeat(first[own] - (np.cumsum(sizes) - sizes), sizes)
        rows = pa.table({"row": np.repeat(row, sizes), "feature": hashes[place].view(np.int64)})
        single = rows.group_by(["row", "feature"], use_threads=False).aggregate([])
        at = single["row"]
        return pa.table([batch.column("label").take(at.combine_chunks()), batch.column("half").take(at.combine_chunks()), single["feature"]], ["label", "half", "feature"])

    return run


def worths(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Log of how much likelier a feature is in toxic texts, with a margin for chance; 0 at least."""
    sure = np.maximum(toxic - MARGIN * np.sqrt(toxic), 1e-9) / max(1, n_toxic)
    return np.maximum(0, np.log(sure / ((other + 1) / max(1, n_other)))).astype(np.float32)


def inputs(signs: np.ndarray) -> np.ndarray:
    """What the last step sees of the two highest worths: both, the square of the first, which alone is proof if it is high, and one."""
    return np.column_stack([signs[0], signs[0] ** 2, signs[1], np.ones(signs.shape[1])])


def fit(signs: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weights of a logistic model, by Newton steps with a small penalty; a word never speaks against toxicity."""
    x, w = inputs(signs), np.array([0.5, 0.0, 0.5, -4.0])
    penalty = np.array([1e-3, 1e-3, 1e-3, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weights * (p - labels)) / weights.sum() + penalty * w
        curve = (x * (weights * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x / weights.sum() + np.diag(penalty + 1e-6)
        w = w - np.clip(np.linalg.solve(curve, gradient), -1, 1)
        w[:3] = np.maximum(w[:3], 0)
    return w


def train(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """The language model of all documents, and a classifier of at most ``rows`` labelled ones of each class.

    Worths of one half of the sample judge the other half, so the last step sees chance at work. An id labelled twice
    is toxic if one label says so. Without labels of both classes no text is toxic.
    """
    language = language_model(documents)
    chosen, counts = sample(documents, labels, rows)
    held = chosen.sparkSession.sparkContext.broadcast(language)  # one megabyte

    def marks(batch: pa.RecordBatch) -> pa.Table:
        return _marks(held.value)(batch)

    sizes = {(r["label"], r["half"]): r["count"] for r in chosen.groupBy("label", "half").count().collect()}
    n = [sum(v for (label, _), v in sizes.items() if label == k) for k in (0, 1)]
    if not all(n):
        return Model(language)
    seen = map_arrow(chosen, marks, "label int, half int, feature long").groupBy("feature").agg(*[F.count_if((F.col("label") == k) & (F.col("half") == h)).alias(f"n{k}{h}") for k in (0, 1) for h in (0, 1)])
    # Only what is likelier in toxic texts is of use; the sample bounds how much that is.
    useful = seen.where((F.col("n10") + F.col("n11")) * n[0] > (F.col("n00") + F.col("n01") + 1) * n[1]).where("n10 + n11 > 1").toArrow()
    known = useful["feature"].to_numpy().view(np.uint64)
    order = np.argsort(known)
    known = known[order]
    t = {(k, h): useful[f"n{k}{h}"].to_numpy()[order].astype(float) for k in (0, 1) for h in (0, 1)}
    halves = [worths(t[1, h], t[0, h], sizes.get((1, h), 0), sizes.get((0, h), 0)) for h in (0, 1)]
    crossed = chosen.sparkSession.sparkContext.broadcast((known, halves))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, both = crossed.value
        found = tokens_of(*sound(*view(batch.column("text"))))
        out = np.zeros((2, 2, batch.num_rows))
        for h in (0, 1):
            one = weighed(keys, both[h], found, held.value)
            out[h, :, : one.shape[1]] = one
        other = 1 - batch.column("half").to_numpy()
        index = np.arange(batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column("label"), pa.array(out[other, 0, index]), pa.array(out[other, 1, index])], ["label", "one", "two"])

    judged = map_arrow(chosen, judge, "label int, one double, two double").toArrow()
    label = judged["label"].to_numpy()
    share = np.array([counts[0] / n[0], counts[1] / n[1]])
    weights = fit(np.stack([judged["one"].to_numpy(), judged["two"].to_numpy()]), label.astype(float), share[label])
    crossed.destroy()
    held.destroy()
    return Model(language, known, worths(t[1, 0] + t[1, 1], t[0, 0] + t[0, 1], n[1], n[0]), weights)


def scored(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``score`` of each row, from its whole text; a null text counts as empty. Other columns are not read."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # a few megabytes, bounded by the sample

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(*view(batch.column(1))))], ["doc_id", "score"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, score double")


def restored(documents: DataFrame, language: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` with disguised words as they were read; a token that was read in another way is lower case."""
    held = documents.sparkSession.sparkContext.broadcast(language)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = sound(*view(batch.column(1)))
        found = tokens_of(data, offsets)
        points, first = restore(held.value, found)
        words = [" ".join("".join(map(chr, points[a:b])).replace("\x00", " ").split()) for a, b in zip(first[:-1], first[1:])]
        own = ["".join(map(chr, found.points[a:b])) for a, b in zip(found.first[:-1], found.first[1:])]
        raw, bounds = data.tobytes(), np.searchsorted(found.row, np.arange(len(offsets)))
        out = []
        for r in range(batch.num_rows):
            parts, at = [], int(offsets[r])
            for k in range(bounds[r], bounds[r + 1]):
                token, low, high = found.token[k], int(found.starts[k]), int(found.ends[k])
                same = words[token] == own[token] or not words[token]
                parts += [raw[at:low], raw[low:high] if same else words[token].encode("utf-8", "surrogatepass")]
                at = high
            out.append(b"".join([*parts, raw[at : int(offsets[r + 1])]]).decode("utf-8", "replace"))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string(), mask=~batch.column(1).is_valid().to_numpy(zero_copy_only=False))], ["doc_id", "text"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(docs, run, "doc_id long, text string")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: labels outside the held-out fold teach, all texts give the language model."""
    documents = table(spark, sf_dir, "documents")
    model = train(documents, table(spark, sf_dir, "labels").where(~held_out()))
    found = scored(documents, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
