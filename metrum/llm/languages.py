"""Language ID for multilingual texts: mixtures of language models, fitted by expectation-maximisation.

A language's model is its distribution of hashed byte trigrams over all documents of known language. For a text, EM
finds the proportions of the languages that make its trigrams likeliest; the set of languages is the one of the
greatest likelihood less a penalty for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.tables import table
from metrum.llm.text import map_arrow, prepare, view

BITS = 15
BINS = 1 << BITS
SLICES = 16
SMOOTH = 0.5
ROUNDS = 12
#: What a language more must add to the log likelihood, times the log of the text's trigrams.
PENALTY = 3.0
#: Codes of languages are few; a table of more is refused, as the models are sent to every task (128 KB each).
MOST_LANGUAGES = 512
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
#: A-Z lower, other ASCII than letters a space.
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint32)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all trigrams inside rows, and the offsets of rows among them; trigrams without letters are left out."""
    if len(data) < 3:
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    folded = FOLD[data]
    value = folded[:-2] | folded[1:-1] << np.uint32(8) | folded[2:] << np.uint32(16)
    keep = value != 0x202020
    ends = offsets[1:]
    for back in (1, 2):  # a trigram that starts at a row's last two bytes reaches into the next row
        at = ends - back
        at = at[(at >= 0) & (at < len(keep))]
        keep[at] = False
    bins = (value * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32)
    before = np.concatenate([[0], np.cumsum(keep)])
    return bins[keep], before[np.minimum(offsets, len(keep))]


def learn(documents: DataFrame, lang: str = "lang", text: str = "text") -> tuple[list[str], np.ndarray]:
    """Names of the languages, sorted, and the probabilities of bins by language (bins x languages).

    Counts cover every row with a language: each task sums its rows, and the sums are added by language and slice.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            bins, rows = grams(*view(batch.column(1)))
            own = np.repeat(code, np.diff(rows))
            for k, name in enumerate(names.dictionary.to_pylist()):
                sums[name] = sums.get(name, 0) + np.bincount(bins[own == k], minlength=BINS)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array([part.astype(np.int64).tobytes() for part in np.split(total, SLICES)], pa.binary())],
                ["lang", "slice", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in rows.column("counts"))
        return pa.table([rows.column("lang")[:1], rows.column("slice")[:1], pa.array([total.tobytes()], pa.binary())], ["lang", "slice", "counts"])

    kind = "lang string, slice int, counts binary"
    summed = docs.mapInArrow(count, kind).groupBy("lang", "slice").applyInArrow(add, kind)
    rows = summed.limit(MOST_LANGUAGES * SLICES + 1).collect()
    names = sorted({r["lang"] for r in rows})
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((len(names), SLICES, BINS // SLICES))
    for r in rows:
        counts[names.index(r["lang"]), r["slice"]] = np.frombuffer(r["counts"], np.int64)
    smooth = counts.reshape(len(names), BINS) + SMOOTH
    return names, np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T)


def proportions(chances: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the mixture of some languages: their shares, and the log likelihood."""
    share = np.full(chances.shape[1], 1 / chances.shape[1])
    if len(share) == 1:
        return share, float(counts @ np.log(chances[:, 0]))
    total = counts.sum()
    for _ in range(ROUNDS):
        share = share * ((counts / (chances @ share)) @ chances) / total
    return share, float(counts @ np.log(np.maximum(chances @ share, 1e-300)))


def mixture(model: np.ndarray, bins: np.ndarray) -> tuple[list[int], np.ndarray]:
    """The languages of a text, most first, and their shares."""
    counts = np.bincount(bins, minlength=BINS)
    used = np.flatnonzero(counts)
    counts, chances = counts[used].astype(float), model[used]
    single = counts @ np.log(chances)
    share, _ = proportions(chances, counts)
    order = np.argsort(-share, kind="stable")
    best = int(np.argmax(single))
    chosen, shares, value = [best], np.ones(1), float(single[best])
    cost = PENALTY * np.log(len(bins) + 1)
    for size in range(2, len(order) + 1):
        own = sorted(order[:size].tolist())
        part, likely = proportions(chances[:, own], counts)
        if likely - cost * (size - 1) <= value:
            break
        chosen, shares, value = own, part, likely - cost * (size - 1)
    rank = np.argsort(-shares, kind="stable")
    return [chosen[i] for i in rank], shares[rank]


LANGUAGES = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))


def identify(documents: DataFrame, names: list[str], model: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``languages``, an array of (lang, share), greatest share first, from each row's whole text.

    The array is empty for a null text, one without a letter, or without any model. Other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast((names, model))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, chances = held.value
        bins, rows = grams(*view(batch.column(1)))
        out = []
        for low, high, whole in zip(rows[:-1], rows[1:], batch.column(1).to_pylist()):
            if not own or not LETTER.search(whole or ""):
                out.append([])
            else:
                used = bins[low:high]
                if not len(used):  # one or two bytes: with a space on either side
                    padded = np.frombuffer(f" {whole} ".encode("utf-8", "surrogatepass"), np.uint8)
                    used, _ = grams(padded, np.array([0, len(padded)]))
                languages, shares = mixture(chances, used)
                out.append([{"lang": own[k], "share": float(s)} for k, s in zip(languages, shares)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, LANGUAGES)], ["doc_id", "languages"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(docs, run, "doc_id long, languages array<struct<lang:string,share:double>>")


def op10_languages(spark, sf_dir: str) -> DataFrame:
    """The contract's columns: the models learn from documents outside the held-out fold only."""
    documents = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = identify(documents, *learn(documents.where(~fold)))
    top = F.try_element_at("languages", F.lit(1))
    return found.select(
        "doc_id", F.coalesce(fold, F.lit(False)).alias("held_out"), F.coalesce(top["lang"], F.lit(UNKNOWN)).alias("lang_pred"),
        F.coalesce(F.least(top["share"], F.lit(1.0)), F.lit(0.0)).alias("score"))
