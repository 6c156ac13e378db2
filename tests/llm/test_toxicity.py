"""Deobfuscation against all readings of a lattice, planted disguises, held-out accuracy, and edge cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrum.llm import toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def language(spark):
    return toxicity.language_model(spark.read.parquet(f"{SF}/documents.parquet"))


def read(language, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    found = toxicity.tokens_of(raw, np.array([0, len(raw)]))
    points, first = toxicity.restore(language, found)
    return ["".join(map(chr, points[first[k] : first[k + 1]])).replace("\x00", " ").strip() for k in found.token]


def best(language, units, rows):
    """Highest log probability over all readings of the units in ``rows``, and one that has it."""
    top, chosen = -1e30, None
    for path in itertools.product(*[[k for k in range(10) if units.price[r, k] > toxicity.ABSENT] for r in rows]):
        score, line = 0.0, [0, 0]
        for r, k in zip(rows, path):
            score += units.price[r, k]
            letters = [int(toxicity.classes(units.letter[r : r + 1, k])[0])] * int(units.copies[r, k])
            for c in ([0] if units.broken[r, k] else []) + letters:
                score += language[line[-2], line[-1], c]
                line = [0, 0] if c == 0 else [line[-1], c]
        score += language[line[-2], line[-1], 0]
        if score > top:
            top, chosen = score, path
    return top, chosen


def test_viterbi_against_all_readings(language):
    draw = random.Random(4)
    for _ in range(40):
        n = draw.randrange(1, 6)
        points = np.array([ord(draw.choice("abst013!$")) for _ in range(n)], np.uint32)
        units = toxicity.lattices(points, np.array([draw.choice([1, 1, 2, 3]) for _ in range(n)]), np.array([draw.random() < 0.4 for _ in range(n)]), np.array([k > 0 and draw.random() < 0.3 for k in range(n)]))
        took = toxicity.readings(language, units, np.array([0, n]))
        want, path = best(language, units, range(n))
        single = toxicity.Lattices(*[np.take_along_axis(v, took[:, None].astype(int), 1) for v in (units.letter, units.copies, units.broken, units.price)])
        padded = toxicity.Lattices(*[np.concatenate([v, np.full((n, 9), f, v.dtype)], 1) for v, f in zip((single.letter, single.copies, single.broken, single.price), (0, 1, False, toxicity.ABSENT))])
        assert best(language, padded, range(n))[0] == pytest.approx(want, abs=1e-3), (points, path, took)


def test_disguises(language):
    assert read(language, "idi0t m0r0n stuuuupid stupppiiid tra$h w0rthle5s path3tic") == ["idiot", "moron", "stupid", "stupid", "trash", "worthless", "pathetic"]
    assert read(language, "s t u p i d, s.c.u.m") [0].replace(" ", "") == "stupidscum"
    assert read(language, "The thing and others, 97.47 A B") == ["the", "thing", "and", "others", "", "", "a", "b"]
    assert read(language, "") == []


def test_counts_of_language_model():
    """Three classes in a row over whole words, against a loop; tokens with signs or digits, as "(ab", don't count."""
    texts = ["Abé ab ab", "", "x1 ab (ab) été", "é" * 300]
    raw = "".join(texts).encode()
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = np.zeros((toxicity.CLASSES,) * 3, int)
    for word in ["abé", "ab", "ab", "ab", "été", "é" * 300]:
        line = [0, 0, *toxicity.classes(np.array([ord(c) for c in word])).tolist(), 0]
        for three in zip(line, line[1:], line[2:]):
            want[three] += 1
    assert (toxicity.language_counts(np.frombuffer(raw, np.uint8), offsets) == want.ravel()).all()


def test_held_out_and_disguised(spark):
    """On the given labels: held-out texts, and the same ones with their words in disguise."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.train(documents, labels.where(~toxicity.held_out()))
    asked = documents.join(labels.where(toxicity.held_out()).where("toxic IS NOT NULL").select("doc_id", "toxic"), "doc_id").where("lang = 'en'")
    got = toxicity.scored(asked, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert sum(r["score"] >= toxicity.CUTOFF for r in got if r["toxic"]) >= 0.8 * sum(r["toxic"] for r in got)
    assert not any(r["score"] >= toxicity.CUTOFF for r in got if not r["toxic"])
    disguised = asked.where("toxic = 1").withColumn("text", F.regexp_replace(F.regexp_replace("text", "idiot", "1d10t"), "moron", "m0roooon"))
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(disguised, model).collect()}
    kept = [again[r["doc_id"]] >= toxicity.CUTOFF for r in got if r["toxic"] and r["score"] >= toxicity.CUTOFF]
    assert sum(kept) >= 0.9 * len(kept)
    shown = {r["doc_id"]: r["text"] for r in toxicity.restored(disguised, model.language).collect()}
    assert any("moron" in t for t in shown.values()) and not any("m0roooon" in t for t in shown.values())


def test_worths_and_weights():
    """The margin for chance, and a logistic fit that separates."""
    worth = toxicity.worths(np.array([0.0, 1, 5, 400]), np.array([0.0, 0, 50, 0]), 1000, 1000)
    assert worth[0] == worth[1] == worth[2] == 0 and worth[3] > 5
    signs = np.array([[0, 0.5, 1, 5, 6, 5], [0, 0, 0.5, 0, 5, 4.0]])
    w = toxicity.fit(signs, np.array([0, 0, 0, 1, 1, 1.0]), np.ones(6))
    p = 1 / (1 + np.exp(-toxicity.inputs(signs) @ w))
    assert (p[:3] < 0.3).all() and (p[3:] > 0.7).all() and (w[:3] >= 0).all()


def test_edges(spark):
    """Nulls, empty and very long texts, ids that repeat, clashing columns, no labels, no rows."""
    schema = "doc_id long, text string, score double, label int, half int, feature long, row int, n long"
    texts = [(1, "you idiot"), (1, "fine"), (2, None), (3, ""), (4, "z" * 300_000), (5, "word1 " * 60_000), (None, "you idiot"), (None, None), (6, "\n \t"), (7, "漢字 😀 ﬁ ẞ 1 2 3 a b c")]
    documents = spark.createDataFrame([(*t, 0.0, 1, 2, 3, 4, 5) for t in texts], schema).repartition(3)
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (4, 0), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    model = toxicity.train(documents, labels)
    got = toxicity.scored(documents, model).collect()
    assert sorted((r["doc_id"] for r in got), key=str) == sorted((t[0] for t in texts), key=str)
    assert all(0 <= r["score"] <= 1 for r in got)
    none = toxicity.train(documents, labels.limit(0))
    assert all(r["score"] < toxicity.CUTOFF for r in toxicity.scored(documents, none).collect())
    nothing = spark.createDataFrame([], schema)
    assert toxicity.scored(nothing, toxicity.train(nothing, labels)).count() == 0
    shown = {r["doc_id"]: r["text"] for r in toxicity.restored(documents.where("doc_id > 1"), none.language).collect()}
    assert shown[2] is None and shown[3] == "" and shown[6] == "\n \t"
