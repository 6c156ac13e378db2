"""Operators against plain versions, the piece model's own library, exact round trips and held-out rows."""

import base64
import json
import random
import struct

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from metrum.llm import chat, decontamination, languages, licences, near_dedup, pieces, quality, retrieval, secret_scan, substring_dedup

SF = "/root/testdata/sf0.01"


def texts_of(sf=SF):
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


# Secrets


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x80 + (len(body).bit_length() + 7) // 8]) + len(body).to_bytes((len(body).bit_length() + 7) // 8)
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


P, Q = (1 << 521) - 1, (1 << 607) - 1
RSA = der(0x30, *map(number, (0, P * Q, 65537, 12345, P, Q, 1, 2, 3)))
PKCS8 = der(0x30, number(0), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(range(32)))))
EC = der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86\x48")))


def field(data):
    return struct.pack(">I", len(data)) + data


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(b"public" * 8) + field(b"private" * 20)


def url64(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


JWT = f"{url64(json.dumps({'alg': 'HS256'}).encode())}.{url64(json.dumps({'sub': '1'}).encode())}.{url64(b'signature!' * 3)}"


@pytest.mark.parametrize(
    "text, kinds",
    [
        (base64.b64encode(RSA).decode(), ["der"]),
        (base64.b64encode(PKCS8).decode(), ["der"]),
        (base64.b64encode(EC).decode(), ["der"]),
        (RSA.hex(), ["der"]),
        (RSA.hex().upper(), ["der"]),
        (base64.b64encode(SSH).decode(), ["ssh"]),
        (JWT, ["jwt"]),
        (base64.b64encode(b'password = "hunter22x"').decode(), ["encoded"]),
        (base64.b64encode(base64.b64encode(b"token: abcdefgh12345")).decode(), ["encoded"]),
        ("-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END RSA PRIVATE KEY-----", ["pem"]),
        ("-----BEGIN OPENSSH PRIVATE KEY-----\n" + base64.encodebytes(SSH).decode() + "-----END OPENSSH PRIVATE KEY-----", ["pem"]),
        (base64.b64encode(RSA[:-1]).decode(), []),  # the outer length does not add up
        (base64.b64encode(RSA.replace(number(P), number(P - 2))).decode(), []),  # p times q is not n
        (base64.b64encode(SSH + b"x").decode(), []),
        (f"{url64(b'{}')}{url64(b'padding!!')}.{url64(b'{}')}.x", []),
        (base64.b64encode(b"an ordinary sentence of plain words").decode(), []),
        (base64.b64encode(bytes(range(120))).decode(), []),
        ("the quick brown fox of considerable lengthwithoutanyspacesinsidethisword", []),
    ],
)
def test_structures(text, kinds):
    found = secret_scan.find(f"é {text} .")
    # What patterns find inside base64 by chance is theirs alone.
    assert [k for k, _, _ in found if k not in secret_scan.BASE] == kinds
    for kind, low, high in found:
        if kind in ("der", "ssh", "jwt", "pem", "encoded"):
            assert f"é {text} ."[low:high] == text


def test_base_patterns():
    text = 'é Api_Key: "abcdef" token=abc secret = aaaaaaa AKIA' + "A" * 16 + " AKIA12 " + "0a" * 12 + " " + "0" * 23
    got = [(k, text[a:b]) for k, a, b in secret_scan.find(text)]
    assert got == [("assign", 'Api_Key: "abcdef'), ("assign", "secret = aaaaaaa"), ("access", "AKIA" + "A" * 16), ("hex", "0a" * 12)]
    assert secret_scan.find("paſſword = abcdefgh to\u212aen = abcdefgh") == []  # letters beyond ASCII are no letters of a name
    assert secret_scan.base_spans("api_key=token:abcdefgh") == []  # the shorter match is taken and fails


# Retrieval


@pytest.mark.parametrize("seed", range(3))
def test_top_k(spark, monkeypatch, seed):
    monkeypatch.setattr(retrieval, "BUCKET_ROWS", 40)
    draw = np.random.default_rng(seed)
    values = draw.normal(0, 1, (400, 8)) * draw.lognormal(0, 1.5, (400, 1))
    values[50:120] = values[50]  # many copies of one vector
    values[200:205] = 0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in retrieval.top(frame, F.col("vec_id") % 20 == 0, group_rows=7).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(1024 * values).astype(np.int64)
    for q in range(0, 400, 20):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:10]
        assert sorted(found[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]


# Substrings


@pytest.mark.parametrize("seed", range(3))
def test_substrings(spark, seed):
    draw, window = random.Random(seed), 5
    passages = [[draw.choice("abcdefgh") + str(draw.randrange(30)) for _ in range(draw.randrange(4, 30))] for _ in range(6)]
    docs = []
    for i in range(60):
        words = [w for _ in range(draw.randrange(0, 5)) for w in (draw.choice(passages) if draw.random() < 0.5 else [draw.choice("xyz") for _ in range(6)])]
        docs.append((draw.randrange(1000) - 500, draw.choice([" ", "\n", "\t \x0b"]).join(words)))
    docs = list(dict(docs).items())
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in substring_dedup.without_repeats(frame, window=window, chunk_bytes=200, bucket_words=64).collect()}
    least = {}
    for i, text in docs:
        words = text.split()
        for p in range(len(words) - window + 1):
            key = tuple(words[p : p + window])
            least[key] = min(least.get(key, i), i)
    for i, text in docs:
        words = text.split()
        gone = {p + k for p in range(len(words) - window + 1) if least[tuple(words[p : p + window])] < i for k in range(window)}
        assert got[i].kept == " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (got[i].n_words, got[i].n_removed) == (len(words), len(gone))
        assert {k for r in got[i].ranges for k in range(r.start, r.end)} == gone


# Near duplicates


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates(spark, monkeypatch, seed):
    """Groups whose members lie around the threshold, in blocks much smaller than the groups."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    draw = random.Random(seed)
    docs = []
    for _ in range(4):
        base = [f"w{draw.randrange(10_000)}" for _ in range(150)]
        for _ in range(60):
            words = list(base)
            for _ in range(draw.randrange(0, 4)):
                words[draw.randrange(150)] = f"n{draw.randrange(10_000)}"
            docs.append((len(docs), " ".join(words).upper() if draw.random() < 0.3 else " ".join(words)))
    docs += [(1000 + i, " ".join("abc"[: i % 4])) for i in range(9)]
    draw.shuffle(docs)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    sets = {}
    for i, text in docs:
        words = text.lower().split()
        sets[i] = {tuple(words[p : p + 5]) for p in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: (len(s), find(i)) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id) for i, r in got.items()}


def test_registers_estimate_similarity():
    draw = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.9):
        guesses = []
        for _ in range(30):
            common, own = int(400 * share), 400 - int(400 * share)
            pool = draw.integers(0, 1 << 63, common + own, dtype=np.uint64)
            cut = common + own // 2
            a, b = pool[:cut], np.concatenate([pool[:common], pool[cut:]])
            x, y = (near_dedup.registers(near_dedup.minima(np.sort(s))) for s in (a, b))
            union = near_dedup.registers(near_dedup.minima(np.sort(pool)))
            assert (union == np.maximum(x, y)).all()  # sketches merge
            equal, above = (x == y).sum(), (x > y).sum()
            sizes = [np.array([float(len(s))]) for s in (a, b)]
            guesses.append(float(near_dedup.estimate(*(np.array([v]) for v in (equal, above, near_dedup.REGISTERS - equal - above)), *sizes)[0]))
        assert abs(np.mean(guesses) - common / len(pool)) < 0.03


# Pieces


def sample_texts():
    draw = random.Random(7)
    letters = list("aetinosr .,\nABéß漢字<>|0x😀▁")
    return [t for _, t, _ in texts_of()[:150]] + ["", " ", "   ", "a" * 700, "日本" * 90, "x" * 97 + " y"] + ["".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(200)]


def test_pieces_are_the_library_s():
    model, vocabulary, texts = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.Vocabulary.load(), sample_texts()
    ids, offsets = pieces.encode(vocabulary, texts)
    expected = model.encode(texts, num_threads=1)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == expected
    data, at = pieces.decode(vocabulary, ids, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])] == [t.replace("▁", " ") for t in texts] == model.decode(expected)


def test_viterbi_finds_the_best_path():
    """The public pieces read as a unigram model: no segmentation is better, by a plain search over all cuts."""
    proto = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL).serialized_model_proto()
    trainer = dict(f for f in pieces.messages(proto) if f[0] == 2)[2]
    assert dict(pieces.messages(trainer))[3] == pieces.BPE and trainer.count(b"\x18\x02") == 1
    model = sentencepiece.SentencePieceProcessor(model_proto=proto.replace(trainer, trainer.replace(b"\x18\x02", b"\x18\x01")))
    vocabulary = pieces.Vocabulary.of(model)
    assert vocabulary.kind == pieces.UNIGRAM
    texts = [w for t in sample_texts()[:40] for w in t.split()[:40]] + ["ab<x>é", "xz"]
    ids, offsets = pieces.encode(vocabulary, texts)
    score = {t: float(vocabulary.scores[i]) for t, i in vocabulary.ids.items()}
    same = 0
    for text, a, b, other in zip(texts, offsets[:-1], offsets[1:], model.encode(texts, num_threads=1)):
        marked = "▁" + text
        best = [0.0] + [float("-inf")] * len(marked)
        for end in range(1, len(marked) + 1):
            best[end] = max(best[start] + score.get(marked[start:end], float("-inf")) for start in range(max(0, end - 16), end))
        own = ids[a:b].tolist()
        assert "".join(vocabulary.texts[i] for i in own) == marked and sum(score[vocabulary.texts[i]] for i in own) == best[-1]
        assert sum(score[vocabulary.texts[i]] for i in other) <= best[-1]
        same += own == other
    assert same > 0.9 * len(texts)
    ids, offsets = pieces.encode(vocabulary, ["漢字x"])
    assert [vocabulary.texts[i] for i in ids] == model.encode("漢字x", out_type=str)


# Chat


def test_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "TILE_TURNS", 3)
    draw = random.Random(2)
    said = {}
    for conv in range(80):
        said[conv] = [(draw.choice("ua"), draw.choice("xy")) for _ in range(draw.randrange(1, 9))]
        if conv % 3 == 0 and conv:
            said[conv] = said[draw.randrange(conv)][: draw.randrange(1, 9)]
    frame = spark.createDataFrame([(c, 10 * t, r, x) for c, turns in said.items() for t, (r, x) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    kept = {c for c, own in said.items() if not any((len(o) > len(own) or len(o) == len(own) and d < c) and o[: len(own)] == own for d, o in said.items() if d != c)}
    got = {}
    for r in chat.formatted(frame, part_turns=4).orderBy("conv_id", "part").collect():
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    assert got == {c: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in said[c]) for c in kept}


# Licences


def test_licences(spark):
    rows = duckdb.sql(f"SELECT doc_id, source, text FROM '{SF}/documents.parquet'").fetchall()
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
    files = [(r.path, r.text) for r in frame.select(licences.document_path().alias("path"), "text").collect()]
    got = {r.path: r for r in licences.op9_licences(spark, SF).collect()}
    assert len(got) == len(files)
    held = {p: licences.candidates(t, p.rsplit("/", 1)[-1].startswith("LICENSE")) for p, t in files}
    every = [c for own in held.values() for c in own]
    words = {w for texts in licences.TEMPLATES.values() for t in texts for w in licences.WORD.findall(t.lower())}
    table = licences.Templates(licences.TEMPLATES, len(every), {w: sum(w in c for c in every) for w in words})

    def cosine(a, b):
        weigh = {w: table.weight.get(w, table.other) for w in {*a, *b}}
        dot = sum(a[w] * b[w] * weigh[w] ** 2 for w in a if w in b)
        return dot / (sum((n * weigh[w]) ** 2 for w, n in a.items()) * sum((n * weigh[w]) ** 2 for w, n in b.items())) ** 0.5

    templates = [(name, licences.Counter(licences.WORD.findall(t.lower()))) for name, texts in licences.TEMPLATES.items() for t in texts]
    own = {}
    for path, found in held.items():
        best = max(((cosine(c, t), name) for c in found for name, t in templates), default=(0, None))
        own[path] = (best[1], round(best[0], 6)) if best[0] >= licences.THRESHOLD else None
        assert (got[path].score is None) == (own[path] is None)
        if own[path]:
            assert got[path].licence == own[path][0] and abs(got[path].score - own[path][1]) < 2e-6
    given = {}
    for path in sorted(own):
        if own[path] and path.rpartition("/")[2].startswith("LICENSE"):
            place = path.rpartition("/")[0]
            if place not in given or own[path][1] > given[place][1]:
                given[place] = (own[path][0], own[path][1])
    for path in own:
        if not own[path]:
            place, found = path, None
            while place and not found:
                place = place.rpartition("/")[0]
                found = given.get(place)
            assert got[path].licence == (found and found[0]) and got[path].origin == ("inherited" if found else "none")


# Held-out rows


def test_languages_of_held_out_documents(spark):
    lang = {i: x for i, _, x in texts_of()}
    held = [r for r in languages.op10_languages(spark, SF).collect() if r.held_out]
    assert len(held) > 150 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97


def test_mixtures_of_languages(spark):
    """Half of one text and half of another: both languages, in about these shares."""
    by = {}
    for _, text, lang in texts_of():
        if len(text) > 1500:
            by.setdefault(lang, []).append(text[:1500])
    names = sorted(by)
    pairs = [(by[a][k] + " " + by[b][k], {a, b}) for a in names for b in names if a < b for k in range(3)]
    own, model = languages.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(pairs)], "doc_id long, text string")
    found = {r.doc_id: r.languages for r in languages.identify(frame, own, model).collect()}
    right = [{x.lang for x in found[i]} == both and min(x.share for x in found[i]) > 0.3 for i, (_, both) in enumerate(pairs)]
    assert np.mean(right) > 0.8


def test_quality_of_held_out_labels(spark):
    marks = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall())
    held = [r for r in quality.op5_quality(spark, SF).collect() if r.held_out and r.doc_id in marks]
    good, bad = ([r.score for r in held if marks[r.doc_id] == q] for q in (1, 0))
    assert np.mean([x > y for x in good for y in bad]) > 0.95
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.88


def test_classifier_gradient():
    """The step that fit() takes follows the numerical gradient: the loss of a tiny sample falls to almost nothing."""
    texts = [b"good plain words here and there", b"BAD!! WORDS!! HERE!!", b"more plain words of the kind", b"SHOUT!! AND!! SHOUT!!"] * 8
    labels = np.array([1, 0, 1, 0] * 8, np.float32)
    net = quality.fit(texts, labels, np.ones(32, np.float32))
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    scores = quality.score(net, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert (scores[labels == 1] > 0.9).all() and (scores[labels == 0] < 0.1).all()
    long = b"word " * 20_000 + b"BAD!! WORDS!! HERE!!"
    assert quality.score(net, np.frombuffer(long, np.uint8), np.array([0, len(long)]))[0] < 0.5  # the end counts too


# The pipeline, stage by stage on what its predecessor kept


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
    start = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    net = quality.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").where(~quality.held_out()))
    scores = {i: quality.score(net, np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())]))[0] for i, r in start.items()}
    assert set(kept[0]) == {i for i, s in scores.items() if s >= quality.CUTOFF}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/quality/*.parquet'")
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{sf}/benchmark.parquet'")
    assert set(kept[1]) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({near_dedup.OP6_SQL}) WHERE kept").fetchall()}
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/near_dedup/*.parquet'")
    assert set(kept[2]) == {r[0] for r in con.execute(f"SELECT doc_id FROM ({decontamination.OP1_SQL}) WHERE NOT contaminated").fetchall()}
    assert {i: secret_scan.redact(r.text) for i, r in kept[2].items()} == {i: r.text for i, r in kept[3].items()}
    assert all(r.n_chars == len(r.text) for r in kept[3].values())
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert {i: r.ids for i, r in kept[4].items()} == {i: model.encode(r.text) for i, r in kept[3].items()} and all(r.exact for r in kept[4].values())
