"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import base64
import hashlib
import textwrap
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrum.llm import chat, decontamination, languages, licences, near_dedup, pieces, quality, retrieval, secret_scan, substring_dedup

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
GLUED = "ab" * 300_000
COPY = " ".join(f"copied{i}" for i in range(40))
TEXTS = [
    (1, COPY), (2, COPY), (3, COPY + " end"), (3, COPY + " end"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"),
    (9, LONG), (10, GLUED), (None, COPY), (None, None), (11, 'token = "abcdef1234" é'), (12, "ßäö 漢字 ▁ 😀"),
]
EXTRA = "n_words long, n_hit long, score double, kept boolean, spans string, key string, label int, node string, n_chars long, ids string, rank int, part int"
SCHEMA = f"doc_id long, text string, lang string, source string, {EXTRA}"


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, t, "en" if (i or 0) % 2 else None, None, 1, 2, 3.0, True, "s", "k", 4, "n", len(t) if t else None, "x", 5, 6) for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (9, 1, None), (None, 1, 0), (7, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, COPY), (1, COPY), (2, None), (3, "ONE"), (None, "word1 word2")], "item_id long, text string")


def by_id(df):
    out = {}
    for row in df.collect():
        out.setdefault(row["doc_id"], []).append(row.asDict())
    assert sum(map(len, out.values())) == len(TEXTS)
    return out


def test_decontamination(documents, nothing, benchmark):
    found = by_id(decontamination.contamination(documents, benchmark))
    assert found[1][0]["items"] == ["1"] and found[1][0]["n_hit"] == found[1][0]["n_words"] == 40
    assert found[1][0]["spans"][0].asDict() == {"start": 0, "end": len(COPY)}
    assert [r["n_hit"] for r in found[3]] == [40, 40] and found[3][0]["n_words"] == 41
    assert found[4][0]["n_words"] == found[5][0]["n_words"] == found[6][0]["n_words"] == 0
    assert found[7][0]["items"] == found[8][0]["items"] == ["3"]
    assert found[9][0]["n_words"] == 60_000 and found[9][0]["n_hit"] == 0 and found[10][0]["n_words"] == 1
    assert decontamination.contamination(nothing, benchmark).count() == 0
    assert decontamination.contamination(documents, benchmark.limit(0)).where("n_hit > 0").count() == 0
    kept = decontamination.decontaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 9, 10, 11, 12]


def test_decontamination_in_blocks(documents, benchmark):
    def rows(df):
        return sorted(map(str, df.collect()))

    whole, cut = decontamination.contamination(documents, benchmark), decontamination.contamination(documents, benchmark, block_windows=3)
    assert rows(whole) == rows(cut)
    assert rows(decontamination.decontaminated(documents, benchmark)) == rows(decontamination.decontaminated(documents, benchmark, block_windows=3))


def test_secrets(documents, nothing):
    found = by_id(secret_scan.secrets(documents))
    assert [tuple(s) for s in found[11][0]["spans"]] == [("assign", 0, 19)]
    assert found[4][0]["spans"] == [] and [tuple(s) for s in found[10][0]["spans"]] == [("hex", 0, len(GLUED))]
    assert secret_scan.secrets(nothing).count() == 0
    clean = {r.doc_id: r for r in secret_scan.redacted(documents).where("doc_id > 3").collect()}
    assert clean[11].text == '[SECRET]" é' and clean[11].n_chars == 11 and clean[4].text is None and clean[12].text == TEXTS[-1][1]
    assert secret_scan.redacted(documents).columns == documents.columns


BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----"
CIPHERTEXT = b"".join(hashlib.sha256(bytes([i])).digest() for i in range(20))
LOCKED = BEGIN + "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n" + base64.encodebytes(CIPHERTEXT).decode() + END
KEY = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(b"\x30\x2e\x02\x01\x00\x30\x05\x06\x03\x2b\x65\x70\x04\x22\x04\x20" + CIPHERTEXT[:32]).decode() + "-----END PRIVATE KEY-----"
#: One number of 60,000 bytes in an encrypted key's container.
LARGE = "-----BEGIN ENCRYPTED PRIVATE KEY-----\n" + base64.encodebytes(b"\x04\x82\xea\x60" + CIPHERTEXT[:60] * 1000).decode() + "-----END ENCRYPTED PRIVATE KEY-----"


@pytest.mark.parametrize(
    "text",
    [
        LOCKED, LOCKED.replace("\n", "\r\n"), LOCKED.replace("\n", "\\n"), LOCKED.replace("\n", "\\r\\n"), LOCKED.replace("\n", "\n    "), LOCKED.replace("\n\n", "\n"),
        LOCKED.replace("AES-128-CBC", "DES-EDE3-CFB").replace(base64.encodebytes(CIPHERTEXT).decode(), base64.encodebytes(CIPHERTEXT[:-3]).decode()),
        KEY, KEY.replace("\n", "\r\n"), KEY.replace("\n", "\\n"), KEY.replace("\n", "\\\\n"), KEY.replace("\n", "\nComment: mine\n\n", 1), LARGE,
    ],
)
def test_private_key_blocks(text):
    assert [s for s in secret_scan.find(f"é {text} .") if s[0] == "pem"] == [("pem", 2, 2 + len(text))]
    assert secret_scan.redact(f"{BEGIN} {text}, {END}") == f"{BEGIN} [SECRET], {END}"


def test_blocks_that_are_no_keys():
    for text in (BEGIN + "Proc-Type: 4,ENCRYPTED\n\n" + END, LOCKED.replace("4,ENCRYPTED", "4,MIC-CLEAR"), LOCKED.replace("END RSA", "END DSA"), BEGIN * 20_000 + END, END + KEY[:-30]):
        assert "pem" not in [kind for kind, _, _ in secret_scan.find(text)]


def lines(data, width, gap="\n"):
    text = data if isinstance(data, str) else base64.b64encode(data).decode()
    return gap.join(text[i : i + width] for i in range(0, len(text), width))


DER = base64.b64decode("".join(KEY.splitlines()[1:-1]))
SPLIT = b"a list of settings that is long enough to go on: password=hunter2 and then some more words"
CONTAINER = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4) + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"".join(len(x).to_bytes(4) + x for x in (CIPHERTEXT[:51], CIPHERTEXT[:200]))


@pytest.mark.parametrize(
    "text, kind",
    [
        ("dG9rZW46YWJjZGVm", "encoded"), ("cGFzc3dvcmQ9aHVudGVyMg==", "encoded"), (b"token:abcdef".hex().upper(), "encoded"), (b"password=hunter2".hex().upper(), "encoded"),
        (base64.b64encode("naïve “quotes”: password=hunter2".encode()).decode(), "encoded"),
        (lines(SPLIT, 64), "encoded"), (lines(SPLIT, 76), "encoded"), (lines(SPLIT, 66), "encoded"), (lines(SPLIT, 8), "encoded"), (lines(SPLIT.hex().upper(), 64), "encoded"),
        (lines(SPLIT, 64, "\r\n"), "encoded"), (lines(SPLIT, 64, "\\n"), "encoded"), (lines(SPLIT, 64, " \n    "), "encoded"),
        (lines(DER, 16), "der"), (lines(DER, 40), "der"), (lines(CONTAINER, 64), "ssh"), (lines(CONTAINER, 70), "ssh"), (lines(DER.hex().upper(), 30), "der"),
    ],
)
@pytest.mark.parametrize("before, behind", [("é ", " ."), ("some words\n", "\nWords"), ("key: ", "\n\nwords"), (KEY + "\n", ""), ('"', '"'), ("x" * 64 + "\n", "\nx")])
def test_shortest_and_wrapped_secrets(text, kind, before, behind):
    found = [s for s in secret_scan.find(before + text + behind) if s[0] not in (*secret_scan.BASE, "pem")]
    assert found == [(kind, len(before), len(before) + len(text))]
    assert text[:12] not in secret_scan.redact(before + text + behind)


def test_wrapped_text_that_is_no_secret():
    for text in (lines(b"an ordinary sentence of plain words that goes on for more than one line", 64), "word\n" * 50_000, lines(DER[:-1], 40), lines(CIPHERTEXT, 76), "long" * 20_000 + "\n" * 20_000):
        assert [s for s in secret_scan.find(text) if s[0] not in secret_scan.BASE] == []


def test_wrapped_layers_without_a_secret():
    """Each byte of each layer is read once: time follows the size, not the number of ways to cut the lines."""
    text = "This is an ordinary sentence about beats and bars, without any of those things in it."
    for _ in range(20):
        text = base64.encodebytes(text.encode()).decode()
    start = time.process_time()
    assert secret_scan.find(text) == []
    assert time.process_time() - start < 2
    hidden = "note: password = hunter2secret and nothing else here, only words to make it longer"
    for _ in range(12):
        hidden = base64.encodebytes(hidden.encode()).decode()
    assert [kind for kind, _, _ in secret_scan.find("before " + hidden + " after")] == ["encoded"]


def test_layers_of_any_number():
    for secret in (b"password=hunter2", LOCKED.encode(), DER):
        for n in (1, 2, 3, 4, 9, 20):
            data = secret
            for i in range(n):
                data = base64.b64encode(data) if i % 4 else data.hex().upper().encode() if i % 8 else base64.encodebytes(data).rstrip()
            assert secret_scan.redact(f"a {data.decode()} b") == "a [SECRET] b"


def test_top_k(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0], "x"), (0, [1.0, 0.0], "y"), (1, [0.5, 0.5], "x"), (2, [0.5, 0.5], "x"), (3, None, "x"), (4, [nan, 1.0], "x"), (5, [None, 1.0], "x"), (None, [9.0, 9.0], "x"), (6, [], "x"), (7, [-1.0], "x"), (100, [2.0, 2.0], None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    found = retrieval.top(vectors, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found if r.query_id == 0] == [(0, 1, 100, 2 << 20), (0, 2, 1, 1 << 19), (0, 3, 2, 1 << 19), (0, 4, 6, 0), (0, 5, 7, -(1 << 20))]
    assert retrieval.top(vectors.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert retrieval.top(vectors, F.col("vec_id") == 99).count() == 0
    large = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, -1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in retrieval.top(large, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_substrings(documents, nothing):
    found = by_id(substring_dedup.without_repeats(documents))
    assert found[1][0]["n_removed"] == 0 and found[1][0]["kept"] == COPY
    assert found[2][0]["n_removed"] == 40 and found[2][0]["kept"] == ""
    assert [r["kept"] for r in found[3]] == ["end", "end"]
    assert [r["n_removed"] for r in found[None]] == [0, 0] and COPY in [r["kept"] for r in found[None]]
    assert found[4][0]["n_words"] == 0 and found[9][0]["kept"] == LONG and found[10][0]["n_words"] == 1
    assert substring_dedup.without_repeats(nothing).count() == 0


def test_substrings_between_repeated_rows(spark):
    passage = " ".join(f"shared{i}" for i in range(13))
    rows = [(5, passage), (7, f"own {passage} end"), (5, passage)]
    for order in (rows, [rows[1], rows[0], rows[2]], [(5, f"{passage} x"), *rows, (5, passage)]):
        found = substring_dedup.without_repeats(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert [(r.kept, r.n_removed) for r in found if r.doc_id == 7] == [("own end", 13)]
        assert all(r.n_removed == 0 for r in found if r.doc_id == 5)


def test_quality(documents, nothing, labels):
    net = quality.train(documents, labels)
    found = by_id(quality.scored(documents, net))
    assert all(0 <= r["score"] <= 1 for rows in found.values() for r in rows)
    assert found[4][0]["score"] == found[5][0]["score"]
    assert quality.scored(nothing, quality.train(nothing, labels.limit(0))).count() == 0
    assert quality.accepted(documents, net, cutoff=0.0).columns == documents.columns
    assert quality.accepted(documents, net, cutoff=0.0).count() == len(TEXTS)


def test_near_duplicates(documents, nothing):
    found = by_id(near_dedup.near_duplicates(documents))
    assert {found[i][0]["component_id"] for i in (1, 2, 3)} == {1}
    assert found[7][0]["component_id"] == found[8][0]["component_id"] == 7 and found[7][0]["n_shingles"] == 1
    assert [found[i][0]["component_id"] for i in (4, 5, 6)] == [4, 5, 6] and found[4][0]["n_shingles"] == 0
    assert [r["component_id"] for r in found[None]] == [None, None]
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.deduplicated(documents)
    assert set(kept.columns) == set(documents.columns)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 10, 11, 12]
    twice = near_dedup.deduplicated(documents.where("doc_id = 3"))
    assert twice.count() == 1


def test_near_duplicates_under_one_id(spark):
    """Different texts of one id: only what is linked goes; of rows with one id and text the least stays."""
    other = " ".join(f"unlike{i}" for i in range(30))
    rows = [(1, COPY, "b"), (2, COPY + " x", "a"), (2, other, "c"), (2, other, "b"), (5, COPY + " y", "a"), (5, COPY + " z", "a"), (6, "", "a"), (6, None, "a"), (None, COPY, "a"), (None, COPY, "a")]
    kept = near_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3))
    want = [(1, COPY, "b"), (2, other, "b"), (6, "", "a"), (None, COPY, "a"), (None, COPY, "a")]
    assert sorted(map(tuple, kept.collect()), key=repr) in (sorted(want, key=repr), sorted([*want[:2], (6, None, "a"), *want[3:]], key=repr))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id, r.component_id) for r in found.where("doc_id IS NOT NULL").collect()) == [(1, 1), (2, 1), (2, 2), (2, 2), (5, 1), (5, 1), (6, 6), (6, 6)]


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string, part int, pos int, n_turns int"
    said = [("user", "a"), ("assistant", None), (None, "<|im_end|>")]
    rows = [(conv, turn, *said[turn], 0, 0, 0) for conv, size in ((1, 3), (2, 2), (3, 2), (4, 1), (5, 3)) for turn in range(size)]
    rows += [(6, 0, "user", "a", 0, 0, 0), (6, 0, "user", "a", 0, 0, 0), (None, 0, "user", "b", 0, 0, 0), (7, None, "user", "", 0, 0, 0), (8, 0, "user", None, 0, 0, 0)]
    table = spark.createDataFrame(rows, schema)
    found = {(r.conv_id, r.part): r for r in chat.formatted(table, part_turns=2).collect()}
    assert sorted(found) == [(1, 0), (1, 1), (6, 0), (7, 0), (8, 0)]
    assert found[1, 0].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert found[1, 1].text == "<|im_start|>unknown\n<| im_end|><|im_end|>\n" and found[6, 0].n_turns == 2
    assert chat.formatted(table.limit(0)).count() == 0


def test_long_conversation_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(chat, "TILE_TURNS", 4)
    rows = [(conv, turn, "user", f"t{turn}") for conv, size in ((1, 30), (2, 29), (3, 30), (4, 7)) for turn in range(size)] + [(5, 0, "user", "t0"), (5, 1, "user", "other")]
    found = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_turns=8)
    assert sorted((r.conv_id, r.part, r.n_turns) for r in found.collect()) == [(1, 0, 8), (1, 1, 8), (1, 2, 8), (1, 3, 6), (5, 0, 2)]


def test_pieces(documents, nothing):
    vocabulary = pieces.Vocabulary.load()
    found = pieces.encoded(documents, vocabulary)
    rows = by_id(found)
    assert rows[4][0]["ids"] == rows[5][0]["ids"] == [] and all(r["exact"] for own in rows.values() for r in own)
    back = {r.doc_id: r.text for r in pieces.decoded(found, vocabulary).where("doc_id > 3").collect()}
    assert back[9] == LONG and back[10] == GLUED and back[4] == "" and back[12] == TEXTS[-1][1].replace("▁", " ")
    assert pieces.encoded(nothing, vocabulary).count() == 0
    assert pieces.decoded(documents.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), vocabulary).where("text <> ''").count() == 0


def test_licences(spark):
    notice = "Released under the MIT License."
    rows = [
        ("a/LICENSE", notice, 1), ("a/COPYING", notice, 1), ("a/b/x.md", "text", 1), ("a/b/x.md", "text", 1), ("a/b/own.md", f"x\n{notice}\ny", 1),
        ("c/x.md", None, 1), (None, notice, 1), (None, None, 1), ("top.md", "", 1), ("a/b/c/d.md", "Licence unclear to me and to all the others here", 1), ("a/long.md", LONG, 1),
    ]
    files = spark.createDataFrame(rows, "path string, text string, score int")
    found = licences.licences(files).collect()
    assert len(found) == len(rows)
    got = {r.path: r for r in found}
    assert got["a/b/x.md"].licence == "MIT" and got["a/b/x.md"].inherited_from == "a/COPYING" and got["a/b/x.md"].origin == "inherited"
    assert got["a/b/own.md"].origin == "own" and got["c/x.md"].origin == got["top.md"].origin == "none"
    assert got["a/b/c/d.md"].origin == got["a/long.md"].origin == "inherited"
    assert licences.licences(files.limit(0)).count() == 0


def test_notices_without_cue_words(spark):
    notices = [(name, text) for name, texts in licences.TEMPLATES.items() for text in texts]
    rows = [(f"{i}/x.py", f"import os\n\n# {text}\n\nprint(os.name)\n") for i, (_, text) in enumerate(notices)]
    rows += [("own/LICENSE", "Released under the MIT License."), ("own/a.c", "int a;\n/* Proprietary and confidential. Unauthorized copying of this file is strictly prohibited. */\n"), ("own/b.c", "int b;\n")]
    got = {r.path: r for r in licences.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert [(got[f"{i}/x.py"].licence, got[f"{i}/x.py"].origin) for i in range(len(notices))] == [(name, "own") for name, _ in notices]
    assert (got["own/a.c"].licence, got["own/a.c"].origin) == ("Proprietary", "own") and (got["own/b.c"].licence, got["own/b.c"].origin) == ("MIT", "inherited")


BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above notice, this list of conditions and the following disclaimer."""
BSD3 = BSD2 + """ 2. Neither the name of the Example Organization nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED AS IS."""
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify and merge it."""
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that this notice appears in all copies."


def test_licences_of_roots(spark):
    """Licence files in the root of relative and of absolute paths, and nearer ones below."""
    mit, isc = "Released under the MIT License", "Released under the ISC License"
    rows = [("LICENSE", mit), ("b.c", "x"), ("src/a.c", "x"), ("src/deep/er/c.c", "x"), ("lib/COPYING", isc), ("lib/d.c", "x"), ("lib/e/f.c", "x"), ("/LICENSE", isc), ("/g.c", "x"), ("/h/i.c", "x"), (None, "x"), ("", "x")]
    got = {r.path: (r.licence, r.inherited_from) for r in licences.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert all(got[p] == ("MIT", "LICENSE") for p in ("b.c", "src/a.c", "src/deep/er/c.c", ""))
    assert all(got[p] == ("ISC", "lib/COPYING") for p in ("lib/d.c", "lib/e/f.c"))
    assert all(got[p] == ("ISC", "/LICENSE") for p in ("/g.c", "/h/i.c")) and got[None] == (None, None)


def test_headers_and_identifiers(spark):
    """Every licence by its identifier line and its standard header, one line or wrapped, behind comment marks."""
    said = [(name, text) for name in licences.TEMPLATES if name != "Proprietary" for text in licences.identifiers(name)]
    said += list(licences.HEADERS.items())
    rows = [(f"{i}/x.c", f"// {text}\nint main() {{ return {i}; }}\n") for i, (_, text) in enumerate(said)]
    rows += [(f"{i}/y.c", "/*\n" + textwrap.indent(textwrap.fill(text, 60), " * ") + "\n */\nint x;\n") for i, (_, text) in enumerate(said)]
    got = {r.path: r.licence for r in licences.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: n for p, n in got.items() if n != said[int(p.split("/")[0])][0]} == {}


def test_wrapped_notices(spark):
    files = [("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3), ("MIT", GRANT), ("ISC", ISC)]
    rows, want = [], {}
    for name, text in files:
        for width in (30, 60, 72, 76, 80, 1000):
            body = textwrap.wrap(text, width)
            forms = {"LICENSE": "\n".join(body), "hash.py": "\n".join(["#!/bin/sh", "#", *(f"# {x}" for x in body), "import os"]), "star.c": "/*\r\n" + "\r\n".join(f" * {x}" for x in body) + "\r\n */\r\nint a;",
                     "rem.bat": "\n".join(f"REM {x}" for x in body), "amid.md": "some words before\n" + "\n".join(body) + "\nand some behind"}
            for file, whole in forms.items():
                rows.append((f"{name}/{width}/{file}", whole))
                want[rows[-1][0]] = (name, "own")
            rows.append((f"{name}/{width}/src/x.c", "int a;"))
            want[rows[-1][0]] = (name, "inherited")
    got = {r.path: (r.licence, r.origin) for r in licences.licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == want


def test_languages(documents, nothing):
    names, model = languages.learn(documents)
    found = by_id(languages.identify(documents, names, model))
    assert names == ["en"] and found[4][0]["languages"] == [] and found[6][0]["languages"] == []
    assert found[7][0]["languages"][0]["lang"] == "en"
    empty = languages.learn(nothing)
    assert all(r["languages"] == [] for own in by_id(languages.identify(documents, *empty)).values() for r in own)
    assert languages.identify(nothing, names, model).count() == 0


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("empty", [False, True])
def test_stages(spark, documents, nothing, labels, benchmark, tmp_path, name, stage, empty):
    own = documents.select("doc_id", "text", "lang", "source", "n_chars", "score")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    found = stage(spark, own.limit(0) if empty else own, str(tmp_path))
    assert (found.count() == 0) == empty
    if name != "pieces":
        assert set(found.columns) == set(own.columns)


def test_item_digest_is_of_sorted_strings(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, "alpha"), (10, "beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = decontamination.op1_decontamination(spark, str(tmp_path)).first()
    assert row.items_sha256 == hashlib.sha256(b"10,9").hexdigest() and row.contaminated


def test_arrow_views_of_slices():
    from metrum.llm.text import view, words

    whole = pa.array(["x y", None, "", "zz é", "q"])
    assert view(whole[1:4])[0].tobytes() == "zz é".encode() and view(whole[1:4])[1].tolist() == [0, 0, 0, 5]
    assert words(whole).rows.tolist() == [0, 2, 2, 2, 4, 5]
