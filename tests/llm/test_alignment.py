"""Cross-tokenizer alignment against a plain version that goes through every byte."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pytest
import sentencepiece
import tokenizers

from metrum.llm import alignment

SF = "/root/testdata/sf0.001"
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def plain():
    whole = tokenizers.Tokenizer.from_file(alignment.BYTE_BPE)
    whole.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL)
    letters = alignment.byte_letters()

    def tokens(text):
        a = whole.encode(" " + text, add_special_tokens=False).ids
        b = pieces.encode(text)
        a_bytes = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode()
        return (a, a_bytes, b, b_bytes) if b"".join(a_bytes) == want == b"".join(b_bytes) else None

    def run(texts):
        made, corpus = [], Counter()
        for text in texts:
            found = tokens(text) if text else None
            if found is None:
                made.append(None)
                continue
            a, a_bytes, b, b_bytes = found
            owner_a = [k for k, x in enumerate(a_bytes) for _ in x]
            owner_b = [k for k, x in enumerate(b_bytes) for _ in x]
            links = [(a[i], b[j]) for i, j in set(zip(owner_a, owner_b))]
            corpus.update(links)
            ends_a, ends_b = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
            cuts = sorted(set(ends_a) & set(ends_b))
            groups = [([], []) for _ in cuts]
            for side, ids, ends in ((0, a, ends_a), (1, b, ends_b)):
                for i, end in zip(ids, ends):
                    groups[bisect_left(cuts, end)][side].append(str(i))
            shown = ";".join(",".join(x) + "|" + ",".join(y) for x, y in groups)
            made.append((len(a), len(b), len(cuts), links, hashlib.sha256(shown.encode()).hexdigest()))
        top = Counter()
        for (_, b), n in corpus.items():
            top[b] = max(top[b], n)
        none = (0, 0, 0, 0, 0, 0, "")
        rows = [none if m is None else (*m[:3], len(m[3]), sum(corpus[p] == top[p[1]] for p in m[3]), sum(corpus[p] for p in m[3]), m[4]) for m in made]
        return rows, corpus, top

    return run


def test_given_documents(spark, plain):
    """Every document of the smallest table, cut into several slices and batches."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    want, corpus, top = plain([r["text"] for r in rows])
    found = alignment.align(documents.repartition(3), slice_bytes=20_000)
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in found.documents.collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, want)}
    pairs = {(r["a"], r["b"]): (r["count"], r["best"]) for r in found.pairs.collect()}
    assert pairs == {p: (n, n == top[p[1]]) for p, n in corpus.items()}


def test_edges(spark, plain):
    """Nulls, empty, long and odd texts, special tokens' strings, repeated rows, clashing columns, an empty table."""
    draw = random.Random(3)
    letters = "ab Zé\tß\n漢字 😀▁ı'9½٣  ​ẞﬁ .,"
    texts = [
        None, "", " ", "   ", "\n\n", "x", " x", "x ", "<|endoftext|>", "a<|endoftext|>b</s><unk><0x41>", "they'll we've I'M", "word " * 3000, "z" * 50_000, " " * 3000, "\x00\x1f\x85",
        *["".join(draw.choice(letters) for _ in range(draw.randrange(40))) for _ in range(300)],
    ]
    rows = [(i, t, 1, "k", 2, 3, 4) for i, t in enumerate(texts)] + [(8, texts[8], 0, "", 0, 0, 0), (None, "null id", 0, "", 0, 0, 0)]
    schema = "doc_id long, text string, number int, pair string, chunk int, best int, count int"
    want, *_ = plain([r[1] for r in rows])
    found = alignment.align(spark.createDataFrame(rows, schema).repartition(4)).documents
    got = sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in found.collect()), key=repr)
    assert got == sorted(((r[0], *w) for r, w in zip(rows, want)), key=repr)
    nothing = alignment.align(spark.createDataFrame([], schema))
    assert nothing.documents.count() == nothing.pairs.count() == 0
