"""Secret scans: patterns first, then structural confirmation of what base64 and hex candidates decode to.

``assign``, ``access`` and ``hex`` are plain patterns and always reported. A further span is reported only once its
decoded bytes prove to be a secret, base64 and hex also where they are wrapped over several lines:

``pem``      a private-key block whose body is a key by one of the two parsers below, or is encrypted as its header says
``ssh``      binary with the OpenSSH magic whose length-prefixed fields add up to the whole
``der``      ASN.1 whose nested lengths add up to the whole and whose fields are those of a PKCS#1, PKCS#8 or EC key
``jwt``      a signed token: the header is a JSON object with ``alg``, the payload a JSON object
``encoded``  printable UTF-8 that itself holds an assignment, an access key or a signed token
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import struct
from bisect import bisect

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrum.llm.decontamination import merge
from metrum.llm.tables import table
from metrum.llm.text import map_arrow

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "ssh", "der", "jwt", "encoded")
RANK = {kind: i for i, kind in enumerate(KINDS)}
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run of at least 24, as the runs of any length do not overlap
PEM = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)PRIVATE KEY-----")
ESCAPED = re.compile(r"(?:\\+r)?\\+n|\\+(?=/)")  # a line break or slash as JSON may write it
# The shortest secret of the base patterns has 12 bytes: 16 characters of base64, 24 of hex.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
HEX_CANDIDATE = re.compile(r"[0-9a-fA-F]{24,}")
BREAK = re.compile(r"[ \t]*+(?:\r\n?|\n|\\++r\\++n|\\++n)[ \t]*+")
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:{BREAK.pattern}[A-Za-z0-9+/_-]++)++={{0,2}}")
CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
OPENSSH = b"openssh-key-v1\x00"
MARK = "[SECRET]"
PLAIN_TEXT = ""


def decode(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, padded or not; None if it is none."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """The (tag, content) of consecutive ASN.1 values that fill ``data`` exactly; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size = int.from_bytes(data[at : at + more])
            if size < 0x80 or more > 1 and size < 1 << 8 * (more - 1):
                return None  # DER lengths are minimal
            at += more
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def is_der_key(data: bytes) -> bool:
    """A PKCS#1 RSA key, a PKCS#8 key or an EC key, in nested lengths that all add up."""
    outer = fields(data) if data[:1] == b"\x30" else None
    inner = fields(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or inner[0][0] != INTEGER or len(inner[0][1]) != 1:
        return False
    version, tags = inner[0][1][0], [tag for tag, _ in inner]
    if version in (0, 1) and tags[:9] == [INTEGER] * 9:
        numbers = [int.from_bytes(value) for _, value in inner[1:9]]
        return numbers[0].bit_length() >= 256 and numbers[1] % 2 == 1 and numbers[3] * numbers[4] == numbers[0]
    if version in (0, 1) and tags[1:3] == [SEQUENCE, OCTETS]:
        algorithm = fields(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == OBJECT and len(inner[2][1]) >= 16
    return version == 1 and tags[1:2] == [OCTETS] and len(inner[1][1]) >= 20 and all(tag in (0xA0, 0xA1) for tag in tags[2:])


def is_ssh_key(data: bytes) -> bool:
    """OpenSSH's container: cipher, kdf, options, a count, that many public keys, the private part, nothing more."""
    if not data.startswith(OPENSSH):
        return False
    at = len(OPENSSH)

    def take() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        (size,) = struct.unpack_from(">I", data, at)
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    if any(take() is None for _ in range(3)) or at + 4 > len(data):
        return False
    (count,) = struct.unpack_from(">I", data, at)
    at += 4
    return 1 <= count <= 64 and all(take() is not None for _ in range(count)) and take() is not None and at == len(data)


def is_signed(header: str, payload: str) -> bool:
    def loaded(part: str) -> object:
        data = decode(part)
        try:
            return json.loads(data) if data else None
        except (ValueError, RecursionError):
            return None

    head = loaded(header)
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(loaded(payload), dict)


def pem_blocks(text: str) -> list[tuple[str, int, int, int, int]]:
    """Label, start, start and end of the body, and end of every BEGIN marker whose next marker is its END."""
    marks = list(PEM.finditer(text)) if "PRIVATE KEY-----" in text else []
    return [(a[2], a.start(), a.end(), b.start(), b.end()) for a, b in zip(marks, marks[1:]) if a[1] == "BEGIN" and b[1] == "END" and a[2] == b[2]]


def is_pem_key(label: str, body: str) -> bool:
    """The body of a block, after RFC 1421 headers if it has any, is a private key or encrypted as label or headers say."""
    lines = [line.strip() for line in ESCAPED.sub(lambda m: "\n" if m[0].endswith("n") else "", body).strip().splitlines()]
    cut = 0
    if lines and ":" in lines[0]:  # headers end at the first empty line, or else with the last that has a colon
        cut = lines.index("") if "" in lines else max(i for i, line in enumerate(lines) if ":" in line) + 1
    heads = {name.strip().lower(): "".join(value.split()).upper() for name, _, value in (line.partition(":") for line in lines[:cut])}
    data = decode("".join("".join(lines[cut:]).split()))
    if not data:
        return False
    if heads.get("proc-type") == "4,ENCRYPTED":
        cipher = heads.get("dek-info", "").partition(",")[0]
        return len(data) % 8 == 0 or bool(cipher) and not cipher.endswith(("CBC", "ECB"))  # only those fill whole blocks
    return is_der_key(data) or is_ssh_key(data) or label == "ENCRYPTED " and bool(fields(data))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain patterns, leftmost and not overlapping within a kind."""
    found = []
    lower = text.encode("utf-8", "surrogatepass").lower()
    if any(name in lower for name in NAMES):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def inside(at: int, blocks: list[tuple[int, int]]) -> bool:
    """Whether a place is in one of the blocks, which are in order and disjoint."""
    n = bisect(blocks, at, key=lambda block: block[0])
    return n > 0 and at < blocks[n - 1][1]


def wraps(sizes: list[int]) -> list[tuple[int, int]]:
    """Ranges of lines that may be one wrapped text: all, or lines of one width, with a shorter one behind and one before
    or not. A first or last of the same width may be a word of the text around. Of the same lines longest first."""
    ranges, at = [(0, len(sizes))], 0
    while at < len(sizes):
        stop = at + 1
        while stop < len(sizes) and sizes[stop] == sizes[at]:
            stop += 1
        tail = stop + (stop < len(sizes) and sizes[stop] < sizes[at])
        ranges += [(low, high) for high in (tail, stop, stop - 1) for low in (max(0, at - 1), at, at + 1) if high - low > 1]
        at = stop
    return list(dict.fromkeys(ranges))


def wrapped_spans(text: str, blocks: list[tuple[int, int]]) -> tuple[list[tuple[str, int, int]], list[tuple[int, int]]]:
    """Secrets in base64 or hex that go on over several lines, outside the blocks; in order, disjoint. And what was read
    as text without one."""
    found, plain = [], []
    for run in WRAPPED.finditer(text):
        lines, at = [], run.start()
        for gap in BREAK.finditer(text, *run.span()):
            lines.append((at, gap.start()))
            at = gap.end()
        lines.append((at, run.end()))
        lines = [line for line in lines if not inside(line[0], blocks)]
        done, read = 0, []
        for low, high in wraps([b - a for a, b in lines]):
            # What was read as text within a longer range is not read again: else each layer would be read several times.
            if low < done or any(a <= low and high <= b for a, b in read):
                continue
            whole = "".join(text[a:b] for a, b in lines[low:high])
            if len(whole) < 16:
                continue
            kind = _decoded(decode(whole))
            if not kind and len(whole) % 2 == 0 and HEX_CANDIDATE.fullmatch(whole):
                kind = _decoded(bytes.fromhex(whole)) or kind
            if kind:
                found.append((kind, lines[low][0], lines[high - 1][1]))
                done = high
            elif kind == PLAIN_TEXT:
                read.append((low, high))
        plain += [(lines[low][0], lines[high - 1][1]) for low, high in read]
    return found, plain


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure is that of a secret."""
    found: list[tuple[str, int, int]] = []
    blocks = [(start, end) for label, start, low, high, end in pem_blocks(text) if is_pem_key(label, text[low:high])]
    found += [("pem", *span) for span in blocks]
    if "." in text:
        found += [("jwt", *m.span()) for m in TOKEN.finditer(text) if is_signed(m[1], m[2])]
    joined, plain = wrapped_spans(text, blocks)
    found += joined
    wrapped = [(low, high) for _, low, high in joined]
    blocks, plain = sorted(blocks + wrapped), disjoint(plain)
    for m in CANDIDATE.finditer(text):
        if not inside(m.start(), blocks) and not inside(m.start(), plain):
            kind = _decoded(decode(m[0]))
            if kind:
                found.append((kind, *m.span()))
    for m in HEX_CANDIDATE.finditer(text):
        if not inside(m.start(), wrapped):
            kind = _decoded(bytes.fromhex(m[0])) if (m.end() - m.start()) % 2 == 0 else None
            if kind and (kind, *m.span()) not in found:
                found.append((kind, *m.span()))
    return found


def _decoded(data: bytes | None) -> str | None:
    """What bytes are, if a secret; ``PLAIN_TEXT`` (false, too) if they are text without one.

    Text is scanned as any other: each layer is shorter than the one around it, so that ends.
    """
    if not data:
        return None
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    if len(data) >= 12:
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return None
        if CONTROL.search(text):
            return None
        if any(kind != "hex" for kind, _, _ in base_spans(text)) or confirmed_spans(text):
            return "encoded"
        return PLAIN_TEXT
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text in code points, by start, then kind."""
    text = text or ""
    return sorted([*base_spans(text), *confirmed_spans(text)], key=lambda s: (s[1], RANK[s[0]], s[2]))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secrets(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (kind, start, end) in code points, end exclusive.

    A null text counts as empty and has no spans. Repeated rows give repeated results; other columns are not read.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[dict(zip(("kind", "start", "end"), span)) for span in find(whole)] for whole in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, SPANS)], ["doc_id", "spans"])

    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(docs, scan, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(text: str | None, mark: str = MARK) -> str | None:
    """The text with every stretch of found spans replaced by one mark."""
    if not text:
        return text
    out, at = [], 0
    for low, high in merge([(low, high) for _, low, high in find(text)]):
        out += [text[at:low], mark]
        at = high
    return "".join([*out, text[at:]])


def redacted(documents: DataFrame, text: str = "text", length: str | None = "n_chars", mark: str = MARK) -> DataFrame:
    """All rows and columns, secrets replaced by ``mark``; ``length`` names a column that counts the text's characters."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = batch.column(text).to_pylist()
        clean = [redact(whole, mark) for whole in own]
        columns = dict(zip(batch.schema.names, batch.columns))
        columns[text] = pa.array(clean, batch.schema.field(text).type)
        if length in columns:
            counts = [old if before == after else len(after) for before, after, old in zip(own, clean, columns[length].to_pylist())]
            columns[length] = pa.array(counts, batch.schema.field(length).type)
        return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return map_arrow(documents, run, documents.schema)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`secrets`."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    found = secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *map(count, BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
