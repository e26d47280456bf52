"""Secret scans: patterns find candidates, and their structure confirms them.

Three base patterns (assignments, access ids, hex runs) report what they match. Further
kinds are reported only if a decoder agrees: a signed token's header must be base64url
JSON with an algorithm, a key block's base64 must hold DER whose nested lengths add up,
and bare base64 or hex must decode to such DER. A bare key may be in either alphabet of
base64 or either case of hex, may follow any mark such as =, and may be wrapped over
lines; as DER begins with its length, what follows the key does not matter.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texspark.llm.common import extended, table, text_slices

#: Kinds in the order that breaks ties.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der")

_KEYWORD = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]")
_ASSIGN = re.compile(rf"""(?:{_KEYWORD})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----([A-Za-z0-9+/=\s\\]*)-----END \1-----")
#: A token begins where no other of its characters stands before, but for an escape.
_JWT = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))(?=(eyJ[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+))")
#: DER starts with 0x30, whose base64 starts with M; the length keeps the next letter among A to P. Letters and digits before it belong to another run, but not those of an escape.
_DER = re.compile(r"M[A-P](?:(?<![A-Za-z0-9]..)|(?<=\\[nrt]..))")
_HEX_DER = re.compile(r"30(?<![0-9a-f]..)(?=[\s\\:]*[0-9A-Fa-f])|30(?<=\\[nrt]..)")
#: What a bare key is written in, and what may stand between two lines or bytes of it.
_BASE64_RUN, _BASE64_GAP = re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"(?:\\[nrt]|[\s\\])+")
#: Bytes of a key at most: RSA keys of 16,384 bits take about 9,400.
MAX_KEY = 1 << 14
_HEX_RUN, _HEX_GAP = re.compile(r"[0-9A-Fa-f]+"), re.compile(r"(?:\\[nrt]|[\s\\:])+")


def der_items(data: bytes, at: int, end: int, depth: int = 0) -> list[int] | None:
    """Tags of the values that fill data[at:end] exactly, those nested in them checked too."""
    tags = []
    while at < end:
        if end - at < 2 or depth > 16:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > end:
                return None
            length = int.from_bytes(data[at : at + size], "big")
            at += size
        if at + length > end:
            return None
        if tag & 0x20 and der_items(data, at, at + length, depth + 1) is None:
            return None
        tags.append(tag)
        at += length
    return tags


def is_der_key(data: bytes) -> bool:
    """One sequence of two values or more, with all lengths in accord."""
    if len(data) < 24 or data[:1] != b"\x30" or der_items(data, 0, len(data)) is None:
        return False
    head = 2 + (data[1] & 0x7F if data[1] >= 0x80 else 0)
    tags = der_items(data, head, len(data)) or []
    return len(tags) >= 2 and tags[0] in (0x02, 0x30)


def decoded(text: str) -> bytes | None:
    text = re.sub(r"[\s\\]|\\n", "", text)
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_key_block(label: str, body: str) -> bool:
    if "KEY" not in label:
        return False
    data = decoded(body.replace("\\n", ""))
    return data is not None and (is_der_key(data) or data.startswith(b"openssh-key-v1\0"))


def is_signed_token(text: str) -> bool:
    """The header is JSON with an algorithm, and the claims are JSON too."""
    try:
        head, claims, _ = (base64.urlsafe_b64decode(x + "=" * (-len(x) % 4)) for x in text.split("."))
        parsed = json.loads(head)
        return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str) and isinstance(json.loads(claims), dict)
    except (ValueError, binascii.Error, RecursionError):
        return False


def taken(text: str, at: int, n: int, run: re.Pattern, gap: re.Pattern) -> tuple[str, int] | None:
    """The n characters of a run from `at` on, without gaps, and where they end; None if there are fewer."""
    pieces = []
    while n > 0:
        if m := run.match(text, at, at + n):
            pieces.append(m.group())
            n -= len(m.group())
        elif not pieces or not (m := gap.match(text, at)):
            return None
        at = m.end()
    return "".join(pieces), at


def der_size(head: bytes) -> int | None:
    """Bytes of the sequence that begins with `head`; None if no key of up to MAX_KEY does."""
    wide = head[1] & 0x7F if head[1] >= 0x80 else 0
    if head[0] != 0x30 or wide > 4 or head[1] == 0x80 or head[2 + wide] not in (0x02, 0x30):
        return None
    size = 2 + wide + (int.from_bytes(head[2 : 2 + wide], "big") if wide else head[1])
    return size if size <= MAX_KEY else None


def base64_key_end(text: str, start: int) -> int | None:
    """Where the bare DER key in base64 at `start` ends, its padding too; None if there is none."""
    data = lambda chars: base64.b64decode(chars.replace("-", "+").replace("_", "/") + "=" * (-len(chars) % 4))
    head = taken(text, start, 12, _BASE64_RUN, _BASE64_GAP)
    size = der_size(data(head[0])) if head else None
    if size is None or (chars := -(-size * 4 // 3)) > len(text) - start or not (whole := taken(text, start, chars, _BASE64_RUN, _BASE64_GAP)):
        return None
    if not is_der_key(data(whole[0])[:size]):
        return None
    end = whole[1]
    for _ in range(-chars % 4):
        end += text.startswith("=", end)
    return end


def hex_key_end(text: str, start: int) -> int | None:
    """The same for hex."""
    head = taken(text, start, 18, _HEX_RUN, _HEX_GAP)
    size = der_size(bytes.fromhex(head[0])) if head else None
    if size is None or 2 * size > len(text) - start or not (whole := taken(text, start, 2 * size, _HEX_RUN, _HEX_GAP)):
        return None
    return whole[1] if is_der_key(bytes.fromhex(whole[0])) else None


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text's secrets, in code points, sorted by start and kind."""
    found = []
    lower = text.lower()
    if any(w in lower for w in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    blocks = [m.span() for m in _PEM.finditer(text) if is_key_block(m[1], m[2])] if "-----BEGIN " in text else []
    found += [(a, b, "pem") for a, b in blocks]
    if "eyJ" in text:
        at = 0
        for m in _JWT.finditer(text):
            if m.start() >= at and is_signed_token(m[1]):
                at = m.end(1)
                found.append((m.start(), at, "jwt"))
    at, ended = 0, 0  # ended: blocks that end before the candidate
    keys = [(m.start(), base64_key_end) for m in _DER.finditer(text)] + [(m.start(), hex_key_end) for m in _HEX_DER.finditer(text)]
    for start, key_end in sorted(keys, key=lambda x: x[0]):  # a key holds sequences that look like keys, and a key block holds its key
        while ended < len(blocks) and blocks[ended][1] <= start:
            ended += 1
        if start >= at and not (ended < len(blocks) and blocks[ended][0] <= start) and (end := key_end(text, start)):
            found.append((start, end, "der"))
            at = end
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame) -> DataFrame:
    """Secrets in the whole texts of docs (any columns, text among them).

    Returns docs with spans, an array of (start, end, kind) in code points (end exclusive),
    by start and then by kind. Null and empty texts have none; repeated rows are scanned
    once each; an empty table gives no rows. A column of docs named spans is replaced.
    The time a text takes grows with its length; each text is held whole by a task.
    """
    docs = docs.drop("spans")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for part in text_slices(batch):
                spans = [[{"start": a, "end": b, "kind": k} for a, b, k in spans_of(t or "")] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kind)], [*part.schema.names, "spans"])

    return docs.mapInArrow(find, extended(docs, "spans array<struct<start:bigint,end:bigint,kind:string>>"))


def masked(text: str, spans: list[tuple[int, int, str]], mark: str) -> str:
    """The text with its spans replaced by the mark; overlapping ones by one mark."""
    pieces, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            pieces += [text[at:a], mark]
        at = max(at, b)
    return "".join([*pieces, text[at:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of the texts replaced by the mark; overlapping spans by one mark. Other columns stay."""

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                texts = [masked(t, spans, mark) if t and (spans := spans_of(t)) else t for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in part.schema.names], part.schema.names)

    return docs.mapInArrow(redact, docs.schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and digest of the base kinds, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda *kinds: F.filter("spans", lambda s: s.kind.isin(*kinds))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(joined(of(*KINDS[:3])).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
