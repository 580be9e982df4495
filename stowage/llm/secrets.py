"""Secret scans with structural confirmation.

Plain patterns (assign, access, hex) report as they match. Beyond them, base64 and hex candidates are decoded and reported
only if their bytes parse: a DER private key (every nested length adds up to the end: PKCS#1, PKCS#8 or SEC 1), an OpenSSH key
(magic and length-prefixed fields), or a signed token whose header is a JSON object with "alg" and whose payload is JSON.

Defined cases: null or empty text has no spans; offsets are code points, end exclusive; equal spans of one kind appear once;
repeated rows, also of one doc_id or without one, each get their own row; an empty table gives no rows; scan() reads only doc_id and
text, and mask_secrets() passes all columns on, so none clashes.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, frugal, pieces, text_bytes

#: Fixed patterns of the plain kinds, and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt")
WORDS = ("passw", "secret", "token", "apikey", "api_key")

RUN = 24
_CLASS = np.zeros(256, bool)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z0-9 ]*PRIVATE KEY-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[wy][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")


def base_spans(text: str, long_run: bool = True) -> list[tuple[str, int, int]]:
    """The plain kinds' spans. long_run: whether the text may have RUN characters of the base64 class in a row."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if long_run:
        out += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return out


def _elements(raw: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements (tag, start, end of content) that fill raw[at:end] exactly; else None."""
    out = []
    while at < end:
        if at + 2 > end:
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(raw[at : at + k], "big")
            at += k
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def key_kind(raw: bytes) -> str | None:
    """What private key these bytes are: der, openssh or None."""
    magic = b"openssh-key-v1\0"
    if raw.startswith(magic):
        at, n = len(magic), 0
        while n < 3 and at + 4 <= len(raw):
            at += 4 + int.from_bytes(raw[at : at + 4], "big")
            n += 1
        return "openssh" if n == 3 and at + 4 <= len(raw) else None
    top = _elements(raw, 0, len(raw))
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return None
    own = _elements(raw, top[0][1], top[0][2])
    if not own or own[0][0] != 2 or own[0][2] - own[0][1] != 1:
        return None
    tags, version = [t for t, _, _ in own], raw[own[0][1]]
    if version in (0, 1) and len(own) >= 9 and all(t == 2 for t in tags[:9]):
        return "der"
    if version in (0, 1) and tags[1:3] == [0x30, 4] and (inner := _elements(raw, *own[1][1:])) and inner[0][0] == 6:
        return "der"
    return "der" if version == 1 and tags[1:2] == [4] and all(t in (0xA0, 0xA1) for t in tags[2:]) and len(own) > 1 else None


def _base64(s: str) -> bytes | None:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    if len(s) % 4 == 1:
        return None
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(s: str) -> dict | None:
    try:
        x = json.loads(_base64(s) or b"")
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded structure proves a key or a signed token."""
    out = []
    for m in ARMOUR.finditer(text):
        if (raw := _base64("".join(m[1].split()))) and (kind := key_kind(raw)):
            out.append((kind, *m.span()))
    for m in BASE64.finditer(text):
        if (raw := _base64(m[0])) and (kind := key_kind(raw)):
            out.append((kind, *m.span()))
    for m in HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and (kind := key_kind(bytes.fromhex(m[0]))):
            out.append((kind, *m.span()))
    for m in TOKEN.finditer(text):
        head, body, _ = m[0].split(".")
        if (h := _object(head)) is not None and isinstance(h.get("alg"), str) and (_object(body) is not None or "enc" in h):
            out.append(("jwt", *m.span()))
    return out


def spans_of(text: str, long_run: bool = True) -> tuple[list, list]:
    """(plain spans, all spans), each by start, then kind as in KINDS."""
    order = lambda x: (x[1], KINDS.index(x[0]), x[2])
    base = sorted(base_spans(text, long_run), key=order)
    more = confirmed_spans(text) if long_run or "-----BEGIN" in text or "ey" in text and text.count(".") > 1 and TOKEN.search(text) else []
    return base, sorted({*base, *more}, key=order) if more else base


def long_runs(column: pa.Array) -> np.ndarray:
    """Which texts may have RUN or more characters of the base64 class in a row: all that have, and few others."""
    data, off = text_bytes(column)
    stops = np.flatnonzero(~_CLASS[data])
    edges = np.union1d(np.union1d(stops, off - 1), off[1:])  # documents' ends also end a run, a character early on either side
    long_ = edges[1:][np.diff(edges) >= RUN - 1]
    out = np.zeros(len(off) - 1, bool)
    out[np.clip(np.searchsorted(off, long_ - 1, side="right") - 1, 0, max(0, len(out) - 1))] = bool(len(out))
    return out


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = []
                for text, long_ in zip(part.column(1).to_pylist(), long_runs(part.column(1)), strict=True):
                    base, all_ = spans_of(text or "", bool(long_))
                    kinds = [k for k, _, _ in base]
                    out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(all_)))
                arrays = [pa.array([r[i] for r in out], pa.int64() if i < 3 else pa.string()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, spans: list) -> str:
    """text with each span (overlapping ones as one) replaced by <secret>."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], "<secret>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets masked in text; the same columns (n_chars, if there, follows the text). Null texts stay null."""
    columns = docs.columns
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                col = part.column("text")
                texts = [t if t is None else masked(t, spans_of(t, bool(x))[1]) for t, x in zip(col.to_pylist(), long_runs(col), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, col.type) if c == "text" else part.column(c) for c in columns], columns)

    out = docs.mapInArrow(run, shape)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
