"""Byte-level BPE by a sentencepiece model that is written straight from a rank vocabulary.

Each vocabulary entry becomes a piece whose characters stand for its bytes (one printable character a byte), scored by its
negative rank; the normaliser is the identity, without a dummy prefix and without changes to white space. sentencepiece then
merges the best-scored neighbouring pair first, leftmost on ties, which is the rank merge. Text is cut into pre-tokens by the
vocabulary's pattern, each is encoded alone, and equal ones are encoded once (a bounded memory). An entry that its own
merges don't reach is looked up whole, as rank encoders do. Decoding maps ids to bytes.

Defined cases: null or empty text has no ids; ids are those of the whole text at any length; undecodable ids don't occur;
repeated rows each get their own row, an empty table gives none; only doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import struct
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame

from .shared import documents, frugal, held, text_bytes

#: Chunks of text that a worker remembers at most.
CACHE = 400_000


@functools.cache
def byte_chars() -> list[str]:
    """A character for each byte: itself where that is printable and not a space, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def _field(number: int, kind: int, value) -> bytes:
    """One protocol-buffer field: kind 0 varint, 2 bytes, 5 float."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 0x7F:
            out.append(n & 0x7F | 0x80)
            n >>= 7
        return bytes([*out, n])

    head = varint(number << 3 | kind)
    if kind == 0:
        return head + varint(value)
    return head + (struct.pack("<f", value) if kind == 5 else varint(len(value)) + value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of these ranks; id = rank, and one more id, the unknown piece, that no input reaches."""
    size = max(ranks.values()) + 1
    by_rank: list[bytes | None] = [None] * size
    for token, rank in ranks.items():
        by_rank[rank] = token
    chars = byte_chars()
    out = []
    for rank, token in enumerate(by_rank):
        name = "".join(chars[b] for b in token) if token is not None else f"▀{rank}"
        out.append(_field(1, 2, _field(1, 2, name.encode()) + _field(2, 5, -float(rank)) + (b"" if token is not None else _field(3, 0, 5))))  # 5: unused
    out.append(_field(1, 2, _field(1, 2, "▁<unk>".encode()) + _field(2, 5, 0.0) + _field(3, 0, 2)))  # 2: unknown
    trainer = _field(3, 0, 2) + _field(4, 0, size + 1) + _field(24, 0, 0) + _field(40, 0, size) + b"".join(_field(n, 0, (1 << 64) - 1) for n in (41, 42, 43))
    normaliser = _field(1, 2, b"identity") + _field(3, 0, 0) + _field(4, 0, 0) + _field(5, 0, 0)
    return b"".join(out) + _field(2, 2, trainer) + _field(3, 2, normaliser)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_names(words: pa.Array) -> list[str]:
    """Each word as the characters that stand for its bytes."""
    chars = byte_chars()
    data, off = text_bytes(words)
    codes = np.array([c.encode().ljust(2, b"\0") for c in chars], "S2").view(np.uint8).reshape(256, 2)
    size = np.array([len(c.encode()) for c in chars])[data]
    both = codes[data]
    return _strings(both[np.arange(2) < size[:, None]], np.concatenate([[0], np.cumsum(size)])[off]).to_numpy(zero_copy_only=False).tolist()


def _gathered(ids: np.ndarray, first: np.ndarray, n: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ids[first : first + n] of these entries, one after the other, and their lengths."""
    n = n[which]
    ends = np.cumsum(n)
    return ids[np.repeat(first[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n


def _cuts() -> np.ndarray:
    """By a byte and the next one (in 16 bits): whether a text may be cut between them."""
    code = np.arange(256)
    blank = np.isin(code, [*range(9, 14), *range(28, 33)])
    alnum = np.isin(code, [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])
    mark = (code < 128) & ~alnum & (code != ord("'")) & (code != ord(" "))
    return ((~blank[:, None] & (code == ord(" "))) | (alnum[:, None] & mark)).ravel()


_CUTS = _cuts()


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """The strings between the places at of these bytes."""
    wide = at[-1] > 0x7FFFFFFF
    kind = pa.LargeStringArray if wide else pa.StringArray
    out = kind.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64 if wide else np.int32)), pa.py_buffer(data))
    return out.cast(pa.string()) if wide else out


def binary(data: np.ndarray, off: np.ndarray) -> pa.Array:
    """A binary column of these bytes, cut at the offsets."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])


class Pretokens:
    """Ids of whole columns of texts, by an encoder of single pre-tokens.

    A text is cut before each space that doesn't follow white space and before each ASCII mark or control (but an apostrophe)
    behind an ASCII letter or digit: no pre-token goes beyond such a cut, and what stands between two of them splits alike alone or
    in its text. The cuts, the different chunks of a column and their places among the remembered ones are found by vector
    operations on the column's bytes; only chunks that aren't remembered are split by the pattern and encoded, all
    at once. The memory holds cache chunks at most: when it is full, those that one column alone had go first.

    learn: different words -> their ids, one after the other, and the number of ids of each. special: a string that stands for
    one id wherever it occurs, and that id.
    """

    def __init__(self, pattern: str, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], special: tuple[str, int] | None = None, cache: int = CACHE):
        self.split = regex.compile(pattern).findall
        self.learn, self.special, self.cache = learn, special, cache
        self.known = pa.array([], pa.string())
        self.ids, self.first, self.n, self.seen = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other (null: none), and the len + 1 offsets of the texts among them."""
        if self.special is None or not pc.any(pc.match_substring(column, self.special[0])).as_py():
            return self._encode(*text_bytes(column))
        parts = pc.split_pattern(pc.fill_null(column, ""), self.special[0])
        ends = parts.offsets.to_numpy().astype(np.int64)
        ids, off = self._encode(*text_bytes(parts.flatten()))
        inner = np.ones(len(off) - 1, bool)
        inner[ends[:-1]] = False  # a special string stands before each part but a text's first
        return np.insert(ids, off[:-1][inner], np.uint32(self.special[1])), off[ends] + ends - np.arange(len(ends))

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = _CUTS[data[:-1].astype(np.uint16) << 8 | data[1:]]
        cut[off] = True
        at = np.flatnonzero(cut)
        chunks = _strings(data, at).dictionary_encode()
        which = self._places(chunks.dictionary)[chunks.indices.to_numpy()]
        ids, n = _gathered(self.ids, self.first, self.n, which)
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, off)]

    def _places(self, chunks: pa.Array) -> np.ndarray:
        """Where the memory has each of these different chunks; those that it hasn't are learnt."""
        if len(self.known) + len(chunks) > self.cache:
            self._forget()
        # the few chunks are hashed and the many known ones looked up among them
        there = pc.fill_null(pc.index_in(self.known, chunks), -1).to_numpy()
        found = np.flatnonzero(there >= 0)
        place = np.full(len(chunks), -1, np.int64)
        place[there[found]] = found
        self.seen[found] += 1
        new = np.flatnonzero(place < 0)
        if len(new):
            names = chunks.take(pa.array(new))
            cut = [self._cut(x) for x in names.to_numpy(zero_copy_only=False).tolist()]
            words = pa.array(list(chain.from_iterable(cut)), pa.string()).dictionary_encode()
            ids, n = self.learn(words.dictionary)
            ids, n = _gathered(ids, np.cumsum(n) - n, n, words.indices.to_numpy())
            count = np.fromiter(map(len, cut), np.int64, len(cut))
            n = np.diff(np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(count)])])
            place[new] = len(self.known) + np.arange(len(new))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(n) - n])
            self.ids, self.n = np.concatenate([self.ids, ids]), np.concatenate([self.n, n])
            self.seen = np.concatenate([self.seen, np.ones(len(n), np.int32)])
            self.known = pa.concat_arrays([self.known, names])
        return place

    def _forget(self) -> None:
        """Leaves the chunks that several columns had, half of the memory at most."""
        keep = np.flatnonzero(self.seen > 1)
        keep = np.sort(keep[np.argsort(-self.seen[keep], kind="stable")][: self.cache // 2])
        self.ids, self.n = _gathered(self.ids, self.first, self.n, keep)
        self.known, self.first, self.seen = self.known.take(pa.array(keep)), np.cumsum(self.n) - self.n, np.maximum(1, self.seen[keep] // 2)

    def _cut(self, x: str) -> tuple[str, ...] | list[str]:
        """The pre-tokens of a chunk; plain words need no pattern."""
        return (x,) if x[:1] == " " and x[1:].isalpha() else self.split(x)


class Codec:
    """encode() gives a column's ids and their offsets by text; decode() gives ids' bytes and the bytes' offsets by text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: tuple[str, int] | None = None, whole: bool = True):
        """whole: whether a word that is an entry has that entry's id, though its merges don't reach it (as rank encoders have it)."""
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        table: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.table = pa.array(table, pa.large_binary())
        names = byte_names(self.table)
        self.whole = {t: [i] for i, (t, got) in enumerate(zip(names, self.model.encode(names, num_threads=1), strict=True)) if t and got != [i]} if whole else {}
        self.encode = Pretokens(pattern, self._learn, special).encode

    def _learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        names = byte_names(words)
        ids = self.model.encode(names, num_threads=1)
        if self.whole:
            ids = [self.whole.get(x, own) for x, own in zip(names, ids, strict=True)]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum())), n

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[memoryview, np.ndarray]:
        got = self.table.take(pa.array(ids))
        _, ends, data = got.buffers()
        ends = np.frombuffer(ends, np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
        return memoryview(data if data is not None else b""), ends[off]


@held
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32) of each text. path: a rank file that every executor has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids, off = own.encode(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), binary(ids.astype("<u4"), 4 * off)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and the decoded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            data, off = own.decode(np.frombuffer(b"".join(raw), "<u4"), np.cumsum([0, *map(len, raw)]) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binary(np.frombuffer(data, np.uint8), off)], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def op4_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    path, pattern = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN

    def digests(data: memoryview, off: np.ndarray) -> pa.Array:
        return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.string())

    @functools.partial(frugal, holds=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids, off = own.encode(batch.column(1))
            raw = memoryview(ids.astype("<u4")).cast("B") if len(ids) else memoryview(b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), digests(raw, 4 * off), digests(*own.decode(ids, off))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
