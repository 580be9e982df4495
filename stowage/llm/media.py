"""Media columns: content-addressed payloads in tar shards.

A payload is stored losslessly as an 8-bit greyscale PNG, WIDTH samples a row, as a member of a tar shard in the shared folder;
the member's name is the payload's SHA-256. Rows carry digest, shard, offset and length. Each task writes its own shards and
each payload once a task; over all tasks one place is kept a digest, so equal texts point to the same bytes. Shards have names
of their own for each attempt and are complete before any row names them, so a repeated task leaves no wrong place behind.
Header-only range reads fill the metadata columns; features come from the stored bytes, read back.

Defined cases: a null or empty text is one payload of WIDTH bytes 255; repeated texts share a place, repeated rows each
get their own row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents, new_folder, pieces, written

#: Samples of a row; the filling sample; bytes of a shard after which the next begins; zlib level.
WIDTH, FILL, SHARD, LEVEL = 576, 255, 64 << 20, 6
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Signature and IHDR chunk: what a header read fetches.
HEADER = 33


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded bytes, and how many of them are the text's."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // WIDTH))
    return raw + bytes([FILL]) * (rows * WIDTH - len(raw)), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(data: bytes) -> bytes:
    rows = np.zeros((len(data) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """width, height, bits a sample, of a PNG's first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("no PNG header")
    return struct.unpack(">IIB", head[16:25])


def from_png(data: bytes) -> bytes:
    """The samples of a PNG as to_png() writes it (filter 0)."""
    width, height, _ = png_header(data[:HEADER])
    at, body = HEADER, []
    while at < len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        if zlib.crc32(data[at + 4 : at + 8 + n]) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if data[at + 4 : at + 8] == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Difference hash of 65 mean levels along the payload, with its mean and deviation: 16 hex digits, then both in 1/100."""
    x = np.frombuffer(samples, np.uint8)
    sums = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    at = np.arange(66) * len(x) // 65
    means = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at))
    bits = np.packbits(means[1:] > means[:-1]).tobytes().hex()
    mean = sums[-1] / len(x)
    dev = np.sqrt(max(0.0, float(np.square(x, dtype=np.int64).sum()) / len(x) - mean * mean))
    return f"{bits}:{int(mean * 100)}:{int(dev * 100)}"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if not folder.startswith("file:/") or folder.startswith("file://") else "file://" + folder[5:])


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes the shards; a written table of one row a document: doc_id, n_bytes, digest and, where this task stored the payload, shard, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, at, known, rows = None, "", 0, set(), []

        def close():
            nonlocal out
            if out is not None:
                out.write(bytes(1024))
                out.close()
                out = None

        def told():
            ready = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()))], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
            rows.clear()
            return ready

        try:
            for batch in batches:
                for part in pieces(batch, 64):
                    for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                        data, n = payload(text)
                        digest = hashlib.sha256(data).hexdigest()
                        if digest in known:
                            rows.append((doc, n, digest, None, None, None))
                            continue
                        known.add(digest)
                        media = to_png(data)
                        if out is None:
                            name, at = f"{uuid.uuid4().hex}.tar", 0
                            out = system.open_output_stream(f"{root}/{name}")
                        info = tarfile.TarInfo(f"{digest[:2]}/{digest}.png")
                        info.size = len(media)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + media + bytes(-len(media) % 512))
                        rows.append((doc, n, digest, name, at + len(head), len(media)))
                        at += len(head) + len(media) + -len(media) % 512
                        if at >= SHARD:
                            close()
                            yield told()
            close()
            if rows:
                yield told()
        finally:
            close()

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long"), "media-rows")


def places(rows: DataFrame) -> DataFrame:
    """One place a digest: digest, shard, offset, length."""
    return rows.filter("shard IS NOT NULL").groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")


def _in_order(place: DataFrame, parts: int | None = None) -> DataFrame:
    return (place.repartition("shard") if parts is None else place.repartition(parts, "shard")).sortWithinPartitions("shard", "offset")


def _reads(place: DataFrame, folder: str, read, names: list[str], shape: str, kinds: list) -> DataFrame:
    """place's rows, in shard order, with what read(file, offset, length) returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        file, at = None, None
        for batch in batches:
            for part in pieces(batch):
                out = []
                for _, shard, offset, length in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if shard != at:
                        if file is not None:
                            file.close()
                        file, at = system.open_input_file(f"{root}/{shard}"), shard
                    out.append(read(file, offset, length))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["digest", *names])
        if file is not None:
            file.close()

    return _in_order(place.select("digest", "shard", "offset", "length")).mapInArrow(run, f"digest string, {shape}")


def metadata(place: DataFrame, folder: str) -> DataFrame:
    """digest, width, height, bits: from HEADER bytes of each payload, nothing else is read."""
    return _reads(place, folder, lambda f, at, n: png_header(f.read_at(HEADER, at)), ["width", "height", "bits"], "width int, height int, bits int", [pa.int32()] * 3)


def _features(file, offset: int, length: int) -> tuple:
    media = file.read_at(length, offset)
    data = from_png(media)
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(data)


def features(place: DataFrame, folder: str) -> DataFrame:
    """By digest: what the stored bytes, read back and decoded, show."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    shape = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _reads(place, folder, _features, names, shape, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()])


def op8_media(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "media-shards")
    rows = store(documents(spark, sf_dir), folder)
    place = written(places(rows), "media-places")
    found = features(place, folder).join(metadata(place, folder), "digest")
    return rows.select("doc_id", "n_bytes", "digest").join(found, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits")
