"""Chunking: fixed-size and content-defined splits, joins, dedup statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import content_id


def pieces_of(body: str, size: int, at: str) -> Column:
    """The body's pieces of size bytes, the last one shorter, as an array of (at, data): exploded, no row carries the whole body."""
    return F.expr(f"transform(sequence(0, cast(ceil(octet_length({body}) / {size}) AS INT) - 1), i -> struct(i AS {at}, substring({body}, i * {size} + 1, {size}) AS data))")


def split_fixed(objects: DataFrame, size: int, keys: tuple[str, ...] = ("bucket", "key")) -> DataFrame:
    """keys, chunk_index, chunk_id, size, data: body in pieces of size bytes, the last one shorter; an empty body has none. Also on a stream of objects."""
    if size < 1:
        raise ValueError("size must be positive")
    parts = objects.filter(F.octet_length("body") > 0).select(*keys, F.explode(pieces_of("body", size, "chunk_index")).alias("x")).select(*keys, "x.*")
    return parts.select(*keys, "chunk_index", content_id(F.col("data")).alias("chunk_id"), F.octet_length("data").cast("long").alias("size"), "data")


def join_chunks(chunks: DataFrame, keys: tuple[str, ...] = ("bucket", "key")) -> DataFrame:
    """keys, body, size, sha_ok, size_ok: chunks (chunk_index, chunk_id, size, data) put together in order, as bytes, and verified."""
    good = F.sha2("data", 256) == F.col("chunk_id")
    fits = F.octet_length("data") == F.col("size")
    body = F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY chunk_index)")
    return chunks.groupBy(*keys).agg(body.alias("body"), F.sum("size").alias("size"), F.bool_and(good).alias("sha_ok"), F.bool_and(fits).alias("size_ok"))


def read_objects(refs: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("bucket", "key")) -> DataFrame:
    """keys, status, body: the objects of refs (chunk_index, chunk_id, size) in order from stored (chunk_id, data).

    status is ok, or the first chunk's fault: missing, or size where its length isn't the reference's; body is null then.
    """
    held = refs.join(stored.select("chunk_id", "data"), "chunk_id", "left")
    fault = F.when(F.col("data").isNull(), "missing").when(F.octet_length("data") != F.col("size"), "size")
    by = held.groupBy(*keys).agg(F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY chunk_index)").alias("body"), F.min_by(fault, F.when(fault.isNotNull(), F.col("chunk_index"))).alias("fault"))
    return by.select(*keys, F.coalesce("fault", F.lit("ok")).alias("status"), F.when(F.col("fault").isNull(), F.col("body")).alias("body"))


def dedup_stats(chunks: DataFrame) -> DataFrame:
    """total, distinct and shared references, bytes of both, and the saved share."""
    by = chunks.groupBy("chunk_id").agg(F.count("*").alias("refs"), F.max("size").alias("size"))
    return by.agg(F.sum("refs").alias("total_refs"), F.count("*").alias("unique_chunks"), F.count_if(F.col("refs") > 1).alias("shared_chunks"), F.sum(F.col("refs") * F.col("size")).alias("total_bytes"), F.sum("size").alias("unique_bytes"))


@dataclass(frozen=True)
class ContentDefined:
    """Bounds and mask bits of content-defined cuts; an invalid order falls back to the defaults. relax: bits of the last mask, 0 for none."""

    least: int = 1 << 20
    normal: int = 4 << 20
    most: int = 16 << 20
    strict_bits: int = 22
    loose_bits: int = 20
    relax_bits: int = 0

    def valid(self) -> ContentDefined:
        return self if 0 < self.least < self.normal < self.most and self.strict_bits > 0 and self.loose_bits > 0 else ContentDefined()


#: Our own gear table: the first eight bytes of the SHA-256 of each byte value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:8], "big") for i in range(256)], np.uint64)


def _mask(bits: int) -> np.uint64:
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def cut_points(data: bytes, config: ContentDefined) -> list[int]:
    """Ends of the pieces. The rolling value at a byte depends on the 64 bytes before it only, so it's one vector for all."""
    c = config.valid()
    n = len(data)
    if n <= c.least:
        return [n] if n else []
    g = GEAR[np.frombuffer(data, np.uint8)]
    fp = g.copy()
    for k in range(1, 64):
        fp[k:] += g[:-k] << np.uint64(k)
    strict, loose = np.flatnonzero(fp & _mask(c.strict_bits) == 0), np.flatnonzero(fp & _mask(c.loose_bits) == 0)
    relax = np.flatnonzero(fp & _mask(c.relax_bits) == 0) if c.relax_bits else None
    ends, at = [], 0
    while n - at > c.least:
        end = min(at + c.most, n)
        late = at + c.normal + (c.most - c.normal) // 2 if relax is not None else end
        cut = None
        for points, a, b in ((strict, at + c.least, min(at + c.normal, end)), (loose, at + c.normal, min(late, end)), (relax, late, end)):
            if points is not None and a < b:
                i = np.searchsorted(points, a)
                if i < len(points) and points[i] < b:
                    cut = int(points[i]) + 1
                    break
        at = cut or end
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def split_content(objects: DataFrame, config: ContentDefined = ContentDefined(), data: bool = False) -> DataFrame:
    """bucket, key, chunk_index, offset, size, chunk_id (and data, if asked for) of content-defined chunks (Arrow batches: cuts are sequential in a body)."""
    names = ["bucket", "key", "chunk_index", "offset", "size", "chunk_id", *(["data"] if data else [])]
    kinds = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                held, at = memoryview(body.as_buffer() or b""), 0  # pieces are hashed where they are
                for i, end in enumerate(cut_points(held, config)):
                    rows.append((bucket, key, i, at, end - at, hashlib.sha256(held[at:end]).hexdigest(), *([bytes(held[at:end])] if data else [])))
                    at = end
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    shape = "bucket string, key string, chunk_index int, offset long, size long, chunk_id string" + (", data binary" if data else "")
    return objects.select("bucket", "key", "body").mapInArrow(run, shape)


def put_chunks(stored: DataFrame, puts: DataFrame) -> DataFrame:
    """addr, chunk_id, size, status of each put of a chunk at a node: mismatch if its id isn't its bytes' digest, already-stored, or stored.

    stored: addr, chunk_id; puts: addr, chunk_id, digest, size, force. A forced put stores over what is there. Repeated puts of one chunk are one.
    """
    own = puts.withColumn("same", F.coalesce(F.col("digest") == F.col("chunk_id"), F.lit(False))).groupBy("addr", "chunk_id", "same").agg(F.max("size").alias("size"), F.max("force").alias("force"))
    there = stored.select("addr", "chunk_id").distinct().withColumn("there", F.lit(True))
    status = F.when(~F.col("same"), "mismatch").when(F.col("there").isNotNull() & ~F.col("force"), "already-stored").otherwise("stored")
    return own.join(there, ["addr", "chunk_id"], "left").select("addr", "chunk_id", "size", status.alias("status"))
