"""Reed-Solomon over GF(2^8), polynomial 0x11d: numpy kernels on Arrow batches."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_id
from .chunking import pieces_of

POLYNOMIAL = 0x11D


@functools.cache
def mul_table() -> np.ndarray:
    """256 x 256 products, by shifting and reducing."""
    a = np.arange(256, dtype=np.uint16)[:, None]
    b = np.arange(256, dtype=np.uint16)[None, :]
    out = np.zeros((256, 256), np.uint16)
    for bit in range(8):
        out ^= np.where(b >> bit & 1, a, 0).astype(np.uint16)
        a = np.where(a & 0x80, (a << 1) ^ POLYNOMIAL, a << 1).astype(np.uint16)
    return out.astype(np.uint8)


def inverse(x: int) -> int:
    if not x:
        raise ZeroDivisionError("0 has no inverse")
    return int(np.flatnonzero(mul_table()[x] == 1)[0])


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(mul_table()[a[:, :, None], b[None, :, :]], axis=1)


def invert(m: np.ndarray) -> np.ndarray:
    """Gauss-Jordan; a singular matrix is an error."""
    n, t = len(m), mul_table()
    w = np.concatenate([m.astype(np.uint8), np.eye(n, dtype=np.uint8)], axis=1)
    for c in range(n):
        rows = np.flatnonzero(w[c:, c]) + c
        if not len(rows):
            raise ValueError("singular matrix")
        w[[c, rows[0]]] = w[[rows[0], c]]
        w[c] = t[inverse(int(w[c, c])), w[c]]
        for r in range(n):
            if r != c and w[r, c]:
                w[r] ^= t[w[r, c], w[c]]
    return w[:, n:]


@functools.cache
def encoding_matrix(k: int, m: int) -> np.ndarray:
    """(k + m) x k, the identity on top: Vandermonde times the inverse of its top square."""
    if k < 1 or m < 1 or k + m > 256:
        raise ValueError("k and m must be positive, k + m at most 256")
    t, v = mul_table(), np.ones((k + m, k), np.uint8)
    for c in range(1, k):
        v[:, c] = t[v[:, c - 1], np.arange(k + m)]
    return multiply(v, invert(v[:k]))


def _apply(matrix: np.ndarray, data: np.ndarray) -> np.ndarray:
    """matrix (r x k) times data (k x bytes): one table row a coefficient."""
    t, out = mul_table(), np.zeros((len(matrix), data.shape[1]), np.uint8)
    for r, row in enumerate(matrix):
        for c, x in enumerate(row):
            if x:
                out[r] ^= t[x][data[c]]
    return out


def encode(data: np.ndarray, m: int) -> np.ndarray:
    """Parity of equal-sized, non-empty data shards (k x bytes)."""
    if data.ndim != 2 or not data.size:
        raise ValueError("shards must be of equal size and not empty")
    return _apply(encoding_matrix(len(data), m)[len(data) :], data)


@functools.lru_cache(4096)
def _decoder(k: int, m: int, rows: tuple[int, ...], lost: tuple[int, ...]) -> np.ndarray:
    """The matrix that makes the lost data shards of those of rows."""
    return invert(encoding_matrix(k, m)[list(rows)])[list(lost)]


def reconstruct(shards: list[np.ndarray | None], k: int) -> list[np.ndarray | None]:
    """Missing data shards rebuilt from the first k there are; parity stays as it is."""
    have = [i for i, s in enumerate(shards) if s is not None]
    if len(have) < k:
        raise ValueError("fewer than k shards")
    lost = tuple(i for i in range(k) if shards[i] is None)
    if not lost:
        return list(shards)
    rows = tuple(have[:k])
    made = _apply(_decoder(k, len(shards) - k, rows, lost), np.stack([shards[i] for i in rows]))
    return [made[lost.index(i)] if i in lost else s for i, s in enumerate(shards)]


def parse_code(text):
    """(k, m) columns of "K+M" text: trimmed, positive integers; else nulls."""
    t = F.split(F.trim(text), r"\+")
    k, m = (F.trim(F.try_element_at(t, F.lit(i))).try_cast("int") for i in (1, 2))
    ok = (F.size(t) == 2) & (k > 0) & (m > 0)
    return F.when(ok, k), F.when(ok, m)


def stripes(objects: DataFrame, k: int, shard: int, keys: tuple[str, ...] = ("bucket", "key")) -> DataFrame:
    """keys, stripe_index, stripe_id, data_len, data: the body in zero-padded stripes of k * shard bytes."""
    cut = objects.filter(F.octet_length("body") > 0).select(*keys, F.explode(pieces_of("body", k * shard, "stripe_index")).alias("x")).select(*keys, "x.*")
    padded = F.expr(f"rpad(data, {k * shard}, X'00')")
    return cut.select(*keys, "stripe_index", F.octet_length("data").alias("data_len"), padded.alias("data")).withColumn("stripe_id", content_id(F.col("data")))


def content_stripes(chunks: DataFrame, k: int, keys: tuple[str, ...] = ("bucket", "key")) -> DataFrame:
    """keys, stripe_index, stripe_id, data_len, data of content-defined chunks (chunk_index, data): each is a stripe, padded to a multiple of k."""
    padded = F.expr(f"rpad(data, cast(greatest(1, ceil(octet_length(data) / {k})) * {k} AS INT), X'00')")
    return chunks.select(*keys, F.col("chunk_index").alias("stripe_index"), F.octet_length("data").alias("data_len"), padded.alias("data")).withColumn("stripe_id", content_id(F.col("data")))


def shards(stripe: DataFrame, k: int, m: int) -> DataFrame:
    """stripe_id, shard_index, shard_id, data of each distinct stripe: k of data, m of parity, in Arrow batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, by_size = [], {}
            for sid, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_size.setdefault(len(data), []).append((sid, data))
            for size, own in by_size.items():  # stripes of one size are encoded together
                data = np.frombuffer(b"".join(x for _, x in own), np.uint8).reshape(len(own), k, size // k).transpose(1, 0, 2)
                every = np.concatenate([data, encode(data.reshape(k, -1), m).reshape(m, len(own), -1)])
                for j, (sid, _) in enumerate(own):
                    parts = [every[i, j].tobytes() for i in range(k + m)]
                    rows += [(sid, i, hashlib.sha256(x).hexdigest(), x) for i, x in enumerate(parts)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], ["stripe_id", "shard_index", "shard_id", "data"])

    return stripe.select("stripe_id", "data").dropDuplicates(["stripe_id"]).mapInArrow(run, "stripe_id string, shard_index int, shard_id string, data binary")


def _held(held: DataFrame) -> DataFrame:
    """stripe_id, s: each stripe's shards in order. Dealt by stripe at once, so that what reads it twice makes the shards once."""
    return held.repartition("stripe_id").groupBy("stripe_id").agg(F.array_sort(F.collect_list(F.struct("shard_index", "data"))).alias("s"))


def rebuilt(held: DataFrame, k: int, m: int) -> DataFrame:
    """stripe_id, degraded, data (null if fewer than k shards): stripes with all data shards are joined in the JVM, only degraded ones reach Python."""
    by = _held(held).withColumn("n_data", F.size(F.filter("s", lambda x: x["shard_index"] < k)))
    whole = by.filter(F.col("n_data") == k).select("stripe_id", F.lit(False).alias("degraded"), F.concat(*(F.get("s", F.lit(i))["data"] for i in range(k))).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s in batch.column(1).to_pylist():
                out.append(b"".join(x.tobytes() for x in reconstruct(_placed(s, k + m), k)[:k]) if len(s) >= k else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([True] * len(out)), pa.array(out, pa.binary())], ["stripe_id", "degraded", "data"])

    return whole.unionByName(by.filter(F.col("n_data") < k).select("stripe_id", "s").mapInArrow(run, "stripe_id string, degraded boolean, data binary"))


def _placed(s: list[dict], n: int) -> list[np.ndarray | None]:
    have: list = [None] * n
    for x in s:
        have[x["shard_index"]] = np.frombuffer(x["data"], np.uint8)
    return have


def read_bodies(refs: DataFrame, held: DataFrame, k: int, m: int, keys: tuple[str, ...] = ("bucket", "key")) -> DataFrame:
    """keys, body, degraded: objects (refs: stripe_index, stripe_id, data_len) read from the shards that are held and verify.

    held: stripe_id, shard_index, shard_id, data. Stripes are rebuilt where needed and trimmed to data_len; body is null where a
    stripe has fewer than k shards.
    """
    good = held.filter(F.sha2("data", 256) == F.col("shard_id")).select("stripe_id", "shard_index", "data")
    both = refs.join(rebuilt(good, k, m), "stripe_id", "left").withColumn("data", F.expr("substring(data, 1, data_len)"))
    by = both.groupBy(*keys).agg(F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY stripe_index)").alias("body"), F.bool_and(F.col("data").isNotNull()).alias("whole"), F.bool_or(F.coalesce("degraded", F.lit(True))).alias("degraded"))
    return by.select(*keys, F.when(F.col("whole"), F.col("body")).alias("body"), "degraded")


def repaired(held: DataFrame, plan: DataFrame, k: int, m: int) -> DataFrame:
    """stripe_id, shard_index, addr, shard_id, data: each planned shard made anew from the first k that are held, and its new place.

    plan: stripe_id, shard_index, new_addr (null: none). Data shards are reconstructed, lost parity is encoded again from the data, in one
    pass by stripe. shard_id and data are null where a stripe has fewer than k shards: the repair failed.
    """
    dead = plan.filter("new_addr IS NOT NULL").groupBy("stripe_id").agg(F.array_sort(F.collect_list(F.struct("shard_index", "new_addr"))).alias("dead"))
    both = dead.join(_held(held), "stripe_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sid, dead_, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = None
                if s is not None and len(s) >= k:
                    data = np.stack(reconstruct(_placed(s[:k], k + m), k)[:k])
                    data = np.concatenate([data, encode(data, m)]) if any(x["shard_index"] >= k for x in dead_) else data
                for x in dead_:
                    new = data[x["shard_index"]].tobytes() if data is not None else None
                    rows.append((sid, x["shard_index"], x["new_addr"], new and hashlib.sha256(new).hexdigest(), new))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string(), pa.binary()), strict=True)], ["stripe_id", "shard_index", "addr", "shard_id", "data"])

    return both.select("stripe_id", "dead", "s").mapInArrow(run, "stripe_id string, shard_index int, addr string, shard_id string, data binary")


def gf_rows(spark: SparkSession) -> DataFrame:
    """a, b, p of all 65,536 products, in the JVM: exponents and logarithms of 2 by a fold."""
    t = mul_table()
    rows = [(int(a), t[a].tobytes()) for a in range(256)]
    x = spark.createDataFrame(rows, "a int, row binary")
    return x.select("a", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("b"), "row").select("a", "b", F.conv(F.hex(F.expr("substring(row, b + 1, 1)")), 16, 10).cast("int").alias("p"))
