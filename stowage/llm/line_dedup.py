"""Line dedup by two Bloom filters.

One pass over the texts sets, for each document's distinct line keys, a bit in a once-seen filter and, where that bit was
set by another document, in a twice-seen filter. A second pass ships only the keys that the twice-seen filter suspects, as
text, to an exact count of documents. A third pass drops the lines of the confirmed keys. Filters have a fixed number of
bits (a parameter), so their memory is bounded at every size; a fuller filter only makes more suspects, never other results.

Defined cases: a null or empty text is one empty line; a key shorter than min_chars is never dropped; a line that repeats
within one document counts once for it; rows of one doc_id, or without one, are separate documents here; an empty table gives an empty
table; extra columns pass through line_dedup(), also such as are named like mark()'s.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, frugal, pieces, unused, written

#: The white space stripped from a line's ends.
SPACE = b" \t\n\x0b\x0c\r"
#: Bits of each filter and of a segment of it, as powers of two: 2^27 bits are 16 MB.
BITS, SEGMENT_BITS = 27, 19
#: Tasks whose filters meet in one, and repeated keys that are broadcast at most (some 30 MB a worker).
FAN, BROADCAST_KEYS = 64, 200_000


def keys_of(text: str | None, min_chars: int = 1) -> tuple[list[str], list[bytes | None]]:
    """A text's lines and their keys; None for a key of fewer than min_chars code points."""
    text = text or ""
    lines = text.split("\n")
    keys = [x.strip(SPACE) for x in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]
    if min_chars <= 1:
        return lines, [k or None for k in keys]
    return lines, [k if len(k.decode("utf-8", "surrogatepass")) >= min_chars else None for k in keys]


def _positions(texts: list, min_chars: int, bits: int) -> Iterator[np.ndarray]:
    """The filter positions of each document, each once."""
    for t in texts:
        yield np.fromiter({xxhash.xxh3_64_intdigest(k) >> (64 - bits) for k in set(keys_of(t, min_chars)[1]) if k is not None}, np.int64)


def _marks(parts: list[np.ndarray], bits: int, segment: int) -> pa.Table:
    """Rows (segment, level, the places set in it as uint32) of the pair of filters over these documents."""
    at, n = np.unique(np.concatenate(parts), return_counts=True)
    rows = []
    for level, x in ((1, at), (2, at[n > 1])):
        cuts = np.searchsorted(x, np.arange(0, (1 << bits) + 1, 1 << segment))
        rows += [(s, level, (x[a:b] - (s << segment)).astype(np.uint32).tobytes()) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["segment", "level", "at"])


def _merged(segment: int, group: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """One pair of filters, as bits, of several: a place is seen twice if one of them has it twice, or two of them once."""
    once, twice = np.zeros_like(pairs[0][0]), np.zeros_like(pairs[0][0])
    for a, b in pairs:
        twice |= b | once & a
        once |= a
    bits = [pa.array([np.packbits(x, bitorder="little").tobytes()], pa.binary()) for x in (once, twice)]
    return pa.table([pa.array([segment], pa.int32()), pa.array([group], pa.int32()), *bits], ["segment", "group", "once", "twice"])


def twice_filter(docs: DataFrame, min_chars: int = 1, bits: int = BITS, segment: int = SEGMENT_BITS, fan: int = FAN) -> bytes:
    """The twice-seen filter, one bit a place. Each task makes its own pair; pairs merge segment by segment, those of fan tasks at a time."""

    @frugal
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in pieces(batch):
                for at in _positions(part.column(0).to_pylist(), min_chars, bits):
                    held.append(at)
                    n += len(at)
                if n > 1_000_000:
                    yield from _marks(held, bits, segment).to_batches()
                    held, n = [], 0
        if n:
            yield from _marks(held, bits, segment).to_batches()

    def first(key: tuple, table: pa.Table) -> pa.Table:
        pairs = []
        for level, at in zip(table["level"].to_pylist(), table["at"].to_pylist(), strict=True):
            places, none = np.zeros(1 << segment, bool), np.zeros(1 << segment, bool)
            places[np.frombuffer(at, np.uint32)] = True
            pairs.append((places, none) if level == 1 else (none, places))
        return _merged(key[0].as_py(), key[1].as_py(), pairs)

    def next_(key: tuple, table: pa.Table) -> pa.Table:
        unpacked = (np.unpackbits(np.frombuffer(x, np.uint8), bitorder="little").astype(bool) for name in ("once", "twice") for x in table[name].to_pylist())
        pairs = list(unpacked)
        return _merged(key[0].as_py(), key[1].as_py(), list(zip(pairs[: table.num_rows], pairs[table.num_rows :], strict=True)))

    shape = "segment int, group int, once binary, twice binary"
    found = docs.select("text").mapInArrow(own, "segment int, level int, at binary").withColumn("group", F.floor(F.spark_partition_id() / fan).cast("int"))
    level = written(found.groupBy("segment", "group").applyInArrow(first, shape), "line-filters")
    while (level.agg(F.max("group")).first()[0] or 0) > 0:
        level = written(level.withColumn("group", F.floor(F.col("group") / fan).cast("int")).groupBy("segment", "group").applyInArrow(next_, shape), "line-filters")
    out = np.zeros(1 << (bits - 3), np.uint8)
    step = 1 << (segment - 3)
    for row in level.select("segment", "twice").toLocalIterator():
        out[row.segment * step : (row.segment + 1) * step] = np.frombuffer(row.twice, np.uint8)
    return out.tobytes()


def _suspects(docs: DataFrame, id_: str, seen, min_chars: int, bits: int) -> DataFrame:
    """id long, key binary: each row's different keys that the twice-seen filter suspects."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.frombuffer(seen.value, np.uint8)
        for batch in batches:
            for part in pieces(batch):
                ids, keys = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for k in set(keys_of(text, min_chars)[1]):
                        if k is not None:
                            at = xxhash.xxh3_64_intdigest(k) >> (64 - bits)
                            if twice[at >> 3] >> (at & 7) & 1:
                                ids.append(doc)
                                keys.append(k)
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], ["id", "key"])

    return docs.select(id_, "text").mapInArrow(run, "id long, key binary")


def repeated_lines(docs: DataFrame, seen, min_docs: int = 10, min_chars: int = 1, bits: int = BITS) -> DataFrame:
    """key binary, n_docs long, first_doc long: every key that stands in min_docs documents or more (2 at least). seen: the broadcast twice-seen filter."""
    found = _suspects(docs, "doc_id", seen, min_chars, bits)
    return found.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("id").alias("first_doc")).filter(F.col("n_docs") >= max(2, min_docs))


def mark(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", bits: int = BITS, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """docs with text after the drop and, beside, n_lines, n_dropped (long).

    keep="none" drops a repeated key's lines everywhere; keep="first" leaves its first line in the document of the smallest id.
    Up to broadcast_keys repeated keys travel as 16-byte digests; beyond that, the suspected lines are joined with them.
    """
    seen = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, min_chars, bits))
    keys = written(repeated_lines(docs, seen, min_docs, min_chars, bits).select(_digest_column(), "first_doc"), "line-keys")
    if keys.count() > broadcast_keys:
        return _apply_joined(docs, keys, seen, min_chars, keep, bits)
    seen.unpersist()
    drop = docs.sparkSession.sparkContext.broadcast({bytes(r.digest): r.first_doc for r in keys.toLocalIterator()})
    return _apply(docs, drop, min_chars, keep)


def _digest_column() -> Column:
    """The digest of the column key, as _digest() has it."""
    return F.expr("unhex(substr(sha2(key, 256), 1, 32))").alias("digest")


def _digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:16]


def _cut(lines: list[str], keys: list, doc_id: int, drop: dict, keep: str, cache: dict) -> tuple[str, int]:
    out, done = [], set()
    for line, key in zip(lines, keys, strict=True):
        if key is not None:
            d = cache.get(key)
            if d is None:
                if len(cache) > 200_000:
                    cache.clear()
                d = cache[key] = _digest(key)
            if d in drop and not (keep == "first" and drop[d] == doc_id and d not in done):
                continue
            done.add(d)
        out.append(line)
    return "\n".join(out), len(lines) - len(out)


def _apply(docs: DataFrame, drop, min_chars: int, keep: str, extra: str | None = None) -> DataFrame:
    columns = docs.columns
    if extra:
        columns = [c for c in columns if c != extra]
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    @frugal
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, bytes] = {}
        known = drop.value if drop else None
        for batch in batches:
            for part in pieces(batch):
                texts, lines_, dropped = [], [], []
                ids = part.column("doc_id").to_pylist()
                own = part.column(extra).to_pylist() if extra else [None] * len(ids)
                for doc, text, mine in zip(ids, part.column("text").to_pylist(), own, strict=True):
                    lines, keys = keys_of(text, min_chars)
                    table = known if known is not None else {bytes(x["digest"]): x["first_doc"] for x in mine or ()}
                    kept, n = _cut(lines, keys, doc, table, keep, cache)
                    texts.append(kept)
                    lines_.append(len(lines))
                    dropped.append(n)
                arrays = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64())], [*columns, "n_lines", "n_dropped"])

    return docs.mapInArrow(cut, f"{shape}, n_lines long, n_dropped long")


def _apply_joined(docs: DataFrame, keys: DataFrame, seen, min_chars: int, keep: str, bits: int) -> DataFrame:
    """For more repeated keys than are broadcast: rows get numbers, in a table, and each row its own repeated keys by a join of the suspected ones."""
    row, drop = unused("row", docs.columns), unused("drop", docs.columns)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "line-docs")
    found = _suspects(numbered, row, seen, min_chars, bits).select("id", _digest_column())
    mine = found.join(keys, "digest").groupBy("id").agg(F.collect_list(F.struct("digest", "first_doc")).alias(drop)).withColumnRenamed("id", unused("id", [*docs.columns, row, drop]))
    held = numbered.join(mine, numbered[row] == mine[mine.columns[0]], "left").select(*(numbered[c] for c in docs.columns), mine[drop])
    return _apply(held, None, min_chars, keep, drop)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none") -> DataFrame:
    """docs with the repeated lines dropped from text; the same columns (n_chars, if there, follows the text)."""
    names = docs.columns
    clash = {c: unused(c, [*names, "n_lines", "n_dropped"]) for c in names if c.lower() in ("n_lines", "n_dropped")}
    out = mark(docs.withColumnsRenamed(clash), min_docs, min_chars, keep).drop("n_lines", "n_dropped")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*names)


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = mark(documents(spark, sf_dir).select("doc_id", "text"), 10, 1, "none")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: the same result. chr(11), chr(12): white space without an escape of its own.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
), repeated AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*)::BIGINT AS n_lines, count(r.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE r.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN repeated r ON l.key = r.key GROUP BY l.doc_id
"""
