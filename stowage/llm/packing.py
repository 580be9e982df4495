"""Packing: concatenate and cut.

Pass one tokenises each text once and writes its ids to a table in the shared folder, with the running token count inside its
partition. The partitions' totals give, by a prefix sum over one row a partition, each partition's global offset. Pass two
adds both and cuts the endless sequence at every multiple of the window; a document that crosses a cut has one record on each
side of it. No text or id is shuffled.

Defined cases: a null or empty text is the end id alone; a document longer than a window spans several; only the last sequence
can be short; an empty table gives no rows. Repeated doc_ids, and rows without one, are separate documents, each with its own
pieces. A text's literal of the vocabulary's added token is that token's one id, as the tokenizers library encodes by default. Only
doc_id and text are read, so other columns never clash.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Codec, binary, byte_chars
from .shared import documents, frugal, held, pieces, small, written

WINDOW, END = 2048, 1


@held
def _codec(path: str, pattern: str) -> Codec:
    """The encoder of a tokenizers file of byte-level BPE, whose ids must be in the order of its merges."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    byte_of = {c: b for b, c in enumerate(byte_chars())}
    model, added = found["model"], [(x["content"], x["id"]) for x in found["added_tokens"]]
    strings = {x for x, _ in added}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in strings}
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if model["type"] != "BPE" or merged != sorted(merged) or len(added) > 1 or any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in found["added_tokens"]):
        raise ValueError("not a byte-level BPE file whose ids follow its merges, with one plain added token at most")
    return Codec(ranks, pattern, added[0] if added else None, bool(model.get("ignore_merges")))


def tokenised(docs: DataFrame, path: str, pattern: str, end: int = END) -> DataFrame:
    """A written table: part int, before long (tokens of the partition before this document), doc_id, doc_tokens, ids.

    ids are little-endian, two bytes each where the vocabulary allows it (wide = false), else four.
    """

    @functools.partial(frugal, holds=True)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part_id, before = _codec(path, pattern), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, off = own.encode(batch.column(1))
            ids = np.insert(ids, off[1:], np.uint32(end))
            off = off + np.arange(len(off))
            wide = bool(ids.max(initial=0) > 0xFFFF)
            at = before + off[:-1]
            before += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), part_id, np.int32)), pa.array(at), batch.column(0).cast(pa.int64()), pa.array(np.diff(off)), pa.array(np.full(len(at), wide)), binary(ids.astype("<u4" if wide else "<u2"), (4 if wide else 2) * off)],
                ["part", "before", "doc_id", "doc_tokens", "wide", "ids"],
            )

    shape = "part int, before long, doc_id long, doc_tokens long, wide boolean, ids binary"
    return written(docs.select("doc_id", "text").mapInArrow(run, shape), "packed-ids")


def offsets(tokens: DataFrame) -> DataFrame:
    """part, first: tokens of all partitions before this one. One row a partition of the table, so the sum is over few rows."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).orderBy("part").toLocalIterator()
    rows, first = [], 0
    for r in totals:
        rows.append((r.part, first))
        first += r.n
    return tokens.sparkSession.createDataFrame(rows, "part int, first long")


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 512):
                out = []
                c = [part.column(i).to_pylist() for i in range(5)]
                for doc, n, wide, ids, at in zip(*c, strict=True):
                    data = (ids if wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                    start = 0
                    while start < n:
                        seq, off = divmod(at + start, window)
                        length = min(n - start, window - off)
                        out.append((doc, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n, seq, off))
                        start += length
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    placed = tokens.join(small(offsets(tokens)), "part").select("doc_id", "doc_tokens", "wide", "ids", (F.col("first") + F.col("before")).alias("at"))
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, pattern: str, window: int = WINDOW, end: int = END) -> DataFrame:
    return cut(tokenised(docs, path, pattern, end), window)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(documents(spark, sf_dir), P.path("byte_bpe_50k.json"), P.PATTERN)
