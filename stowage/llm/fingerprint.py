"""Document fingerprints: a Merkle tree of sections, paragraphs and sentences.

A paragraph is a line (its digest covers all its bytes); a section ends after a blank line or where a paragraph's own digest says so (one in eight), so an edit
moves no boundary far from it. Leaves are the digests of a paragraph's sentences; each node's digest is that of its children,
and the root is the digest of the sections'. The fingerprint is text: root, then `/` sections, `:` paragraphs, `.` leaves. Equal roots
mean equal texts; differing branches are followed down to the leaves, which locate the edits. Likeness is the share of leaves
(with their multiplicity) that both trees have, of the larger tree's leaves.

Defined cases: a null or empty text has a root and no leaf; two of them are alike (1), one of them and any text are not (0);
documents without a doc_id come last in the order; rows of one doc_id, or without one, follow each other by text; an empty table
gives no rows; other columns are ignored by the query and kept by fingerprints(), but for one of that name.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents, pieces

SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: Words of a leaf at most, and hex digits of its digest.
LEAF_WORDS, DIGITS = 12, 8
#: Ranges of ids at most.
MOST_RANGES = 20_000


def _leaves(paragraph: str) -> list[str]:
    out = []
    for s in SENTENCE.split(paragraph):
        if s.count(" ") < LEAF_WORDS:
            parts = [s]
        else:
            words = s.split(" ")
            parts = [" ".join(words[i : i + LEAF_WORDS]) for i in range(0, len(words), LEAF_WORDS)]
        out += [f"{xxhash.xxh32_intdigest(p.encode('utf-8', 'surrogatepass')):08x}" for p in parts]
    return out


def tree(text: str) -> str:
    """The text's fingerprint."""
    paragraphs: list[bytes] = []
    above, sections = hashlib.sha256(), [[]]

    def close() -> None:
        if paragraphs:
            above.update(hashlib.blake2b(b"".join(paragraphs), digest_size=16).digest())
            paragraphs.clear()
        if sections[-1]:
            sections.append([])

    for line in text.split("\n") if text else ():
        node = hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()  # of all its bytes: white space counts
        paragraphs.append(node)
        if line.strip():
            sections[-1].append(".".join(_leaves(line)))
        if node[0] % 8 == 0 or not line.strip():
            close()
    close()
    return "/".join([above.hexdigest(), *(":".join(s) for s in sections if s)])


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints' texts are, 0 to 1."""
    if a == b:
        return 1.0
    x, y = a.split("/"), b.split("/")
    if x[0] == y[0]:
        return 1.0
    nx, ny = (sum(s.count(".") + s.count(":") + 1 for s in t[1:]) for t in (x, y))
    if not nx or not ny:
        return 0.0
    left, right = Counter(x[1:]), Counter(y[1:])
    common = 0
    for level in (":", ".", None):  # what is equal on one level isn't opened on the next
        same = left & right
        common += sum(n * (s.count(".") + s.count(":") + 1) for s, n in same.items())
        left, right = left - same, right - same
        if level:
            left, right = (Counter(p for s, n in t.items() for p in s.split(level) * n) for t in (left, right))
    return common / max(nx, ny)


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) of a whose digests b hasn't: where the edits are. Sections that both have are not opened."""
    theirs = b.split("/")[1:]
    there, whole = {p for s in theirs for p in s.split(":")}, set(theirs)
    return [(i, j) for i, s in enumerate(a.split("/")[1:]) if s not in whole for j, p in enumerate(s.split(":")) if p not in there]


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with a column fingerprint behind its own, in place of one of that name."""
    docs = docs.drop("fingerprint")
    columns = docs.columns
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([tree(t or "") for t in part.column("text").to_pylist()])], [*columns, "fingerprint"])

    return docs.mapInArrow(run, f"{shape}, fingerprint string")


def _ranges(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts key reaches, by two short searches: first among every root of their number, then within one such step."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    reached = lambda values, x: F.size(F.filter(values, lambda c: x >= c))
    literal = lambda values: F.array(*(F.lit(c).cast("long") for c in values))
    coarse = reached(literal(cuts[step - 1 :: step]), key)
    fine = F.get(F.array(*(literal(cuts[i : i + step - 1]) if cuts[i : i + step - 1] else F.array().cast("array<bigint>") for i in range(0, len(cuts) + 1, step))), coarse)
    return coarse * step + F.coalesce(reached(fine, key), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (bucket, doc_id, text, ghost) such that, bucket by bucket in descending doc_id, each row that is no ghost is followed by its next document.

    Buckets are ranges of doc_id. The first document of each is also sent, as a ghost, to the bucket before it, the very first
    one to the last bucket; so nothing needs all documents in one order in one task. One shuffle of the texts.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("key"))
    parts = min(MOST_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    span = docs.agg(F.min("key").alias("a"), F.count("*").alias("n")).first()
    if not span.n:
        return docs.select(F.lit(0).alias("bucket"), "doc_id", "text", F.lit(False).alias("ghost"))
    cuts = sorted({int(x) for x in docs.approxQuantile("key", [i / parts for i in range(1, parts)], 0.5 / parts)} - {span.a})
    # bucket 0 has the largest ids; a cut is the smallest id of its bucket
    rows = docs.withColumn("bucket", (F.lit(len(cuts)) - _ranges(F.col("key"), cuts)).cast("int"))
    heads = {r.bucket: r.h for r in rows.groupBy("bucket").agg(F.max("key").alias("h")).collect()}  # one row a bucket
    order = sorted(heads)
    before = F.broadcast(spark.createDataFrame([(order[i - 1] if i else order[-1], heads[b]) for i, b in enumerate(order)], "bucket int, key long"))
    # of documents that repeat the head's id the ghost is the first by text, as in the bucket's own order
    own = rows.select("bucket", "doc_id", "text", F.lit(False).alias("ghost"), "key")
    ghosts = docs.join(before, "key").groupBy("bucket", "key").agg(F.min("doc_id").alias("doc_id"), F.min(F.coalesce("text", F.lit(""))).alias("text")).select("bucket", "doc_id", "text", F.lit(True).alias("ghost"), "key")
    return own.unionByName(ghosts).repartition(len(order), "bucket").sortWithinPartitions("bucket", "ghost", F.desc("key"), F.coalesce("text", F.lit(""))).select("bucket", "doc_id", "text", "ghost")


def op7_fingerprint(spark, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        for batch in batches:
            for part in pieces(batch):
                out = []
                for bucket, doc, text, ghost in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    text = text or ""
                    own = tree(text)
                    if held and held[0] == bucket:
                        _, doc0, text0, own0 = held
                        k = len(text0) // 3
                        edited = text0[: len(text0) - k] + text[:k]
                        other = tree(edited)
                        out.append((doc0, len(text0), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own0, other, likeness(own0, other), likeness(own0, own)))
                    held = None if ghost else (bucket, doc, text, own)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return with_next(documents(spark, sf_dir)).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
