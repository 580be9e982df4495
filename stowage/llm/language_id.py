"""Language identification: multinomial naive Bayes over hashed character n-grams.

Fitted on at most FIT_ROWS rows of labelled documents (those of the smallest id hashes, whole texts); the log-probability matrix
(buckets x languages) is broadcast, and texts are scored in batches in numpy: the batch's sparse count matrix times the log matrix.

Defined cases: null text or text without a letter is `und`, score 0; ties go to the language that sorts first; without any
labelled document all are `und`. Letters are lower-cased; all else counts as one space. Repeated rows count and are scored one by
one; an id of more than FIT_ROWS rows is left out of the fit; rows without an id are scored but not learnt from; an empty table gives an empty table;
other columns pass through language_filter(), also such as are named like predict()'s.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import documents, frugal, pieces, unused

#: Documents that the model is fitted on at most; n-gram orders; hash buckets as a power of two; additive smoothing.
FIT_ROWS, ORDERS, BUCKET_BITS, ALPHA = 20_000, (1, 2, 3), 15, 0.5
#: Texts of a batch whose count matrix is made at once.
TEXTS = 16


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, non-letters as spaces, runs of spaces as one, one at each end."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(_letters()[c], c, np.uint32(32))
    space = c == 32
    return c[~(space & np.concatenate([[False], space[:-1]]))]


def buckets(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> np.ndarray:
    """The hash bucket of each n-gram of the text."""
    c = _codes(text).astype(np.uint64)
    out = []
    for n in orders:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out.append((h >> np.uint64(64 - bits)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def sparse_counts(parts: list[np.ndarray], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A batch's count matrix (texts x buckets), sparse: the row and bucket of each entry that isn't 0, in order, and the entry."""
    rows = np.repeat(np.arange(len(parts), dtype=np.int64) << bits, [len(p) for p in parts])
    counts = np.bincount(rows + np.concatenate(parts), minlength=len(parts) << bits)
    at = np.flatnonzero(counts)
    return at >> bits, at & ((1 << bits) - 1), counts[at]


class Model:
    """languages in order; logs: matrix of log probabilities (buckets, languages); prior: log of each language's share."""

    def __init__(self, languages: list[str], counts: np.ndarray, rows: np.ndarray, alpha: float = ALPHA):
        self.languages = languages
        if not languages:
            return
        c = counts.astype(np.float64) + alpha
        self.logs = np.ascontiguousarray(np.log(c / c.sum(axis=1, keepdims=True)).T)
        self.prior = np.log(rows / rows.sum())

    def totals(self, parts: list[np.ndarray], bits: int = BUCKET_BITS) -> np.ndarray:
        """Log prior and log likelihood (texts x languages) of texts with an n-gram or more: the sparse count matrix times logs."""
        rows, cols, counts = sparse_counts(parts, bits)
        terms = self.logs[cols] * counts[:, None]
        return self.prior + np.add.reduceat(terms, np.searchsorted(rows, np.arange(len(parts))), axis=0)

    def predict(self, texts: list[str | None], orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        able = [i for i, t in enumerate(texts) if t and self.languages and any(map(str.isalpha, t))]
        for at in range(0, len(able), TEXTS):
            own = able[at : at + TEXTS]
            total = self.totals([buckets(texts[i], orders, bits) for i in own], bits)
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for i, k, score in zip(own, best.tolist(), share.tolist(), strict=True):
                langs[i], scores[i] = self.languages[k], score
        return langs, scores


def fit(docs: DataFrame, where: Column | None = None, rows: int = FIT_ROWS, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> Model:
    """A model of the languages in `lang`, from at most rows documents that have both text and lang (and satisfy where)."""
    able = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    able = able.filter(where) if where is not None else able
    # the ids alone are ordered and cut, by the rows that they stand for; the bound keeps them broadcastable
    order = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    some = able.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") <= rows).select(F.xxhash64("doc_id").alias("h"), "doc_id", "n").orderBy("h", "doc_id").limit(rows)
    some = some.withColumn("total", F.sum("n").over(order)).filter(F.col("total") <= rows).select("doc_id")
    chosen = able.select("doc_id", "lang", "text").join(F.broadcast(some), "doc_id").repartition(12, F.xxhash64("doc_id"))

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for part in pieces(batch):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = held.setdefault(lang, [0, np.zeros(1 << bits, np.int64)])
                    own[0] += 1
                    own[1] += np.bincount(buckets(text, orders, bits), minlength=1 << bits)
        for lang, (n, c) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int64()), pa.array([c.tobytes()], pa.binary())], ["lang", "n", "counts"])

    total: dict[str, list] = {}
    for r in chosen.select("lang", "text").mapInArrow(count, "lang string, n long, counts binary").toLocalIterator():
        own = total.setdefault(r.lang, [0, np.zeros(1 << bits, np.int64)])
        own[0] += r.n
        own[1] += np.frombuffer(r.counts, np.int64)
    names = sorted(total)
    return Model(names, np.array([total[x][1] for x in names]).reshape(len(names), 1 << bits), np.array([total[x][0] for x in names], float))


def predict(docs: DataFrame, model: Model, orders: tuple[int, ...] = ORDERS, bits: int = BUCKET_BITS) -> DataFrame:
    """docs with lang_pred string and score double behind its columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    shape = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for part in pieces(batch):
                langs, scores = own.predict(part.column("text").to_pylist(), orders, bits)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*columns, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{shape}, lang_pred string, score double")


def held_out() -> Column:
    """crc32(doc_id as text) mod 4 = 2."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out())
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def language_filter(docs: DataFrame) -> DataFrame:
    """The documents that have a language: `und` ones go. The same columns."""
    names = docs.columns
    clash = {c: unused(c, [*names, "lang_pred", "score"]) for c in names if c.lower() in ("lang_pred", "score")}
    out = predict(docs.withColumnsRenamed(clash), fit(docs)).filter("lang_pred <> 'und'").drop("lang_pred", "score")
    return out.withColumnsRenamed({v: k for k, v in clash.items()}).select(*names)
