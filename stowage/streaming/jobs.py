"""Structured Streaming forms of the log, liveness and scrub operators; tests hold each against its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WAL = "seq long, ts timestamp, op string, bucket string, key string, value double"


def wal_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """JSON lines as they arrive; files of each micro-batch at most."""
    return spark.readStream.schema(WAL).option("maxFilesPerTrigger", files).json(folder)


def upsert_into(folder: str):
    """A foreachBatch sink: state version n + 1 is state n with the batch folded in; each version is a folder, so a retried batch writes its own anew.

    Each micro-batch rewrites the state, so its size should be a fair share of it; older versions stay, for readers, until their folders are deleted.
    """
    def sink(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.select("bucket", "key", "seq", "op", "value")
        if epoch:
            new = new.unionByName(spark.read.parquet(f"{folder}/v{epoch - 1}"))
        last = new.groupBy("bucket", "key").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value"))
        last.write.mode("overwrite").parquet(f"{folder}/v{epoch}")

    return sink


def liveness_stream(probes: DataFrame, threshold: int = 3) -> DataFrame:
    """Streaming liveness: a state of (total, consecutive failures) a node. probes: addr, seq, ok."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total, fails = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for ok in rows["ok"]:
            total, fails = total + 1, 0 if ok else fails + 1
        state.update((total, fails))
        yield pd.DataFrame({"addr": [key[0]], "total_probes": [total], "consec_fails": [fails], "healthy": [fails < threshold]})

    return probes.groupBy("addr").applyInPandasWithState(step, "addr string, total_probes long, consec_fails long, healthy boolean", "total long, fails long", "update", "NoTimeout")


def scrub_stream(chunks: DataFrame) -> DataFrame:
    """Spoilt chunks of a stream of (addr, chunk_id, data)."""
    return chunks.filter(F.col("data").isNull() | (F.sha2("data", 256) != F.col("chunk_id"))).select("addr", "chunk_id")
