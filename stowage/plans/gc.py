"""Garbage collection: what an inventory holds and nothing claims."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def claimed(refs: DataFrame) -> DataFrame:
    return refs.select("chunk_id", "addr").distinct()


def plan(inventory: DataFrame, refs: DataFrame, as_of: int, min_age: int = 60, registry: DataFrame | None = None) -> DataFrame:
    """addr, chunk_id, size, age of each sweep, by addr and chunk_id. min_age <= 0 means 60 seconds."""
    min_age = min_age if min_age > 0 else 60
    held = inventory if registry is None else inventory.join(F.broadcast(registry.select("addr")), "addr", "left_semi")
    old = held.filter(F.col("mtime") <= as_of - min_age)
    return old.join(claimed(refs), ["chunk_id", "addr"], "left_anti").select("addr", "chunk_id", "size", (F.lit(as_of) - F.col("mtime")).cast("long").alias("age")).orderBy("addr", "chunk_id")


def listing_failures(registry: DataFrame, listed: DataFrame) -> DataFrame:
    """Registered nodes without a listing: a plan must not be made while there are any."""
    return registry.select("addr").join(listed.select("addr").distinct(), "addr", "left_anti")


def apply(inventory: DataFrame, sweeps: DataFrame) -> DataFrame:
    """The inventory after the sweeps."""
    return inventory.join(sweeps.select("addr", "chunk_id"), ["addr", "chunk_id"], "left_anti").select(inventory.columns)


def stats(inventory: DataFrame, refs: DataFrame, sweeps: DataFrame) -> DataFrame:
    """scanned, claimed_keys, swept, freed."""
    return (
        inventory.agg(F.count("*").alias("scanned"))
        .crossJoin(claimed(refs).agg(F.count("*").alias("claimed_keys")))
        .crossJoin(sweeps.agg(F.count("*").alias("swept"), F.coalesce(F.sum("size"), F.lit(0)).alias("freed")))
    )
