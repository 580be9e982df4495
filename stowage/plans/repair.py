"""Repair of erasure-coded stripes: all of a stripe is in one row, so states and plans need no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _judged(stripes: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """stripes with up and dead (arrays of its shards) and state. live: addr, the registered nodes."""
    one = F.broadcast(live.agg(F.collect_set("addr").alias("live")))
    own = stripes.crossJoin(one).withColumn("up", F.filter("shards", lambda s: F.array_contains("live", s["addr"]))).withColumn("dead", F.array_sort(F.filter("shards", lambda s: ~F.array_contains("live", s["addr"]))))
    return own.withColumn("state", F.when(F.size("dead") == 0, "healthy").when(F.size("up") < k, "unrepairable").otherwise("repairable")).drop("live")


def status(stripes: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """stripe_id, survivors, dead, state (healthy, repairable, unrepairable). stripes: stripe_id, shards (array of shard_index, addr)."""
    own = _judged(stripes, live, k)
    return own.select("stripe_id", F.size("up").cast("long").alias("survivors"), F.size("dead").cast("long").alias("dead"), "state")


def plan(stripes: DataFrame, live: DataFrame, k: int) -> DataFrame:
    """Each dead shard of an unhealthy stripe with its new address: unused wanted ones in address order; null if the stripe can't be repaired.

    stripes: stripe_id, shards, desired (array of addresses). Dead shards beyond the addresses there are stay out of a repairable stripe's plan.
    """
    free = F.array_sort(F.array_except("desired", F.transform("up", lambda s: s["addr"])))
    own = _judged(stripes, live, k).filter("state <> 'healthy'").select("stripe_id", "state", F.col("dead").alias("d"), F.when(F.col("state") == "repairable", free).otherwise(F.array().cast("array<string>")).alias("f"))
    out = own.select("stripe_id", "state", F.inline(F.arrays_zip("d", "f"))).filter("d IS NOT NULL AND (f IS NOT NULL OR state = 'unrepairable')")
    return out.select("stripe_id", "d.shard_index", F.col("d.addr").alias("old_addr"), F.col("f").alias("new_addr"), "state")


def stats(stripes: DataFrame) -> DataFrame:
    """scanned, repairable, unrepairable of states."""
    return stripes.agg(F.count("*").alias("scanned"), F.count_if(F.col("state") == "repairable").alias("repairable"), F.count_if(F.col("state") == "unrepairable").alias("unrepairable"))


def run_stats(made: DataFrame) -> DataFrame:
    """stripes, repaired, failed, bytes of a repair run (made: stripe_id, shard_id, data): a stripe fails if one of its shards wasn't made."""
    by = made.groupBy("stripe_id").agg(F.bool_and(F.col("shard_id").isNotNull()).alias("ok"), F.sum(F.octet_length("data")).alias("n"))
    return by.agg(F.count("*").alias("stripes"), F.count_if("ok").alias("repaired"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"))
