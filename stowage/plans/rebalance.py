"""Rebalancing: from where copies are to where placement wants them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def plan_chunks(chunks: DataFrame) -> DataFrame:
    """chunks: chunk_id, size, actual, desired (arrays). Rows with missing copies: missing and surplus, sorted; surplus alone plans nothing."""
    out = chunks.withColumn("missing", F.array_sort(F.array_except("desired", "actual"))).withColumn("surplus", F.array_sort(F.array_except("actual", "desired")))
    return out.filter(F.size("missing") > 0)


def plan_shards(stripes: DataFrame) -> DataFrame:
    """stripe_id, shard_index, shard_id, old_addr, new_addr: displaced shards in index order meet the unused wanted addresses in address order.

    stripes: stripe_id, shards (array of shard_index, shard_id, addr), desired (array of addresses). All of a stripe is in its row, so
    nothing is shuffled. Displaced shards without an address left stay out.
    """
    own = stripes.withColumn("held", F.transform("shards", lambda s: s["addr"]))
    own = own.select("stripe_id", F.filter(F.array_sort("shards"), lambda s: ~F.array_contains("desired", s["addr"])).alias("away"), F.array_sort(F.array_except("desired", "held")).alias("free"))
    return _met(own.withColumnRenamed("away", "rows")).select("stripe_id", "x.rows.shard_index", "x.rows.shard_id", F.col("x.rows.addr").alias("old_addr"), F.col("x.free").alias("new_addr")).filter("old_addr IS NOT NULL AND new_addr IS NOT NULL")


def _met(own: DataFrame) -> DataFrame:
    """One row x (rows, free) a place of both arrays; the shorter one's rest is null."""
    return own.withColumn("x", F.explode(F.arrays_zip("rows", "free")))


def gathered(shards: DataFrame, desired: DataFrame) -> DataFrame:
    """Rows of shards (stripe_id, shard_index, shard_id, addr) and of wanted addresses (stripe_id, addr) as plan_shards() takes them."""
    by = shards.groupBy("stripe_id").agg(F.array_sort(F.collect_list(F.struct("shard_index", "shard_id", "addr"))).alias("shards"))
    return by.join(desired.groupBy("stripe_id").agg(F.collect_set("addr").alias("desired")), "stripe_id")


def summary(objects: DataFrame, chunk_plan: DataFrame, shard_plan: DataFrame) -> DataFrame:
    """scanned (objects), chunk_moves, shard_moves of a whole plan."""
    counts = [x.agg(F.count("*").alias(name)) for x, name in ((objects, "scanned"), (chunk_plan, "chunk_moves"), (shard_plan, "shard_moves"))]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def update_replicas(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """objects (id, chunks: array of arrays of addresses) after changes (id, at, replicas), and ok: false, and nothing changed, where a change's at is no place of it.

    A later row of changes for the same place isn't expected; the version stays as it is.
    """
    by = changes.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "replicas"))).alias("new"))
    out = objects.join(by, "id", "left").withColumn("ok", F.coalesce(F.forall(F.map_keys("new"), lambda i: (i >= 0) & (i < F.size("chunks"))), F.lit(True)))
    return out.withColumn("chunks", F.when(F.col("ok") & F.col("new").isNotNull(), F.transform("chunks", lambda c, i: F.coalesce(F.element_at("new", i), c))).otherwise(F.col("chunks"))).drop("new")


def apply_chunks(plan: DataFrame, outcomes: DataFrame) -> DataFrame:
    """outcomes: chunk_id, addr, ok of every copy. All copied: (actual and desired) with the copies; else actual with those that worked."""
    done = outcomes.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("addr")))).alias("copied"), F.bool_and("ok").alias("all_ok"))
    kept = F.when(F.col("all_ok"), F.array_intersect("actual", "desired")).otherwise(F.col("actual"))
    return plan.join(done, "chunk_id").select("chunk_id", "size", "all_ok", F.size("copied").alias("n_copied"), F.array_sort(F.array_distinct(F.concat(kept, "copied"))).alias("replicas"))


def stats(applied: DataFrame) -> DataFrame:
    """migrated, failed, bytes copied."""
    return applied.agg(F.count_if("all_ok").alias("migrated"), F.count_if(~F.col("all_ok")).alias("failed"), F.sum(F.col("size") * F.col("n_copied")).alias("bytes"))
