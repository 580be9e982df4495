"""Merkle inventories, audits by digest, and the choice of repairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def bucket_digests(rows: DataFrame) -> DataFrame:
    """addr, idx, hash, n of the non-empty buckets: SHA-256 of the sorted ids, each followed by a newline; a bucket is an id's first byte."""
    idx = F.conv(F.substring("chunk_id", 1, 2), 16, 10).cast("int")
    held = rows.select("addr", "chunk_id").distinct().groupBy("addr", idx.alias("idx")).agg(F.array_sort(F.collect_list("chunk_id")).alias("ids"))
    return held.select("addr", "idx", F.sha2(F.concat(F.array_join("ids", "\n"), F.lit("\n")), 256).alias("hash"), F.size("ids").alias("n"))


def expected(refs: DataFrame) -> DataFrame:
    """addr, bucket, chunk_id of all references; those without an address or a whole id are skipped."""
    good = refs.filter("addr <> ''").filter(F.col("chunk_id").rlike("^[0-9a-f]{64}$"))
    return good.select("addr", F.conv(F.substring("chunk_id", 1, 2), 16, 10).cast("int").alias("bucket"), "chunk_id").distinct()


def roots(digests: DataFrame) -> DataFrame:
    """addr, root, total: SHA-256 over all 256 raw bucket digests in order."""
    by = digests.groupBy("addr").agg(F.map_from_entries(F.collect_list(F.struct("idx", "hash"))).alias("m"), F.sum("n").alias("total"))
    every = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.coalesce(F.element_at("m", i), F.lit(EMPTY)))
    return by.select("addr", F.sha2(F.unhex(F.array_join(every, "")), 256).alias("root"), "total")


def audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """addr, chunk_id, kind (missing, extra): ids of the buckets whose digests differ, and no others, are compared."""
    e, a = bucket_digests(expected), bucket_digests(actual)
    differ = e.join(a.select("addr", "idx", F.col("hash").alias("there")), ["addr", "idx"], "full_outer").filter("hash IS NULL OR there IS NULL OR hash <> there").select("addr", F.lpad(F.lower(F.hex("idx")), 2, "0").alias("prefix"))
    within = lambda df, flag: df.select("addr", "chunk_id").distinct().withColumn("prefix", F.substring("chunk_id", 1, 2)).join(differ, ["addr", "prefix"], "left_semi").select("addr", "chunk_id", F.lit(True).alias(flag))
    both = within(expected, "wanted").join(within(actual, "held"), ["addr", "chunk_id"], "full_outer")
    return both.filter("wanted IS NULL OR held IS NULL").select("addr", "chunk_id", F.when(F.col("held").isNull(), "missing").otherwise("extra").alias("kind"))


def report(expected: DataFrame, actual: DataFrame, nodes: DataFrame, unreachable: list[str] = ()) -> DataFrame:
    """A row a registered node: reachable, root equality, missing and extra counts."""
    diff = audit(expected, actual).groupBy("addr").agg(F.count_if(F.col("kind") == "missing").alias("missing"), F.count_if(F.col("kind") == "extra").alias("extra"))
    count = lambda df, name: df.select("addr", "chunk_id").distinct().groupBy("addr").agg(F.count("*").alias(name))
    out = nodes.select("addr").join(count(expected, "expected"), "addr", "left").join(count(actual, "actual"), "addr", "left").join(diff, "addr", "left")
    up = ~F.col("addr").isin(list(unreachable)) if unreachable else F.lit(True)
    zero = lambda c: F.when(up, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return out.select("addr", up.alias("reachable"), *[zero(c) for c in ("expected", "actual", "missing", "extra")])


def sources(targets: DataFrame, owners: DataFrame, missing: DataFrame, corrupt: DataFrame, reachable: DataFrame) -> DataFrame:
    """For each (chunk_id, addr) of targets the first owner (by address) that is another node, reachable, and neither lacks nor has spoilt the chunk."""
    bad = missing.select("addr", "chunk_id").unionByName(corrupt.select("addr", "chunk_id")).distinct()
    able = owners.select("chunk_id", "addr").distinct().join(bad, ["addr", "chunk_id"], "left_anti").join(F.broadcast(reachable.select("addr")), "addr", "left_semi").withColumnRenamed("addr", "owner")
    found = targets.join(able, "chunk_id", "left").filter("owner IS NULL OR owner <> addr").groupBy("chunk_id", "addr").agg(F.min("owner").alias("source"))
    return targets.join(found, ["chunk_id", "addr"], "left")


def classify(jobs: DataFrame, inline: bool = False) -> DataFrame:
    """jobs: addr, chunk_id, reason, source, ec and, if there, reachable. mode: skip, ec-inline or ec-deferred, no-source or replication."""
    up = F.col("reachable") if "reachable" in jobs.columns else F.lit(True)
    return jobs.withColumn("mode", F.when(~up, "skip").when(F.col("ec"), "ec-inline" if inline else "ec-deferred").when(F.col("source").isNull(), "no-source").otherwise("replication"))


def dry_run(jobs: DataFrame, inline: bool = False) -> DataFrame:
    """classify() with planned: what a run would do. Nothing is done, and no budget holds."""
    return classify(jobs, inline).withColumn("planned", F.col("mode").isin("replication", "ec-inline"))


def budgeted(jobs: DataFrame, budget: int, groups: list[str], order: list[str]) -> DataFrame:
    """Serial order by groups, then order, over all jobs: a job runs while fewer than budget before it have succeeded; 0 is no limit.

    jobs: mode, ok. groups lead the order and have few values (nodes, reasons, buckets): their totals, one row each, give each
    group's start, so no task orders all jobs. state: throttled, the mode of a job that copies nothing, repaired or failed.
    """
    good = (F.col("ok") & (F.col("mode") == "replication")).cast("int")
    span = (Window.unboundedPreceding, -1)
    firsts = jobs.groupBy(*groups).agg(F.sum(good).alias("n")).withColumn("first", F.coalesce(F.sum("n").over(Window.orderBy(*groups).rowsBetween(*span)), F.lit(0))).drop("n")
    own = F.coalesce(F.sum(good).over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(*span)), F.lit(0))
    out = jobs.withColumn("own", own).join(F.broadcast(firsts), groups).withColumn("before", F.col("first") + F.col("own")).drop("first", "own")
    return out.withColumn("state", F.when((F.lit(budget) > 0) & (F.col("before") >= budget), "throttled").when(F.col("mode") != "replication", F.col("mode")).when(F.col("ok"), "repaired").otherwise("failed"))


def stripe_repairs(shards: DataFrame, gone: DataFrame, spoilt: DataFrame) -> DataFrame:
    """One repair a stripe: stripe_id, dead (array of shard_index, addr, force), survivors (array of shard_index, addr).

    shards: stripe_id, shard_index, addr, shard_id; gone, spoilt: addr, shard_id that an audit misses, that a scrub found wrong. A spoilt
    shard is overwritten (force) and is no survivor; the new address is the old one.
    """
    flagged = shards.join(gone.select("addr", "shard_id").distinct().withColumn("gone", F.lit(True)), ["addr", "shard_id"], "left").join(spoilt.select("addr", "shard_id").distinct().withColumn("spoilt", F.lit(True)), ["addr", "shard_id"], "left")
    bad = F.col("gone").isNotNull() | F.col("spoilt").isNotNull()
    by = flagged.groupBy("stripe_id").agg(
        F.array_sort(F.collect_list(F.when(bad, F.struct("shard_index", "addr", F.col("gone").isNull().alias("force"))))).alias("dead"),
        F.array_sort(F.collect_list(F.when(~bad, F.struct("shard_index", "addr")))).alias("survivors"),
    )
    return by.filter(F.size("dead") > 0)


def scheduled(repairs: DataFrame, budget: int, spent: int, order: list[str]) -> DataFrame:
    """repairs with state: the first budget - spent in order are scheduled, the others throttled; a budget of 0 is no limit. At most budget rows are gathered."""
    if budget <= 0:
        return repairs.withColumn("state", F.lit("scheduled"))
    first = repairs.orderBy(*order).limit(max(0, budget - spent)).select(*order).withColumn("state", F.lit("scheduled"))
    return repairs.join(F.broadcast(first), order, "left").withColumn("state", F.coalesce("state", F.lit("throttled")))


#: Before and after every seq; the most ranges of sightings, and the most rows of theirs that the driver gathers.
NEVER, EVER, RANGES, GATHERED = -(1 << 63), (1 << 63) - 1, 1000, 2_000_000


def _linked(sightings: DataFrame, key: str, cuts: list[int]) -> DataFrame:
    """key, seq, __range (how many cuts are at or before seq), __prev (the key's sighting before, of any range), __next (the one after, in this range).

    Windows are of a key in one range, then of a row a range: no task sorts all sightings of a frequent key.
    """
    seq = F.col("seq").cast("long")
    within = F.lit(0)
    if cuts:
        known, steps = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        within = F.aggregate(steps, F.lit(0), lambda n, step: n + F.when(F.get(known, n + step - 1) <= seq, step).otherwise(0))
    own = Window.partitionBy("__range", key)
    every = sightings.filter("seq IS NOT NULL").select(key, "seq", within.alias("__range"))
    every = every.select("*", F.lag(seq).over(own.orderBy("seq")).alias("__prev"), F.lead(seq).over(own.orderBy("seq")).alias("__next"), F.max(seq).over(own).alias("__last"))
    heads = every.filter("__prev IS NULL").withColumn("__prev", F.lag("__last").over(Window.partitionBy(key).orderBy("__range")))
    return heads.unionByName(every.filter("__prev IS NOT NULL")).drop("__last")


def _in_order(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """The order of a range's rows by seq, seq and __prev in that order, and where each seq's rows begin, with the end."""
    seq = table.column("seq").to_numpy().astype(np.int64)
    order = np.argsort(seq, kind="stable")
    seq, prev = seq[order], table.column("__prev").fill_null(NEVER).to_numpy()[order]
    return order, seq, prev, [*np.unique(seq, return_index=True)[1].tolist(), len(seq)]


def _last_starts(table: pa.Table, cap: int) -> pa.Table:
    """__range, seq, prev, last, held of a range's first cap + 1 keys: if all were cleared at seq, the last clearing in the range and the keys held from there to its end.

    A sighting is new after a clearing at s if its key's sighting before is before s, so a window of whole seqs is moved along and keys are never compared.
    """
    order, seq, prev, begin = _in_order(table)
    heads = np.flatnonzero(prev < seq[0])[: cap + 1]
    after, n = table.column("__next").fill_null(EVER).to_numpy()[order].tolist(), len(begin) - 1
    value, before = seq[begin[:-1]].tolist(), prev.tolist()
    last, count, to, held, end = list(range(n)), [0] * n, [n] * n, 0, 0
    for i, s in enumerate(value):
        end = max(end, i)
        while end < n:
            more = 0
            for b in before[begin[end] : begin[end + 1]]:
                more += b < s
            if held + more > cap:
                break
            held, end = held + more, end + 1
        to[i], count[i] = end, held if end > i else cap + 1  # more than cap keys at one seq: no clearing helps
        if end > i:
            beyond = value[end] if end < n else EVER
            for a in after[begin[i] : begin[i + 1]]:
                held -= a >= beyond
    for i in reversed(range(n)):
        if i < to[i] < n:
            last[i] = last[to[i]]
    at = [last[i] for i in np.searchsorted(value, seq[heads]).tolist()]
    columns = [np.full(len(at), table.column("__range")[0].as_py(), np.int32), seq[heads], prev[heads], np.array([value[i] for i in at]), np.array([count[i] for i in at])]
    return pa.table(columns, names=["__range", "seq", "prev", "last", "held"])


def _alerts(table: pa.Table, cap: int, last: int, first: int) -> pa.Table:
    """The rows of a range that raise an alert: last is the clearing in force where it begins, first the range's own first one (EVER: none)."""
    order, seq, prev, begin = _in_order(table)
    before, starts, held = prev.tolist(), [last], 0
    for b, e in zip(begin, begin[1:]):
        s = int(seq[b])
        if s >= first:
            more = sum(x < starts[-1] for x in before[b:e])
            if s == first or held + more > cap:
                starts.append(s)
                held, more = 0, sum(x < s for x in before[b:e])
            held += more
    force = np.array(starts)[np.searchsorted(starts, seq, "right") - 1]
    return table.take(pa.array(order[prev < force]))


def first_seen(sightings: DataFrame, key: str, cap: int = 100_000, rows: int = 100_000) -> DataFrame:
    """key, seq of the sightings that raise an alert: a key's first, until cap keys are held; the next new key clears them and all count anew.

    sightings: key, seq (whole numbers, unique). Each clearing needs the one before it, so ranges of about rows sightings (more where there would
    be over 1,000 ranges, or over 2,000,000 rows to gather) tell in parallel where a chain of clearings that enters them leaves: it can enter only at
    a range's first cap + 1 keys. The driver follows the one chain from range to range, and each range lists its alerts: three passes over
    the sightings, whatever the number of alerts.
    At that bound ranges grow with the sightings, each held whole by one task: past 1e8 sightings for small caps, past 1.9e6 (19 ranges) for the default cap.
    """
    sightings = sightings.select(key, "seq")
    parts = ", ".join(f"{i / RANGES}D" for i in range(1, RANGES))
    seen = sightings.selectExpr("count(seq) AS n", f"percentile_approx(CAST(seq AS BIGINT), array({parts}), {10 * RANGES}) AS cuts").first()
    ranges = max(1, min(RANGES, -(-seen.n // rows), GATHERED // (cap + 1)))
    linked = _linked(sightings, key, sorted({seen.cuts[i * RANGES // ranges - 1] for i in range(1, ranges)}))
    found = linked.groupBy("__range").applyInArrow(lambda t: _last_starts(t, cap), "__range int, seq long, prev long, last long, held long").toArrow()
    found = found.sort_by([("__range", "ascending"), ("seq", "ascending")])
    ids, seq, prev, lasts, helds = (found.column(c).to_numpy() for c in ("__range", "seq", "prev", "last", "held"))
    entries, last, left = {}, NEVER + 1, 1
    for r, lo, hi in zip(*(x.tolist() for x in (np.unique(ids), *(np.searchsorted(ids, np.unique(ids), side) for side in ("left", "right"))))):
        new = seq[lo:hi][prev[lo:hi] < last]
        if len(new) < left:
            entries[r], left = (last, EVER), left - len(new)
            continue
        first = int(new[left - 1])
        at = lo + int(np.searchsorted(seq[lo:hi], first))
        entries[r], last, left = (last, first), int(lasts[at]), cap + 1 - int(helds[at])
        if left < 1:
            raise ValueError(f"more than {cap} keys at seq {last}")
    shape = linked.select(key, "seq").schema
    return linked.select(key, "seq", "__range", "__prev").groupBy("__range").applyInArrow(lambda t: _alerts(t, cap, *entries[t.column("__range")[0].as_py()]).select([key, "seq"]), shape)
