"""The mutation log, liveness, and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed bounds of the duration histogram, in seconds.
LADDER = (0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
#: Fixed names of the log's operations, as they stand in its lines.
OPERATIONS = (
    "put_object",
    "delete_object",
    "create_bucket",
    "delete_bucket",
    "create_multipart_upload",
    "put_multipart_part",
    "complete_multipart_upload",
    "abort_multipart_upload",
    "add_runtime_dn",
    "remove_runtime_dn",
)


def since(log: DataFrame, seq: int) -> DataFrame:
    return log.filter(F.col("seq") > seq).orderBy("seq")


def until_corrupt(lines: DataFrame) -> DataFrame:
    """Rows before the first undecodable line. lines: at, ok."""
    bad = lines.filter(~F.col("ok")).agg(F.min("at").alias("bad"))
    return lines.crossJoin(F.broadcast(bad)).filter("bad IS NULL OR at < bad").drop("bad")


def fold(log: DataFrame) -> DataFrame:
    """Final state: each key's last operation, deletions left out."""
    last = log.groupBy("bucket", "key").agg(F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"), F.max_by("value", "seq").alias("value"))
    return last.filter("op <> 'delete_object'").select("bucket", "key", "seq", "value")


def merge(snapshot: DataFrame, log: DataFrame, seq: int) -> DataFrame:
    """A follower's state: the snapshot at seq with what came after it."""
    base = snapshot.select("bucket", "key", "seq", F.lit("put_object").alias("op"), "value")
    return fold(base.unionByName(log.filter(F.col("seq") > seq).select("bucket", "key", "seq", "op", "value")))


def follow(state: DataFrame, known: int, log: DataFrame, snapshot: DataFrame, at: int) -> tuple[DataFrame, int, str]:
    """A follower's next state (bucket, key, seq, value), the number up to which it stands, and whence it came: log or snapshot.

    state stands for the log up to known (0: never synced); log holds what the leader retains (seq, op, bucket, key, value); snapshot
    stands for the log up to at. The rows behind known are applied if the log has them without a gap and knows each operation; else the
    snapshot replaces the state. One row is fetched to decide.
    """
    seen = log.agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.count_if((F.col("seq") > known) & ~F.col("op").isin(*OPERATIONS)).alias("unknown")).first()
    if known > 0 and seen["first"] is not None and seen["first"] <= known + 1 and seen["unknown"] == 0:
        return merge(state, log, known), max(known, seen["last"]), "log"
    return snapshot, at, "snapshot"


def sync_status(runs: DataFrame) -> DataFrame:
    """addr, last_sync, last_size, last_err, total_syncs, total_errors of followers. runs: addr, at, size, err (null where it went well).

    last_err is empty once a later run went well. One aggregate with map-side combining.
    """
    good = F.col("err").isNull()
    by = runs.groupBy("addr").agg(F.max(F.when(good, F.col("at"))).alias("last_sync"), F.max_by("size", F.when(good, F.col("at"))).alias("last_size"), F.max_by("err", "at").alias("err"), F.count_if(good).alias("total_syncs"), F.count_if(~good).alias("total_errors"))
    return by.select("addr", "last_sync", "last_size", F.coalesce("err", F.lit("")).alias("last_err"), "total_syncs", "total_errors")


def group_commit(log: DataFrame, every: int) -> DataFrame:
    """start (seconds), batch, first: the rows that one tick of every seconds commits, and the time of the first of them. log: at (seconds)."""
    start = (F.floor(F.col("at") / every) * every).cast("long")
    return log.groupBy(start.alias("start")).agg(F.count("*").alias("batch"), F.min("at").alias("first"))


def commit_gauges(log: DataFrame, every: int, now: int) -> DataFrame:
    """One row: last_batch (rows of the last tick up to now that had any, else 0) and oldest_unsynced (age in seconds of the oldest row since the last tick, else 0)."""
    tick = now - now % every
    by = group_commit(log.filter(F.col("at") <= now), every)
    done = F.col("start") < tick
    return by.agg(F.coalesce(F.max_by(F.when(done, F.col("batch")), F.when(done, F.col("start"))), F.lit(0)).cast("long").alias("last_batch"), F.coalesce(F.lit(now) - F.min(F.when(~done, F.col("first"))), F.lit(0)).cast("long").alias("oldest_unsynced"))


def liveness(probes: DataFrame, threshold: int = 3) -> DataFrame:
    """addr, total_probes, consec_fails, healthy, latency_ms of the last probe: the fold of a node's probes in order of seq.

    Two aggregates with map-side combining: the last success, then the probes behind it. A row a node is broadcast between them.
    """
    by = probes.groupBy("addr").agg(F.count("*").alias("total_probes"), F.max_by("latency_ms", "seq").alias("latency_ms"), F.max(F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    behind = probes.join(F.broadcast(by.select("addr", "last_ok")), "addr").filter("last_ok IS NULL OR seq > last_ok").groupBy("addr").agg(F.count("*").alias("consec_fails"))
    out = by.join(behind, "addr", "left").withColumn("consec_fails", F.coalesce("consec_fails", F.lit(0)).cast("long"))
    return out.select("addr", "total_probes", "consec_fails", "latency_ms", "last_ok").withColumn("healthy", F.col("consec_fails") < threshold)


def state_of(log: DataFrame) -> DataFrame:
    """bucket, key, seq, version of the live keys: puts since the last delete count up, a logged completion brings its own version (logged_version) and later puts count on from it."""
    by = log.groupBy("bucket", "key").agg(F.max(F.when(F.col("op") == "delete_object", F.col("seq"))).alias("gone"), F.max(F.when(F.col("op") == "complete_multipart_upload", F.col("seq"))).alias("done"))
    own = log.filter(F.col("op").isin("put_object", "complete_multipart_upload")).join(by, ["bucket", "key"]).filter("gone IS NULL OR seq > gone")
    base = F.max(F.when(F.col("seq") == F.col("done"), F.col("logged_version")))
    after = F.count_if((F.col("op") == "put_object") & (F.col("done").isNull() | (F.col("done") < F.coalesce("gone", F.lit(0))) | (F.col("seq") > F.col("done"))))
    return own.groupBy("bucket", "key").agg(F.max("seq").alias("seq"), (F.coalesce(base, F.lit(0)) + after).cast("long").alias("version"))


def histogram(observations: DataFrame, bounds: tuple = LADDER) -> DataFrame:
    """le, n (cumulative), one row a bound and one for +Inf; one pass, conditional counts. observations: secs; negatives count as 0."""
    v = F.greatest("secs", F.lit(0.0))
    row = observations.agg(*[F.count_if(v <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count("*").alias("inf"))
    pairs = F.array(*[F.struct(F.lit(f"{b:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit("+Inf").alias("le"), F.col("inf").alias("n")))
    return row.select(F.explode(pairs).alias("x")).select("x.*")


def duration_sum(observations: DataFrame) -> DataFrame:
    """micros: the sum, each observation cut to microseconds."""
    return observations.agg(F.sum(F.floor(F.greatest("secs", F.lit(0.0)) * 1e6)).cast("long").alias("micros"))


def rendered(counters: DataFrame, name: str, label: str) -> DataFrame:
    """line: text of a counter by label, in order of the label."""
    return counters.orderBy(label).select(F.concat(F.lit(f"{name}{{{label}=\""), F.col(label), F.lit('"} '), F.col("n").cast("string")).alias("line"))
