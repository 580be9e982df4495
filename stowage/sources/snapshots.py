"""Versioned tables: snapshots, reload, restore, seeding, and a log with monotone numbers.

A store is a folder with one Parquet folder a table and version, and a manifest to which each version adds its rows last. Only
what the manifest names exists for a reader, so a lost job leaves files that nobody reads and never half a version.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, name string, n_rows long, seq long"


def new_store(spark: SparkSession) -> str:
    """A new store's place in the folder that spark.checkpoint.dir names; where that is unset, on one machine in a temporary one; a cluster raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="stowage-")
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """version, name, n_rows, seq of each table of each version; empty for a store without one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/manifest")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")


def newest(spark: SparkSession, store: str) -> int:
    """The last version's number; 0 for none."""
    return manifest(spark, store).agg(F.max("version")).first()[0] or 0


def snapshot(tables: dict[str, DataFrame], store: str, seq: int = 0) -> int:
    """Writes tables as the store's next version, which stands for the log up to seq; returns its number."""
    spark = next(iter(tables.values())).sparkSession
    version, rows = newest(spark, store) + 1, []
    for name, frame in tables.items():
        folder = f"{store}/{name}/v{version}"
        frame.write.mode("overwrite").parquet(folder)
        rows.append((version, name, spark.read.schema(frame.schema).parquet(folder).count(), seq))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    return version


def load(spark: SparkSession, store: str, name: str, version: int | None = None) -> DataFrame:
    """A table of a version, the newest that has it unless one is given; an unknown one is an error."""
    known = manifest(spark, store).filter(F.col("name") == name)
    version = version or known.agg(F.max("version")).first()[0]
    if version is None or known.filter(F.col("version") == version).isEmpty():
        raise KeyError(f"no version {version} of {name}")
    return spark.read.parquet(f"{store}/{name}/v{version}")


def reload(spark: SparkSession, store: str, name: str, view: str) -> DataFrame:
    """Points view at the newest version; queries that run already keep the one that they began with."""
    load(spark, store, name).createOrReplaceTempView(view)
    return spark.table(view)


def restore(spark: SparkSession, store: str, version: int) -> int:
    """Makes an old version the newest by copying it, once its row counts agree with the manifest. The replaced one stays."""
    own = manifest(spark, store).filter(F.col("version") == version).collect()  # one row a table
    if not own:
        raise KeyError(f"no version {version}")
    tables = {r["name"]: load(spark, store, r["name"], version) for r in own}
    for r in own:
        if (n := tables[r["name"]].count()) != r.n_rows:
            raise ValueError(f"{r['name']} of version {version} has {n} rows, not {r.n_rows}")
    return snapshot(tables, store, own[0].seq)


def seed(nodes: DataFrame, store: str) -> int:
    """Replaces the node registry: the next version has these nodes alone."""
    return snapshot({"nodes": nodes}, store)


def append(rows: DataFrame, store: str, order: str) -> DataFrame:
    """Adds rows to the log, numbered on from its last number in the order of a column (unique); returns them with seq.

    Rows are dealt by ranges and written with their place in the range; ranges' counts, one row a range, give the offsets.
    """
    spark = rows.sparkSession
    last = manifest(spark, store).filter("name = 'log'").agg(F.max("seq")).first()[0] or 0
    version = newest(spark, store) + 1
    at = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(order).sortWithinPartitions(order).withColumns({"__range": F.shiftright(at, 33), "__at": at.bitwiseAND((1 << 33) - 1)})
    dealt.write.mode("overwrite").parquet(f"{store}/staged/v{version}")
    staged = spark.read.schema(dealt.schema).parquet(f"{store}/staged/v{version}")
    offsets, total = [], last
    for r in staged.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").toLocalIterator():
        offsets.append((r["__range"], total))
        total += r.n
    if total == last:
        return staged.select(F.lit(last).alias("seq"), *rows.columns)
    places = F.broadcast(spark.createDataFrame(offsets, "__range long, __first long"))
    snapshot({"log": staged.join(places, "__range").select((F.col("__first") + F.col("__at") + 1).alias("seq"), *rows.columns)}, store, total)
    return load(spark, store, "log", version)


def log(spark: SparkSession, store: str) -> DataFrame:
    """The log's segments that no truncation has ended, as one frame."""
    known = manifest(spark, store)
    ended = known.filter("name = 'cut'").agg(F.max("seq")).first()[0] or 0
    live = [r.version for r in known.filter((F.col("name") == "log") & (F.col("seq") > ended)).orderBy("version").toLocalIterator()]
    if not live:
        return load(spark, store, "log").limit(0)
    return spark.read.parquet(*(f"{store}/log/v{v}" for v in live)).filter(F.col("seq") > ended)


def truncate(spark: SparkSession, store: str, seq: int) -> int:
    """After a snapshot at seq: the log's rows up to it end, numbers go on. Returns the epoch, the number of truncations so far."""
    snapshot({"cut": spark.createDataFrame([(seq,)], "seq long")}, store, seq)
    return manifest(spark, store).filter("name = 'cut'").count()
