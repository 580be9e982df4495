"""What the operators of this subpackage share: tables in the cluster's shared folder, size-checked broadcasts, Arrow helpers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a join's side is broadcast; beyond it the join shuffles. The second bound is for joins with whole texts, which cost more to shuffle.
BROADCAST_BYTES, TEXTS_BROADCAST_BYTES = 8 << 20, 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir. Where that is unset, on one machine a new one is set; a cluster raises."""
    small_batches(spark)
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stowage-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder's place in the shared folder, deleted when the session's JVM ends."""
    folder = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path)
    system.deleteOnExit(path)
    return f"{folder}/data"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no more than a read."""
    folder = new_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def row_bytes(df: DataFrame) -> int:
    """What a row of df takes in a broadcast table, roughly."""
    size = {"bigint": 8, "int": 8, "double": 8, "boolean": 8}
    return 24 + sum(size.get(kind, 32 if kind in ("string", "binary") else 128) for _, kind in df.dtypes)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for a broadcast if it takes at most limit bytes (rows are counted here unless given); else as it is, for a shuffled join."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes(df) <= limit else df


def unused(name: str, columns: list[str]) -> str:
    """name, with underscores before it until none of the columns has it (upper and lower case count as equal)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, so that Python objects of few rows exist at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def give_back() -> None:
    """Returns the worker's freed memory to the system: the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def relieve(spark: SparkSession) -> None:
    """Has the executors' JVMs collect their garbage, so that the heap that a stage needed goes back to the system before the next one's workers start.

    One short task a core: an executor that gets none keeps its heap, and no result depends on it.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


#: The model that this worker's steps hold between tasks, by its function and arguments. Only this module's functions touch it: steps are
#: pickled, with copies of the values that they name.
HELD: dict = {}


def held(make: Callable) -> Callable:
    """make with its last result kept for the worker's next tasks, until a frugal step runs there that holds none."""

    @functools.wraps(make)
    def get(*key):
        name = (make.__module__, make.__qualname__, *key)
        if name not in HELD:
            HELD.clear()
            HELD[name] = make(*key)
        return HELD[name]

    return get


def let_go() -> None:
    """Frees what the worker's steps of other stages held."""
    if HELD:
        HELD.clear()
        gc.collect()
        give_back()


def frugal(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A step for mapInArrow that gives its freed memory back when it ends, and, unless it holds a model itself, lets go of the model of another when it begins.

    Workers outlive their stages: without this, each would hold every model that any stage before needed.
    """

    @functools.wraps(step)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        yield from step(batches)
        give_back()

    return run


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and the len + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


#: Rows and bytes of an Arrow batch at most, in the sessions that run these operators: rows here are whole texts, or blocks of them.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches of few rows and bytes, so that a worker and its JVM hold a few MB of text at a time (a longer row is a batch of its own)."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(name)
        if now.startswith("-") or not 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(now) <= most:
            spark.conf.set(name, str(most))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
