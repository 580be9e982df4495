"""A node's chunk inventory from its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import is_chunk_id


def chunk_id_of(path: Column) -> Column:
    """The id that a path ending in <two digits>/<the other 62> stands for; null for temporary and other files."""
    pattern = r"(?:^|/)([^/]{2})/([^/]{62})$"
    cid = F.concat(F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2))
    return F.when(is_chunk_id(cid), cid)


def inventory(spark: SparkSession, root: str, addr: str) -> DataFrame:
    """addr, chunk_id, size, mtime (seconds) of the chunk files under root/chunks; a folder without files gives no rows. The files' bytes are not read. An empty file, which Spark's file sources skip, is not listed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root.rstrip('/')}/chunks")
    rows = files.select(F.lit(addr).alias("addr"), chunk_id_of(F.col("path")).alias("chunk_id"), F.col("length").alias("size"), F.unix_seconds("modificationTime").alias("mtime"))
    return rows.filter("chunk_id IS NOT NULL")
