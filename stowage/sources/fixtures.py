"""Storage tables derived from the test tables: objects, nodes, references, inventory, log, probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import split_fixed
from ..operators.placement import pick, references

NODES = [("dn1", "hot", "rack1"), ("dn2", "hot", "rack2"), ("dn3", "hot", "rack3"), ("dn4", "cold", "rack1"), ("dn5", "cold", "rack2"), ("dn6", "cold", "rack3")]
OLD = NODES[:5]
AS_OF, BASE_TIME, CHUNK, REPLICAS = 1706745600, 1704067200, 1024, 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_column() -> Column:
    return F.concat("lang", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".txt"))


def objects_raw(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("bucket"), key_column().alias("key"), F.encode("text", "UTF-8").alias("body"), "doc_id")


def nodes(spark) -> DataFrame:
    return spark.createDataFrame(NODES, "addr string, class string, domain string")


def chunks(spark, sf_dir) -> DataFrame:
    return split_fixed(objects_raw(spark, sf_dir), CHUNK).drop("data")


def distinct_chunks(spark, sf_dir) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("chunk_id").agg(F.max("size").alias("size"))


def placed(spark, sf_dir, on=OLD) -> DataFrame:
    """chunk_id, size, addrs of every distinct chunk."""
    return distinct_chunks(spark, sf_dir).withColumn("addrs", pick(F.col("chunk_id"), REPLICAS, on))


def refs(spark, sf_dir, on=OLD) -> DataFrame:
    """chunk_id, addr, replica_pos of every distinct chunk."""
    return references(distinct_chunks(spark, sf_dir), "chunk_id", pick(F.col("chunk_id"), REPLICAS, on))


def _drawn(tag: str) -> Column:
    return F.sha2(F.concat("chunk_id", "addr", F.lit(tag)), 256)


def inventory(spark, sf_dir) -> DataFrame:
    """addr, chunk_id, size, mtime: the old references less a sixteenth, plus as large a share of orphans on other nodes."""
    every = placed(spark, sf_dir).select("chunk_id", "size", "addrs", F.explode(F.array(*[F.lit(a) for a, _, _ in OLD])).alias("addr"))
    own = F.array_contains("addrs", F.col("addr"))
    kept = every.filter((own & (F.substring(_drawn("drop"), 1, 1) != "0")) | (~own & (F.substring(_drawn("orphan"), 1, 1) == "0")))
    return kept.select("addr", "chunk_id", "size", (F.lit(BASE_TIME) + F.conv(F.substring(_drawn("mtime"), 1, 5), 16, 10).cast("long") * 3).alias("mtime"))


def corrupt(spark, sf_dir) -> DataFrame:
    return inventory(spark, sf_dir).filter(F.substring(_drawn("rot"), 1, 2) == "00").select("addr", "chunk_id")


def wal(spark, sf_dir) -> DataFrame:
    """seq, ts, op, bucket, key."""
    op = F.when(F.col("event_type") == "error", "delete_object").otherwise("put_object")
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("seq"), "ts", op.alias("op"), F.lit("b").alias("bucket"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), "value")


def probes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("dn"), (F.col("user_id") % 6 + 1).cast("string")).alias("addr"), F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("ok"), F.floor("value").cast("long").alias("latency_ms"))


def parts(spark, sf_dir) -> DataFrame:
    """upload_id, part_number, etag, size."""
    body = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("upload_id"), (F.col("turn") + 1).alias("part_number"), F.concat(F.lit('"'), F.sha2(body, 256), F.lit('"')).alias("etag"), F.octet_length(body).cast("long").alias("size"))


#: The same tables for DuckDB.
SQL = """
objects_raw AS (SELECT source AS bucket, lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS key, encode(text) AS body, doc_id FROM documents),
nodes(addr, class, domain) AS (VALUES ('dn1','hot','rack1'),('dn2','hot','rack2'),('dn3','hot','rack3'),('dn4','cold','rack1'),('dn5','cold','rack2'),('dn6','cold','rack3')),
chunk_at AS (SELECT bucket, key, body, unnest(range(((octet_length(body) + 1023) // 1024)::BIGINT)) AS chunk_index FROM objects_raw),
chunks AS (SELECT bucket, key, chunk_index, sha256(body[chunk_index * 1024 + 1 : (chunk_index + 1) * 1024]) AS chunk_id, least(1024, octet_length(body) - chunk_index * 1024)::BIGINT AS size FROM chunk_at),
distinct_chunks AS (SELECT chunk_id, max(size) AS size FROM chunks GROUP BY 1),
scored AS (SELECT chunk_id, size, addr, class, domain, substr(sha256(chunk_id || '|' || addr), 1, 16) AS score FROM distinct_chunks, nodes),
old_refs AS (SELECT chunk_id, size, addr, pos FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, addr) - 1 AS pos FROM scored WHERE addr <> 'dn6') WHERE pos < 3),
new_refs AS (SELECT chunk_id, size, addr, pos FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, addr) - 1 AS pos FROM scored) WHERE pos < 3),
inventory AS (SELECT s.addr, s.chunk_id, s.size, 1704067200 + ('0x' || substr(sha256(s.chunk_id || s.addr || 'mtime'), 1, 5))::BIGINT * 3 AS mtime FROM scored s LEFT JOIN old_refs r ON r.chunk_id = s.chunk_id AND r.addr = s.addr
  WHERE s.addr <> 'dn6' AND ((r.addr IS NOT NULL AND substr(sha256(s.chunk_id || s.addr || 'drop'), 1, 1) <> '0') OR (r.addr IS NULL AND substr(sha256(s.chunk_id || s.addr || 'orphan'), 1, 1) = '0'))),
corrupt AS (SELECT addr, chunk_id FROM inventory WHERE substr(sha256(chunk_id || addr || 'rot'), 1, 2) = '00'),
wal AS (SELECT event_id + 1 AS seq, ts, CASE WHEN event_type = 'error' THEN 'delete_object' ELSE 'put_object' END AS op, 'b' AS bucket, 'user/' || user_id::VARCHAR AS key, value FROM events),
probes AS (SELECT 'dn' || (user_id % 6 + 1)::VARCHAR AS addr, event_id AS seq, event_type <> 'error' AS ok, floor(value)::BIGINT AS latency_ms FROM events),
parts AS (SELECT conv_id AS upload_id, turn + 1 AS part_number, '"' || sha256(encode(text)) || '"' AS etag, octet_length(encode(text))::BIGINT AS size FROM conversations)
"""
