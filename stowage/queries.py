"""The registered queries of the storage operators with the SQL that must agree with them.

A query's name begins with the operator family's letter and number. Every frame is flat: arrays leave as sorted text.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions import hashing as H
from .operators import catalog, chunking, erasure, logs, placement, signing
from .plans import audit, gc, rebalance, repair
from .sources import files, snapshots
from .sources import fixtures as X

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
K, M, SHARD = 4, 2, 256
CDC = chunking.ContentDefined(256, 1024, 4096, 11, 9, 0)


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {X.SQL.strip()}{sql}" if sql.lstrip().startswith(",") else f"WITH {X.SQL.strip()}\n{sql}"
        return f

    return keep


def joined(c) -> F.Column:
    return F.array_join(F.array_sort(c), ",")


# --- sources, scans, sinks


@query("a1_scan", "SELECT bucket, key, octet_length(body)::BIGINT AS size, doc_id FROM objects_raw")
def a1(spark, d):
    return X.objects_raw(spark, d).select("bucket", "key", F.octet_length("body").cast("long").alias("size"), "doc_id")


@query("a2_lookup", "SELECT bucket, key, sha256(body) AS digest FROM objects_raw WHERE bucket = 'src3' AND key = 'fr/00000003.txt'")
def a2(spark, d):
    return X.objects_raw(spark, d).filter("bucket = 'src3' AND key = 'fr/00000003.txt'").select("bucket", "key", F.sha2("body", 256).alias("digest"))


@query("a3_inventory_paths", "SELECT addr, chunk_id, size FROM inventory")
def a3(spark, d):
    """Ids rebuilt from chunks/<two digits>/<rest> paths; temporary and malformed names are ignored."""
    rows = X.inventory(spark, d)
    path = F.concat(F.lit("chunks/"), F.substring("chunk_id", 1, 2), F.lit("/"), F.expr("substring(chunk_id, 3)"))
    paths = rows.select("addr", "size", F.explode(F.array(path, F.concat(path, F.lit(".tmp")), F.lit("chunks/zz/other"))).alias("path"))
    return paths.withColumn("chunk_id", files.chunk_id_of(F.col("path"))).filter("chunk_id IS NOT NULL").select("addr", "chunk_id", "size")


@query("a4_node_listing", "SELECT chunk_id, size, mtime FROM inventory WHERE addr = 'dn2'")
def a4(spark, d):
    return X.inventory(spark, d).filter("addr = 'dn2'").select("chunk_id", "size", "mtime")


@query("a5_first_available", "SELECT r.chunk_id, arg_min(i.addr, r.pos) AS source FROM old_refs r LEFT JOIN inventory i ON i.chunk_id = r.chunk_id AND i.addr = r.addr WHERE i.addr IS NOT NULL GROUP BY 1")
def a5(spark, d):
    return X.refs(spark, d).join(X.inventory(spark, d).select("chunk_id", "addr"), ["chunk_id", "addr"]).groupBy("chunk_id").agg(F.min_by("addr", "replica_pos").alias("source"))


@query("a6_verified_put", "SELECT DISTINCT 'dn1' AS addr, chunk_id, size FROM chunks WHERE substr(chunk_id, 1, 1) <> 'f'")
def a6(spark, d):
    """Chunks whose id isn't their digest are refused; a chunk that is there stays once."""
    c = chunking.split_fixed(X.objects_raw(spark, d), X.CHUNK)
    claimed = F.when(F.col("chunk_id").startswith("f"), F.sha2(F.lit(b"x"), 256)).otherwise(F.col("chunk_id"))
    return c.withColumn("id", claimed).filter(F.sha2("data", 256) == F.col("id")).select(F.lit("dn1").alias("addr"), F.col("id").alias("chunk_id"), "size").dropDuplicates(["addr", "chunk_id"])


@query("a6_put_outcomes", """SELECT r.addr, r.chunk_id, r.size, CASE WHEN substr(r.chunk_id, 1, 1) = 'f' THEN 'mismatch' WHEN i.addr IS NOT NULL AND c.addr IS NULL THEN 'already-stored' ELSE 'stored' END AS status
FROM old_refs r LEFT JOIN inventory i ON i.addr = r.addr AND i.chunk_id = r.chunk_id LEFT JOIN corrupt c ON c.addr = r.addr AND c.chunk_id = r.chunk_id""")
def a6_outcomes(spark, d):
    """Every chunk is put where it belongs, twice; puts where a scrub found wrong bytes are forced, and bodies of ids that begin with f aren't the chunk's."""
    rows = X.placed(spark, d).select("chunk_id", "size", F.explode("addrs").alias("addr"), F.when(F.col("chunk_id").startswith("f"), F.sha2(F.lit(b"x"), 256)).otherwise(F.col("chunk_id")).alias("digest"))
    forced = rows.join(X.corrupt(spark, d).withColumn("rot", F.lit(True)), ["addr", "chunk_id"], "left").withColumn("force", F.col("rot").isNotNull())
    return chunking.put_chunks(X.inventory(spark, d), forced.unionByName(rows.withColumns({"rot": F.lit(None).cast("boolean"), "force": F.lit(False)})))


@query("a7_delete", "SELECT i.addr, i.chunk_id FROM inventory i LEFT JOIN corrupt c ON c.addr = i.addr AND c.chunk_id = i.chunk_id WHERE c.addr IS NULL")
def a7(spark, d):
    return X.inventory(spark, d).join(X.corrupt(spark, d), ["addr", "chunk_id"], "left_anti").select("addr", "chunk_id")


@query("a8_recount", "SELECT addr, count(*)::BIGINT AS chunks, sum(size)::BIGINT AS bytes FROM inventory GROUP BY addr")
def a8(spark, d):
    return X.inventory(spark, d).groupBy("addr").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


@query("a10_snapshot_retention", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events WHERE event_type = 'signup' AND user_id = 7) WHERE n > 7")
def a10(spark, d):
    """Snapshots beyond the newest seven."""
    e = X.table(spark, d, "events").filter("event_type = 'signup' AND user_id = 7")
    keep = e.orderBy(F.desc("ts"), F.desc("event_id")).limit(7).select("event_id")
    return e.join(F.broadcast(keep), "event_id", "left_anti").select("event_id")


@query("a11_snapshot_history", "SELECT 'snap-' || strftime(ts, '%Y%m%dT%H%M%S') || '.bin' AS name FROM events WHERE event_type = 'signup' AND user_id = 7 ORDER BY ts DESC")
def a11(spark, d):
    e = X.table(spark, d, "events").filter("event_type = 'signup' AND user_id = 7")
    names = e.select("ts", F.concat(F.lit("snap-"), F.date_format("ts", "yyyyMMdd'T'HHmmss"), F.lit(".bin")).alias("name"))
    return names.filter(F.col("name").rlike(r"^snap-\d{8}T\d{6}\.bin$")).orderBy(F.desc("ts")).select("name")


@query("a14_log_lines", "SELECT seq, op, key FROM wal")
def a14(spark, d):
    """The log through its JSON lines and back, with a fixed schema."""
    lines = X.wal(spark, d).select(F.to_json(F.struct("seq", "op", "bucket", "key")).alias("line"))
    return lines.select(F.from_json("line", "seq long, op string, bucket string, key string").alias("x")).select("x.seq", "x.op", "x.key")


@query("a15_json_report", """SELECT '{"addr":"' || addr || '","chunks":' || count(*)::VARCHAR || '}' AS line FROM inventory GROUP BY addr""")
def a15(spark, d):
    return X.inventory(spark, d).groupBy("addr").agg(F.count("*").alias("chunks")).select(F.to_json(F.struct("addr", "chunks")).alias("line"))


XML_PAGE = 50


@query("a16_xml_listing", f"""SELECT bucket, '<ListBucketResult><Name>' || bucket || '</Name><KeyCount>' || count(*)::VARCHAR || '</KeyCount>' || string_agg('<Contents><Key>' || replace(replace(key, '&', '&amp;'), '<', '&lt;') || '</Key><Size>' || size::VARCHAR || '</Size></Contents>', '' ORDER BY key) || '</ListBucketResult>' AS xml
FROM (SELECT bucket, key, octet_length(body) AS size, row_number() OVER (PARTITION BY bucket ORDER BY key) AS n FROM objects_raw) WHERE n <= {XML_PAGE} GROUP BY bucket""")
def a16(spark, d):
    """The first page of each bucket, as one document of its envelope; a page is of a bounded size, so the rest is cut before it is gathered."""
    w = Window.partitionBy("bucket").orderBy("key")
    rows = X.objects_raw(spark, d).select("bucket", "key", F.octet_length("body").alias("size"), F.row_number().over(w).alias("n")).filter(F.col("n") <= XML_PAGE)
    safe = F.regexp_replace(F.regexp_replace("key", "&", "&amp;"), "<", "&lt;")
    one = F.concat(F.lit("<Contents><Key>"), safe, F.lit("</Key><Size>"), F.col("size").cast("string"), F.lit("</Size></Contents>"))
    by = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("key", one.alias("x")))).alias("c"))
    return by.select("bucket", F.concat(F.lit("<ListBucketResult><Name>"), "bucket", F.lit("</Name><KeyCount>"), F.size("c").cast("string"), F.lit("</KeyCount>"), F.array_join(F.transform("c", lambda x: x["x"]), ""), F.lit("</ListBucketResult>")).alias("xml"))


@query("a16_xml_request", "SELECT upload_id, string_agg(part_number::VARCHAR || ':' || etag, ',' ORDER BY part_number) AS asked FROM parts GROUP BY 1")
def a16_request(spark, d):
    """Completion requests written as XML and parsed again."""
    rows = X.parts(spark, d).groupBy("upload_id").agg(F.array_sort(F.collect_list(F.struct("part_number", "etag"))).alias("p"))
    one = lambda x: F.concat(F.lit("<Part><PartNumber>"), x["part_number"].cast("string"), F.lit("</PartNumber><ETag>"), x["etag"], F.lit("</ETag></Part>"))
    xml = rows.select("upload_id", F.concat(F.lit("<CompleteMultipartUpload>"), F.array_join(F.transform("p", one), ""), F.lit("</CompleteMultipartUpload>")).alias("xml"))
    asked = xml.select("upload_id", F.from_xml("xml", "Part array<struct<PartNumber: bigint, ETag: string>>").alias("r"))
    return asked.select("upload_id", F.array_join(F.transform("r.Part", lambda x: F.concat(x["PartNumber"].cast("string"), F.lit(":"), x["ETag"])), ",").alias("asked"))


# --- chunking and dedup


@query("b1_fixed_chunks", "SELECT bucket, key, chunk_index::INT AS chunk_index, chunk_id, size FROM chunks")
def b1(spark, d):
    return X.chunks(spark, d)


@query("b3_content_defined_chunks")
def b3(spark, d):
    return chunking.split_content(X.objects_raw(spark, d), CDC)


@query("b6_join_chunks", "SELECT bucket, key, sha256(body) AS digest, octet_length(body)::BIGINT AS size, true AS sha_ok, true AS size_ok FROM objects_raw WHERE octet_length(body) > 0")
def b6(spark, d):
    out = chunking.join_chunks(chunking.split_fixed(X.objects_raw(spark, d), X.CHUNK))
    return out.select("bucket", "key", F.sha2("body", 256).alias("digest"), "size", "sha_ok", "size_ok")


@query("b8_valid_ids", "SELECT addr, count(*) FILTER (regexp_full_match(chunk_id, '[0-9a-f]{64}'))::BIGINT AS valid, count(*) FILTER (regexp_full_match(upper(chunk_id), '[0-9a-f]{64}'))::BIGINT AS upper_valid FROM inventory GROUP BY addr")
def b8(spark, d):
    return X.inventory(spark, d).groupBy("addr").agg(F.count_if(H.is_chunk_id(F.col("chunk_id"))).alias("valid"), F.count_if(H.is_chunk_id(F.upper("chunk_id"))).alias("upper_valid"))


@query("b9_distinct_chunks", "SELECT chunk_id, size FROM distinct_chunks")
def b9(spark, d):
    return X.distinct_chunks(spark, d)


@query("b10_dedup_stats", "SELECT sum(n)::BIGINT AS total_refs, count(*)::BIGINT AS unique_chunks, (count(*) FILTER (n > 1))::BIGINT AS shared_chunks, sum(n * size)::BIGINT AS total_bytes, sum(size)::BIGINT AS unique_bytes FROM (SELECT chunk_id, count(*) AS n, max(size) AS size FROM chunks GROUP BY 1)")
def b10(spark, d):
    return chunking.dedup_stats(X.chunks(spark, d))


@query("b11_etags", "SELECT bucket, key, '\"' || sha256(body) || '\"' AS etag FROM objects_raw")
def b11(spark, d):
    return X.objects_raw(spark, d).select("bucket", "key", H.etag(F.col("body")).alias("etag"))


# --- placement


@query("c1_scores", "SELECT chunk_id, addr, score FROM scored")
def c1(spark, d):
    return X.distinct_chunks(spark, d).crossJoin(F.broadcast(X.nodes(spark))).select("chunk_id", "addr", H.score(F.col("chunk_id"), F.col("addr")).alias("score"))


@query("c2_pick", "SELECT chunk_id, addr, pos::INT AS replica_pos FROM old_refs")
def c2(spark, d):
    return X.refs(spark, d).select("chunk_id", "addr", "replica_pos")


DOMAIN = """, dom AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, domain ORDER BY score DESC, addr) AS d FROM scored),
by_domain AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY d > 1, score DESC, addr) AS r FROM dom)
"""


@query("c3_pick_by_domain", DOMAIN + "SELECT chunk_id, string_agg(addr, ',' ORDER BY r) AS addrs FROM by_domain WHERE r <= 4 GROUP BY 1")
def c3(spark, d):
    return X.distinct_chunks(spark, d).select("chunk_id", F.array_join(placement.pick_by_domain(F.col("chunk_id"), 4, X.NODES), ",").alias("addrs"))


@query("c4_place_chunk", DOMAIN + "SELECT chunk_id, string_agg(addr, ',' ORDER BY r) AS addrs FROM by_domain WHERE r <= 3 GROUP BY 1")
def c4(spark, d):
    return X.distinct_chunks(spark, d).select("chunk_id", F.array_join(placement.pick_by_domain(F.col("chunk_id"), min(3, len(X.NODES)), X.NODES), ",").alias("addrs"))


@query("c5_place_stripe", DOMAIN + "SELECT chunk_id, string_agg(addr, ',' ORDER BY r) AS addrs FROM by_domain WHERE r <= 6 GROUP BY 1")
def c5(spark, d):
    return X.distinct_chunks(spark, d).select("chunk_id", F.array_join(placement.pick_by_domain(F.col("chunk_id"), K + M, X.NODES), ",").alias("addrs"))


@query("c6_place_in_class", "SELECT chunk_id, string_agg(addr, ',' ORDER BY score DESC, addr) AS addrs FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, addr) AS r FROM scored WHERE class = 'hot') WHERE r <= 2 GROUP BY 1")
def c6(spark, d):
    return X.distinct_chunks(spark, d).select("chunk_id", F.array_join(placement.pick(F.col("chunk_id"), 2, [x for x in X.NODES if x[1] == "hot"]), ",").alias("addrs"))


@query("c7_class_preferred", DOMAIN + """, hot AS (SELECT chunk_id, string_agg(addr, ',' ORDER BY score DESC, addr) AS hot3 FROM scored WHERE class = 'hot' GROUP BY 1)
SELECT chunk_id, hot3, string_agg(addr, ',' ORDER BY r) AS hot4 FROM by_domain JOIN hot USING (chunk_id) WHERE r <= 4 GROUP BY 1, 2""")
def c7(spark, d):
    """Three copies fit the hot class; four don't, so all nodes are used by domain."""
    c = F.col("chunk_id")
    return X.distinct_chunks(spark, d).select("chunk_id", F.array_join(placement.pick_class(c, 3, X.NODES, "hot"), ",").alias("hot3"), F.array_join(placement.pick_class(c, 4, X.NODES, "hot"), ",").alias("hot4"))


@query("c8_simulation", """, k AS (SELECT 'chunk-' || i::VARCHAR AS k FROM range(10000) t(i)), s AS (SELECT k, addr, substr(sha256(k || '|' || addr), 1, 16) AS score FROM k, nodes),
o AS (SELECT k, addr FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, addr) AS r FROM s WHERE addr <> 'dn6') WHERE r <= 3), w AS (SELECT k, addr FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, addr) AS r FROM s) WHERE r <= 3),
mv AS (SELECT count(*) AS moved FROM (SELECT k, string_agg(addr, ',' ORDER BY addr) AS a FROM o GROUP BY 1) x JOIN (SELECT k, string_agg(addr, ',' ORDER BY addr) AS b FROM w GROUP BY 1) y USING (k) WHERE a <> b)
SELECT n.addr, (SELECT count(*) FROM o WHERE o.addr = n.addr)::BIGINT AS copies_before, (SELECT count(*) FROM w WHERE w.addr = n.addr)::BIGINT AS copies_after, (SELECT moved FROM mv)::BIGINT AS moved FROM nodes n""")
def c8(spark, d):
    return placement.simulate(10_000, X.OLD, X.NODES, 3, spark)


@query("c9_nodes_by_class", "SELECT class, count(*)::BIGINT AS n, string_agg(addr, ',' ORDER BY addr) AS addrs, count(DISTINCT domain)::BIGINT AS domains FROM nodes GROUP BY class")
def c9(spark, d):
    return X.nodes(spark).groupBy("class").agg(F.count("*").alias("n"), joined(F.collect_list("addr")).alias("addrs"), F.count_distinct("domain").alias("domains"))


# --- erasure coding

@query("d1_products", """SELECT a::INT AS a, b::INT AS b, bit_xor(CASE WHEN (b >> s) & 1 = 1 THEN x ELSE 0 END)::INT AS p FROM (
  SELECT a, b, s, list_reduce(list_prepend(a, range(s)), lambda v, i: CASE WHEN v & 128 = 128 THEN xor((v << 1), 285) & 255 ELSE v << 1 END) AS x FROM range(256) ta(a), range(256) tb(b), range(8) ts(s)) GROUP BY 1, 2""")
def d1(spark, d):
    return erasure.gf_rows(spark)


@query("d3_encoding_matrix", "SELECT * FROM (VALUES (4, 0, '27,28,18,20'), (4, 1, '28,27,20,18'), (6, 0, '7,6,5,4,3,2'), (6, 1, '6,7,4,5,2,3'), (6, 2, '160,223,223,183,254,232')) t(k, p, coefs)")
def d3(spark, d):
    rows = [(k, p, ",".join(map(str, row))) for k, m in ((4, 2), (6, 3)) for p, row in enumerate(erasure.encoding_matrix(k, m)[k:])]
    return spark.createDataFrame(rows, "k int, p int, coefs string")


STRIPES = """, stripe_at AS (SELECT bucket, key, body, unnest(range(((octet_length(body) + 1023) // 1024)::BIGINT)) AS stripe_index FROM objects_raw),
raw AS (SELECT bucket, key, stripe_index, body[stripe_index * 1024 + 1 : (stripe_index + 1) * 1024] AS raw FROM stripe_at),
stripes AS (SELECT bucket, key, stripe_index, octet_length(raw)::INT AS data_len, unhex(rpad(hex(raw), 2048, '0')) AS data, sha256(unhex(rpad(hex(raw), 2048, '0'))) AS stripe_id FROM raw)
"""


def _stripes(spark, d):
    return erasure.stripes(X.objects_raw(spark, d), K, SHARD)


PARITY = STRIPES + """, few AS (SELECT DISTINCT stripe_id, data FROM stripes), coef(p, c, coef) AS (VALUES (0,0,27),(0,1,28),(0,2,18),(0,3,20),(1,0,28),(1,1,27),(1,2,20),(1,3,18)),
mul AS (SELECT a, b, bit_xor(CASE WHEN (b >> s) & 1 = 1 THEN x ELSE 0 END)::INT AS p FROM (SELECT a, b, s, list_reduce(list_prepend(a, range(s)), lambda v, i: CASE WHEN v & 128 = 128 THEN xor((v << 1), 285) & 255 ELSE v << 1 END) AS x FROM (SELECT DISTINCT coef::BIGINT AS a FROM coef), range(256) tb(b), range(8) ts(s)) GROUP BY 1, 2),
bts AS (SELECT stripe_id, i // 256 AS c, i % 256 AS pos, ('0x' || hex(data[i + 1 : i + 1]))::INT AS b FROM few, range(1024) t(i)),
par AS (SELECT stripe_id, (4 + p)::INT AS shard_index, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY pos))) AS shard_id FROM (SELECT stripe_id, coef.p AS p, pos, bit_xor(mul.p) AS v FROM bts JOIN coef USING (c) JOIN mul ON mul.a = coef.coef AND mul.b = bts.b GROUP BY 1, 2, 3) GROUP BY 1, 2)
"""


@query("d5_parity", PARITY + "SELECT stripe_id, shard_index, shard_id FROM par")
def d5(spark, d):
    """Parity shards' ids of every distinct stripe."""
    return erasure.shards(_stripes(spark, d), K, M).filter(F.col("shard_index") >= K).select("stripe_id", "shard_index", "shard_id")


@query("d6_reconstruct", STRIPES + ", one AS (SELECT DISTINCT stripe_id FROM stripes) SELECT stripe_id, stripe_id AS rebuilt_id, (substr(stripe_id, 1, 1) < '8') AS degraded FROM one")
def d6(spark, d):
    """Half of the stripes lose data shards 0 and 2; what is rebuilt has the stripe's digest."""
    s = erasure.shards(_stripes(spark, d), K, M)
    held = s.filter(~(F.col("shard_index").isin(0, 2) & (F.substring("stripe_id", 1, 1) < "8")))
    return erasure.rebuilt(held, K, M).select("stripe_id", F.sha2("data", 256).alias("rebuilt_id"), "degraded")


@query("d7_stripes", STRIPES + "SELECT bucket, key, stripe_index::INT AS stripe_index, stripe_id, data_len FROM stripes")
def d7(spark, d):
    return _stripes(spark, d).select("bucket", "key", "stripe_index", "stripe_id", "data_len")


CODES = "(VALUES ('4+2'), (' 6+3 '), ('0+2'), ('4+'), ('x+2'), ('4+2+1'), ('')) t(code)"


@query("d8_content_stripes")
def d8(spark, d):
    """Stripes of content-defined chunks, each padded to a multiple of K."""
    chunks = chunking.split_content(X.objects_raw(spark, d), CDC, data=True)
    return erasure.content_stripes(chunks, K).select("bucket", "key", "stripe_index", "data_len", F.octet_length("data").alias("padded"), "stripe_id")


@query("d9_parse_code", f"SELECT code, CASE WHEN ok THEN k END AS k, CASE WHEN ok THEN m END AS m FROM (SELECT *, coalesce(n = 2 AND k > 0 AND m > 0, false) AS ok FROM (SELECT code, len(string_split(trim(code), '+')) AS n, try_cast(trim(string_split(trim(code), '+')[1]) AS INT) AS k, try_cast(trim(string_split(trim(code), '+')[2]) AS INT) AS m FROM {CODES}))")
def d9(spark, d):
    rows = spark.createDataFrame([("4+2",), (" 6+3 ",), ("0+2",), ("4+",), ("x+2",), ("4+2+1",), ("",)], "code string")
    k, m = erasure.parse_code(F.col("code"))
    return rows.select("code", k.alias("k"), m.alias("m"))


SHARD_AT = STRIPES + """, ids AS (SELECT DISTINCT stripe_id FROM stripes), sc AS (SELECT stripe_id, addr, domain, substr(sha256(stripe_id || '|' || addr), 1, 16) AS score FROM ids, nodes),
sd AS (SELECT *, row_number() OVER (PARTITION BY stripe_id, domain ORDER BY score DESC, addr) AS d FROM sc),
want AS (SELECT stripe_id, addr, (row_number() OVER (PARTITION BY stripe_id ORDER BY d > 1, score DESC, addr) - 1)::INT AS shard_index FROM sd)
"""


def _placed(spark, d):
    """stripe_id, want (addresses by shard index) of every distinct stripe."""
    return _stripes(spark, d).select("stripe_id").distinct().select("stripe_id", placement.pick_by_domain(F.col("stripe_id"), K + M, X.NODES).alias("want"))


def _shard_rows(spark, d):
    """stripe_id, shard_index, addr of every distinct stripe."""
    return _placed(spark, d).select("stripe_id", F.posexplode("want").alias("shard_index", "addr"))


def _in_shards(addr, **more):
    """want as an array of shards, each at addr(index, wanted address)."""
    return F.transform("want", lambda x, i: F.struct(i.alias("shard_index"), *(f(i).alias(n) for n, f in more.items()), addr(i, x).alias("addr")))


@query("d10_read_status", SHARD_AT + "SELECT stripe_id, (count(*) FILTER (addr NOT IN ('dn1', 'dn4', 'dn5')) >= 4) AS readable, bool_or(shard_index < 4 AND addr IN ('dn1', 'dn4', 'dn5')) AS degraded FROM want GROUP BY 1")
def d10(spark, d):
    down = F.col("addr").isin("dn1", "dn4", "dn5")
    return _shard_rows(spark, d).groupBy("stripe_id").agg((F.count_if(~down) >= K).alias("readable"), F.bool_or((F.col("shard_index") < K) & down).alias("degraded"))


@query("d10_read_bodies", SHARD_AT + "SELECT s.bucket, s.key, sha256(any_value(o.body)) AS digest, bool_or(w.g) AS degraded FROM stripes s JOIN objects_raw o ON o.bucket = s.bucket AND o.key = s.key JOIN (SELECT stripe_id, bool_or(shard_index < 4 AND addr IN ('dn1', 'dn4')) AS g FROM want GROUP BY 1) w ON w.stripe_id = s.stripe_id GROUP BY 1, 2")
def d10_bodies(spark, d):
    """Bodies read with two of six nodes down and a shard of others spoilt: what is lost is rebuilt, and padding trimmed."""
    stripes = _stripes(spark, d)
    up = _shard_rows(spark, d).filter(~F.col("addr").isin("dn1", "dn4"))
    held = erasure.shards(stripes, K, M).join(up.select("stripe_id", "shard_index"), ["stripe_id", "shard_index"])
    bodies = erasure.read_bodies(stripes.select("bucket", "key", "stripe_index", "stripe_id", "data_len"), held, K, M)
    return bodies.select("bucket", "key", F.sha2("body", 256).alias("digest"), "degraded")


@query("d11_degraded_reads", SHARD_AT + "SELECT count(*)::BIGINT AS reads, (count(*) FILTER (g))::BIGINT AS degraded FROM (SELECT stripe_id, bool_or(shard_index < 4 AND addr = 'dn2') AS g FROM want GROUP BY 1)")
def d11(spark, d):
    by = _shard_rows(spark, d).groupBy("stripe_id").agg(F.bool_or((F.col("shard_index") < K) & (F.col("addr") == "dn2")).alias("g"))
    return by.agg(F.count("*").alias("reads"), F.count_if("g").alias("degraded"))


# --- rebalance


def _moves(spark, d):
    c = F.col("chunk_id")
    rows = X.distinct_chunks(spark, d).select("chunk_id", "size", placement.pick(c, 3, X.OLD).alias("actual"), placement.pick(c, 3, X.NODES).alias("desired"))
    return rebalance.plan_chunks(rows)


MOVES = """, m AS (SELECT n.chunk_id, string_agg(n.addr, ',' ORDER BY n.addr) AS missing FROM new_refs n LEFT JOIN old_refs o ON o.chunk_id = n.chunk_id AND o.addr = n.addr WHERE o.addr IS NULL GROUP BY 1),
s AS (SELECT o.chunk_id, string_agg(o.addr, ',' ORDER BY o.addr) AS surplus FROM old_refs o LEFT JOIN new_refs n ON n.chunk_id = o.chunk_id AND n.addr = o.addr WHERE n.addr IS NULL GROUP BY 1),
plan AS (SELECT c.chunk_id, c.size, missing, surplus FROM distinct_chunks c JOIN m USING (chunk_id) LEFT JOIN s USING (chunk_id)),
outc AS (SELECT n.chunk_id, n.addr, substr(n.chunk_id, 2, 1) <> '3' AS ok FROM new_refs n LEFT JOIN old_refs o ON o.chunk_id = n.chunk_id AND o.addr = n.addr WHERE o.addr IS NULL),
done AS (SELECT chunk_id, bool_and(ok) AS all_ok, count(*) FILTER (ok) AS n_copied FROM outc GROUP BY 1),
after AS (SELECT DISTINCT chunk_id, addr FROM (SELECT o.chunk_id, o.addr FROM old_refs o JOIN done USING (chunk_id) LEFT JOIN new_refs n ON n.chunk_id = o.chunk_id AND n.addr = o.addr WHERE NOT all_ok OR n.addr IS NOT NULL UNION ALL SELECT chunk_id, addr FROM outc WHERE ok))
"""


@query("e2_rebalance_plan", MOVES + "SELECT chunk_id, size, missing, coalesce(surplus, '') AS surplus FROM plan")
def e2(spark, d):
    return _moves(spark, d).select("chunk_id", "size", F.array_join("missing", ",").alias("missing"), F.array_join("surplus", ",").alias("surplus"))


SHARD_MOVES = SHARD_AT + """, act AS (SELECT stripe_id, shard_index, CASE WHEN shard_index IN (1, 3) AND substr(stripe_id, 1, 1) < '8' THEN 'dn' || (shard_index + 6)::VARCHAR ELSE addr END AS addr FROM want),
disp AS (SELECT a.*, row_number() OVER (PARTITION BY a.stripe_id ORDER BY a.shard_index) AS r FROM act a LEFT JOIN want w ON w.stripe_id = a.stripe_id AND w.addr = a.addr WHERE w.addr IS NULL),
free AS (SELECT w.stripe_id, w.addr, row_number() OVER (PARTITION BY w.stripe_id ORDER BY w.addr) AS r FROM want w LEFT JOIN act a ON w.stripe_id = a.stripe_id AND w.addr = a.addr WHERE a.addr IS NULL)
"""


def _displaced(spark, d):
    """stripe_id, shards (as they are), desired, of every distinct stripe: one row each."""
    away = lambda i: i.isin(1, 3) & (F.substring("stripe_id", 1, 1) < "8")
    shards = _in_shards(lambda i, x: F.when(away(i), F.concat(F.lit("dn"), (i + 6).cast("string"))).otherwise(x), shard_id=lambda i: F.sha2(F.concat("stripe_id", i.cast("string")), 256))
    return _placed(spark, d).select("stripe_id", shards.alias("shards"), F.col("want").alias("desired"))


@query("e3_shard_moves", SHARD_MOVES + "SELECT d.stripe_id, d.shard_index, d.addr AS old_addr, f.addr AS new_addr FROM disp d JOIN free f ON f.stripe_id = d.stripe_id AND f.r = d.r")
def e3(spark, d):
    return rebalance.plan_shards(_displaced(spark, d)).drop("shard_id")


@query("e1_plan_summary", MOVES + SHARD_MOVES + "SELECT (SELECT count(*) FROM objects_raw)::BIGINT AS scanned, (SELECT count(*) FROM plan)::BIGINT AS chunk_moves, (SELECT count(*) FROM disp d JOIN free f ON f.stripe_id = d.stripe_id AND f.r = d.r)::BIGINT AS shard_moves")
def e1(spark, d):
    return rebalance.summary(X.objects_raw(spark, d), _moves(spark, d), rebalance.plan_shards(_displaced(spark, d)))


LABELLED = """, lab AS (SELECT chunk_id, size, CASE WHEN substr(chunk_id, 1, 1) < '8' THEN 'hot' WHEN substr(chunk_id, 1, 1) < 'c' THEN 'none' ELSE '' END AS label, CASE WHEN substr(chunk_id, 2, 1) < '4' THEN 2 ELSE 3 END AS n FROM distinct_chunks),
act AS (SELECT l.chunk_id, o.addr FROM lab l JOIN old_refs o USING (chunk_id) WHERE o.pos < l.n),
dm AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, domain ORDER BY score DESC, addr) AS d FROM scored),
bd AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY d > 1, score DESC, addr) AS r FROM dm), hr AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, addr) AS r FROM scored WHERE class = 'hot'),
wish AS (SELECT l.chunk_id, hr.addr FROM lab l JOIN hr USING (chunk_id) WHERE label = 'hot' AND hr.r <= l.n UNION ALL SELECT l.chunk_id, bd.addr FROM lab l JOIN bd USING (chunk_id) WHERE label <> 'hot' AND bd.r <= 3),
mi AS (SELECT w.chunk_id, string_agg(w.addr, ',' ORDER BY w.addr) AS missing FROM wish w LEFT JOIN act a ON a.chunk_id = w.chunk_id AND a.addr = w.addr WHERE a.addr IS NULL GROUP BY 1),
su AS (SELECT a.chunk_id, string_agg(a.addr, ',' ORDER BY a.addr) AS surplus FROM act a LEFT JOIN wish w ON a.chunk_id = w.chunk_id AND a.addr = w.addr WHERE w.addr IS NULL GROUP BY 1)
"""


@query("e2_class_plan", LABELLED + "SELECT l.chunk_id, l.label, missing, coalesce(surplus, '') AS surplus FROM lab l JOIN mi USING (chunk_id) LEFT JOIN su USING (chunk_id)")
def e2_class(spark, d):
    """Chunks of labelled objects move within their class, as many copies as they have; unlabelled ones, and those of a class that is too small, by domain."""
    c, first = F.col("chunk_id"), F.substring("chunk_id", 1, 1)
    label = F.when(first < "8", "hot").when(first < "c", "none").otherwise("")
    rows = X.distinct_chunks(spark, d).select("chunk_id", "size", label.alias("label"), F.slice(placement.pick(c, 3, X.OLD), F.lit(1), F.when(F.substring("chunk_id", 2, 1) < "4", 2).otherwise(3)).alias("actual"))
    rows = rows.withColumn("desired", placement.pick_labelled(c, F.col("label"), F.size("actual"), 3, 3, X.NODES))
    return rebalance.plan_chunks(rows).select("chunk_id", "label", F.array_join("missing", ",").alias("missing"), F.array_join("surplus", ",").alias("surplus"))


def _outcomes(plan):
    return plan.select("chunk_id", F.explode("missing").alias("addr"), (F.substring("chunk_id", 2, 1) != "3").alias("ok"))


@query("e4_apply_moves", MOVES + "SELECT chunk_id, string_agg(addr, ',' ORDER BY addr) AS replicas, all_ok FROM after JOIN done USING (chunk_id) GROUP BY chunk_id, all_ok")
def e4(spark, d):
    plan = _moves(spark, d)
    return rebalance.apply_chunks(plan, _outcomes(plan)).select("chunk_id", F.array_join("replicas", ",").alias("replicas"), "all_ok")


@query("e5_apply_shards", SHARD_MOVES + "SELECT a.stripe_id, a.shard_index, CASE WHEN f.addr IS NOT NULL AND substr(a.stripe_id, 2, 1) <> '3' THEN f.addr ELSE a.addr END AS addr FROM act a LEFT JOIN disp d ON d.stripe_id = a.stripe_id AND d.shard_index = a.shard_index LEFT JOIN free f ON f.stripe_id = d.stripe_id AND f.r = d.r")
def e5(spark, d):
    stripes = _displaced(spark, d)
    plan = rebalance.plan_shards(stripes).select("stripe_id", "shard_index", "new_addr")
    ok = F.col("new_addr").isNotNull() & (F.substring("stripe_id", 2, 1) != "3")
    actual = stripes.select("stripe_id", F.inline("shards"))
    return actual.join(plan, ["stripe_id", "shard_index"], "left").select("stripe_id", "shard_index", F.when(ok, F.col("new_addr")).otherwise(F.col("addr")).alias("addr"))


@query("e6_move_stats", MOVES + "SELECT (count(*) FILTER (all_ok))::BIGINT AS migrated, (count(*) FILTER (NOT all_ok))::BIGINT AS failed, sum(size * n_copied)::BIGINT AS bytes FROM plan JOIN done USING (chunk_id)")
def e6(spark, d):
    plan = _moves(spark, d)
    return rebalance.stats(rebalance.apply_chunks(plan, _outcomes(plan)))


# --- garbage collection


@query("f1_claimed", "SELECT DISTINCT chunk_id, addr FROM old_refs")
def f1(spark, d):
    return gc.claimed(X.refs(spark, d))


SWEEPS = ", sweeps AS (SELECT i.addr, i.chunk_id, i.size, (1706745600 - i.mtime)::BIGINT AS age FROM inventory i LEFT JOIN old_refs r ON r.chunk_id = i.chunk_id AND r.addr = i.addr WHERE r.addr IS NULL AND i.mtime <= 1706745600 - 3600)\n"


def _sweeps(spark, d):
    return gc.plan(X.inventory(spark, d), X.refs(spark, d), X.AS_OF, 3600)


@query("f2_gc_plan", SWEEPS + "SELECT * FROM sweeps ORDER BY addr, chunk_id")
def f2(spark, d):
    return _sweeps(spark, d)


@query("f4_listing_failures", "SELECT n.addr FROM nodes n LEFT JOIN inventory i ON i.addr = n.addr WHERE i.addr IS NULL")
def f4(spark, d):
    return gc.listing_failures(X.nodes(spark), X.inventory(spark, d))


@query("f5_gc_apply", SWEEPS + "SELECT i.addr, i.chunk_id FROM inventory i LEFT JOIN sweeps s ON s.addr = i.addr AND s.chunk_id = i.chunk_id WHERE s.addr IS NULL")
def f5(spark, d):
    return gc.apply(X.inventory(spark, d), _sweeps(spark, d)).select("addr", "chunk_id")


@query("f5_gc_stats", SWEEPS + "SELECT (SELECT count(*) FROM inventory)::BIGINT AS scanned, (SELECT count(*) FROM old_refs)::BIGINT AS claimed_keys, count(*)::BIGINT AS swept, coalesce(sum(size), 0)::BIGINT AS freed FROM sweeps")
def f5s(spark, d):
    return gc.stats(X.inventory(spark, d), X.refs(spark, d), _sweeps(spark, d))


# --- repair

LIVE = "('dn1', 'dn2', 'dn3', 'dn4')"
REPAIR = SHARD_AT + f""", act AS (SELECT stripe_id, shard_index, CASE WHEN shard_index IN (1, 4) AND substr(stripe_id, 1, 1) < '8' THEN 'dn' || (shard_index + 6)::VARCHAR WHEN shard_index = 5 THEN 'dn99' WHEN shard_index = 2 AND substr(stripe_id, 1, 1) = '0' THEN 'dn98' ELSE addr END AS addr FROM want),
st AS (SELECT stripe_id, count(*) FILTER (addr IN (SELECT addr FROM nodes)) AS survivors, count(*) FILTER (addr NOT IN (SELECT addr FROM nodes)) AS dead FROM act GROUP BY 1),
states AS (SELECT *, CASE WHEN dead = 0 THEN 'healthy' WHEN survivors < 4 THEN 'unrepairable' ELSE 'repairable' END AS state FROM st),
deads AS (SELECT *, row_number() OVER (PARTITION BY stripe_id ORDER BY shard_index) AS r FROM act WHERE addr NOT IN (SELECT addr FROM nodes)),
free AS (SELECT w.stripe_id, w.addr, row_number() OVER (PARTITION BY w.stripe_id ORDER BY w.addr) AS r FROM want w LEFT JOIN act a ON w.stripe_id = a.stripe_id AND w.addr = a.addr WHERE a.addr IS NULL)
"""


def _broken(spark, d):
    """stripe_id, shards, desired of every distinct stripe, some shards on nodes that are gone."""
    first = F.substring("stripe_id", 1, 1)
    at = lambda i, x: F.when(i.isin(1, 4) & (first < "8"), F.concat(F.lit("dn"), (i + 6).cast("string"))).when(i == 5, "dn99").when((i == 2) & (first == "0"), "dn98").otherwise(x)
    return _placed(spark, d).select("stripe_id", _in_shards(at).alias("shards"), F.col("want").alias("desired"))


@query("g1_stripe_states", REPAIR + "SELECT stripe_id, survivors::BIGINT AS survivors, dead::BIGINT AS dead, state FROM states")
def g1(spark, d):
    return repair.status(_broken(spark, d), X.nodes(spark), K)


@query("g3_repair_plan", REPAIR + "SELECT d.stripe_id, d.shard_index, d.addr AS old_addr, CASE WHEN state = 'repairable' THEN f.addr END AS new_addr, state FROM deads d JOIN states s ON s.stripe_id = d.stripe_id LEFT JOIN free f ON f.stripe_id = d.stripe_id AND f.r = d.r WHERE state = 'unrepairable' OR f.addr IS NOT NULL")
def g3(spark, d):
    return repair.plan(_broken(spark, d), X.nodes(spark), K)


@query("g5_repair_stats", REPAIR + "SELECT count(*)::BIGINT AS scanned, (count(*) FILTER (state = 'repairable'))::BIGINT AS repairable, (count(*) FILTER (state = 'unrepairable'))::BIGINT AS unrepairable FROM states")
def g5(spark, d):
    return repair.stats(repair.status(_broken(spark, d), X.nodes(spark), K))


REMADE = PARITY + REPAIR.removeprefix(STRIPES) + """, made AS (SELECT d.stripe_id, d.shard_index, f.addr FROM deads d JOIN states s ON s.stripe_id = d.stripe_id JOIN free f ON f.stripe_id = d.stripe_id AND f.r = d.r WHERE state = 'repairable'),
whole AS (SELECT stripe_id, i::INT AS shard_index, sha256(data[i * 256 + 1 : (i + 1) * 256]) AS shard_id FROM few, range(4) t(i) UNION ALL SELECT * FROM par)
"""


def _remade(spark, d):
    stripes, live = _broken(spark, d), X.nodes(spark)
    up = stripes.select("stripe_id", F.inline("shards")).join(F.broadcast(live.select("addr")), "addr", "left_semi")
    held = erasure.shards(_stripes(spark, d), K, M).join(up.select("stripe_id", "shard_index"), ["stripe_id", "shard_index"])
    return erasure.repaired(held, repair.plan(stripes, live, K), K, M)


@query("g4_repair", REMADE + "SELECT stripe_id, shard_index, addr, shard_id FROM made JOIN whole USING (stripe_id, shard_index)")
def g4(spark, d):
    """The dead shards of repairable stripes made anew, data and parity, and where they go."""
    return _remade(spark, d).select("stripe_id", "shard_index", "addr", "shard_id")


@query("g5_run_stats", REMADE + "SELECT count(DISTINCT stripe_id)::BIGINT AS stripes, count(DISTINCT stripe_id)::BIGINT AS repaired, 0::BIGINT AS failed, (count(*) * 256)::BIGINT AS bytes FROM made")
def g5_run(spark, d):
    return repair.run_stats(_remade(spark, d))


# --- Merkle inventories and audits

TREE = """, bd AS (SELECT addr, ('0x' || substr(chunk_id, 1, 2))::INT AS idx, sha256(string_agg(chunk_id, chr(10) ORDER BY chunk_id) || chr(10)) AS hash, count(*) AS n FROM inventory GROUP BY 1, 2),
ed AS (SELECT addr, ('0x' || substr(chunk_id, 1, 2))::INT AS idx, sha256(string_agg(chunk_id, chr(10) ORDER BY chunk_id) || chr(10)) AS hash FROM old_refs GROUP BY 1, 2),
diff AS (SELECT coalesce(e.addr, a.addr) AS addr, coalesce(e.chunk_id, a.chunk_id) AS chunk_id, CASE WHEN a.addr IS NULL THEN 'missing' ELSE 'extra' END AS kind FROM old_refs e FULL JOIN inventory a ON a.addr = e.addr AND a.chunk_id = e.chunk_id WHERE a.addr IS NULL OR e.addr IS NULL)
"""


@query("h1_bucket_digests", TREE + "SELECT addr, idx, hash, n::BIGINT AS n FROM bd")
def h1(spark, d):
    return audit.bucket_digests(X.inventory(spark, d)).withColumn("n", F.col("n").cast("long"))


@query("h1_roots", TREE + f"SELECT a.addr, sha256(unhex(string_agg(coalesce(hash, '{audit.EMPTY}'), '' ORDER BY i))) AS root, sum(coalesce(n, 0))::BIGINT AS total FROM (SELECT DISTINCT addr FROM inventory) a CROSS JOIN range(256) t(i) LEFT JOIN bd ON bd.addr = a.addr AND bd.idx = i GROUP BY 1")
def h1r(spark, d):
    return audit.roots(audit.bucket_digests(X.inventory(spark, d))).withColumn("total", F.col("total").cast("long"))


@query("h2_bucket_listing", "SELECT addr, chunk_id FROM inventory WHERE substr(chunk_id, 1, 2) = '3f'")
def h2(spark, d):
    return X.inventory(spark, d).filter("substring(chunk_id, 1, 2) = '3f'").select("addr", "chunk_id")


@query("h3_expected", "SELECT DISTINCT addr, ('0x' || substr(chunk_id, 1, 2))::INT AS bucket, chunk_id FROM old_refs")
def h3(spark, d):
    """Every node's expected chunks in every bucket."""
    return audit.expected(X.refs(spark, d))


@query("h4_audit", TREE + "SELECT * FROM diff")
def h4(spark, d):
    return audit.audit(X.refs(spark, d), X.inventory(spark, d))


@query("h4_buckets_examined", TREE + "SELECT coalesce(e.addr, b.addr) AS addr, count(*)::BIGINT AS buckets FROM ed e FULL JOIN bd b ON b.addr = e.addr AND b.idx = e.idx WHERE e.hash IS DISTINCT FROM b.hash GROUP BY 1")
def h4b(spark, d):
    e, a = audit.bucket_digests(X.refs(spark, d)), audit.bucket_digests(X.inventory(spark, d))
    both = e.join(a.select("addr", "idx", F.col("hash").alias("there")), ["addr", "idx"], "full_outer")
    return both.filter(~F.col("hash").eqNullSafe(F.col("there"))).groupBy("addr").agg(F.count("*").alias("buckets"))


@query("h5_audit_report", TREE + """SELECT n.addr, n.addr <> 'dn4' AS reachable, CASE WHEN n.addr = 'dn4' THEN 0 ELSE (SELECT count(*) FROM old_refs o WHERE o.addr = n.addr) END::BIGINT AS expected, CASE WHEN n.addr = 'dn4' THEN 0 ELSE (SELECT count(*) FROM inventory i WHERE i.addr = n.addr) END::BIGINT AS actual,
CASE WHEN n.addr = 'dn4' THEN 0 ELSE (SELECT count(*) FROM diff x WHERE x.addr = n.addr AND kind = 'missing') END::BIGINT AS missing, CASE WHEN n.addr = 'dn4' THEN 0 ELSE (SELECT count(*) FROM diff x WHERE x.addr = n.addr AND kind = 'extra') END::BIGINT AS extra FROM nodes n""")
def h5(spark, d):
    return audit.report(X.refs(spark, d), X.inventory(spark, d), X.nodes(spark), ["dn4"])


@query("h7_owners", "SELECT chunk_id, string_agg(addr, ',' ORDER BY addr) AS owners FROM old_refs GROUP BY 1")
def h7(spark, d):
    return X.refs(spark, d).groupBy("chunk_id").agg(joined(F.collect_set("addr")).alias("owners"))


JOBS = TREE + """, jobs AS (SELECT addr, chunk_id, 'missing' AS reason FROM diff WHERE kind = 'missing' UNION ALL SELECT c.addr, c.chunk_id, 'corrupt' FROM corrupt c JOIN old_refs r ON r.addr = c.addr AND r.chunk_id = c.chunk_id),
bad AS (SELECT addr, chunk_id FROM jobs UNION SELECT addr, chunk_id FROM corrupt),
able AS (SELECT r.chunk_id, r.addr AS owner FROM old_refs r LEFT JOIN bad b ON b.addr = r.addr AND b.chunk_id = r.chunk_id WHERE b.addr IS NULL AND r.addr <> 'dn5'),
sourced AS (SELECT j.addr, j.chunk_id, j.reason, min(a.owner) AS source FROM jobs j LEFT JOIN able a ON a.chunk_id = j.chunk_id AND a.owner <> j.addr GROUP BY 1, 2, 3),
classed AS (SELECT *, substr(chunk_id, 1, 1) = '0' AS ec FROM sourced)
"""


def _jobs(spark, d):
    refs, inv, bad = X.refs(spark, d), X.inventory(spark, d), X.corrupt(spark, d)
    missing = audit.audit(refs, inv).filter("kind = 'missing'").select("addr", "chunk_id")
    targets = missing.withColumn("reason", F.lit("missing")).unionByName(bad.join(refs.select("addr", "chunk_id"), ["addr", "chunk_id"]).withColumn("reason", F.lit("corrupt")))
    return audit.sources(targets, refs, missing, bad, X.nodes(spark).filter("addr <> 'dn5'")).withColumn("ec", F.substring("chunk_id", 1, 1) == "0")


@query("h8_sources", JOBS + "SELECT addr, chunk_id, reason, source FROM sourced")
def h8(spark, d):
    return _jobs(spark, d).select("addr", "chunk_id", "reason", "source")


@query("h9_repair_modes", JOBS + "SELECT mode, reason, count(*)::BIGINT AS n FROM (SELECT *, CASE WHEN ec THEN 'ec-deferred' WHEN source IS NULL THEN 'no-source' ELSE 'replication' END AS mode FROM classed) GROUP BY 1, 2")
def h9(spark, d):
    return audit.classify(_jobs(spark, d)).groupBy("mode", "reason").agg(F.count("*").alias("n"))


BUDGET = JOBS + """, b AS (SELECT *, CASE WHEN ec THEN 'ec-deferred' WHEN source IS NULL THEN 'no-source' ELSE 'replication' END AS mode, source IS NOT NULL AND substr(chunk_id, 2, 1) <> '7' AS ok FROM classed),
r AS (SELECT *, coalesce(sum((ok AND mode = 'replication')::INT) OVER (ORDER BY addr, reason = 'corrupt', chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
"""


@query("h11_budget", BUDGET + "SELECT addr, chunk_id, reason, CASE WHEN before >= 20 THEN 'throttled' WHEN mode <> 'replication' THEN mode WHEN ok THEN 'repaired' ELSE 'failed' END AS state FROM r")
def h11(spark, d):
    """One budget for all jobs: node by node, missing chunks before spoilt ones."""
    jobs = audit.classify(_jobs(spark, d)).withColumn("ok", F.col("source").isNotNull() & (F.substring("chunk_id", 2, 1) != "7")).withColumn("turn", F.col("reason") == "corrupt").withColumn("bucket", F.substring("chunk_id", 1, 2))
    return audit.budgeted(jobs, 20, ["addr", "turn", "bucket"], ["chunk_id"]).select("addr", "chunk_id", "reason", "state")


STRIPE_JOBS = SHARD_AT + """, fl AS (SELECT stripe_id, shard_index, addr, substr(sha256(stripe_id || shard_index::VARCHAR || 'gone'), 1, 1) = '0' AS gone, substr(sha256(stripe_id || shard_index::VARCHAR || 'spoilt'), 1, 1) = '1' AS spoilt FROM want),
sj AS (SELECT stripe_id, string_agg(shard_index::VARCHAR || '@' || addr || CASE WHEN gone THEN '' ELSE '!' END, ',' ORDER BY shard_index) FILTER (gone OR spoilt) AS dead, coalesce(string_agg(shard_index::VARCHAR, ',' ORDER BY shard_index) FILTER (NOT gone AND NOT spoilt), '') AS survivors FROM fl GROUP BY 1 HAVING bool_or(gone OR spoilt))
"""


def _stripe_jobs(spark, d):
    drawn = lambda tag: F.substring(F.sha2(F.concat("stripe_id", F.col("shard_index").cast("string"), F.lit(tag)), 256), 1, 1)
    shards = _shard_rows(spark, d).withColumn("shard_id", F.concat_ws("-", "stripe_id", "shard_index"))
    return audit.stripe_repairs(shards, shards.filter(drawn("gone") == "0"), shards.filter(drawn("spoilt") == "1"))


@query("h10_stripe_repairs", STRIPE_JOBS + "SELECT stripe_id, dead, survivors FROM sj")
def h10(spark, d):
    """Missing and spoilt shards of a stripe are one repair; ! marks those to overwrite."""
    text = lambda x: F.concat(x["shard_index"].cast("string"), F.lit("@"), x["addr"], F.when(x["force"], "!").otherwise(""))
    return _stripe_jobs(spark, d).select("stripe_id", F.array_join(F.transform("dead", text), ",").alias("dead"), F.array_join(F.transform("survivors", lambda x: x["shard_index"].cast("string")), ",").alias("survivors"))


@query("h11_stripe_budget", STRIPE_JOBS + "SELECT stripe_id, CASE WHEN row_number() OVER (ORDER BY stripe_id) <= 15 THEN 'scheduled' ELSE 'throttled' END AS state FROM sj")
def h11_stripes(spark, d):
    """Of a budget of 20, five spent on copies: stripes take the rest in order."""
    return audit.scheduled(_stripe_jobs(spark, d), 20, 5, ["stripe_id"]).select("stripe_id", "state")


@query("h12_dry_run", JOBS + "SELECT mode, mode IN ('replication', 'ec-inline') AS planned, count(*)::BIGINT AS n FROM (SELECT CASE WHEN addr = 'dn4' THEN 'skip' WHEN ec THEN 'ec-inline' WHEN source IS NULL THEN 'no-source' ELSE 'replication' END AS mode FROM classed) GROUP BY 1, 2")
def h12(spark, d):
    """What a run would do with stripes repaired inline and one node out of reach."""
    return audit.dry_run(_jobs(spark, d).withColumn("reachable", F.col("addr") != "dn4"), inline=True).groupBy("mode", "planned").agg(F.count("*").alias("n"))


@query("h13_first_seen", "SELECT key, min(seq)::BIGINT AS seq FROM wal WHERE op = 'delete_object' GROUP BY key")
def h13(spark, d):
    return X.wal(spark, d).filter("op = 'delete_object'").groupBy("key").agg(F.min("seq").alias("seq"))


@query("h13_alerts", """SELECT key, seq FROM (WITH RECURSIVE starts(s, n) AS (SELECT 0::BIGINT, 0 UNION ALL SELECT (SELECT f FROM (SELECT key, min(seq) AS f FROM wal WHERE op = 'delete_object' AND seq >= starts.s GROUP BY key) ORDER BY f LIMIT 1 OFFSET 100)::BIGINT, n + 1 FROM starts WHERE s IS NOT NULL)
SELECT w.key, s, min(w.seq)::BIGINT AS seq FROM wal w JOIN (SELECT s, lead(s) OVER (ORDER BY s) AS e FROM starts WHERE s IS NOT NULL) ON w.seq >= s AND (e IS NULL OR w.seq < e) WHERE w.op = 'delete_object' GROUP BY w.key, s)""")
def h13_alerts(spark, d):
    """Of 100 held keys, so that they are cleared often; the operator's own cap, 100,000, would hold all keys of the test tables."""
    return audit.first_seen(X.wal(spark, d).filter("op = 'delete_object'").select("key", "seq"), "key", 100)


@query("h15_audit_rollup", TREE + "SELECT count(DISTINCT addr)::BIGINT AS divergent, (count(*) FILTER (kind = 'missing'))::BIGINT AS missing FROM diff")
def h15(spark, d):
    return audit.audit(X.refs(spark, d), X.inventory(spark, d)).agg(F.count_distinct("addr").alias("divergent"), F.count_if(F.col("kind") == "missing").alias("missing"))


# --- scrubbing


@query("i1_scrub", "SELECT bucket, key, chunk_index::INT AS chunk_index, chunk_id FROM chunks WHERE substr(chunk_id, 1, 2) = '00'")
def i1(spark, d):
    """Bodies spoilt where the id begins with 00 are found by their digests."""
    from .streaming.jobs import scrub_stream

    c = chunking.split_fixed(X.objects_raw(spark, d), X.CHUNK)
    rotten = c.withColumn("data", F.when(F.col("chunk_id").startswith("00"), F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))
    return scrub_stream(rotten.withColumn("addr", F.struct("bucket", "key", "chunk_index"))).select("addr.*", "chunk_id")


@query("i2_corrupt_set", "SELECT addr, chunk_id FROM corrupt")
def i2(spark, d):
    """What a scrub found, kept as a version of a table and read again; malformed ids are dropped."""
    found = X.corrupt(spark, d)
    found = found.unionByName(found.select("addr", F.upper("chunk_id").alias("chunk_id")).filter("chunk_id <> lower(chunk_id)"))
    store = snapshots.new_store(spark)
    snapshots.snapshot({"corrupt": found.filter(H.is_chunk_id(F.col("chunk_id")))}, store)
    return snapshots.load(spark, store, "corrupt")


@query("i3_scrub_status", "SELECT i.addr, count(*)::BIGINT AS total, count(c.addr)::BIGINT AS corrupt, coalesce(string_agg(c.chunk_id, ',' ORDER BY c.chunk_id), '') AS ids FROM inventory i LEFT JOIN corrupt c ON c.addr = i.addr AND c.chunk_id = i.chunk_id GROUP BY 1")
def i3(spark, d):
    bad = X.corrupt(spark, d).withColumn("bad", F.col("chunk_id"))
    return X.inventory(spark, d).join(bad, ["addr", "chunk_id"], "left").groupBy("addr").agg(F.count("*").alias("total"), F.count("bad").alias("corrupt"), joined(F.collect_list("bad")).alias("ids"))


# --- quorums

ACKS = ", acks AS (SELECT chunk_id, addr, substr(sha256(chunk_id || addr || 'ack'), 1, 1) > '4' AS ok FROM old_refs)\n"


def _acks(spark, d):
    return X.refs(spark, d).select("chunk_id", "addr", (F.substring(F.sha2(F.concat("chunk_id", "addr", F.lit("ack")), 256), 1, 1) > "4").alias("ok"))


@query("j1_write_quorum", ACKS + "SELECT chunk_id, count(*)::BIGINT AS n, (count(*) FILTER (ok))::BIGINT AS acks, coalesce(string_agg(addr, ',' ORDER BY addr) FILTER (ok), '') AS acked, count(*) FILTER (ok) >= count(*) // 2 + 1 AS ok FROM acks GROUP BY 1")
def j1(spark, d):
    return catalog.write_quorum(_acks(spark, d))


@query("j2_tunable_quorum", ACKS + "SELECT w, count(*) FILTER (a >= w)::BIGINT AS met FROM (SELECT chunk_id, count(*) FILTER (ok) AS a FROM acks GROUP BY 1), (VALUES (1), (2), (3)) t(w) GROUP BY 1")
def j2(spark, d):
    by = _acks(spark, d).groupBy("chunk_id").agg(F.count_if("ok").alias("a"))
    return by.agg(*[F.count_if(F.col("a") >= w).alias(str(w)) for w in (1, 2, 3)]).select(F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(str(w)).alias("met")) for w in (1, 2, 3)])).alias("x")).select("x.*")


@query("j2_quorum_errors", "SELECT w, CASE WHEN w = 0 THEN 2 WHEN w BETWEEN 1 AND 3 THEN w END::BIGINT AS wanted FROM (VALUES (-1), (0), (1), (2), (3), (4)) t(w)")
def j2_errors(spark, d):
    """Null is an error: less than 0, or more than there are targets."""
    return spark.createDataFrame([(w,) for w in range(-1, 5)], "w int").select("w", catalog.quorum_wanted(F.col("w"), F.lit(3)).alias("wanted"))


HEADERS = [("", 3), ("2", 3), ("4", 3), ("0", 3), ("-1", 3), ("x", 3), ("3", 3)]
HEADER_SQL = "(VALUES ('', 3), ('2', 3), ('4', 3), ('0', 3), ('-1', 3), ('x', 3), ('3', 3)) t(h, most)"


@query("j3_quorum_header", f"SELECT h, CASE WHEN h = '' THEN 0 WHEN try_cast(h AS BIGINT) BETWEEN 1 AND most THEN try_cast(h AS BIGINT) END AS w, CASE WHEN h = '' THEN 0 WHEN try_cast(h AS BIGINT) BETWEEN 0 AND most THEN try_cast(h AS BIGINT) END AS n FROM {HEADER_SQL}")
def j3(spark, d):
    rows = spark.createDataFrame(HEADERS, "h string, most int")
    return rows.select("h", catalog.quorum_header(F.col("h"), F.col("most")).alias("w"), catalog.non_negative(F.col("h"), 3).alias("n"))


@query("j4_least_replicas", "SELECT c.bucket, c.key, min(n)::INT AS r FROM chunks c JOIN (SELECT chunk_id, count(*) AS n FROM inventory GROUP BY 1) i USING (chunk_id) GROUP BY 1, 2")
def j4(spark, d):
    held = X.inventory(spark, d).groupBy("chunk_id").agg(F.count("*").cast("int").alias("n"))
    return X.chunks(spark, d).join(held, "chunk_id").groupBy("bucket", "key").agg(F.min("n").alias("r"))


@query("j5_read_agreement", "SELECT r.chunk_id, bool_and(c.addr IS NULL) AND count(*) = 2 AS agree FROM old_refs r LEFT JOIN corrupt c ON c.addr = r.addr AND c.chunk_id = r.chunk_id WHERE pos < 2 GROUP BY 1")
def j5(spark, d):
    bad = X.corrupt(spark, d).withColumn("bad", F.lit(True))
    reads = X.refs(spark, d).join(bad, ["addr", "chunk_id"], "left").select("chunk_id", F.col("replica_pos").alias("pos"), F.col("bad").isNull().alias("verified"), F.when(F.col("bad"), F.col("addr")).otherwise(F.col("chunk_id")).alias("digest"))
    return catalog.read_agreement(reads, 2)


@query("j6_replication_quorum", "SELECT seq, acks, acks + 1 >= 6 // 2 + 1 AS committed FROM (SELECT w.seq, count(*) FILTER (substr(sha256(w.seq::VARCHAR || n.addr), 1, 1) > '7')::BIGINT AS acks FROM wal w, nodes n WHERE n.addr <> 'dn1' GROUP BY 1)")
def j6(spark, d):
    peers = [a for a, _, _ in X.NODES[1:]]
    ack = sum((F.when(F.substring(F.sha2(F.concat(F.col("seq").cast("string"), F.lit(a)), 256), 1, 1) > "7", 1).otherwise(0) for a in peers), F.lit(0))
    return X.wal(spark, d).select("seq", ack.cast("long").alias("acks")).withColumn("committed", F.col("acks") + 1 >= 6 // 2 + 1)


# --- catalogue


@query("k1_list_prefix", "SELECT bucket, key FROM objects_raw WHERE bucket = 'src0' AND starts_with(key, 'en/000') ORDER BY bucket || '/' || key LIMIT 25")
def k1(spark, d):
    return catalog.list_prefix(X.objects_raw(spark, d), "src0", "en/000", 25).select("bucket", "key")


@query("k2_brief_listing", "SELECT key, sum(size)::BIGINT AS size, count(*)::BIGINT AS chunks FROM chunks GROUP BY bucket, key")
def k2(spark, d):
    return X.chunks(spark, d).groupBy("bucket", "key").agg(F.sum("size").alias("size"), F.count("*").alias("chunks")).select("key", "size", "chunks")


@query("k2_brief", """SELECT key, size, version, CASE WHEN doc_id % 3 <> 0 THEN nullif(ceil(size / 700.0)::BIGINT, 0) END AS chunks, CASE WHEN doc_id % 3 = 0 THEN '4+2' END AS ec, CASE WHEN doc_id % 3 = 0 THEN nullif(ceil(size / 1200.0)::BIGINT, 0) END AS stripes
FROM (SELECT bucket, key, doc_id, octet_length(body)::BIGINT AS size, (doc_id % 5 + 1)::BIGINT AS version FROM objects_raw ORDER BY bucket || '/' || key LIMIT 1000)""")
def k2_brief(spark, d):
    """A third of the objects are coded, as in k13."""
    objects = X.objects_raw(spark, d).select("bucket", "key", "doc_id", F.octet_length("body").cast("long").alias("size"), (F.col("doc_id") % 5 + 1).cast("long").alias("version"))
    return catalog.brief(objects, 700, K, M, 300, F.col("doc_id") % 3 == 0)


@query("k3_list_page", """, keys AS (SELECT key, substr(key, 4) AS rest FROM objects_raw WHERE bucket = 'src0' AND starts_with(key, 'en/') AND key > 'en/00000050'), e AS (SELECT CASE WHEN instr(rest, '5') > 0 THEN 'en/' || substr(rest, 1, instr(rest, '5')) ELSE key END AS emit, instr(rest, '5') > 0 AS is_prefix, key FROM keys)
SELECT emit, is_prefix FROM (SELECT emit, is_prefix, min(key) AS f FROM e WHERE NOT is_prefix OR emit > 'en/00000050' GROUP BY 1, 2) ORDER BY f LIMIT 20""")
def k3(spark, d):
    return catalog.list_page(X.objects_raw(spark, d), "src0", "en/", "5", "en/00000050", 20)


PAGES = [("", 3), ("en/00000050", 20), ("", 1000), ("", 0), ("zz", 5), ("en/00000005", 1)]


def _page_sql(i: int, cursor: str, n: int) -> str:
    emitted = f"(SELECT *, row_number() OVER (ORDER BY emit) AS n FROM (SELECT DISTINCT emit, p FROM (SELECT CASE WHEN instr(substr(key, 4), '5') > 0 THEN 'en/' || substr(substr(key, 4), 1, instr(substr(key, 4), '5')) ELSE key END AS emit, instr(substr(key, 4), '5') > 0 AS p FROM objects_raw WHERE bucket = 'src0' AND starts_with(key, 'en/') AND key > '{cursor}') WHERE NOT p OR emit > '{cursor}'))"
    return f"SELECT {i} AS page, coalesce(string_agg(emit, ',' ORDER BY n) FILTER (n <= {n} AND NOT p), '') AS contents, coalesce(string_agg(emit, ',' ORDER BY n) FILTER (n <= {n} AND p), '') AS prefixes, (count(*) FILTER (n <= {n}))::INT AS key_count, count(*) > {n} AS is_truncated, CASE WHEN count(*) > {n} THEN coalesce(max(emit) FILTER (n <= {n}), '') ELSE '' END AS next_token FROM {emitted}"


@query("k3_list_results", " UNION ALL ".join(_page_sql(i, *page) for i, page in enumerate(PAGES)))
def k3_results(spark, d):
    """Whole page results: keys, common prefixes, truncation and the token to go on from, of none, some and all keys."""
    objects, out = X.objects_raw(spark, d), None
    for i, (cursor, n) in enumerate(PAGES):
        one = catalog.list_result(objects, "src0", "en/", "5", cursor, n).select(F.lit(i).alias("page"), F.array_join("contents", ",").alias("contents"), F.array_join("prefixes", ",").alias("prefixes"), "key_count", "is_truncated", "next_token")
        out = one if out is None else out.unionByName(one)
    return out


KEYS_SQL = "(VALUES (NULL), ('10'), ('0'), ('-5'), ('junk'), ('5000')) t(raw)"


@query("k4_max_keys", f"SELECT raw, CASE WHEN try_cast(raw AS INT) IS NULL OR try_cast(raw AS INT) < 0 THEN 1000 ELSE least(try_cast(raw AS INT), 1000) END AS n FROM {KEYS_SQL}")
def k4(spark, d):
    rows = spark.createDataFrame([(None,), ("10",), ("0",), ("-5",), ("junk",), ("5000",)], "raw string")
    return rows.select("raw", catalog.max_keys(F.col("raw")).alias("n"))


@query("k5_list_parts", "SELECT upload_id, part_number, etag, size FROM parts WHERE upload_id = 5 AND part_number > 1 ORDER BY part_number LIMIT 3")
def k5(spark, d):
    return X.parts(spark, d).filter("upload_id = 5 AND part_number > 1").orderBy("part_number").limit(3)


@query("k5_parts_results", " UNION ALL ".join(f"SELECT {m} AS marker, {n} AS most, coalesce(string_agg(part_number::VARCHAR, ',' ORDER BY part_number) FILTER (r <= {n}), '') AS numbers, count(*) > {n} AS is_truncated, coalesce(max(part_number) FILTER (r <= {n}), 0)::BIGINT AS next_marker FROM (SELECT part_number, row_number() OVER (ORDER BY part_number) AS r FROM parts WHERE upload_id = 5 AND part_number > {m})" for m, n in ((0, 1), (1, 2), (0, 1000), (99, 2))))
def k5_results(spark, d):
    parts, out = X.parts(spark, d), None
    for m, n in ((0, 1), (1, 2), (0, 1000), (99, 2)):
        one = catalog.parts_result(parts, 5, m, n).select(F.lit(m).alias("marker"), F.lit(n).alias("most"), F.array_join("part_numbers", ",").alias("numbers"), "is_truncated", "next_marker")
        out = one if out is None else out.unionByName(one)
    return out


REQUESTED = """, c AS (SELECT upload_id, upload_id % 8 AS u, count(*) AS n, sum(size) AS size, '"' || sha256(string_agg(etag, '' ORDER BY part_number)) || '-' || count(*)::VARCHAR || '"' AS tag FROM parts GROUP BY 1),
k AS (SELECT *, CASE WHEN u = 1 THEN 'InvalidPart' WHEN u = 2 AND n > 1 THEN 'InvalidPartOrder' WHEN u IN (3, 4, 5) THEN 'InvalidPart' WHEN u = 6 THEN 'NoSuchUpload' ELSE 'ok' END AS status FROM c),
done AS (SELECT upload_id, status, CASE WHEN status = 'ok' THEN n END::BIGINT AS n_parts, CASE WHEN status = 'ok' THEN size END::BIGINT AS size, CASE WHEN status = 'ok' THEN tag END AS etag FROM k)
"""


def _completed(spark, d):
    """Requests by upload_id % 8: whole, empty, backwards, with a number that isn't there, a wrong tag, a number 0, of no pending upload, without tags."""
    parts, u = X.parts(spark, d), F.col("upload_id") % 8
    extra = lambda n: F.array(F.struct(F.lit(n).cast("long").alias("part_number"), F.lit("").alias("etag")))
    own = F.array_sort(F.collect_list(F.struct("part_number", "etag")))
    with_tag = lambda f: F.transform("own", lambda x, i: F.struct(x["part_number"].alias("part_number"), f(x, i).alias("etag")))
    asked = F.when(u == 1, F.slice("own", 1, 0)).when(u == 2, F.reverse("own")).when(u == 3, F.concat("own", extra(99))).when(u == 4, with_tag(lambda x, i: F.when(i == 0, "other").otherwise(x["etag"]))).when(u == 5, F.concat(extra(0), "own")).when(u == 7, with_tag(lambda x, i: F.lit("")))
    requested = parts.groupBy("upload_id").agg(own.alias("own")).select("upload_id", F.coalesce(asked, F.col("own")).alias("asked"))
    return catalog.complete_requested(parts.filter(u != 6).select("upload_id").distinct(), parts, requested)


@query("k6_complete_requested", REQUESTED + "SELECT * FROM done")
def k6_requested(spark, d):
    return _completed(spark, d)


@query("k6_complete_uploads", """SELECT upload_id, count(*)::BIGINT AS n_parts, sum(size)::BIGINT AS size, '"' || sha256(string_agg(etag, '' ORDER BY part_number)) || '-' || count(*)::VARCHAR || '"' AS etag, true AS ok FROM parts GROUP BY 1""")
def k6(spark, d):
    return catalog.complete_uploads(X.parts(spark, d))


@query("k7_put_parts", """SELECT upload_id, part_number, CASE WHEN part_number = 1 THEN 'again-' || upload_id::VARCHAR ELSE etag END AS etag, CASE WHEN part_number = 1 THEN 7 ELSE size END::BIGINT AS size FROM parts WHERE upload_id % 3 <> 1""")
def k7(spark, d):
    """Part 1 is put twice more, the last one stays; a third of the uploads is aborted."""
    parts = X.parts(spark, d)
    again = lambda seq, tag, size: parts.filter("part_number = 1").select("upload_id", "part_number", F.concat(F.lit(tag), F.col("upload_id").cast("string")).alias("etag"), F.lit(size).cast("long").alias("size"), F.lit(seq).cast("long").alias("seq"))
    return catalog.put_parts(parts, again(1, "once-", 9).unionByName(again(2, "again-", 7)), parts.filter("upload_id % 3 = 1").select("upload_id"))


@query("k8_expired_uploads", "SELECT event_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-10 00:00:00'")
def k8(spark, d):
    return X.table(spark, d, "events").filter("event_type = 'signup' AND ts < TIMESTAMP_NTZ '2024-01-10 00:00:00'").select("event_id")


@query("k8_expired_limit", "SELECT event_id AS upload_id FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-10 00:00:00' ORDER BY user_id, event_id LIMIT 20")
def k8_limit(spark, d):
    up = X.table(spark, d, "events").filter("event_type = 'signup'").select(F.lit("b").alias("bucket"), F.col("user_id").alias("key"), F.col("event_id").alias("upload_id"), F.col("ts").alias("created_at"))
    return catalog.expired_uploads(up, F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'"), 20).select("upload_id")


@query("k9_deletable_buckets", "SELECT b.bucket, b.bucket NOT IN (SELECT bucket FROM objects_raw) AS deletable FROM (SELECT DISTINCT bucket FROM objects_raw UNION ALL SELECT 'empty') b")
def k9(spark, d):
    used = X.objects_raw(spark, d).select("bucket").distinct().withColumn("u", F.lit(True))
    all_ = used.select("bucket").unionByName(spark.createDataFrame([("empty",)], "bucket string"))
    return all_.join(used, "bucket", "left").select("bucket", F.col("u").isNull().alias("deletable"))


@query("k10_normalised", "SELECT * FROM (VALUES (1, 'c1:10:dn1,dn2', ''), (2, 'c2:5:dn3', ''), (3, '', 'x'), (4, '', '')) t(id, chunks, chunk_id)")
def k10(spark, d):
    """An object of the old form of one chunk, one of the new form, one of stripes and an empty one."""
    c = lambda i, n, r: [(i, n, r)]
    rows = [(1, [], [], "c1", 10, ["dn1", "dn2"]), (2, c("c2", 5, ["dn3"]), [], "", 0, []), (3, [], ["s"], "x", 1, ["dn1"]), (4, [], [], "", 0, [])]
    frame = spark.createDataFrame(rows, "id int, chunks array<struct<chunk_id: string, size: int, replicas: array<string>>>, stripes array<string>, chunk_id string, size int, replicas array<string>")
    text = lambda x: F.concat_ws(":", x["chunk_id"], x["size"].cast("string"), F.array_join(x["replicas"], ","))
    return catalog.normalised(frame).select("id", F.array_join(F.transform("chunks", text), "|").alias("chunks"), "chunk_id")


NAMES = ["abc", "ab", "a.b-c", "-abc", "abc-", "a..b", "192.168.1.1", "Abc", "999.1.1.1", "x" * 63, "x" * 64]


@query("k11_bucket_names", "SELECT name, regexp_full_match(name, '[a-z0-9.-]{3,63}') AND NOT regexp_matches(name, '^[.-]|[.-]$') AND NOT contains(name, '..') AND NOT regexp_full_match(name, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') AS valid FROM (VALUES " + ", ".join(f"('{n}')" for n in NAMES) + ") t(name)")
def k11(spark, d):
    return spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", catalog.valid_bucket(F.col("name")).alias("valid"))


@query("k12_versions", "SELECT w.bucket, w.key, count(*)::BIGINT AS version FROM wal w LEFT JOIN (SELECT key, max(seq) AS g FROM wal WHERE op = 'delete_object' GROUP BY 1) x ON x.key = w.key WHERE op = 'put_object' AND (g IS NULL OR seq > g) GROUP BY 1, 2")
def k12(spark, d):
    return catalog.versions(X.wal(spark, d))


@query("k13_store_stats", "SELECT count(*)::BIGINT AS objects, (count(*) FILTER (doc_id % 3 = 0))::BIGINT AS ec_objects, (sum(ceil(octet_length(body) / 700.0)) FILTER (doc_id % 3 <> 0))::BIGINT AS chunks, (sum(ceil(octet_length(body) / 1200.0)) FILTER (doc_id % 3 = 0))::BIGINT AS stripes, (sum(ceil(octet_length(body) / 1200.0) * 6) FILTER (doc_id % 3 = 0))::BIGINT AS shards, 6::BIGINT AS dns FROM objects_raw")
def k13(spark, d):
    """A third of the objects are coded, in shards of 300 bytes; the others have chunks of 700."""
    return catalog.store_stats(X.objects_raw(spark, d), 700, K, M, 300, len(X.NODES), F.col("doc_id") % 3 == 0)


@query("k14_safe_delete", "SELECT DISTINCT chunk_id FROM chunks WHERE bucket = 'src3' AND chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE bucket <> 'src3')")
def k14(spark, d):
    """Chunks that go with a bucket's objects: those that no other object claims."""
    c = X.chunks(spark, d).groupBy("chunk_id").agg(F.bool_and(F.col("bucket") == "src3").alias("only"))
    return c.filter("only").select("chunk_id")


@query("k15_headers", "SELECT bucket, key, 'application/octet-stream' AS content_type, octet_length(body)::BIGINT AS content_length, '\"' || sha256(body) || '\"' AS etag FROM objects_raw")
def k15(spark, d):
    return X.objects_raw(spark, d).select("bucket", "key", F.coalesce(F.lit(None).cast("string"), F.lit("application/octet-stream")).alias("content_type"), F.octet_length("body").cast("long").alias("content_length"), H.etag(F.col("body")).alias("etag"))


REQUESTS = [("GET", "", "", "", "ListBuckets"), ("PUT", "b", "", "", "CreateBucket"), ("DELETE", "b", "", "", "DeleteBucket"), ("GET", "b", "", "list-type=2&prefix=x", "ListObjectsV2"), ("POST", "b", "k", "uploads", "CreateMultipartUpload"), ("PUT", "b", "k", "partNumber=1&uploadId=u", "UploadPart"), ("GET", "b", "k", "uploadId=u", "ListParts"), ("POST", "b", "k", "uploadId=u", "CompleteMultipartUpload"), ("DELETE", "b", "k", "uploadId=u", "AbortMultipartUpload"), ("PUT", "b", "k", "", "PutObject"), ("GET", "b", "k", "", "GetObject"), ("HEAD", "b", "k", "", "HeadObject"), ("DELETE", "b", "k", "", "DeleteObject"), ("PATCH", "b", "k", "", "Unsupported"),
    ("HEAD", "b", "", "", "Unsupported"), ("GET", "b", "", "uploads", "Unsupported"), ("GET", "b", "", "", "Unsupported"), ("GET", "b", "", "list-type=1", "Unsupported"), ("POST", "b", "", "delete", "Unsupported"), ("PUT", "", "", "", "Unsupported"), ("HEAD", "", "", "", "Unsupported"),
    ("PUT", "b", "k", "uploadId=u", "PutObject"), ("PUT", "b", "k", "partNumber=1&uploadId=", "PutObject"), ("GET", "b", "k", "uploadId=", "GetObject"), ("DELETE", "b", "k", "uploadId", "DeleteObject"), ("POST", "b", "k", "uploadId=", "Unsupported"), ("POST", "b", "k", "", "Unsupported"), ("POST", "b", "k", "uploads=&uploadId=u", "CreateMultipartUpload"),
    ("GET", "b", "k", "xuploadId=u", "GetObject"), ("GET", "b", "k", "uploadId=&uploadId=u", "GetObject"), ("GET", "b", "k", "a=b&uploadId=u&c", "ListParts")]


@query("k16_requests", "SELECT * FROM (VALUES " + ", ".join(str(r) for r in REQUESTS) + ") t(method, bucket, key, query, op)")
def k16(spark, d):
    rows = spark.createDataFrame([r[:4] for r in REQUESTS], "method string, bucket string, key string, query string")
    return rows.withColumn("op", catalog.classify_request(*(F.col(c) for c in rows.columns)))


@query("k17_url_paths", "SELECT page_id, split_part(url, '/', 3) AS bucket, 'a b+c/' || regexp_extract(url, '^[a-z]+://[^/?]+/([^?#]*)', 1) AS key FROM pages")
def k17(spark, d):
    """Request paths /bucket/key with escapes: %20 is a blank, a plus is itself."""
    host, rest = (F.regexp_extract("url", pattern, 1) for pattern in ("^[a-z]+://([^/]+)", "^[a-z]+://[^/?]+/([^?#]*)"))
    paths = X.table(spark, d, "pages").select("page_id", F.concat(F.lit("/"), host, F.lit("/a%20b+c/"), rest).alias("path"))
    bucket, key = catalog.split_path(F.col("path"))
    return paths.select("page_id", bucket.alias("bucket"), key.alias("key"))


@query("k18_put_assembly", "SELECT bucket, key, sum(size)::BIGINT AS size, string_agg(chunk_id, ',' ORDER BY chunk_index) AS refs FROM chunks GROUP BY 1, 2")
def k18(spark, d):
    by = X.chunks(spark, d).groupBy("bucket", "key").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))).alias("c"))
    return by.select("bucket", "key", "size", F.array_join(F.transform("c", lambda x: x["chunk_id"]), ",").alias("refs"))


@query("k19_read", """SELECT c.bucket, c.key, coalesce(arg_min(f, chunk_index) FILTER (f IS NOT NULL), 'ok') AS status, CASE WHEN count(f) = 0 THEN sha256(any_value(o.body)) END AS digest
FROM (SELECT *, CASE WHEN substr(chunk_id, 1, 2) = '01' THEN 'missing' WHEN substr(chunk_id, 1, 2) = '00' THEN 'size' END AS f FROM chunks) c JOIN objects_raw o ON o.bucket = c.bucket AND o.key = c.key GROUP BY 1, 2""")
def k19(spark, d):
    """Bodies from their chunks in order, where some are gone and some are cut short: the first fault is told."""
    chunks = chunking.split_fixed(X.objects_raw(spark, d), X.CHUNK)
    stored = chunks.select("chunk_id", "data").dropDuplicates(["chunk_id"]).filter("substring(chunk_id, 1, 2) <> '01'")
    stored = stored.withColumn("data", F.when(F.col("chunk_id").startswith("00"), F.expr("substring(data, 1, octet_length(data) - 1)")).otherwise(F.col("data")))
    return chunking.read_objects(chunks.select("bucket", "key", "chunk_index", "chunk_id", "size"), stored).select("bucket", "key", "status", F.sha2("body", 256).alias("digest"))


@query("k20_inspect", "SELECT '{\"bucket\":\"' || bucket || '\",\"key\":\"' || key || '\",\"size\":' || octet_length(body)::VARCHAR || '}' AS line FROM objects_raw WHERE bucket = 'src3'")
def k20(spark, d):
    return X.objects_raw(spark, d).filter("bucket = 'src3'").select(F.to_json(F.struct("bucket", "key", F.octet_length("body").alias("size"))).alias("line"))


# --- log


def _committed(spark, d):
    return X.wal(spark, d).select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))


@query("l2_group_commit", "SELECT epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS start, count(*)::BIGINT AS batch FROM events GROUP BY 1")
def l2(spark, d):
    return logs.group_commit(_committed(spark, d), 3600).select("start", "batch")


NOWS = [X.BASE_TIME - 1, X.BASE_TIME + 7 * 86400 + 1800, X.BASE_TIME + 20 * 86400 + 3599, X.AS_OF + 10**8]


@query("l2_gauges", ", times AS (SELECT floor(epoch(ts))::BIGINT AS t FROM wal)\n" + "\nUNION ALL ".join(f"""SELECT {n}::BIGINT AS now, coalesce((SELECT count(*) FROM times WHERE t < {n - n % 3600} GROUP BY t // 3600 ORDER BY t // 3600 DESC LIMIT 1), 0)::BIGINT AS last_batch,
 coalesce({n} - (SELECT min(t) FROM times WHERE t BETWEEN {n - n % 3600} AND {n}), 0)::BIGINT AS oldest_unsynced""" for n in NOWS))
def l2_gauges(spark, d):
    """Before the log, at two times in it and long after it."""
    out = [logs.commit_gauges(_committed(spark, d), 3600, n).select(F.lit(n).cast("long").alias("now"), "last_batch", "oldest_unsynced") for n in NOWS]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("l3_since", "SELECT seq, op, key FROM wal WHERE seq > 9900 ORDER BY seq")
def l3(spark, d):
    return logs.since(X.wal(spark, d), 9900).select("seq", "op", "key")


@query("l4_until_corrupt", "SELECT seq FROM wal WHERE seq < (SELECT min(seq) FROM wal WHERE seq % 777 = 0)")
def l4(spark, d):
    return logs.until_corrupt(X.wal(spark, d).select(F.col("seq").alias("at"), (F.col("seq") % 777 != 0).alias("ok"))).select(F.col("at").alias("seq"))


@query("l5_last_seq", "SELECT max(seq)::BIGINT AS seq FROM wal")
def l5(spark, d):
    return X.wal(spark, d).agg(F.max("seq").alias("seq"))


OPERATION_NAMES = "put_object delete_object create_bucket delete_bucket create_multipart_upload put_multipart_part complete_multipart_upload abort_multipart_upload add_runtime_dn remove_runtime_dn"


@query("l7_operations", f"SELECT op, count(*)::BIGINT AS n FROM (SELECT string_split('{OPERATION_NAMES}', ' ')[(seq % 10 + 1)::INT] AS op FROM wal) GROUP BY op")
def l7(spark, d):
    """A log with every operation, whose names are checked; an unknown one is an error."""
    rows = X.wal(spark, d).select(F.element_at(F.split(F.lit(OPERATION_NAMES), " "), (F.col("seq") % 10 + 1).cast("int")).alias("op"))
    known = F.when(F.col("op").isin(*logs.OPERATIONS), F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown op "), "op")))
    return rows.select(known.cast("string").alias("op")).groupBy("op").agg(F.count("*").alias("n"))


FOLD = ", last AS (SELECT bucket, key, max(seq) AS seq, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM wal GROUP BY 1, 2)\n"


@query("l8_fold", FOLD + "SELECT bucket, key, seq::BIGINT AS seq, value FROM last WHERE op <> 'delete_object'")
def l8(spark, d):
    return logs.fold(X.wal(spark, d))


@query("l9_follower", FOLD + "SELECT bucket, key, seq::BIGINT AS seq, value FROM last WHERE op <> 'delete_object'")
def l9(spark, d):
    w = X.wal(spark, d)
    return logs.merge(logs.fold(w.filter("seq <= 5000")), w, 5000)


FOLLOWERS = [("new", 0, 0, "put_object"), ("near", 500, 0, "put_object"), ("edge", 600, 600, "put_object"), ("cut off", 100, 600, "put_object"), ("older", 500, 0, "rename_object")]


@query("l9_fall_back", ", cases(follower, source, upto) AS (VALUES ('new', 'snapshot', 700), ('near', 'log', (SELECT max(seq) FROM wal)), ('edge', 'log', (SELECT max(seq) FROM wal)), ('cut off', 'snapshot', 700), ('older', 'snapshot', 700)), folded AS (SELECT follower, source, upto, key, max(seq) AS seq, arg_max(op, seq) AS op FROM cases JOIN wal ON seq <= upto GROUP BY 1, 2, 3, 4)\nSELECT follower, source, upto::BIGINT AS upto, key, seq::BIGINT AS seq FROM folded WHERE op <> 'delete_object'")
def l9_fall_back(spark, d):
    """Followers that never synced, that the log serves, that stand where it begins, that it no longer reaches, and that meet an unknown operation."""
    w = X.wal(spark, d)
    snapshot, out = logs.fold(w.filter("seq <= 700")), None
    for name, known, cut, op in FOLLOWERS:
        held = w.filter(F.col("seq") > cut).withColumn("op", F.when(F.col("seq") == 800, op).otherwise(F.col("op")) if op not in logs.OPERATIONS else F.col("op"))
        state, upto, source = logs.follow(logs.fold(w.filter(F.col("seq") <= known)), known, held, snapshot, 700)
        one = state.select(F.lit(name).alias("follower"), F.lit(source).alias("source"), F.lit(upto).cast("long").alias("upto"), "key", "seq")
        out = one if out is None else out.unionByName(one)
    return out


@query("l10_recent", "SELECT seq, op, key FROM wal ORDER BY seq DESC LIMIT 10")
def l10(spark, d):
    return X.wal(spark, d).orderBy(F.desc("seq")).limit(10).select("seq", "op", "key")


@query("l11_key_sync", "SELECT * FROM (VALUES ('k1', 'remove', 3), ('k2', 'make primary', 2), ('k3', 'add', 1), ('k5', 'remove', 3)) t(kid, action, turn)")
def l11(spark, d):
    """What makes a ring the wanted one: keys are added, then the primary switches, then the others go."""
    wanted = spark.createDataFrame([("k2", True), ("k3", False), ("k4", False)], "kid string, is_primary boolean")
    held = spark.createDataFrame([("k1", True), ("k2", False), ("k4", False), ("k5", False)], "kid string, is_primary boolean")
    return catalog.key_actions(wanted, held)


# --- liveness

LIVENESS = ", p AS (SELECT *, row_number() OVER (PARTITION BY addr ORDER BY seq) AS n FROM probes), live AS (SELECT addr, count(*)::BIGINT AS total_probes, (max(n) - coalesce(max(n) FILTER (ok), 0))::BIGINT AS consec_fails, arg_max(latency_ms, seq) AS latency_ms, max(seq) FILTER (ok) AS last_ok FROM p GROUP BY 1)\n"


@query("m1_liveness", LIVENESS + "SELECT *, consec_fails < 3 AS healthy FROM live")
def m1(spark, d):
    return logs.liveness(X.probes(spark, d))


@query("m2_registry_shrink", LIVENESS + "SELECT addr, total_probes FROM live WHERE addr IN ('dn1', 'dn2', 'dn3')")
def m2(spark, d):
    return logs.liveness(X.probes(spark, d)).join(F.broadcast(X.nodes(spark).filter("class = 'hot'").select("addr")), "addr", "left_semi").select("addr", "total_probes")


@query("m3_healthy", LIVENESS + "SELECT string_agg(addr, ',' ORDER BY addr) AS healthy FROM live WHERE consec_fails < 3")
def m3(spark, d):
    return logs.liveness(X.probes(spark, d)).filter("healthy").agg(joined(F.collect_list("addr")).alias("healthy"))


@query("m4_recent_runs", "SELECT addr, seq FROM (SELECT addr, seq, row_number() OVER (PARTITION BY addr ORDER BY seq DESC) AS r FROM probes) WHERE r <= 32")
def m4(spark, d):
    w = Window.partitionBy("addr").orderBy(F.desc("seq"))
    return X.probes(spark, d).select("addr", "seq", F.row_number().over(w).alias("r")).filter("r <= 32").select("addr", "seq")


# --- metrics


@query("n1_counters", "SELECT op, key, count(*)::BIGINT AS n FROM wal GROUP BY 1, 2")
def n1(spark, d):
    return X.wal(spark, d).groupBy("op", "key").agg(F.count("*").alias("n"))


@query("n2_gauges", "SELECT (SELECT count(*) FROM inventory)::BIGINT AS chunks, (SELECT count(*) FROM objects_raw)::BIGINT AS objects")
def n2(spark, d):
    return X.inventory(spark, d).agg(F.count("*").alias("chunks")).crossJoin(X.objects_raw(spark, d).agg(F.count("*").alias("objects")))


@query("n3_histogram", "SELECT le, (SELECT count(*) FROM events WHERE b IS NULL OR greatest(value / 1000, 0) <= b)::BIGINT AS n FROM (VALUES " + ", ".join(f"('{b:g}', {b}::DOUBLE)" for b in logs.LADDER) + ", ('+Inf', NULL)) t(le, b)")
def n3(spark, d):
    return logs.histogram(X.table(spark, d, "events").select((F.col("value") / 1000).alias("secs")))


@query("n3_duration_sum", "SELECT sum(floor(greatest(value / 1000, 0) * 1e6))::BIGINT AS micros FROM events")
def n3s(spark, d):
    return logs.duration_sum(X.table(spark, d, "events").select((F.col("value") / 1000).alias("secs")))


@query("n5_rendering", """SELECT 'wal_total{op="' || op || '"} ' || count(*)::VARCHAR AS line FROM wal GROUP BY op ORDER BY op""")
def n5(spark, d):
    return logs.rendered(X.wal(spark, d).groupBy("op").agg(F.count("*").alias("n")), "wal_total", "op")


@query("n6_gateway_metrics", "SELECT (count(*) FILTER (op = 'put_object'))::BIGINT AS puts, (count(*) FILTER (op = 'delete_object'))::BIGINT AS deletes, count(DISTINCT key)::BIGINT AS keys FROM wal")
def n6(spark, d):
    return X.wal(spark, d).agg(F.count_if(F.col("op") == "put_object").alias("puts"), F.count_if(F.col("op") == "delete_object").alias("deletes"), F.count_distinct("key").alias("keys"))


@query("n7_repair_metrics", JOBS + "SELECT reason, count(*)::BIGINT AS n, (count(*) FILTER (source IS NULL))::BIGINT AS unrecoverable FROM sourced GROUP BY 1")
def n7(spark, d):
    return _jobs(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("source").isNull()).alias("unrecoverable"))


# --- signing

SECRET = b"k" * 32
_PAD = "unhex('" + bytes(b ^ 0x36 for b in SECRET.ljust(64, b"\0")).hex() + "')", "unhex('" + bytes(b ^ 0x5C for b in SECRET.ljust(64, b"\0")).hex() + "')"
SIGN = f", signed AS (SELECT page_id, url, page_id * 1000 AS exp, sha256({_PAD[1]} || unhex(sha256({_PAD[0]} || encode('GET:' || url || ':' || (page_id * 1000)::VARCHAR)))) AS sig FROM pages)\n"


def _signed(spark, d):
    p = X.table(spark, d, "pages").select("page_id", "url", (F.col("page_id") * 1000).alias("exp"))
    return p.withColumn("sig", signing.presign(SECRET, F.lit("GET"), F.col("url"), F.col("exp")))


@query("o1_presign", SIGN + "SELECT page_id, url, exp, sig FROM signed")
def o1(spark, d):
    return _signed(spark, d)


@query("o2_verify", SIGN + "SELECT page_id, CASE WHEN page_id % 7 = 1 THEN 'missing sig' WHEN page_id % 7 = 2 THEN 'missing exp' WHEN page_id % 7 = 3 THEN 'bad exp' WHEN exp < 50000 THEN 'expired' WHEN page_id % 7 = 4 THEN 'unknown key' WHEN page_id % 7 = 5 THEN 'bad sig' ELSE 'ok' END AS verdict FROM signed")
def o2(spark, d):
    r = F.col("page_id") % 7
    rows = _signed(spark, d)
    sig = F.when(r == 1, "").when(r == 5, F.reverse("sig")).otherwise(F.col("sig"))
    exp = F.when(r == 2, "").when(r == 3, "soon").otherwise(F.col("exp").cast("string"))
    kid = F.when(r == 4, "k9").when(r == 6, "").otherwise("k1")
    return rows.select("page_id", "url", sig.alias("sig"), exp.alias("exp"), kid.alias("kid")).select("page_id", signing.verify({"k0": b"other", "k1": SECRET}, 50_000, F.lit("GET"), F.col("url"), F.col("kid"), F.col("sig"), F.col("exp")).alias("verdict"))


@query("o3_key_ring", "SELECT * FROM (VALUES ('k1', true, false), ('k2', false, true), ('k3', false, true)) t(kid, is_primary, removable)")
def o3(spark, d):
    """The primary and an only key can't be removed."""
    return catalog.removable_keys(spark.createDataFrame([("k1", True), ("k2", False), ("k3", False)], "kid string, is_primary boolean"))


STAMP, REGION = "20240101T000000Z", "us-east-1"
_KEY = signing.signing_key("secret", STAMP[:8], REGION)
_PADS = ["unhex('" + bytes(b ^ x for b in _KEY.ljust(64, b"\0")).hex() + "')" for x in (0x36, 0x5C)]
SIGNED = f""", canon AS (SELECT page_id, sha256(encode(html)) AS h FROM pages),
req AS (SELECT page_id, h, 'GET' || chr(10) || '/b/' || page_id::VARCHAR || chr(10) || chr(10) || 'host:host' || chr(10) || 'x-amz-content-sha256:' || h || chr(10) || 'x-amz-date:{STAMP}' || chr(10) || chr(10) || 'host;x-amz-content-sha256;x-amz-date' || chr(10) || h AS c FROM canon),
sts AS (SELECT page_id, 'AWS4-HMAC-SHA256' || chr(10) || '{STAMP}' || chr(10) || '{STAMP[:8]}/{REGION}/s3/aws4_request' || chr(10) || sha256(c) AS t FROM req),
v4 AS (SELECT page_id, sha256({_PADS[1]} || unhex(sha256({_PADS[0]} || encode(t)))) AS signature FROM sts)
"""


def _v4(spark, d):
    """id, method, path, host, stamp, body_hash, signature of a request a page."""
    rows = X.table(spark, d, "pages").select(F.col("page_id").alias("id"), F.lit("GET").alias("method"), F.concat(F.lit("/b/"), F.col("page_id").cast("string")).alias("path"), F.lit("host").alias("host"), F.lit(STAMP).alias("stamp"), F.sha2(F.encode("html", "UTF-8"), 256).alias("body_hash"))
    return rows.join(signing.sign_requests(rows, "secret", REGION, STAMP[:8]), "id")


@query("o4_request_signatures", SIGNED + "SELECT page_id AS id, signature FROM v4")
def o4(spark, d):
    return _v4(spark, d).select("id", "signature")


FAULTS = ["ok", "MissingSecurityHeader", "AuthorizationHeaderMalformed", "AccessDenied", "MissingSecurityHeader", "AuthorizationHeaderMalformed", "AccessDenied", "MissingSecurityHeader", "AuthorizationHeaderMalformed", "AccessDenied", "SignatureDoesNotMatch", "AuthorizationHeaderMalformed"]


@query("o4_verify_requests", f"SELECT page_id AS id, string_split('{','.join(FAULTS)}', ',')[(page_id % {len(FAULTS)} + 1)::INT] AS verdict FROM pages")
def o4_verify(spark, d):
    """Signed requests, most with one fault: no header, no credential, an unknown key, no date, another date's scope, an old time, no body hash, an unsigned
    required header, an unsigned x-amz header, another signature, a short scope."""
    r, date = F.col("id") % len(FAULTS), F.lit(STAMP[:8])
    scope = F.concat(F.when(r == 5, "20231231").otherwise(date), F.lit(f"/{REGION}/s3"), F.when(r == 11, "").otherwise("/aws4_request"))
    names = F.when(r == 8, "host;x-amz-date").otherwise(";".join(signing.REQUIRED))
    credential = F.when(r == 2, "").otherwise(F.concat(F.lit("Credential="), F.when(r == 3, "who").otherwise("me"), F.lit("/"), scope, F.lit(", ")))
    header = F.concat(F.lit("AWS4-HMAC-SHA256 "), credential, F.lit("SignedHeaders="), names, F.lit(", Signature="), F.when(r == 10, F.reverse("signature")).otherwise(F.col("signature")))
    pairs = F.array(F.struct(F.lit("host").alias("key"), F.col("host").alias("value")), *(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (("authorization", F.when(r != 1, header)), ("x-amz-date", F.when(r != 4, F.when(r == 6, f"{STAMP[:8]}T010000Z").otherwise(F.col("stamp")))), ("x-amz-content-sha256", F.when(r != 7, F.col("body_hash"))), ("x-amz-meta-x", F.when(r == 9, "x")))))
    requests = _v4(spark, d).select("id", "method", "path", F.lit("").alias("query"), F.map_from_entries(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("headers"))
    return signing.verify_requests(requests, {"me": "secret"}, datetime(2024, 1, 1, 0, 10, tzinfo=UTC))


@query("o5_error_codes", REQUESTED + "SELECT status, CASE status WHEN 'ok' THEN 200 WHEN 'NoSuchUpload' THEN 404 ELSE 400 END AS http, count(*)::BIGINT AS n FROM done GROUP BY 1, 2")
def o5(spark, d):
    """The HTTP status of each outcome of completions."""
    return _completed(spark, d).groupBy("status", catalog.http_status(F.col("status")).alias("http")).agg(F.count("*").alias("n"))


# --- supporting


@query("p1_vote_tally", "SELECT term, (count(*) FILTER (granted))::BIGINT AS votes, count(*) FILTER (granted) >= 6 // 2 + 1 AS elected FROM (SELECT seq // 6 AS term, ok AS granted FROM probes) GROUP BY 1")
def p1(spark, d):
    votes = X.probes(spark, d).select(F.expr("seq div 6").alias("term"), F.col("ok").alias("granted"))
    return votes.groupBy("term").agg(F.count_if("granted").alias("votes"), (F.count_if("granted") >= 6 // 2 + 1).alias("elected"))


@query("s7_upserts", "SELECT * FROM (VALUES ('dn1', 'hot', 'rack1'), ('dn2', 'cold', 'rack2'), ('dn3', 'hot', 'rack9'), ('dn4', 'cold', 'rack1'), ('dn5', 'cold', 'rack2'), ('dn7', 'hot', 'rack4')) t(addr, class, domain)")
def s7(spark, d):
    """The node registry after changes of a class, of a domain twice, an added node and a removed one."""
    rows = [(1, "dn2", "cold", "rack2", False), (2, "dn3", "hot", "rack8", False), (3, "dn3", "hot", "rack9", False), (4, "dn7", "hot", "rack4", False), (5, "dn6", "cold", "rack3", True)]
    return catalog.upsert(X.nodes(spark), spark.createDataFrame(rows, "seq int, addr string, class string, domain string, removed boolean"), "addr")


@query("s8_deletes", "SELECT bucket, key, 'deleted' AS outcome FROM objects_raw WHERE doc_id % 5 = 0 UNION ALL SELECT 'src0', 'no/such/key', 'NoSuchKey'")
def s8(spark, d):
    """Deletes of objects, one of a key that isn't there."""
    objects = X.objects_raw(spark, d)
    asked = objects.filter("doc_id % 5 = 0").select("bucket", "key").unionByName(spark.createDataFrame([("src0", "no/such/key")], "bucket string, key string"))
    return catalog.delete_objects(objects, asked)[1]


@query("s9_replayed_versions", """, lg AS (SELECT event_id + 1 AS seq, user_id AS u, event_type AS e FROM events), g AS (SELECT u, max(seq) FILTER (e = 'error') AS gone, max(seq) FILTER (e = 'signup') AS done FROM lg GROUP BY 1)
SELECT 'b' AS bucket, 'user/' || lg.u::VARCHAR AS key, max(seq)::BIGINT AS seq, (coalesce(max(CASE WHEN seq = done THEN 100 + seq % 7 END), 0) + count(*) FILTER (e <> 'signup' AND seq > greatest(coalesce(gone, 0), coalesce(done, 0))))::BIGINT AS version
FROM lg JOIN g ON g.u = lg.u WHERE e <> 'error' AND (gone IS NULL OR seq > gone) GROUP BY lg.u""")
def s9(spark, d):
    """Versions after a replay in which completions of uploads keep the version that they were logged with."""
    e = X.table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.lit("b").alias("bucket"), F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"), "event_type")
    op = F.when(F.col("event_type") == "error", "delete_object").when(F.col("event_type") == "signup", "complete_multipart_upload").otherwise("put_object")
    return logs.state_of(e.select("seq", "bucket", "key", op.alias("op"), (F.lit(100) + F.col("seq") % 7).alias("logged_version")))


@query("s11_run_status", "SELECT addr, count(*)::BIGINT AS runs, (count(*) FILTER (NOT ok))::BIGINT AS errors, max(seq)::BIGINT AS last FROM probes GROUP BY 1")
def s11(spark, d):
    return X.probes(spark, d).groupBy("addr").agg(F.count("*").alias("runs"), F.count_if(~F.col("ok")).alias("errors"), F.max("seq").alias("last"))


@query("s15_sync_status", """SELECT addr, (max(seq) FILTER (ok))::BIGINT AS last_sync, arg_max(latency_ms, seq) FILTER (ok) AS last_size, CASE WHEN arg_max(ok, seq) THEN '' ELSE 'HTTP 503' END AS last_err, (count(*) FILTER (ok))::BIGINT AS total_syncs, (count(*) FILTER (NOT ok))::BIGINT AS total_errors FROM probes GROUP BY addr""")
def s15(spark, d):
    return logs.sync_status(X.probes(spark, d).select("addr", F.col("seq").alias("at"), F.col("latency_ms").alias("size"), F.when(~F.col("ok"), "HTTP 503").alias("err")))


@query("s17_gc_summary", SWEEPS + "SELECT addr, count(*)::BIGINT AS sweeps, sum(size)::BIGINT AS bytes FROM sweeps GROUP BY addr")
def s17(spark, d):
    return _sweeps(spark, d).groupBy("addr").agg(F.count("*").alias("sweeps"), F.sum("size").alias("bytes"))


@query("s18_csv", "SELECT * FROM (VALUES ('a, b,,c', 'a|b|c'), ('', ''), (' x ', 'x'), ('a,a', 'a|a')) t(raw, items)")
def s18(spark, d):
    rows = spark.createDataFrame([("a, b,,c",), ("",), (" x ",), ("a,a",)], "raw string")
    return rows.select("raw", F.array_join(catalog.csv(F.col("raw")), "|").alias("items"))



# --- versioned tables


def _objects(spark, d) -> DataFrame:
    return X.objects_raw(spark, d).select("bucket", "key", F.octet_length("body").cast("long").alias("size"))


@query("a9_snapshot", "SELECT 1::BIGINT AS version, 'nodes' AS name, 6::BIGINT AS n_rows UNION ALL SELECT 1, 'objects', count(*) FROM objects_raw")
def a9(spark, d):
    store = snapshots.new_store(spark)
    snapshots.snapshot({"objects": _objects(spark, d), "nodes": X.nodes(spark)}, store)
    return snapshots.manifest(spark, store).select("version", "name", "n_rows")


@query("a12_reload", "SELECT bucket, key, octet_length(body)::BIGINT AS size FROM objects_raw WHERE octet_length(body) > 100")
def a12(spark, d):
    store, objects = snapshots.new_store(spark), _objects(spark, d)
    snapshots.snapshot({"objects": objects}, store)
    snapshots.snapshot({"objects": objects.filter("size > 100")}, store)
    return snapshots.reload(spark, store, "objects", "reloaded_objects")


@query("a13_restore", "SELECT bucket, key, octet_length(body)::BIGINT AS size FROM objects_raw")
def a13(spark, d):
    store, objects = snapshots.new_store(spark), _objects(spark, d)
    first = snapshots.snapshot({"objects": objects}, store)
    snapshots.snapshot({"objects": objects.filter("size > 100")}, store)
    snapshots.restore(spark, store, first)
    return snapshots.load(spark, store, "objects")


@query("a18_seed_nodes", "SELECT 'dn' || i AS addr, CASE WHEN i <= 3 THEN 'hot' ELSE 'cold' END AS class, 'rack' || ((i - 1) % 3 + 1) AS domain FROM range(1, 7) AS t(i)")
def a18(spark, d):
    store = snapshots.new_store(spark)
    snapshots.seed(X.nodes(spark).limit(2), store)
    snapshots.seed(X.nodes(spark), store)
    return snapshots.load(spark, store, "nodes")


APPENDED = "SELECT row_number() OVER (ORDER BY event_type = 'error', event_id)::BIGINT AS seq, event_id FROM events"


def _appended(spark, d) -> str:
    store, events = snapshots.new_store(spark), X.table(spark, d, "events").select("event_id", "event_type")
    snapshots.append(events.filter("event_type <> 'error'").select("event_id"), store, "event_id")
    snapshots.append(events.filter("event_type = 'error'").select("event_id"), store, "event_id")
    return store


@query("l1_append", APPENDED)
def l1(spark, d):
    return snapshots.log(spark, _appended(spark, d))


@query("l6_truncate", f"SELECT seq, event_id, 1::BIGINT AS epoch FROM ({APPENDED}) WHERE seq > 100")
def l6(spark, d):
    store = _appended(spark, d)
    epoch = snapshots.truncate(spark, store, 100)
    return snapshots.log(spark, store).withColumn("epoch", F.lit(epoch).cast("long"))


def queries() -> dict[str, Callable[..., DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
