"""Listings, multipart uploads, buckets, quorums and request parsing over catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Fixed HTTP statuses of the storage interface's error codes.
HTTP_STATUS = {
    "NoSuchKey": 404,
    "NoSuchBucket": 404,
    "NoSuchUpload": 404,
    "InvalidPart": 400,
    "InvalidPartOrder": 400,
    "InvalidBucketName": 400,
    "InvalidArgument": 400,
    "MissingSecurityHeader": 400,
    "AuthorizationHeaderMalformed": 400,
    "BucketAlreadyExists": 409,
    "BucketNotEmpty": 409,
    "AccessDenied": 403,
    "SignatureDoesNotMatch": 403,
    "NotImplemented": 501,
}


def http_status(code: Column) -> Column:
    """200 for ok, the status of a known error code, 500 for another."""
    out = F.when(code == "ok", 200)
    for name, status in HTTP_STATUS.items():
        out = out.when(code == name, status)
    return out.otherwise(500)


def list_prefix(objects: DataFrame, bucket: str = "", prefix: str = "", limit: int = 0) -> DataFrame:
    """Objects by bucket/key in scan order; an empty bucket is all, limit <= 0 is all."""
    out = objects.filter(F.col("key").startswith(prefix))
    out = out.filter(F.col("bucket") == bucket) if bucket else out
    out = out.orderBy(F.concat("bucket", F.lit("/"), "key"))
    return out.limit(limit) if limit > 0 else out


def list_page(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", cursor: str = "", max_keys: int = 1000) -> DataFrame:
    """emit, is_prefix, n: one page of keys and common prefixes after the cursor. One more row than max_keys is sorted, never the whole bucket."""
    keys = objects.filter((F.col("bucket") == bucket) & F.col("key").startswith(prefix) & (F.col("key") > cursor))
    rest = F.substring("key", len(prefix) + 1, 1 << 30)
    at = F.instr(rest, delimiter) if delimiter else F.lit(0)
    emit = F.when(at > 0, F.concat(F.lit(prefix), F.expr(f"substring(key, {len(prefix) + 1}, {at_expr(prefix, delimiter)})"))).otherwise(F.col("key")) if delimiter else F.col("key")
    rows = keys.select((at > 0).alias("is_prefix"), emit.alias("emit"), "key").filter(~F.col("is_prefix") | (F.col("emit") > cursor))
    out = rows.groupBy("is_prefix", "emit").agg(F.min("key").alias("first"))
    return out.orderBy("first").limit(max_keys).select("emit", "is_prefix")


def list_result(objects: DataFrame, bucket: str, prefix: str = "", delimiter: str = "", cursor: str = "", max_keys: int = 1000) -> DataFrame:
    """One row: contents, prefixes (arrays in order), key_count, is_truncated, next_token (the last emitted; empty if the page is the last, or of no keys).

    One more than max_keys emissions (1000 at most) are gathered, to see whether there are more.
    """
    page = list_page(objects, bucket, prefix, delimiter, cursor, max_keys + 1).select(F.struct("emit", "is_prefix").alias("e"))
    # emissions are in the order of their first keys; a prefix sorts before the keys under it, so that is their own order too
    held = page.agg(F.array_sort(F.collect_list("e")).alias("all")).select(F.slice("all", 1, max_keys).alias("e") if max_keys else F.expr("slice(all, 1, 0)").alias("e"), (F.size("all") > max_keys).alias("is_truncated"))
    names = lambda wanted: F.transform(F.filter("e", lambda x: x["is_prefix"] == wanted), lambda x: x["emit"])
    last = F.when(F.col("is_truncated") & (F.size("e") > 0), F.element_at(F.transform("e", lambda x: x["emit"]), -1)).otherwise("")
    return held.select(names(False).alias("contents"), names(True).alias("prefixes"), F.size("e").alias("key_count"), "is_truncated", last.alias("next_token"))


def parts_result(parts: DataFrame, upload_id, marker: int = 0, max_parts: int = 1000) -> DataFrame:
    """One row: part_numbers (array), is_truncated, next_marker (the last one listed, 0 for none) of an upload's parts behind the marker."""
    most = min(max_parts, 1000) if max_parts > 0 else 1000
    page = parts.filter((F.col("upload_id") == upload_id) & (F.col("part_number") > marker)).orderBy("part_number").limit(most + 1)
    held = page.agg(F.array_sort(F.collect_list("part_number")).alias("all")).select(F.slice("all", 1, most).alias("part_numbers"), (F.size("all") > most).alias("is_truncated"))
    return held.select("part_numbers", "is_truncated", F.when(F.size("part_numbers") > 0, F.element_at("part_numbers", -1)).otherwise(0).cast("long").alias("next_marker"))


def at_expr(prefix: str, delimiter: str) -> str:
    """SQL length of a common prefix's part behind the prefix."""
    d = delimiter.replace("'", "\\'")
    return f"instr(substring(key, {len(prefix) + 1}), '{d}') + {len(delimiter) - 1}"


def max_keys(raw: Column) -> Column:
    """1000 for absent, junk or negative; at most 1000; 0 stays 0."""
    n = raw.try_cast("int")
    return F.when(n.isNull() | (n < 0), 1000).otherwise(F.least(n, F.lit(1000)))


def non_negative(raw: Column, most: int) -> Column:
    """0 for empty; null (an error) for junk, negative or over most."""
    n = raw.try_cast("bigint")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(0).cast("bigint")).when((n >= 0) & (n <= most), n)


def quorum_header(raw: Column, most: Column) -> Column:
    """0 for empty; null (an error) for junk, below 1 or over most."""
    n = raw.try_cast("bigint")
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(0).cast("bigint")).when((n >= 1) & (n <= most), n)


def csv(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")


def valid_bucket(name: Column) -> Column:
    ip = name.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$")
    return name.rlike(r"^[a-z0-9.-]{3,63}$") & ~name.rlike(r"^[.-]|[.-]$") & ~name.contains("..") & ~ip


def complete_uploads(parts: DataFrame) -> DataFrame:
    """upload_id, n_parts, size, etag, ok: parts (part_number, etag, size) in ascending numbers 1..10000; the tag is of the quoted tags."""
    w = Window.partitionBy("upload_id").orderBy("part_number")
    own = parts.withColumn("before", F.lag("part_number").over(w))
    by = own.groupBy("upload_id").agg(F.count("*").alias("n_parts"), F.sum("size").alias("size"), F.array_sort(F.collect_list(F.struct("part_number", "etag"))).alias("t"), F.bool_and((F.col("part_number") > F.coalesce("before", F.lit(0))) & F.col("part_number").between(1, 10000)).alias("ok"))
    tag = F.sha2(F.array_join(F.transform("t", lambda x: x["etag"]), ""), 256)
    return by.select("upload_id", "n_parts", "size", F.concat(F.lit('"'), tag, F.lit("-"), F.col("n_parts").cast("string"), F.lit('"')).alias("etag"), "ok")


def complete_requested(uploads: DataFrame, parts: DataFrame, requested: DataFrame) -> DataFrame:
    """upload_id, status, n_parts, size, etag: what completing each upload with its requested list gives.

    uploads: upload_id, of pending ones; parts: upload_id, part_number, etag, size; requested: upload_id, asked (array of part_number,
    etag in the request's order). status is ok or the first fault: InvalidPart for an empty list, NoSuchUpload, then part by part
    InvalidPart for a number beyond 1..10000, InvalidPartOrder for one not above the last, InvalidPart for one that isn't there or,
    if the request names an etag, has another.
    """
    asked = requested.select("upload_id", F.posexplode_outer("asked").alias("at", "want")).select("upload_id", "at", "want.*").withColumnRenamed("etag", "wanted")
    before = F.lag("part_number").over(Window.partitionBy("upload_id").orderBy("at"))
    rows = asked.withColumn("before", F.coalesce(before, F.lit(0))).join(uploads.select("upload_id", F.lit(True).alias("pending")), "upload_id", "left").join(parts.select("upload_id", "part_number", "etag", "size"), ["upload_id", "part_number"], "left")
    fault = (
        F.when(F.col("at").isNull(), "InvalidPart")
        .when(F.col("pending").isNull(), "NoSuchUpload")
        .when(~F.col("part_number").between(1, 10000), "InvalidPart")
        .when(F.col("part_number") <= F.col("before"), "InvalidPartOrder")
        .when(F.col("etag").isNull() | (F.coalesce("wanted", F.lit("")) != "") & (F.col("wanted") != F.col("etag")), "InvalidPart")
    )
    by = rows.withColumn("fault", fault).groupBy("upload_id").agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.coalesce("at", F.lit(0)))).alias("f"), F.count("at").alias("n"), F.sum("size").alias("s"), F.array_sort(F.collect_list(F.struct("at", "etag"))).alias("t"))
    tag = F.concat(F.lit('"'), F.sha2(F.array_join(F.transform("t", lambda x: x["etag"]), ""), 256), F.lit("-"), F.col("n").cast("string"), F.lit('"'))
    good = lambda c: F.when(F.col("f").isNull(), c)
    return by.select("upload_id", F.coalesce("f", F.lit("ok")).alias("status"), good(F.col("n")).alias("n_parts"), good(F.col("s")).alias("size"), good(tag).alias("etag"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with the last change (by seq; the table's columns beside) of each key in place of its row; new keys are added, those with removed = true go."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*[c for c in table.columns if c != key], "removed"), "seq").alias("new"))
    both = table.withColumn("old", F.struct(*[c for c in table.columns if c != key])).select(key, "old").join(last, key, "full_outer")
    kept = both.filter(~F.coalesce("new.removed", F.lit(False)))
    return kept.select(*[F.col(c) if c == key else F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in table.columns])


def put_parts(parts: DataFrame, puts: DataFrame, aborted: DataFrame) -> DataFrame:
    """upload_id, part_number, etag, size after puts (by seq; a number put again is replaced) and without aborted uploads (upload_id)."""
    every = parts.select("upload_id", "part_number", "etag", "size", F.lit(-1).cast("long").alias("seq")).unionByName(puts.select("upload_id", "part_number", "etag", "size", "seq"))
    last = every.groupBy("upload_id", "part_number").agg(F.max_by("etag", "seq").alias("etag"), F.max_by("size", "seq").alias("size"))
    return last.join(aborted.select("upload_id").distinct(), "upload_id", "left_anti")


def delete_objects(objects: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The objects (bucket, key) without those asked for, and the outcome of each request: deleted or NoSuchKey."""
    asked = asked.select("bucket", "key").distinct()
    there = objects.select("bucket", "key").distinct().withColumn("there", F.lit(True))
    outcome = asked.join(there, ["bucket", "key"], "left").select("bucket", "key", F.when(F.col("there"), "deleted").otherwise("NoSuchKey").alias("outcome"))
    return objects.join(asked, ["bucket", "key"], "left_anti"), outcome


def normalised(objects: DataFrame) -> DataFrame:
    """objects (chunks, stripes: arrays; chunk_id, size, replicas) of the old form of one chunk, an id without lists, in the new one."""
    old = (F.size("chunks") == 0) & (F.size("stripes") == 0) & (F.coalesce("chunk_id", F.lit("")) != "")
    return objects.withColumns({"chunks": F.when(old, F.array(F.struct("chunk_id", "size", "replicas"))).otherwise(F.col("chunks")), "chunk_id": F.when(old, "").otherwise(F.col("chunk_id"))})


def quorum_wanted(wanted: Column, targets: Column) -> Column:
    """Acknowledgements to wait for: more than half for 0; null (an error) for less than 0 or more than there are targets."""
    return F.when(wanted == 0, F.floor(targets / 2) + 1).when((wanted > 0) & (wanted <= targets), wanted).cast("long")


def key_actions(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """kid, action, turn: what makes the held keys (kid, is_primary) the wanted ones (kid, is_primary).

    Turn 1 adds what is missing, 2 switches the primary, 3 removes what isn't wanted: so a primary and a last key are there at any time. The
    held primary is removed only if another one has been made primary, and nothing is removed if no key is wanted.
    """
    some = wanted.agg(F.count_if("is_primary").alias("primaries"), F.count("*").alias("n"))
    both = wanted.select("kid", F.col("is_primary").alias("w")).join(held.select("kid", F.col("is_primary").alias("h")), "kid", "full_outer").crossJoin(F.broadcast(some))
    removable = (F.col("n") > 0) & (~F.col("h") | (F.col("primaries") > 0))
    acts = F.array_compact(F.array(
        F.when(F.col("h").isNull(), F.struct(F.lit(1).alias("turn"), F.lit("add").alias("action"))),
        F.when(F.col("w") & ~F.coalesce("h", F.lit(False)), F.struct(F.lit(2).alias("turn"), F.lit("make primary").alias("action"))),
        F.when(F.col("w").isNull() & removable, F.struct(F.lit(3).alias("turn"), F.lit("remove").alias("action"))),
    ))
    return both.select("kid", F.explode(acts).alias("x")).select("kid", "x.action", "x.turn")


def removable_keys(ring: DataFrame) -> DataFrame:
    """kid, is_primary, removable of a key ring: neither the primary nor a last key can go."""
    n = ring.agg(F.count("*").alias("n"))
    return ring.crossJoin(F.broadcast(n)).select("kid", "is_primary", (~F.col("is_primary") & (F.col("n") > 1)).alias("removable"))


def store_stats(objects: DataFrame, chunk: int, k: int, m: int, shard: int, nodes: int, coded: Column) -> DataFrame:
    """objects, ec_objects, chunks, stripes, shards, dns: from sizes alone, in one scan. coded: whether an object is erasure coded; others have chunks."""
    n = F.octet_length("body")
    count = lambda size, which: F.coalesce(F.sum(F.when(which, F.ceil(n / size))), F.lit(0)).cast("long")
    stripes = count(k * shard, coded)
    return objects.agg(F.count("*").alias("objects"), F.count_if(coded).alias("ec_objects"), count(chunk, ~coded).alias("chunks"), stripes.alias("stripes"), (stripes * (k + m)).alias("shards"), F.lit(nodes).cast("long").alias("dns"))


def brief(objects: DataFrame, chunk: int, k: int, m: int, shard: int, coded: Column, limit: int = 1000) -> DataFrame:
    """key, size, version, chunks, ec, stripes of the first objects (bucket, key, size, version) in scan order; limit <= 0 is all.

    A coded object has its code ("k+m") and stripes, another one its chunks; what doesn't hold, and a count of 0, is null.
    """
    n = lambda size, which: F.when(which, F.nullif(F.ceil(F.col("size") / size).cast("long"), F.lit(0).cast("long")))
    first = list_prefix(objects, limit=limit)
    return first.select("key", "size", "version", n(chunk, ~coded).alias("chunks"), F.when(coded, F.lit(f"{k}+{m}")).alias("ec"), n(k * shard, coded).alias("stripes"))


def expired_uploads(uploads: DataFrame, cutoff: Column, limit: int = 0) -> DataFrame:
    """Pending uploads (bucket, key, upload_id, created_at) from before the cutoff, the first ones in scan order if there is a limit; those without a time stay."""
    old = uploads.filter(F.col("created_at") < cutoff)
    return old.orderBy("bucket", "key", "upload_id").limit(limit) if limit > 0 else old


def split_path(path: Column) -> tuple[Column, Column]:
    """bucket and key of an escaped request path: percent escapes are decoded, a plus stays."""
    trimmed = F.regexp_replace(path, "^/", "")
    plain = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    return plain(F.substring_index(trimmed, "/", 1)), plain(F.regexp_extract(trimmed, "^[^/]*/(.*)$", 1))


def write_quorum(acks: DataFrame, wanted: int | None = None) -> DataFrame:
    """chunk_id, n, acks, acked, ok: acks (chunk_id, addr, ok); wanted defaults to more than half of the targets."""
    by = acks.groupBy("chunk_id").agg(F.count("*").alias("n"), F.count_if("ok").alias("acks"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok"), F.col("addr")))), ",").alias("acked"))
    w = F.lit(wanted) if wanted else F.floor(F.col("n") / 2) + 1
    return by.withColumn("ok", F.col("acks") >= w)


def read_agreement(reads: DataFrame, r: int) -> DataFrame:
    """chunk_id, agree: of the first r replicas all are verified and identical. reads: chunk_id, pos, verified, digest."""
    return reads.filter(F.col("pos") < r).groupBy("chunk_id").agg((F.bool_and("verified") & (F.count_distinct("digest") == 1) & (F.count("*") == r)).alias("agree"))


def classify_request(method: Column, bucket: Column, key: Column, query: Column) -> Column:
    """The storage operation of a request; query is its raw query text. A parameter that is named twice has its first value; an empty one counts as absent."""
    value = lambda name: F.regexp_extract(query, rf"(?:^|&){name}(?:=([^&]*))?(?:&|$)", 1)
    upload, part, named = value("uploadId") != "", value("partNumber") != "", query.rlike("(^|&)uploads(=|&|$)")
    no_bucket, no_key = F.coalesce(bucket, F.lit("")) == "", F.coalesce(key, F.lit("")) == ""
    of_service = F.when((method == "GET") & no_key, "ListBuckets")
    of_bucket = F.when(method == "PUT", "CreateBucket").when(method == "DELETE", "DeleteBucket").when((method == "GET") & (value("list-type") == "2"), "ListObjectsV2")
    of_object = (
        F.when(method == "PUT", F.when(upload & part, "UploadPart").otherwise("PutObject"))
        .when(method == "GET", F.when(upload, "ListParts").otherwise("GetObject"))
        .when(method == "HEAD", "HeadObject")
        .when(method == "DELETE", F.when(upload, "AbortMultipartUpload").otherwise("DeleteObject"))
        .when(method == "POST", F.when(named, "CreateMultipartUpload").when(upload, "CompleteMultipartUpload"))
    )
    return F.coalesce(F.when(no_bucket, of_service).when(no_key, of_bucket).otherwise(of_object), F.lit("Unsupported"))


def versions(log: DataFrame) -> DataFrame:
    """bucket, key, version: puts since the key's last delete; deleted keys are absent. log: seq, op, bucket, key."""
    by = log.groupBy("bucket", "key").agg(F.max(F.when(F.col("op") == "delete_object", F.col("seq"))).alias("gone"))
    return log.filter("op = 'put_object'").join(by, ["bucket", "key"]).filter("gone IS NULL OR seq > gone").groupBy("bucket", "key").agg(F.count("*").alias("version"))
