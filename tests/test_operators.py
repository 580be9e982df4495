"""Literal cases and properties of the storage operators."""

import hashlib
import hmac
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.functions.hashing import hmac_sha256
from stowage.operators import chunking, erasure, logs, placement
from stowage.plans import audit, gc, rebalance, repair
from stowage.sources import fixtures as X
from stowage.streaming import jobs


def test_gc_cases(spark):
    inv = lambda rows: spark.createDataFrame(rows, "addr string, chunk_id string, size long, mtime long")
    refs = spark.createDataFrame([("c1", "dn1"), ("c1", "dn3")], "chunk_id string, addr string")
    held = inv([("dn1", "c1", 100, 0), ("dn2", "c1", 100, 0), ("dn3", "c1", 100, 0)])
    plan = gc.plan(held, refs, 7200)
    assert [(r.addr, r.chunk_id, r["size"]) for r in plan.collect()] == [("dn2", "c1", 100)]
    assert gc.plan(gc.apply(held, plan), refs, 7200).count() == 0
    young = inv([("dn2", "c1", 1, 7195)])
    assert gc.plan(young, refs, 7200, 60).count() == 0
    assert gc.plan(young, refs, 7200, 1).count() == 1


def test_rebalance_cases(spark):
    rows = spark.createDataFrame([("ok", 10, ["dn1", "dn2"], ["dn1", "dn2"]), ("c1", 100, ["dn1", "dn2", "dn3"], ["dn4", "dn1", "dn3"]), ("surplus", 1, ["dn1", "dn2"], ["dn1"])], "chunk_id string, size long, actual array<string>, desired array<string>")
    plan = rebalance.plan_chunks(rows)
    assert [(r.chunk_id, r.missing, r.surplus) for r in plan.collect()] == [("c1", ["dn4"], ["dn2"])]
    for ok, want in ((True, ["dn1", "dn3", "dn4"]), (False, ["dn1", "dn2", "dn3"])):
        out = rebalance.apply_chunks(plan, spark.createDataFrame([("c1", "dn4", ok)], "chunk_id string, addr string, ok boolean")).first()
        assert out.replicas == want


def test_repair_states(spark):
    rows = [("s", i, f"dn{i}") for i in range(6)]
    shards = spark.createDataFrame(rows, "stripe_id string, shard_index int, addr string")
    stripes = shards.groupBy("stripe_id").agg(F.collect_list(F.struct("shard_index", "addr")).alias("shards")).withColumn("desired", F.array(*(F.lit(f"dn{i}") for i in (9, 8, 5, 7, 2, 3))))
    for dead, state, places in ((0, "healthy", []), (2, "repairable", ["dn7", "dn8"]), (3, "unrepairable", [None] * 3)):
        live = spark.createDataFrame([(f"dn{i}",) for i in range(dead, 10)], "addr string")
        assert repair.status(stripes, live, 4).first().state == state
        assert [r.new_addr for r in repair.plan(stripes, live, 4).orderBy("shard_index").collect()] == places


def test_repair_makes_the_lost_shards(spark):
    """Every loss of one or two shards of a stripe gives the same bytes again; of three the repair fails."""
    data = np.random.default_rng(4).integers(0, 256, (4, 16), dtype=np.uint8)
    every = [x.tobytes() for x in [*data, *erasure.encode(data, 2)]]
    cases = [lost for n in (1, 2, 3) for lost in itertools.combinations(range(6), n)]
    held = spark.createDataFrame([(f"s{i}", j, bytearray(x)) for i, lost in enumerate(cases) for j, x in enumerate(every) if j not in lost], "stripe_id string, shard_index int, data binary")
    plan = spark.createDataFrame([(f"s{i}", j, f"new{j}") for i, lost in enumerate(cases) for j in lost], "stripe_id string, shard_index int, new_addr string")
    made = erasure.repaired(held, plan, 4, 2)
    got = {(r.stripe_id, r.shard_index): (r.addr, r.data and bytes(r.data)) for r in made.collect()}
    assert got == {(f"s{i}", j): (f"new{j}", every[j] if len(lost) < 3 else None) for i, lost in enumerate(cases) for j in lost}
    assert tuple(repair.run_stats(made).first()) == (41, 21, 20, 16 * (6 + 30))


def test_budget_of_successes(spark):
    rng = np.random.default_rng(5)
    jobs = [(f"dn{rng.integers(3)}", bool(rng.random() < 0.3), f"{rng.integers(256):02x}{i}", str(rng.choice(["replication", "no-source", "ec-deferred"], p=[0.8, 0.1, 0.1])), bool(rng.random() < 0.7)) for i in range(200)]
    frame = spark.createDataFrame(jobs, "addr string, turn boolean, chunk_id string, mode string, ok boolean").withColumn("bucket", F.substring("chunk_id", 1, 2))
    for budget in (0, 1, 17, 500):
        done, want = 0, {}
        for a, _, c, mode, ok in sorted(jobs, key=lambda j: j[:3]):
            want[a, c] = "throttled" if budget and done >= budget else mode if mode != "replication" else "repaired" if ok else "failed"
            done += want[a, c] == "repaired"
        assert {(r.addr, r.chunk_id): r.state for r in audit.budgeted(frame, budget, ["addr", "turn", "bucket"], ["chunk_id"]).collect()} == want


def test_updates_of_replicas_are_range_checked(spark):
    objects = spark.createDataFrame([("a", [["x"], ["y"]]), ("b", [["x"]]), ("c", [["z"]])], "id string, chunks array<array<string>>")
    changes = spark.createDataFrame([("a", 1, ["q", "r"]), ("b", 1, ["q"])], "id string, at int, replicas array<string>")
    got = {r.id: (r.chunks, r.ok) for r in rebalance.update_replicas(objects, changes).collect()}
    assert got == {"a": ([["x"], ["q", "r"]], True), "b": ([["x"]], False), "c": ([["z"]], True)}


def test_shard_plan_from_rows(spark):
    shards = spark.createDataFrame([("s", i, f"id{i}", a) for i, a in enumerate(["dn1", "dn8", "dn3", "dn9"])], "stripe_id string, shard_index int, shard_id string, addr string")
    desired = spark.createDataFrame([("s", a) for a in ("dn1", "dn2", "dn3")], "stripe_id string, addr string")
    assert [tuple(r) for r in rebalance.plan_shards(rebalance.gathered(shards, desired)).collect()] == [("s", 1, "id1", "dn8", "dn2")]


def test_content_stripes(spark):
    rows = spark.createDataFrame([("b", "k", i, bytearray(b"x" * n)) for i, n in enumerate((1, 4, 9))], "bucket string, key string, chunk_index int, data binary")
    got = [(r.stripe_index, r.data_len, bytes(r.data)) for r in erasure.content_stripes(rows, 4).orderBy("stripe_index").collect()]
    assert got == [(0, 1, b"x\0\0\0"), (1, 4, b"xxxx"), (2, 9, b"x" * 9 + b"\0" * 3)]


def test_split_of_a_stream(spark, tmp_path):
    """Fixed chunks of objects as they arrive are those of the batch."""
    frame = spark.createDataFrame([("b", f"k{i}", bytearray(bytes(range(i * 7)))) for i in range(9)], "bucket string, key string, body binary")
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = chunking.split_fixed(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 10).drop("data")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(chunking.split_fixed(frame, 10).drop("data"))


def test_liveness_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(6)
    probes = [(f"dn{rng.integers(4)}", i, bool(rng.random() < 0.6), i) for i in range(200)]
    for f in range(4):
        spark.createDataFrame(probes[f * 50 : f * 50 + 50], "addr string, seq long, ok boolean, latency_ms long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # files of one folder are taken in the order of their times; seq decides within a batch, batches come in order
    stream = jobs.liveness_stream(spark.readStream.schema("addr string, seq long, ok boolean, latency_ms long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("addr", "seq", "ok"))
    seen = {}
    stream.writeStream.outputMode("update").foreachBatch(lambda batch, _: seen.update({r.addr: (r.total_probes, r.consec_fails, r.healthy) for r in batch.collect()})).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
    batch = logs.liveness(spark.createDataFrame(probes, "addr string, seq long, ok boolean, latency_ms long"))
    assert seen == {r.addr: (r.total_probes, r.consec_fails, r.healthy) for r in batch.collect()}


def test_golden_movement(spark):
    got = {r.addr: (r.copies_before, r.copies_after, r.moved) for r in placement.simulate(10_000, X.OLD, X.NODES, 3, spark).collect()}
    assert [got[f"dn{i}"][0] for i in range(1, 6)] == [5974, 5960, 6009, 6065, 5992]
    assert [got[f"dn{i}"][1] for i in range(1, 7)] == [4964, 4989, 5019, 5097, 5005, 4926]
    assert got["dn1"][2] == 4926


def test_content_defined_cuts():
    c = chunking.ContentDefined(1024, 4096, 16384, 12, 10, 8)
    data = np.random.default_rng(1).integers(0, 256, 256 << 10, dtype=np.uint8).tobytes()

    def ids(body):
        at, out = 0, []
        for end in chunking.cut_points(body, c):
            out.append(hashlib.sha256(body[at:end]).hexdigest())
            at = end
        assert at == len(body)
        return out

    ends = chunking.cut_points(data, c)
    sizes = np.diff([0, *ends])
    assert (sizes[:-1] >= c.least).all() and (sizes <= c.most).all()
    a, b = ids(data), ids(b"x" + data)
    assert len(set(a) & set(b)) >= 0.8 * len(a)
    assert chunking.cut_points(b"", c) == [] and chunking.cut_points(b"abc", c) == [3]
    assert chunking.ContentDefined(5, 4, 3).valid() == chunking.ContentDefined()


def test_erasure():
    data = np.random.default_rng(2).integers(0, 256, (4, 64), dtype=np.uint8)
    parity = erasure.encode(data, 2)
    every = [*data, *parity]
    for n in (0, 1, 2):
        for lost in itertools.combinations(range(6), n):
            out = erasure.reconstruct([None if i in lost else s for i, s in enumerate(every)], 4)
            assert all((out[i] == data[i]).all() for i in range(4))
    with pytest.raises(ValueError):
        erasure.reconstruct([None, None, None, *every[3:]], 4)
    with pytest.raises(ValueError):
        erasure.encoding_matrix(0, 2)
    for x in range(1, 256):
        assert erasure.mul_table()[x, erasure.inverse(x)] == 1


def test_merkle_locality(spark):
    ids = [hashlib.sha256(x.encode()).hexdigest() for x in ("alpha", "beta", "gamma", "delta", "more")]
    df = lambda xs: spark.createDataFrame([("dn1", x) for x in xs], "addr string, chunk_id string")
    root = lambda xs: audit.roots(audit.bucket_digests(df(xs))).first().root
    assert root(ids[:4]) == root(ids[3::-1]) != root(ids)
    assert [(r.chunk_id, r.kind) for r in audit.audit(df(ids), df(ids[:4])).collect()] == [(ids[4], "missing")]


def test_hmac(spark):
    for secret in (b"k", b"s" * 100):
        got = spark.range(1).select(hmac_sha256(secret, F.lit("GET:/a:1"))).first()[0]
        assert got == hmac.new(secret, b"GET:/a:1", hashlib.sha256).hexdigest()


def test_streams_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    src, state = tmp_path / "wal", tmp_path / "state"
    src.mkdir()
    rows = [{"seq": i, "ts": "2024-01-01T00:00:00Z", "op": "delete_object" if rng.random() < 0.3 else "put_object", "bucket": "b", "key": f"k{rng.integers(5)}", "value": float(i)} for i in range(60)]
    for f in range(3):
        (src / f"{f}.json").write_text("\n".join(json.dumps(r) for r in rows[f * 20 : f * 20 + 20]))
    q = jobs.wal_stream(spark, str(src)).writeStream.foreachBatch(jobs.upsert_into(str(state))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.read.parquet(f"{state}/v2").filter("op <> 'delete_object'")
    batch = logs.fold(spark.createDataFrame(rows))
    assert {(r.key, r.seq) for r in last.collect()} == {(r.key, r.seq) for r in batch.collect()}


def test_versions(spark, tmp_path):
    from stowage.sources import snapshots as V

    store = str(tmp_path / "store")
    assert V.newest(spark, store) == 0
    V.snapshot({"t": spark.range(5)}, store)
    V.snapshot({"t": spark.range(2)}, store)
    assert V.reload(spark, store, "t", "held").count() == 2 and V.restore(spark, store, 1) == 3 and V.load(spark, store, "t").count() == 5
    with pytest.raises(KeyError):
        V.load(spark, store, "t", 9)
    spark.range(4).write.mode("overwrite").parquet(f"{store}/t/v1")
    with pytest.raises(ValueError):
        V.restore(spark, store, 1)


def test_log_numbers(spark, tmp_path):
    from stowage.sources import snapshots as V

    store = str(tmp_path / "log")
    V.append(spark.range(10, 30).repartition(5), store, "id")
    assert V.append(spark.range(0), store, "id").count() == 0
    V.append(spark.range(3), store, "id")
    assert [(r.seq, r.id) for r in V.log(spark, store).orderBy("seq").collect()] == [(i + 1, x) for i, x in enumerate([*range(10, 30), 0, 1, 2])]
    assert V.truncate(spark, store, 20) == 1 and [r.seq for r in V.log(spark, store).orderBy("seq").collect()] == [21, 22, 23]
    assert V.truncate(spark, store, 23) == 2 and V.log(spark, store).count() == 0
    assert [r.seq for r in V.append(spark.range(1), store, "id").collect()] == [24]


def test_parity_of_every_stripe(spark, tmp_path):
    """d5_parity against shift-and-reduce products, byte by byte, of all stripes of a small table."""
    import hashlib

    from stowage import queries

    folder = "/root/testdata/sf0.001"
    spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").limit(8).write.parquet(str(tmp_path / "documents.parquet"))

    def times(a, b):
        out = 0
        while b:
            out ^= a if b & 1 else 0
            a, b = (a << 1) ^ (0x11D if a & 128 else 0), b >> 1
        return out

    table = {c: [times(c, b) for b in range(256)] for c in (27, 28, 18, 20)}
    want = set()
    for sid, data in {(r.stripe_id, bytes(r.data)) for r in queries._stripes(spark, str(tmp_path)).collect()}:
        for p, coefs in enumerate(((27, 28, 18, 20), (28, 27, 20, 18))):
            parity = bytes(table[coefs[0]][data[i]] ^ table[coefs[1]][data[256 + i]] ^ table[coefs[2]][data[512 + i]] ^ table[coefs[3]][data[768 + i]] for i in range(256))
            want.add((sid, 4 + p, hashlib.sha256(parity).hexdigest()))
    got = [tuple(r) for r in queries.queries()["d5_parity"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and len({s[0] for s, *_ in want}) > 1


def test_inventory_from_files(spark, tmp_path):
    import os

    from stowage.sources import files

    bodies = [b"a", b"bb", b""]
    ids = [hashlib.sha256(b).hexdigest() for b in bodies]
    for b, i in zip(bodies, ids, strict=True):
        (tmp_path / "chunks" / i[:2]).mkdir(parents=True, exist_ok=True)
        (tmp_path / "chunks" / i[:2] / i[2:]).write_bytes(b)
        os.utime(tmp_path / "chunks" / i[:2] / i[2:], (1700000000, 1700000000))
    (tmp_path / "chunks" / ids[0][:2] / (ids[0][2:] + ".tmp")).write_bytes(b"x")
    (tmp_path / "chunks" / "zz").mkdir()
    (tmp_path / "chunks" / "zz" / ids[0][2:]).write_bytes(b"x")
    got = files.inventory(spark, str(tmp_path), "dn1")
    assert {tuple(r) for r in got.collect()} == {("dn1", i, len(b), 1700000000) for b, i in zip(bodies, ids, strict=True) if b}


def test_alerts_by_hand(spark):
    import random

    r = random.Random(3)
    seen, want, rows = set(), [], [(r.randrange(9), i) for i in range(200)]
    for key, seq in rows:
        if key not in seen:
            if len(seen) >= 4:
                seen = set()
            seen.add(key)
            want.append((key, seq))
    frame = spark.createDataFrame(rows, "key int, seq int")
    assert sorted(tuple(x) for x in audit.first_seen(frame, "key", 4).collect()) == sorted(want)
    assert audit.first_seen(frame.limit(0), "key", 4).count() == 0
    assert audit.first_seen(frame, "key").count() == 9


def test_alerts_over_many_ranges(spark):
    import random

    r = random.Random(5)
    for cap, keys, n, rows in ((1, 3, 60, 5), (3, 30, 300, 10), (20, 25, 300, 8), (9, 9, 100, 7), (5, 400, 400, 30)):
        at = sorted(r.sample(range(-500, 10**6), n))
        sightings = [(r.choice([None, "often", f"k{r.randrange(keys - 2)}"]), seq) for seq in at] if cap < 20 else [(f"k{r.randrange(keys)}", seq) for seq in at]
        seen, want = set(), []
        for key, seq in sightings:
            if key not in seen:
                seen = (seen if len(seen) < cap else set()) | {key}
                want.append((key, seq))
        r.shuffle(sightings)
        got = audit.first_seen(spark.createDataFrame(sightings, "key string, seq long"), "key", cap, rows)
        assert got.columns == ["key", "seq"] and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)), (cap, keys)


def test_alerts_take_no_job_a_clearing(spark):
    sc = spark.sparkContext
    frame = spark.createDataFrame([(i % 50, i) for i in range(1500)], "key int, seq int")
    try:
        sc.setJobGroup("alerts", "300 clearings")
        assert audit.first_seen(frame, "key", 5).count() == 1500
        assert len(sc.statusTracker().getJobIdsForGroup("alerts")) <= 20
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_puts_of_chunks(spark):
    stored = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2")], "addr string, chunk_id string")
    puts = spark.createDataFrame([("a", "1", "1", 5, False), ("a", "1", "1", 5, False), ("a", "2", "2", 5, True), ("b", "2", "2", 5, False), ("a", "3", "x", 5, True), ("a", "4", None, 5, False)], "addr string, chunk_id string, digest string, size int, force boolean")
    got = {(r.addr, r.chunk_id, r.status) for r in chunking.put_chunks(stored, puts).collect()}
    assert got == {("a", "1", "already-stored"), ("a", "2", "stored"), ("b", "2", "stored"), ("a", "3", "mismatch"), ("a", "4", "mismatch")}


def test_gauges_and_sync_status(spark):
    at = spark.createDataFrame([(5,), (12,), (13,), (31,), (33,)], "at long")
    assert [tuple(logs.commit_gauges(at, 10, n).first()) for n in (4, 12, 25, 34, 99)] == [(0, 0), (1, 0), (2, 0), (2, 3), (2, 0)]
    runs = spark.createDataFrame([("f", 1, 10, None), ("f", 2, None, "x"), ("g", 1, None, "y"), ("g", 2, 7, None), ("h", 1, None, "z")], "addr string, at int, size int, err string")
    assert {tuple(r) for r in logs.sync_status(runs).collect()} == {("f", 1, 10, "x", 1, 1), ("g", 2, 7, "", 1, 1), ("h", None, None, "z", 0, 1)}
