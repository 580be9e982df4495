"""N-gram Jaccard join by a token-group matrix.

Documents with equal shingle sets are one class. Classes are partitioned into groups of similar ones: each links to leaders
(drawn by hashes of ids) of the buckets of its least hashes, if the exact similarity confirms it; the linked ones form a group. Each group's
token union goes into the matrix as rows (token, group), and a query group's overlap with another is bounded by counting the
rows that both have; only pairs of groups whose bound allows a similarity of SHARE are opened and compared document by document,
in blocks. Links between groups and within them give the components.

What keeps it exact and linear. Of each set only its first tokens (PREFIX of the hash range, but at least the prefix that a
link must touch) enter the matrix, in one order for all: common tokens (an ordering hint, found by local counts) last. If two
sets link, X being the one whose first tokens end first, then they share at least need = ceil(3/7 (|A|+|B|)) - |X| + |first(X)|
first tokens. Tokens of more than FEW groups don't make pairs; a pair that needs them has at least `need` of them on both sides,
so it is found from the few groups that have so many. No cap drops a pair: a wider token only takes the second way.

Defined cases: null, empty or wordless text has an empty set, links with nothing and is its own component; fewer words than
WORDS make one shingle; rows of one doc_id are one document for linking and one row each in the result; rows without a doc_id link with nothing and have no
component; ties of leaders go by
a hash of the id, which changes no result; an empty table gives no rows; only doc_id and text are read, and near_dedup() passes all columns on, so
none clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import TEXTS_BROADCAST_BYTES, documents, frugal, give_back, pieces, small, text_bytes, written

#: Words of a shingle; least similarity in hundredths; share of the hash range whose tokens are a set's first ones.
WORDS, SHARE, PREFIX = 5, 75, 0.3
#: Leaders of a hash, hashes of which a leader must have the same, leaders that a set is compared with in
#: a round, and rounds. They only make groups; links that they miss are found between groups.
LEADERS, AGREE, TRIES, ROUNDS = 4, 4, 8, 4
#: Least hashes of a set; groups of a token up to which it makes pairs at once; members of a block.
KEYS, FEW, BLOCK = 8, 8, 32
#: Local count in a chunk of documents from which a token is held common, and how many common tokens are held at most (they only order tokens).
COMMON, COMMON_MOST = 16, 500_000
#: Tokens that a bucket of the matrix has on average.
BUCKET = 500_000
TAU = np.uint64(int(PREFIX * 2**64))

_U = np.uint64
_seeds = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"stowage", seed=i) for i in range(160)), np.uint64)
_BYTE = _seeds[:256] | _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _STEP = _seeds[256] | _U(1), _seeds[257:273] | _U(1)
_powers: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        size = max(n, 1 << 20)
        inverse = _U(pow(int(_BASE), -1, 2**64))
        _powers["p"] = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _powers["i"] = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, inverse)]), dtype=np.uint64)
    return _powers["p"], _powers["i"]


def shingle_sets(column: pa.Array, most: int = 1 << 19) -> Iterator[np.ndarray]:
    """Each text's set of shingle hashes, ascending; texts are hashed most bytes at a time."""
    data, off = text_bytes(column)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, side="right")) - 1)
        yield from _sets(data[off[at] : off[to]], off[at : to + 1] - off[at])
        at = to


def _sets(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    empty = np.zeros(0, np.uint64)
    if not len(data):
        yield from (empty for _ in range(len(off) - 1))
        return
    word = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True  # a document begins; the words of two never join
    starts = np.flatnonzero(word & (first[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (first[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    power, inverse = _power(len(data))
    total = np.concatenate([[_U(0)], np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
    words = _mix((total[ends] - total[starts]) * inverse[starts])
    cut = np.searchsorted(starts, off)
    grams = empty
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        grams = np.zeros(n, np.uint64)
        for i in range(WORDS):
            grams += words[i : i + n] * _STEP[i]
        grams = _mix(grams)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        elif b > a:
            yield _mix(np.array([(words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64)]) + _STEP[8 + b - a : 9 + b - a])
        else:
            yield empty


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (ascending) link: 100 |A and B| >= SHARE |A or B|."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < SHARE * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= SHARE * (len(a) + len(b) - common)


def common_tokens(docs: DataFrame) -> np.ndarray:
    """Tokens that stand in COMMON documents or more of some chunk of documents: all documents are counted, in their tasks."""

    @frugal
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def told():
            t, k = np.unique(np.concatenate(held), return_counts=True)
            t, k = t[k >= COMMON], k[k >= COMMON]
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(k.astype(np.int64))], ["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(0)):
                held.append(s)
                n += len(s)
                if n >= 2_000_000:
                    yield told()
                    held, n = [], 0
        if n:
            yield told()

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    # a bounded hint for the order: leaving tokens out of it changes no result
    most = found.orderBy(F.desc("n"), "token").limit(COMMON_MOST).select("token").toPandas()["token"].to_numpy(np.int64)
    return np.sort(most.view(np.uint64))


def firsts(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, bool]:
    """A set's first tokens, and whether they had to reach beyond the fixed range to be enough."""
    least = len(s) - (SHARE * len(s) + 99) // 100 + 1
    if len(common):
        at = np.searchsorted(common, s)
        rare = common[np.minimum(at, len(common) - 1)] != s
        if not rare.all():
            s = np.concatenate([s[rare], s[~rare]])
            own = int((s[: int(rare.sum())] < TAU).sum())
            return s[: max(own, least)], least > own
    own = int(np.searchsorted(s, TAU))
    return s[: max(own, least)], least > own


def signatures(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """A written table: doc_id, n (set size), digest, keys (KEYS least hashes), first (packed tokens), far (beyond the range)."""
    held = docs.sparkSession.sparkContext.broadcast(common)
    odd = _seeds[280 : 280 + KEYS] | _U(1)

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = held.value
        for batch in batches:
            for part in pieces(batch, 1000):
                out = []
                for s in shingle_sets(part.column(1)):
                    if len(s):
                        first, far = firsts(s, hint)
                        out.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), [int((s * m).min() >> _U(1)) for m in odd], first.tobytes(), far))
                    else:
                        out.append((0, b"", [], b"", False))
                kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array([r[i] for r in out], t) for i, t in enumerate(kinds))], ["doc_id", "n", "digest", "keys", "first", "far"])

    out = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, digest binary, keys array<long>, first binary, far boolean"), "signatures")
    held.unpersist()
    return out


def verify(pairs: DataFrame, blocks: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: the links between documents of pairs' blocks. pairs: x, y of blocks; blocks: block, doc_id, of these pairs alone, a table. Blocks are bounded in members."""
    # a table, so that the joins can be split over tasks where a block is in very many pairs
    held = written(docs.select("doc_id", "text").join(small(blocks, limit=TEXTS_BROADCAST_BYTES), "doc_id").groupBy("block").agg(F.collect_list(F.struct("doc_id", "text")).alias("m")), "texts")
    both = pairs.join(held.select(F.col("block").alias("x"), F.col("m").alias("mx")), "x").join(held.select(F.col("block").alias("y"), F.col("m").alias("my")), "y")

    @frugal
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, []  # rows come in runs of one y
        for batch in batches:
            for part in pieces(batch, 64):
                out = []
                for y, mx, my in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if y != last:
                        last, known = y, _members(my)
                    union = np.unique(np.concatenate([s for _, s in known])) if len(known) > 1 else None
                    done = False
                    for i, a in _members(mx):
                        if union is not None:  # the group's union bounds the overlap with each of its members
                            at = np.searchsorted(union, a)
                            if 100 * int((union[np.minimum(at, len(union) - 1)] == a).sum()) < SHARE * len(a):
                                continue
                        for j, b in known:
                            if linked(a, b):
                                out.append((i, j))
                                done = True
                                break  # both blocks are groups of linked documents: one link joins them
                        if done:
                            break
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return both.select("y", "mx", "my").mapInArrow(compare, "a long, b long")


def _members(m: list[dict]) -> list[tuple[int, np.ndarray]]:
    return list(zip([x["doc_id"] for x in m], shingle_sets(pa.array([x["text"] for x in m], pa.string())), strict=True))


def matrix(units: DataFrame, common: np.ndarray, buckets: int) -> DataFrame:
    """A written table of kind 0: (u, v, c), c tokens of few groups that groups u < v share; kind 1: (token, u, 1), rows of wider tokens.

    units: unit, first. Each task sends its tokens bucket by bucket, packed; common tokens, whose rows could be many, go the second way at once.
    """
    held = units.sparkSession.sparkContext.broadcast(common)
    mult = _seeds[300] | _U(1)

    @frugal
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint = held.value

        def told(tokens, owners):
            t, u = np.concatenate(tokens), np.concatenate(owners)
            if len(hint):
                at = np.searchsorted(hint, t)
                wide = hint[np.minimum(at, len(hint) - 1)] == t
                if wide.any():
                    pair = np.unique(np.stack([t[wide].view(np.int64), u[wide]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(pair.shape[1], -1, np.int32)), pa.array(pair[0]), pa.array(pair[1]), pa.nulls(pair.shape[1], pa.binary()), pa.nulls(pair.shape[1], pa.binary())], ["b", "token", "unit", "tokens", "units"])
                    t, u = t[~wide], u[~wide]
            b = ((t * mult >> _U(40)) % _U(buckets)).astype(np.int32)
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(buckets + 1))
            t, u = t[order], u[order]
            some = [i for i in range(buckets) if cuts[i + 1] > cuts[i]]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), none, none, *(pa.array([x[cuts[i] : cuts[i + 1]].tobytes() for i in some], pa.binary()) for x in (t, u))], ["b", "token", "unit", "tokens", "units"])

        tokens, owners, n = [], [], 0
        for batch in batches:
            for part in pieces(batch, 1000):
                for unit, first in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    t = np.frombuffer(first, np.uint64)
                    tokens.append(t)
                    owners.append(np.full(len(t), unit, np.int64))
                    n += len(t)
                if n >= 1_500_000:
                    yield from told(tokens, owners)
                    tokens, owners, n = [], [], 0
        if n:
            yield from told(tokens, owners)

    def meet(table: pa.Table) -> pa.Table:
        t = np.frombuffer(b"".join(table["tokens"].to_pylist()), np.uint64)
        u = np.frombuffer(b"".join(table["units"].to_pylist()), np.int64)
        order = np.argsort(t, kind="stable")
        t, u = t[order], u[order]
        more = np.zeros(len(t), bool)
        more[1:] = t[1:] == t[:-1]
        more[:-1] |= more[1:]
        t, u = t[more], u[more]  # tokens of at least two rows
        order = np.lexsort((u, t))
        t, u = t[order], u[order]
        keep = np.ones(len(t), bool)
        keep[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1])
        t, u = t[keep], u[keep]
        start = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
        size = np.diff(np.append(start, len(t)))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for m in range(2, FEW + 1):
            rows = u[start[size == m][:, None] + np.arange(m)]
            i, j = np.triu_indices(m, 1)
            left.append(rows[:, i].ravel())
            right.append(rows[:, j].ravel())
        a, b = np.concatenate(left), np.concatenate(right)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, int)
        count = np.diff(np.append(new, len(a)))
        wide = np.repeat(size > FEW, size)
        give_back()
        kind = np.concatenate([np.zeros(len(new), np.int32), np.ones(int(wide.sum()), np.int32)])
        return pa.table([kind, np.concatenate([a[new], t[wide].view(np.int64)]), np.concatenate([b[new], u[wide]]), np.concatenate([count, np.ones(int(wide.sum()), np.int64)])], ["kind", "x", "y", "c"])

    sent = written(units.select("unit", "first").mapInArrow(send, "b int, token long, unit long, tokens binary, units binary"), "matrix")
    held.unpersist()
    shape = "kind int, x long, y long, c long"
    met = sent.filter("b >= 0").groupBy("b").applyInArrow(meet, shape)
    return written(met.unionByName(sent.filter("b < 0").selectExpr("1 AS kind", "token AS x", "unit AS y", "1L AS c")), "overlaps")


def _need(a: str, b: str) -> str:
    """The least number of first tokens that a link between groups a and b shares (SQL)."""
    return f"greatest(1, ceil(3 * ({a}.low + {b}.low) / 7D) + if({a}.far OR {b}.far, least({a}.slack, {b}.slack), greatest({a}.slack, {b}.slack)))"


def candidates(overlaps: DataFrame, units: DataFrame) -> DataFrame:
    """x, y: pairs of groups whose bound allows a link. units: unit, low, high (set sizes), slack (least of |first| - |set|), far."""
    pairs = overlaps.filter("kind = 0").groupBy("x", "y").agg(F.sum("c").alias("c"))
    wide = overlaps.filter("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("unit")).distinct()
    several = wide.groupBy("token").agg(F.min("unit").alias("a"), F.max("unit").alias("b")).filter("a < b").select("token")
    wide = written(wide.join(several, "token", "left_semi"), "wide")
    had = wide.groupBy("unit").agg(F.count("*").alias("h"))
    facts = written(units.join(had, "unit", "left").select("unit", "low", "high", "slack", "far", F.coalesce("h", F.lit(0)).alias("h")), "groups")
    fits = "p.low * 3 <= q.high * 4 AND q.low * 3 <= p.high * 4"
    few = pairs.alias("o").join(facts.alias("p"), F.expr("o.x = p.unit")).join(facts.alias("q"), F.expr("o.y = q.unit")).filter(f"{fits} AND o.c + least(p.h, q.h) >= {_need('p', 'q')}").select("x", "y")
    # a link that only wide tokens show needs `need` of them; of the two groups one has so many by its own figures
    own = wide.join(facts.filter("h > 0"), "unit")
    rich = own.filter("far OR h >= greatest(1, slack + low - floor(high / 7D))")
    second = rich.alias("p").join(own.alias("q"), F.expr(f"p.token = q.token AND p.unit <> q.unit AND {fits} AND least(p.h, q.h) >= {_need('p', 'q')}"))
    second = second.groupBy(F.col("p.unit").alias("x"), F.col("q.unit").alias("y"), F.expr(_need("p", "q")).alias("need")).agg(F.count("*").alias("c")).filter("c >= need")
    return few.unionByName(second.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))).distinct()


def leader_pairs(reps: DataFrame, labels: DataFrame | None, salt: int) -> DataFrame:
    """x > y: sets to compare, each with at most TRIES leaders of its buckets that are of another label. reps: doc_id, n, keys."""
    sets = reps.select("doc_id", "n", "keys", F.col("doc_id").alias("label"))
    if labels is not None:
        sets = reps.select("doc_id", "n", "keys").join(small(labels.withColumnRenamed("id", "doc_id")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))
    keyed = sets.select("doc_id", "label", F.explode("keys").alias("key"))
    picks = [F.min(F.struct(F.xxhash64("doc_id", F.lit(r)).alias("h"), F.col("doc_id").alias("leader"), F.col("label").alias("other"))).alias(f"p{r}") for r in range(salt, salt + LEADERS)]
    leaders = keyed.groupBy("key").agg(*picks, F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    leaders = leaders.select("key", F.array_distinct(F.array(*(F.struct(f"p{r}.leader", f"p{r}.other") for r in range(salt, salt + LEADERS)))).alias("leaders"))
    tried = keyed.join(small(written(leaders, "keys")), "key").select("doc_id", "label", F.inline("leaders")).filter("label <> other").select("doc_id", "leader").distinct()
    own = sets.select(F.col("doc_id").alias("leader"), F.col("n").alias("m"), F.col("keys").alias("own"))
    both = written(tried.join(sets.drop("label"), "doc_id"), "tried").join(own, "leader")
    agreed = both.withColumn("c", F.size(F.array_intersect("keys", "own"))).filter(f"c >= {AGREE} AND 100 * least(n, m) >= {SHARE} * greatest(n, m)")
    # at most KEYS * LEADERS of them a set
    order = F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), F.xxhash64("leader").alias("h"), "leader")))
    top = agreed.groupBy("doc_id").agg(F.slice(order, 1, TRIES).alias("t")).select("doc_id", F.explode("t.leader").alias("leader"))
    return top.select(F.greatest("doc_id", "leader").alias("x"), F.least("doc_id", "leader").alias("y")).distinct()


def similar_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs."""
    spark = docs.sparkSession
    common = common_tokens(docs)
    rows = signatures(docs, common)
    # one class for each set; its documents are represented by the least id
    # (only classes of several rows are joined, and as a table: a class of very many copies can then be split over tasks)
    classes = written(rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1").select("digest", "rep"), "classes")
    members = written(rows.select("doc_id", "n", "digest").join(small(classes), "digest", "left"), "members")
    copies = written(members.filter("rep <> doc_id").select("doc_id", "digest", "rep").distinct(), "copies")
    # only the copied set of an id is left out: the id's rows of other sets are not copies
    not_reps = small(copies.select("doc_id", "digest"))
    reps = rows.filter("n > 0 AND doc_id IS NOT NULL").join(not_reps, ["doc_id", "digest"], "left_anti")

    # groups: each class and the leaders it agrees with best, confirmed; in rounds, by other leaders each time, while they link on
    stars, labels = None, None
    for salt in range(0, ROUNDS * LEADERS, LEADERS):
        tries = written(leader_pairs(reps, labels, salt), "leaders")
        alone = written(tries.select(F.explode(F.array("x", "y")).alias("block")).distinct().select("block", F.col("block").alias("doc_id")), "blocks")
        new = written(verify(tries, alone, docs), "stars")
        stars = new if stars is None else stars.unionByName(new)
        labels = written(components(stars), "labels")
        if new.count() * 10 < tries.count() or new.isEmpty():
            break

    # the matrix, over groups
    n_labels = labels.count()
    named = reps.join(small(labels.withColumnsRenamed({"id": "doc_id", "label": "unit"}), n_labels), "doc_id", "left").withColumn("unit", F.coalesce("unit", "doc_id"))
    slack = (F.octet_length("first") / 8).cast("int") - F.col("n")
    units = written(named.groupBy("unit").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min(slack).alias("slack"), F.max("far").alias("far"), F.count("*").alias("size")), "units")
    tokens = rows.agg(F.sum(F.octet_length("first"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // (8 * BUCKET)))
    found = written(candidates(matrix(named, common, buckets), units), "pairs")

    # open what the bound allows, block by block
    ids = named.select("doc_id", "unit").join(found.select(F.explode(F.array("x", "y")).alias("unit")).distinct(), "unit", "left_semi").join(units.select("unit", "size"), "unit")
    block = F.when(F.col("size") <= 1, F.col("unit").cast("string")).otherwise(F.concat_ws("-", "unit", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / BLOCK))))
    blocks = written(ids.select("unit", "doc_id", block.alias("block")), "open-blocks")
    by_unit = blocks.select("unit", "block").distinct()
    opened = found.join(by_unit.select(F.col("unit").alias("x"), F.col("block").alias("bx")), "x").join(by_unit.select(F.col("unit").alias("y"), F.col("block").alias("by")), "y").select(F.col("bx").alias("x"), F.col("by").alias("y"))
    cross = verify(opened, blocks.select("block", "doc_id"), docs)

    label = labels.select("id", "label")
    star_edges = label.filter("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b"))
    # a doc_id that stands in rows of several sets joins their classes
    edges = star_edges.unionByName(cross).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    final = components(edges)
    return members.join(small(final.withColumnsRenamed({"id": "doc_id", "label": "component_id"})), "doc_id", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_groups(documents(spark, sf_dir))


def near_dedup(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one of the least id. The same columns."""
    groups = similar_groups(docs)
    gone = written(groups.filter("component_id <> doc_id").select("doc_id").distinct(), "near-copies")
    return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
