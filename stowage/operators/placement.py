"""Rendezvous placement without a shuffle: a sorted array of scored nodes on each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import descending, score

Node = tuple[str, str, str]  # addr, class, domain


def _ranked(key: Column, nodes: list[Node]) -> list[Column]:
    """A text for each node whose ascending order is score descending, address ascending: the flipped score's 16 digits, then the address."""
    return [F.concat(descending(score(key, F.lit(a))), F.lit(a)) for a, _, _ in nodes]


def _first(ranked: list[Column], n: int | Column, skip: int = 16) -> Column:
    """The addresses of the first n texts."""
    return F.transform(F.slice(F.sort_array(F.array(*ranked)), F.lit(1), F.lit(n) if isinstance(n, int) else n), lambda x: F.substring(x, skip + 1, 1 << 30))


def pick(key: Column, n: int, nodes: list[Node]) -> Column:
    """Addresses of the n best nodes: score descending, address ascending; all of them if n is more, none if n <= 0."""
    if n <= 0 or not nodes:
        return F.array().cast("array<string>")
    return _first(_ranked(key, nodes), n)


def pick_by_domain(key: Column, n: int, nodes: list[Node]) -> Column:
    """First the best node of each domain, then the others, both by score."""
    if n <= 0 or not nodes:
        return F.array().cast("array<string>")

    def picked(ranked: Column) -> Column:
        texts = [F.get(ranked, F.lit(i)) for i in range(len(nodes))]
        by: dict[str, list[Column]] = {}
        for text, (_, _, domain) in zip(texts, nodes, strict=True):
            by.setdefault(domain, []).append(text)
        best = {d: F.least(*own) if len(own) > 1 else own[0] for d, own in by.items()}
        return _first([F.concat(F.when(text == best[d], "0").otherwise("1"), text) for text, (_, _, d) in zip(texts, nodes, strict=True)], n, 17)

    # an array of one element binds the texts, which are else hashed again wherever they stand
    return F.element_at(F.transform(F.array(F.array(*_ranked(key, nodes))), picked), 1)


def pick_class(key: Column, n: int, nodes: list[Node], wanted: str) -> Column:
    """Among the class's nodes, blind to domains, if it has n; else by domain among all."""
    own = [x for x in nodes if x[1] == wanted]
    return pick(key, n, own) if len(own) >= n else pick_by_domain(key, n, nodes)


def pick_labelled(key: Column, label: Column, replicas: Column, wanted: int, n: int, nodes: list[Node]) -> Column:
    """Among the nodes of the label's class as many as there are replicas, blind to domains, if the class has wanted nodes; else n by domain among all."""
    out = pick_by_domain(key, n, nodes)
    for name in sorted({c for _, c, _ in nodes}):
        own = [x for x in nodes if x[1] == name]
        if len(own) >= wanted:
            out = F.when(label == name, _first(_ranked(key, own), replicas)).otherwise(out)
    return out


def references(ids: DataFrame, key: str, placed: Column) -> DataFrame:
    """key, addr, replica_pos."""
    return ids.select(key, F.posexplode(placed).alias("replica_pos", "addr"))


def simulate(n_keys: int, before: list[Node], after: list[Node], n: int, spark) -> DataFrame:
    """One row a node: copies before and after; with the moved keys' count on each row."""
    keys = spark.range(n_keys).select(F.concat(F.lit("chunk-"), F.col("id").cast("string")).alias("k"))
    both = keys.select("k", pick(F.col("k"), n, before).alias("o"), pick(F.col("k"), n, after).alias("w"))
    moved = both.agg(F.count_if(F.array_sort("o") != F.array_sort("w")).alias("moved"))
    old = both.select(F.explode("o").alias("addr")).groupBy("addr").agg(F.count("*").alias("copies_before"))
    new = both.select(F.explode("w").alias("addr")).groupBy("addr").agg(F.count("*").alias("copies_after"))
    return new.join(old, "addr", "full_outer").crossJoin(F.broadcast(moved)).select("addr", F.coalesce("copies_before", F.lit(0)).cast("long").alias("copies_before"), F.coalesce("copies_after", F.lit(0)).cast("long").alias("copies_after"), F.col("moved").cast("long").alias("moved"))
