"""License scans by diagonal voting, in DataFrame operations only.

Every rolling two-word hash of every text joins the templates' positions, a fixed table of a few hundred rows; each hit, its two
words compared, votes for the diagonal (place in the text minus place in the template). A template of a whole phrase is found where a
diagonal has all its votes. For longer notices neighbouring diagonals (a few words put in or left out) merge, and any span of the
merged, of twice the template's length at most, is confirmed if enough of the template's distinct two-word steps stand in it.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; first_word and last_word are null where
n_base is 0; repeated rows, also of one doc_id or without one, each get their own row; an empty table gives no rows; only doc_id and
text are read, so other columns never clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import documents, written

#: Fixed phrases of the base scan and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: The method's own templates (name, label, words, least share of its steps): whole short phrases, and notices with gaps.
NOTICES = [
    ("cc-by-nc", "cc-by-nc", "cc by nc", 1.0),
    ("cc-by-sa", "cc-by-sa", "cc by sa", 1.0),
    ("lgpl", "lgpl", "gnu lesser general public license", 1.0),
    ("agpl", "agpl", "gnu affero general public license", 1.0),
    ("mpl", "mpl", "mozilla public license", 1.0),
    ("bsd", "bsd", "bsd 3 clause license", 1.0),
    ("mit-notice", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", 0.6),
    ("apache-notice", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.6),
    ("gpl-notice", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version", 0.6),
    ("bsd-notice", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", 0.6),
]
#: The hash that stands for a text itself beside its pairs of words.
WHOLE = 0
#: How far apart neighbouring diagonals are at most, in words.
NEAR = 4


def words(text: Column) -> Column:
    """The lower-cased (A-Z) words of a text."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def templates(spark) -> DataFrame:
    """One row a two-word step: name, label, base, at, steps, share, w1, w2, h. A fixed few hundred rows."""
    rows = []
    for name, label, phrase, share in [*((p, v, p, 1.0) for p, v in BASE.items()), *NOTICES]:
        w = phrase.split(" ")
        rows += [(name, label, name in BASE, i, len(w) - 1, share, w[i], w[i + 1]) for i in range(len(w) - 1)]
    shape = "name string, label string, base boolean, at int, steps int, share double, w1 string, w2 string"
    return spark.createDataFrame(rows, shape).withColumn("h", F.xxhash64("w1", "w2"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs."""
    steps = templates(docs.sparkSession)
    # one element a rolling pair of words and one, without a second word, for the text itself: that one joins the row of hash null
    words_ = docs.select("doc_id", words(F.col("text")).alias("w")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), "w")
    pairs = words_.select("row", "doc_id", "n_words", F.posexplode(F.arrays_zip(F.concat("w", F.array(F.lit(""))).alias("w1"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(1))).alias("w2"))).alias("i", "x"))
    whole = F.col("i") == F.col("n_words")
    pairs = pairs.filter(whole | F.col("x.w2").isNotNull()).select("row", "doc_id", "n_words", "i", "x.w1", "x.w2", F.when(whole, WHOLE).otherwise(F.xxhash64("x.w1", "x.w2")).alias("h"))
    places = steps.unionByName(docs.sparkSession.createDataFrame([(WHOLE,)], "h long"), allowMissingColumns=True).withColumnsRenamed({"w1": "t1", "w2": "t2"})
    hits = pairs.join(F.broadcast(places), "h").filter("t1 IS NULL AND i = n_words OR w1 = t1 AND w2 = t2 AND i < n_words")
    hits = written(hits.select("row", "doc_id", "n_words", "i", "name", "label", "base", "at", "steps", "share"), "license-hits")

    rows = hits.filter("name IS NULL").select("row", "doc_id", "n_words")
    votes = hits.filter("name IS NOT NULL").withColumn("diagonal", F.col("i") - F.col("at"))
    lines = votes.filter("base").groupBy("row", "name", "label", "steps", "diagonal").agg(F.count("*").alias("n"))
    base = lines.filter("n = steps").groupBy("row").agg(F.count("*").alias("n_base"), F.min("diagonal").cast("long").alias("first_word"), F.max("diagonal").cast("long").alias("last_word"), F.collect_set("label").alias("base_set"))

    by = Window.partitionBy("row", "name").orderBy("diagonal")
    own = votes.filter("NOT base").withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEAR).cast("int"), F.lit(1))).withColumn("group", F.sum("new").over(by))
    # spans of 2 * steps words from each hit of a group on: places are scaled, so that one range fits every template
    scale = math.lcm(*(2 * r.steps for r in steps.select("steps").distinct().collect()))
    span = Window.partitionBy("row", "name", "group").orderBy(F.col("i").cast("long") * (F.lit(scale).cast("long") / (2 * F.col("steps"))).cast("long")).rangeBetween(0, scale - 1)
    spans = own.withColumn("covered", F.size(F.collect_set("at").over(span)))
    # a span is confirmed if it has enough of the template
    sure = spans.filter("covered >= share * steps").groupBy("row").agg(F.collect_set("label").alias("own_set"), F.max(F.col("covered") / F.col("steps")).alias("cover"))

    empty = F.array().cast("array<string>")
    both = F.array_sort(F.array_union(F.coalesce("base_set", empty), F.coalesce("own_set", empty)))
    return rows.select("row", "doc_id", "n_words").join(base, "row", "left").join(sure, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.array_join(F.array_sort(F.coalesce("base_set", empty)), ",").alias("base_labels"), F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
