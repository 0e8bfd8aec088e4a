"""License scans by diagonal voting.

Texts and templates are sequences of words. Every run of k words of a text is hashed, where k is the template's number of words
up to ``GRAM``; all rolling hashes are joined with the places of the templates' runs, and a hit counts only if the
words are the same, too. A hit at word p of the text and word t of a template votes for the diagonal p - t. Votes are
counted per diagonal, neighbouring diagonals (at most ``GAP`` apart, where words were put in or left out) are merged, and the
merged span is verified: the share of the template's words that its hits cover must reach ``min_share``, and the
span may be at most twice as long as the template, else only its best single diagonal counts. A phrase of up to
``GRAM`` words is one run, so each of its hits is a whole place of it.

The join is with the templates' runs, whose number is known on the driver: they are broadcast up to ``BROADCAST_RUNS``
rows (about 60 bytes each) and shuffled beyond it. Texts are scanned once and never shuffled: a hit carries only its place.
Hits are written, then dealt by the row's number in the scan, so copies, ids and sources of any share are
spread; one shuffle of narrow rows serves all steps. A row's own marker hit keeps it without a template in it.

Words are runs of digits, letters and characters beyond ASCII; A-Z count as lower case. Cases: NULL and
empty texts have no word and no label; NULL and repeated ids are rows like any other; in a very long text every
place is counted; no templates give no labels; an empty table no rows. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitgauge.staging import stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What lies between words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a run; shorter templates are one run.
GRAM = 4
GAP = 3
MIN_SHARE = 0.6
BROADCAST_RUNS = 200_000


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # a base phrase, whose places are counted


# The base phrases and their labels.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]

# Words of well-known license notices.
NOTICES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """Array of a text's words, empty for NULL."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())
    return F.filter(F.split(low, BREAK), lambda w: w != "")


def runs_of(words: Column, k: int) -> Column:
    """Hashes of all runs of k words, in order."""
    last = F.size(words) - k
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(k), *[words[i + j] for j in range(k)]))


def template_runs(docs: DataFrame, templates: Iterable[Template]) -> DataFrame:
    """(hash, template, label, phrase, length, place, k, said): every run of every template, and a marker with k = 0."""
    spark = docs.sparkSession
    rows = [(i, t.label, t.text, t.phrase) for i, t in enumerate(templates)]
    texts = spark.createDataFrame(rows, "template int, label string, text string, phrase boolean").coalesce(1)
    texts = texts.withColumn("words", words_of(F.col("text"))).filter(F.size("words") > 0)
    runs = [
        texts.filter(F.least(F.size("words"), F.lit(GRAM)) == k)
        .select("*", F.posexplode(runs_of(F.col("words"), k)).alias("place", "hash"))
        .select("hash", "template", "label", "phrase", F.size("words").alias("length"), "place", F.lit(k).alias("k"),
                F.slice("words", F.col("place") + 1, k).alias("said"))
        for k in range(1, GRAM + 1)
    ]
    marker = spark.range(1).select(
        F.xxhash64(F.lit(0)).alias("hash"), F.lit(-1).alias("template"), F.lit(None).cast("string").alias("label"),
        F.lit(False).alias("phrase"), F.lit(0).alias("length"), F.lit(0).alias("place"), F.lit(0).alias("k"),
        F.array().cast("array<string>").alias("said"),
    )
    out = marker
    for part in runs:
        out = out.unionByName(part)
    return out


def hits(docs: DataFrame, key: str, text: str, templates: list[Template]) -> DataFrame:
    """(row, id, n_words, template, label, phrase, length, pos, place, k): the places where a run of a template stands.

    Each row of ``docs`` has a hit of the marker besides.
    """
    sizes = sorted({min(GRAM, len(_plain_words(t.text))) for t in templates} - {0})
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), words_of(F.col(text)).alias("words")
    ).select("*", F.size("words").alias("n_words"))
    own = F.array(F.xxhash64(F.lit(0)))
    grams = rows.select(
        "row", "id", "words", "n_words", F.posexplode(F.concat(own, *[runs_of(F.col("words"), k) for k in sizes])).alias("at", "hash")
    )
    known = template_runs(docs, templates)
    if sum(len(_plain_words(t.text)) for t in templates) <= BROADCAST_RUNS:
        known = F.broadcast(known)
    # runs of k words begin after the marker and all shorter runs
    begin, base = {}, F.lit(1)
    for k in sizes:
        begin[k], base = base, base + F.greatest(F.col("n_words") - (k - 1), F.lit(0))
    pos = F.lit(0)
    for k in sizes:
        pos = F.when(F.col("k") == k, F.col("at") - begin[k]).otherwise(pos)
    met = grams.join(known, "hash").withColumn("pos", pos)
    met = met.filter((F.col("k") == 0) | (F.slice("words", F.col("pos") + 1, F.greatest("k", F.lit(1))) == F.col("said")))
    return met.select("row", "id", "n_words", "template", "label", "phrase", "length", "pos", "place", "k")


def _plain_words(text: str) -> list[str]:
    """A template's words (ASCII case only), to know how many there are before Spark reads them."""
    low = text.translate(str.maketrans(UPPER, UPPER.lower()))
    return "".join(c if c in "0123456789" or "a" <= c <= "z" or ord(c) > 127 else " " for c in low).split(" ")


def _covered(places: str) -> Column:
    """Number of a template's words in runs that begin at the listed places."""
    def run(p: Column) -> Column:
        return F.sequence(p, p + F.least(F.col("length"), F.lit(GRAM)) - 1)

    return F.size(F.array_distinct(F.flatten(F.transform(places, run))))


def spans(found: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(row, template, label, first, last, share): verified spans of ``hits``, from word ``first`` to ``last``.

    A merged span that is too long for its template is the best of its diagonals (the first of equal ones).
    """
    each = ["row", "template", "label", "length"]
    votes = found.filter("template >= 0").withColumn("diagonal", F.col("pos") - F.col("place"))
    lines = votes.groupBy(*each, "diagonal").agg(
        F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last"), F.collect_set("place").alias("places"),
    ).withColumn("own", _covered("places"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > GAP
    lines = lines.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
    lines = lines.withColumn("band", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.struct(F.col("own"), -F.col("diagonal"), "first", "last")
    merged = lines.groupBy(*each, "band").agg(
        F.min("first").alias("first"), F.max("last").alias("last"),
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max(best).alias("best"),
    )
    whole = F.col("last") - F.col("first") + 1 <= 2 * F.col("length")
    merged = merged.select(
        *each, F.when(whole, F.col("first")).otherwise(F.col("best.first")).alias("first"),
        F.when(whole, F.col("last")).otherwise(F.col("best.last")).alias("last"),
        (F.when(whole, _covered("places")).otherwise(F.col("best.own")) / F.col("length")).alias("share"),
    )
    return merged.filter(F.col("share") >= min_share).drop("length")


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: list[Template] = PHRASES,
    notices: list[Template] = NOTICES, min_share: float = MIN_SHARE,
) -> DataFrame:
    """One row per row of ``docs``: key, n_words, places of the base phrases, labels, and the best span's share.

    ``spans`` lists all verified spans (label, first and last word, share), in the order of the text.
    """
    found = stage(hits(docs, key, text, [*phrases, *notices]), "license-hits").repartition("row")
    verified = spans(found, min_share).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("first", "last", "label", "share"))).alias("spans"),
        F.max("share").alias("score"),
    )
    base = F.col("phrase")
    rows = found.groupBy("row").agg(
        F.max(F.when(F.col("template") < 0, F.struct("id"))).alias("d"), F.max("n_words").cast("bigint").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("pos"))).cast("bigint").alias("first_word"),
        F.max(F.when(base, F.col("pos"))).cast("bigint").alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base"),
    )
    both = rows.join(verified, "row", "left").withColumn("spans", F.coalesce("spans", F.array()))
    labels = F.array_sort(F.array_union("base", F.col("spans.label")))
    return both.select(
        F.col("d.id").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
