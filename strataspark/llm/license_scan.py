"""License scans: an exact set-similarity join of text blocks with license templates.

A block is ``BLOCK`` consecutive words, starting every ``STRIDE`` words, so any run of up to STRIDE
words lies within one. A block has a template's label if it holds at least ``theta`` of the
template's distinct words. Template words are ordered by the number of documents that have them,
rarest first; a template's prefix of |T| - ceil(theta |T|) + 1 words, the length filter and the
positional filter leave few candidates, which are then verified. Words outside all templates never
count, so blocks shrink to the templates' vocabulary, and a document whose vocabulary can't reach
any template isn't cut into blocks. Base phrases are templates of consecutive words.

DataFrame functions only, without a shuffle but for the counts of the templates' words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace

#: What the base phrases are and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Opening words of the notices by which well-known licenses are applied.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "licensed under the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license"),
)
THETA = 0.8
BLOCK, STRIDE = 64, 32
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. ``lower`` does this too except where it makes ASCII letters of U+212A or U+0130."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _places(words: Column) -> Column:
    """(start, label) of every base phrase."""

    def of(own: list[str], label: str) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all(F.get(words, i + k) == w for k, w in enumerate(own)))
        return F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))

    return F.concat(*(of(phrase.split(), label) for phrase, label in BASE_PHRASES.items()))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _block_of(words: Column, vocabulary: Column) -> Column:
    """Each block's words of the vocabulary, in the vocabulary's order."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - STRIDE, F.lit(1)), F.lit(STRIDE))
    return F.transform(starts, lambda s: F.array_intersect(vocabulary, F.slice(words, s, BLOCK)))


def _containment(blocks: Column, own: list[str], need: int) -> Column:
    """Largest share of the template ``own`` (in global order) in a block that has ``need`` of its words, else 0."""
    full = _strings(own)

    def share(block: Column) -> Column:
        # both are in global order: what follows a common word bounds what can be shared from it on
        early = F.lit(False)
        for i, w in enumerate(own[: len(own) - need + 1]):
            at = F.array_position(block, w)
            early = early | ((at > 0) & (F.least(F.lit(len(own) - i), F.size(block) - at.cast("int") + 1) >= need - i))
        overlap = F.size(F.array_intersect(block, full))
        return F.when((F.size(block) >= need) & early & (overlap >= need), overlap / F.lit(float(len(own)))).otherwise(F.lit(0.0))

    return F.coalesce(F.array_max(F.transform(blocks, share)), F.lit(0.0))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, theta: float = THETA) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row.

    Null texts count as empty: no words, no labels, score 0. The score is the largest template
    share of a block that reached theta, and 1 where a base phrase stands.
    """
    sets = [(label, list(dict.fromkeys(text.split()))) for label, text in templates]
    needs = [math.ceil(theta * len(own) - 1e-9) for _, own in sets]
    vocabulary = sorted({w for _, own in sets for w in own})
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    own = own.select("doc_id", F.regexp_extract_all("t", F.lit(f"({WORDS})"), F.lit(1)).alias("w"), F.col("t").contains("license").alias("l"))
    own = own.withColumn("v", F.array_intersect("w", _strings(vocabulary)))
    possible = F.lit(False)
    for (_, words), need in zip(sets, needs, strict=True):
        possible = possible | (F.size(F.array_intersect("v", _strings(words))) >= need)
    own = own.withColumn("possible", possible)
    # texts are cut into words once; words are kept where a phrase or a template may stand
    words = F.when(F.col("l") | F.col("possible"), F.col("w")).otherwise(F.array().cast("array<string>"))
    own = own.select("doc_id", F.size("w").cast("long").alias("n_words"), "v", "l", "possible", words.alias("w"))
    own = Workspace(docs.sparkSession, "licenses").table(own, "words")
    # one row for each word of the templates
    counts = {r["word"]: r["count"] for r in own.select(F.explode("v").alias("word")).groupBy("word").count().collect()}
    vocabulary.sort(key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    empty = F.array().cast("array<array<string>>")
    own = own.withColumn("blocks", F.when(F.col("possible"), _block_of(F.col("w"), _strings(vocabulary))).otherwise(empty))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    own = own.withColumn("places", F.when(F.col("l") & (F.size("w") > 0), _places(F.col("w"))).otherwise(none))
    shares = [_containment(F.col("blocks"), sorted(words, key=rank.__getitem__), need) for (_, words), need in zip(sets, needs, strict=True)]
    found = F.array(*(F.struct(F.lit(label).alias("label"), s.alias("share")) for (label, _), s in zip(sets, shares, strict=True)))
    nothing = F.array().cast("array<struct<label:string,share:double>>")
    own = own.withColumn("found", F.when(F.size("blocks") > 0, F.filter(found, lambda x: x["share"] > 0)).otherwise(nothing))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    labels = F.array_sort(F.array_distinct(F.concat(F.col("places.label"), F.col("found.label"))))
    n = F.size("places")
    return own.select(
        "doc_id",
        "n_words",
        n.cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
    )
