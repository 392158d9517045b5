"""License scans by an exact set-similarity join, in DataFrame functions only.

Text blocks are windows of a document's words, each as the set of its words, and the document as a whole.
A window is twice as long as the longest template and the next begins half-way, so a notice lies in one
window however its lines are broken. A
template is found in a block when at least a given share of the template's words are in the block.
Words are ordered by the number of windows that hold them in the whole corpus, rarest first. If a block
holds at least ``need`` of a template's m words, it holds one of the template's m - need + 1 rarest, and
that one is among the block's own n - need + 1 rarest: only these prefixes are joined. A block with
fewer than ``need`` words is left out (length filter), and so is a pair whose shared word leaves too
few words behind it on either side (positional filter). The pairs that remain are verified.

Only words of some template can be shared, so blocks keep just those; the join is with the templates,
whose number and size the caller fixes. Phrases, whose words must stand consecutively, are templates
of which the whole document must hold every word; their places are then read off the word positions.

Words are runs of ASCII letters and digits and of any other characters beyond ASCII, with A to Z
lower-cased. A missing text has no words. Repeated rows each give a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.plans.scratch import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = WORD.replace("[^", "[")  # all that no word holds
CONTAINMENT = 0.8

# Phrases whose words must stand consecutively, and their labels.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# The customary notices of public licenses, and their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under the creative commons attribution 4 0 international license": "cc-by-4.0",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
}


class Template(NamedTuple):
    """``need`` of ``words`` must be in a block; a phrase's words must also stand in order."""

    name: str
    label: str
    words: list[str]
    need: int
    phrase: bool


def templates_of(templates: dict[str, str], phrases: dict[str, str], containment: float) -> list[Template]:
    out = []
    for text, label in templates.items():
        words = list(dict.fromkeys(text.split()))
        out.append(Template(text, label, words, max(1, ceil(containment * len(words) - 1e-9)), False))
    for text, label in phrases.items():
        out.append(Template(text, label, text.split(), len(set(text.split())), True))
    return out


def window_step(templates: Sequence[Template]) -> int:
    """Words from one window to the next: those of the longest template. A window is two steps long."""
    return max((len(t.name.split()) for t in templates if not t.phrase), default=1)


def word_sets(docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, row, n_words, places, sets): a document's word count, the places of words that occur in
    phrases, and for each window with template words the set of these."""
    vocabulary = sorted({w for t in templates for w in t.words})
    ordered = sorted({w for t in templates if t.phrase for w in t.words})
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    # Cutting between words gives the same ones as looking for them and costs a sixth. Only the first and
    # the last piece can be empty.
    words = F.array_remove(F.split(text, BETWEEN), "")
    rows = docs.select("doc_id", F.expr("uuid()").alias("row"), words.alias("words"))
    step = window_step(templates)
    # Half a window at a time, so that each word is looked up once.
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("words") / step).cast("int") - 1))
    halves = F.transform(starts, lambda i: F.filter(F.slice("words", i * step + 1, step), lambda w: w.isin(vocabulary)))
    places = F.transform("words", lambda w, i: F.when(w.isin(ordered), F.struct(i.alias("at"), w.alias("word"))))
    rows = rows.select(
        "doc_id",
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.filter(places, lambda p: p.isNotNull()).alias("places"),
        halves.alias("halves"),
    )
    # The last window would be half of the one before it.
    first = F.slice("halves", F.lit(1), F.greatest(F.lit(1), F.size("halves") - 1))
    second = F.slice("halves", F.lit(2), F.size("halves"))
    none = F.array().cast("array<string>")
    sets = F.zip_with(first, second, lambda a, b: F.array_union(a, F.coalesce(b, none)))
    return rows.select("doc_id", "row", "n_words", "places", F.filter(sets, lambda s: F.size(s) > 0).alias("sets"))


def _rarest_first(blocks: DataFrame, templates: Sequence[Template]) -> list[str]:
    """All template words by the number of windows that hold them."""
    windows = blocks.select(F.explode("sets").alias("words")).select(F.explode("words").alias("word"))
    # One row per word of a template.
    counts = {r["word"]: r["n"] for r in windows.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))


def _least_need(templates: Sequence[Template], phrase: bool) -> int | None:
    return min((t.need for t in templates if t.phrase == phrase), default=None)


def similar_blocks(blocks: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(row, template, containment): every template found in a window of a document or, for phrases,
    every phrase of which the document has all words; the largest containment of each."""
    spark = blocks.sparkSession
    order = _rarest_first(blocks, templates)
    ranked = F.array(*[F.lit(w) for w in order])
    whole = F.struct(F.lit(True).alias("phrase"), F.array_distinct(F.flatten("sets")).alias("words"))
    windows = F.transform("sets", lambda s: F.struct(F.lit(False).alias("phrase"), s.alias("words")))
    parts = blocks.filter(F.size("sets") > 0).select(
        "row", F.posexplode(F.concat(F.array(whole), windows)).alias("block", "part")
    )
    # The intersection keeps the order of its first side.
    parts = parts.select(
        "row", "block", F.col("part.phrase").alias("phrase"), F.array_intersect(ranked, "part.words").alias("words")
    )
    rows = []
    for i, t in enumerate(templates):
        own = sorted(set(t.words), key=order.index)
        for at in range(len(own) - t.need + 1):
            rows.append((i, t.phrase, own[at], at, own, t.need))
    schema = "template int, t_phrase boolean, word string, t_at int, t_words array<string>, need int"
    prefixes = F.broadcast(spark.createDataFrame(rows, schema))  # as large as the templates given
    # A block's prefix for the least demanding template of its kind covers those of all others. Without a
    # template of the kind there is no such number, and the filter lets no block pass.
    least = F.when(F.col("phrase"), F.lit(_least_need(templates, True))).otherwise(
        F.lit(_least_need(templates, False))
    )
    prefix = F.slice("words", F.lit(1), F.size("words") - least + 1)
    probes = parts.filter(F.size("words") >= least).select(
        "row", "block", "phrase", "words", F.posexplode(prefix).alias("at", "word")
    )
    behind = F.least(F.size("t_words") - F.col("t_at"), F.size("words") - F.col("at"))
    pairs = (
        probes.join(prefixes, "word")
        .filter(F.col("phrase") == F.col("t_phrase"))
        .filter(F.size("words") >= F.col("need"))
        .filter(behind >= F.col("need"))
    )
    shared = F.size(F.array_intersect("words", "t_words"))
    found = pairs.select("row", "template", "need", shared.alias("shared"), F.size("t_words").alias("size"))
    found = found.filter(F.col("shared") >= F.col("need"))
    return found.groupBy("row", "template").agg(F.max(F.col("shared") / F.col("size")).alias("containment"))


def _phrase_starts(places: Column, words: Sequence[str]) -> Column:
    """Word numbers at which the words stand one after the other. Words that do so are neighbours among
    the places as well, so each place is looked at once."""

    def start(p: Column, i: Column) -> Column:
        found = p["word"] == words[0]
        for j, w in enumerate(words[1:], 1):
            follower = F.get(places, i + j)
            found = found & (follower["word"] == w) & (follower["at"] == p["at"] + j)
        return F.when(found, p["at"].cast("long"))

    return F.filter(F.transform(places, start), lambda at: at.isNotNull())


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    n_base counts the places of phrases, first_word and last_word are their smallest and largest start.
    labels joins the labels of phrases and templates; score is the largest containment, 1 for a phrase.
    """
    found = templates_of(
        TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases, containment
    )
    if not found:
        raise ValueError("at least one template or phrase is needed")
    blocks = materialise(word_sets(docs, found), "word-sets")
    # Phrases and templates go separate ways from here; written, the join runs once for both.
    near = materialise(similar_blocks(blocks, found), "similar-blocks")
    labels = F.broadcast(
        docs.sparkSession.createDataFrame(
            [(i, t.label, t.phrase) for i, t in enumerate(found)], "template int, label string, phrase boolean"
        )
    )
    hits = near.join(labels, "template")
    # Phrases of which all words occur: their places decide.
    starts = F.lit(None).cast("array<bigint>")
    for i, t in enumerate(found):
        if t.phrase:
            starts = F.when(F.col("template") == i, _phrase_starts(F.col("places"), t.words)).otherwise(starts)
    with_places = blocks.select("row", "places").join(hits.filter("phrase"), "row")
    standing = (
        with_places.select("row", "label", starts.alias("starts"))
        .filter(F.size("starts") > 0)
        .select("row", "label", F.lit(1.0).alias("containment"), "starts")
    )
    alike = hits.filter("NOT phrase").select(
        "row", "label", "containment", F.array().cast("array<bigint>").alias("starts")
    )
    base = F.when(F.size("starts") > 0, F.col("label"))
    per_row = standing.unionByName(alike).groupBy("row").agg(
        F.sum(F.size("starts")).cast("long").alias("n_base"),
        F.min(F.array_min("starts")).alias("first_word"),
        F.max(F.array_max("starts")).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("containment").alias("score"),
    )
    return blocks.select("row", "doc_id", "n_words").join(per_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
