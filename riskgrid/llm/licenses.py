"""License scans by an exact set-similarity join. DataFrame functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskgrid.llm.common import ascii_lower
from riskgrid.operators.sizes import lookup_join
from riskgrid.sources.workdir import materialize

# Words are runs of anything but these characters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Phrases whose words must stand consecutively, with their labels. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Notices that a text block is compared with, as sets of words, with their labels. Fixed values.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee "
            "is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD = 0.8


def words_of(text: Column) -> Column:
    """The words of a lower-case text. Splitting at what lies between is ten times as fast as matching words."""
    return F.array_remove(F.split(text, NO_WORD), "")


def phrase_places(words: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """Array of (place, label) for every place where a phrase's words stand consecutively."""
    found = []
    for phrase, label in phrases:
        parts = phrase.split()
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _all(
            [F.get(words, i + n) == w for n, w in enumerate(parts)]))
        found.append(F.transform(at, lambda i: F.struct(i.cast("bigint").alias("place"), F.lit(label).alias("label"))))
    return F.when(F.size(words) > 0, F.concat(*found))


def _all(tests: list[Column]) -> Column:
    whole = tests[0]
    for test in tests[1:]:
        whole = whole & test
    return F.coalesce(whole, F.lit(False))


def needed(size: int, threshold: float) -> int:
    """Words of a template that a block must contain."""
    return max(1, math.ceil(size * threshold - 1e-9))


class TemplateIndex:
    """Templates as word sets in a global order of words, with their prefixes.

    ``order`` has all template words, rarest in the table first; the join is on each template's prefix, the
    words of which a text block must have at least one if it contains enough of the template.
    """

    def __init__(self, texts: DataFrame, words: Column, templates: Sequence[tuple[str, str]], threshold: float):
        self.labels = [label for label, _ in templates]
        vocabulary = sorted({w for _, text in templates for w in text.split()})
        counts = dict.fromkeys(vocabulary, 0)
        # At most one row per template word.
        for row in (texts.select(F.explode(words).alias("word")).where(F.col("word").isin(vocabulary))
                    .groupBy("word").count().collect()):
            counts[row["word"]] = row["count"]
        self.order = sorted(vocabulary, key=lambda w: (counts[w], w))
        rank = {w: i for i, w in enumerate(self.order)}
        self.sets = [sorted(set(text.split()), key=rank.__getitem__) for _, text in templates]
        self.enough = [needed(len(s), threshold) for s in self.sets]
        self.lengths = [len(text.split()) for _, text in templates]
        self.rows = [(w, number, place, len(s), enough)
                     for number, (s, enough) in enumerate(zip(self.sets, self.enough))
                     for place, w in enumerate(s[: len(s) - enough + 1])]
        self.starters = sorted({r[0] for r in self.rows})


def block_matches(texts: DataFrame, text: str, keep: Sequence[str], index: TemplateIndex) -> DataFrame:
    """``keep`` columns, ``block`` (line number), ``label`` and ``containment`` for every line of the lower-case
    text and template with enough of the template's words in the line.

    The join is on prefix words. A pair goes on only if the line has words enough (length filter), and the words
    that are left on both sides after the shared one can reach the bound (position filter); the shared words are
    then counted. Only template words are kept of a line, as no other word can be shared.
    """
    spark = texts.sparkSession
    prefixes = spark.createDataFrame(index.rows, "word string, template int, place int, size int, enough int")
    lines = texts.select(*keep, F.posexplode(F.split(text, "\n")).alias("block", "line"))
    found = lines.select(*keep, "block", words_of(F.col("line")).alias("words")) \
        .where(F.arrays_overlap("words", F.lit(index.starters)))
    # array_intersect keeps the order of its first argument: rarest words first.
    held = found.select(*keep, "block", F.array_intersect(F.lit(index.order), F.col("words")).alias("held"))
    pairs = (held.select(*keep, "block", "held", F.posexplode("held").alias("at", "word"))
             .join(F.broadcast(prefixes), "word")
             .where(F.size("held") >= F.col("enough"))
             .where(F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at")) >= F.col("enough")))
    shared = F.size(F.array_intersect("held", F.get(F.lit(index.sets), F.col("template"))))
    return (pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("enough"))
            .select(*keep, "block", F.get(F.lit(index.labels), F.col("template")).alias("label"),
                    (F.col("shared") / F.col("size")).alias("containment")))


def wrapped_matches(texts: DataFrame, text: str, keep: Sequence[str], index: TemplateIndex) -> DataFrame:
    """The same columns for notices that go on over line breaks.

    A template is compared with every stretch of as many words as it has, wherever it begins and however many
    lines it is on. A stretch with enough of its words has one of its prefix words, so only the words around
    those are looked at, where they are on more than one line. ``block`` is the line of the last word from
    which a stretch with enough words begins, or null where another prefix word's row gives it.
    """
    spark = texts.sparkSession
    prefixes = spark.createDataFrame(index.rows, "word string, template int, place int, size int, enough int") \
        .withColumn("length", F.get(F.lit(index.lengths), F.col("template")))
    most = max(index.lengths)
    line_words = F.transform(F.split(text, "\n"), lambda line, number: F.transform(
        words_of(line), lambda word: F.struct(number.alias("line"), word.alias("word"))))
    split = texts.select(*keep, F.flatten(line_words).alias("words"))
    placed = split.select(*keep, F.transform("words", lambda w, at: F.struct(
        at.alias("at"), w["line"].alias("line"), w["word"].alias("word"))).alias("placed"))
    centres = F.filter("placed", lambda w: w["word"].isin(index.starters))
    around = placed.select(*keep, F.explode(F.transform(centres, lambda w: F.struct(
        w["at"].alias("centre"), w["word"].alias("word"),
        F.slice("placed", F.greatest(w["at"] - most + 2, F.lit(1)),
                w["at"] - F.greatest(w["at"] - most + 1, F.lit(0)) + 2 * most - 1).alias("around")))).alias("c")) \
        .select(*keep, "c.*").where(F.get("around", F.lit(0))["line"] < F.element_at("around", -1)["line"])
    held = around.join(F.broadcast(prefixes), "word").withColumn("held", F.filter("around", lambda w: (
        (w["at"] > F.col("centre") - F.col("length")) & (w["at"] < F.col("centre") + 2 * F.col("length") - 1)
        & F.array_contains(F.get(F.lit(index.sets), F.col("template")), w["word"])))) \
        .where(F.size(F.array_distinct(F.transform("held", lambda w: w["word"]))) >= F.col("enough"))
    starts = held.withColumn("starts", F.transform("held", lambda w: F.struct(
        w["at"].alias("at"), w["line"].alias("line"), F.size(F.array_distinct(F.transform(
            F.filter("held", lambda v: (v["at"] >= w["at"]) & (v["at"] < w["at"] + F.col("length"))),
            lambda v: v["word"]))).alias("shared"))))
    good = starts.withColumn("good", F.filter("starts", lambda w: (
        (w["at"] <= F.col("centre")) & (w["shared"] >= F.col("enough"))))).where(F.size("good") > 0)
    last = F.filter("starts", lambda w, place: (w["at"] <= F.col("centre")) & (w["shared"] >= F.col("enough"))
                    & (F.coalesce(F.get("starts", place + 1)["shared"], F.lit(0)) < F.col("enough")))
    return good.select(*keep, F.explode_outer(F.transform(last, lambda w: w["line"])).alias("block"),
                       F.get(F.lit(index.labels), F.col("template")).alias("label"),
                       (F.array_max(F.transform("good", lambda w: w["shared"])) / F.col("size")).alias("containment"))


def scan(documents: DataFrame, doc_id: str, text: str, templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """One row per document: words, places of the base phrases, labels and score.

    ``n_words``, ``n_base`` (all places), ``first_word`` and ``last_word`` (their smallest and largest start,
    else null), ``base_labels`` and ``labels`` (distinct, sorted, comma-joined, empty if none), ``score`` (1
    where a base phrase stands, else the greatest containment found, else 0), ``n_blocks`` (lines that match
    a template). Two passes over the texts: one counts the template words in all of them, one takes the words
    of each text and sets aside the few texts with a prefix word, whose lines are then joined. With ``wrapped``
    notices that go on over line breaks are found too, and ``n_blocks`` counts the lines that they begin on.

    Null texts count as empty; empty texts have no words. Repeated rows each get a row. Null ids are kept. Other
    columns take no part. An empty table gives an empty result.
    """
    lower = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    rows = documents.select(F.col(doc_id).alias("doc_id"), lower.alias("lower"))
    words = words_of(F.col("lower"))
    index = TemplateIndex(rows, words, templates, threshold)
    # The words are a column of their own: inside a lambda the expression would run for every place.
    split = rows.select("doc_id", "lower", words.alias("words"))
    last_words = F.lit(sorted({phrase.split()[-1] for phrase, _ in PHRASES}))
    narrow = materialize(split.select(
        "doc_id", F.md5(F.col("lower").cast("binary")).alias("text_key"), F.size("words").cast("bigint").alias("n_words"),
        F.when(F.arrays_overlap("words", last_words), phrase_places(F.col("words"))).alias("places"),
        F.when(F.arrays_overlap("words", F.lit(index.starters)), F.col("lower")).alias("blocks")), "words")
    # Equal texts have equal matches, so the text's key is enough.
    texts = narrow.where(F.col("blocks").isNotNull()).select("text_key", "blocks")
    matches = block_matches(texts, "blocks", ["text_key"], index)
    if wrapped and templates:
        matches = matches.unionByName(wrapped_matches(texts, "blocks", ["text_key"], index))
    by_text = matches.groupBy("text_key").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment"),
        F.countDistinct("block").alias("n_blocks"))
    base = F.transform(F.coalesce("places", F.array()), lambda p: p["label"])
    joined = lookup_join(narrow.drop("blocks"), materialize(by_text, "matches"), ["text_key"])
    starts = F.transform("places", lambda p: p["place"])
    return joined.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("more", F.array()))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("bigint").alias("n_blocks"))
