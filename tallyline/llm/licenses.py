r"""License scan by diagonal voting.

The words of a text and of every template are hashed in all rolling windows of
three. The windows of all texts are joined with the template positions; a hit
votes for the diagonal ``text position - template position``. Votes are counted
per text, template and diagonal; neighbouring diagonals (at most DRIFT apart,
so that a word put in or left out does not split a passage) are merged; and the
span of each merged group is verified word by word against the template. Three
phrases are found by the same join, where a diagonal needs all their words.

TEMPLATES is a small catalogue, a few hundred positions; ``templates`` may name
any table (label, line) of whole license texts instead. Their positions are
broadcast below MOST_BROADCAST rows, by count; beyond it the windows are
shuffled to them. Hits carry the words around them, so no text is read again or
shuffled. Everything is a DataFrame expression.

Defined results: a null or empty text has no words and no labels; rows that
repeat id and text get equal results; two texts with one id are told apart by a
hash of the text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.durable import Durable

K = 3
DRIFT = 2
MOST_BROADCAST = 200_000
#: Share of a template's words that a span has to have in place.
LEAST = 0.75

#: The 66 ASCII characters that are no letter or digit, one by one: a class of single characters is a table look-up in Java's
#: regular expressions, where a class of ranges is a chain of tests.
_OTHERS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
NOT_WORD, WORD = f"[{_OTHERS}]+", f"[^{_OTHERS}]+"

# fixed values
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all beyond ASCII, A-Z as a-z."""
    return F.filter(F.split(F.lower(text), NOT_WORD, -1), lambda w: w != "")


def _windows(words: Column) -> Column:
    """The hashes of all K consecutive words.

    The words and their number are bound once, as the one element of an array, so that no step of the lambda below computes them again.
    """
    each = lambda w, i: F.xxhash64(*(F.element_at(w, i + j) for j in range(K)))
    rolled = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - K + 1), lambda i: each(w, i))
    none = F.array().cast("array<bigint>")
    return F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) >= K, rolled(w)).otherwise(none)), 1)


def template_positions(spark, templates: DataFrame | None = None) -> DataFrame:
    """(template, label, phrase, words, place, gram) of every window of the phrases and of every template, ready to be joined."""
    constant = [(-1 - i, label, True, line) for i, (label, line) in enumerate(PHRASES.items())]
    if templates is None:
        constant += [(i, label, False, line) for i, (label, line) in enumerate(TEMPLATES)]
    table = spark.createDataFrame(constant, "template long, label string, phrase boolean, line string")
    if templates is not None:
        table = table.unionByName(templates.select(F.xxhash64("label", "line").alias("template"), "label", F.lit(False).alias("phrase"), "line").distinct())
    table = table.withColumn("t_words", words_of(F.col("line")))
    placed = table.select("template", "label", "phrase", "t_words", F.posexplode(_windows(F.col("t_words"))).alias("place", "gram"))
    if templates is None:
        return F.broadcast(placed)
    placed = Durable(spark).keep(placed)
    return F.broadcast(placed) if placed.count() <= MOST_BROADCAST else placed


def hits(texts: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """(doc_id, hash, template, label, phrase, t_words, diagonal, place, around) of every shared window of rows (doc_id, hash, text).

    ``around`` holds the text's words that lie on the diagonal, DRIFT more on either side; ``lead`` tells how many are before it.
    """
    worded = texts.select("doc_id", "hash", words_of(F.col("text")).alias("words")).withColumn("grams", _windows(F.col("words")))
    # a plain column's elements are joined where they are made: only a hit gets a row, and with it the words around it
    placed = worded.select("doc_id", "hash", "words", F.posexplode_outer("grams").alias("position", "gram"))
    diagonal = F.col("position") - F.col("place")
    begin = F.greatest(diagonal - DRIFT, F.lit(0))
    return (
        placed.join(template_positions(texts.sparkSession, templates), "gram")
        .withColumn("diagonal", diagonal)
        .withColumn("lead", F.col("diagonal") - begin)
        .withColumn("around", F.slice("words", begin + 1, F.size("t_words") + F.col("lead") + DRIFT))
        .select("doc_id", "hash", "template", "label", "phrase", "t_words", "diagonal", "place", "lead", "around")
        .distinct()
    )


def passages(found: DataFrame) -> DataFrame:
    """(doc_id, hash, label, phrase, start, score) of verified passages."""
    group = ["doc_id", "hash", "template"]
    votes = found.groupBy(*group, "label", "phrase", "diagonal").agg(
        F.count_distinct("place").alias("votes"),
        F.first("t_words").alias("t_words"),
        F.first("lead").alias("lead"),
        F.first("around").alias("around"),
    )
    whole = votes.filter("phrase").filter(F.col("votes") == F.size("t_words") - K + 1).filter(F.slice("around", F.col("lead") + 1, F.size("t_words")) == F.col("t_words"))
    exact = whole.select("doc_id", "hash", "label", "phrase", F.col("diagonal").alias("start"), F.lit(1.0).alias("score"))
    order = Window.partitionBy(*group).orderBy("diagonal")
    runs = (
        votes.filter("not phrase")
        .withColumn("opens", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True)).cast("int"))
        .withColumn("run", F.sum("opens").over(order))
        .groupBy(*group, "label", "run")
        .agg(
            F.max_by(F.struct("diagonal", "t_words", "lead", "around"), F.struct("votes", -F.col("diagonal"))).alias("best"),
            F.sum("votes").alias("votes"),
        )
    )
    # a template word counts as in place if the span has it at most DRIFT away from the best diagonal
    placed = F.size(
        F.filter(
            F.sequence(F.lit(1), F.size("best.t_words")),
            lambda i: F.array_contains(F.slice("best.around", F.greatest(i + F.col("best.lead") - DRIFT, F.lit(1)), 2 * DRIFT + 1), F.element_at("best.t_words", i)),
        )
    )
    close = runs.withColumn("score", placed / F.size("best.t_words")).filter(F.col("score") >= LEAST)
    return exact.unionByName(close.select("doc_id", "hash", "label", F.lit(False).alias("phrase"), F.col("best.diagonal").alias("start"), "score"))


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: DataFrame | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    of_phrase = lambda c: F.when(F.col("phrase"), c)
    # few rows, read by both kinds of passages
    found = Durable(df.sparkSession).keep(hits(texts, templates))
    labelled = (
        passages(found)
        .groupBy("doc_id", "hash")
        .agg(
            F.count(of_phrase(F.lit(1))).alias("n_base"),
            F.min(of_phrase(F.col("start"))).cast("long").alias("first_word"),
            F.max(of_phrase(F.col("start"))).cast("long").alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(of_phrase(F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
            F.max("score").alias("score"),
        )
        .withColumnsRenamed({"doc_id": "d", "hash": "h"})
    )
    n_words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return (
        texts.select("doc_id", "hash", n_words.alias("n_words"))
        .join(labelled, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("hash") == F.col("h")), "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
            "first_word",
            "last_word",
            F.coalesce("base_labels", F.lit("")).alias("base_labels"),
            F.coalesce("labels", F.lit("")).alias("labels"),
            F.coalesce("score", F.lit(0.0)).alias("score"),
        )
    )
