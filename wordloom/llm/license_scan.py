"""License scans in DataFrame functions only: phrases, and a set-similarity join.

Words are runs of ASCII letters and digits and of any character beyond ASCII,
after A-Z are lower-cased. Two scans share one split of each whole text.

**Phrases.** Places where a phrase's words stand consecutively, counted and
located in the document's words joined by two spaces, so that neighbouring
places share no separator.

**Templates.** Every text block whose words contain at least
:data:`THRESHOLD` of a template's distinct words is found by an exact
set-similarity join:

* *Blocks.* A template of up to ``s`` words, ``s`` a power of two from
  :data:`SMALLEST`, is compared with blocks of ``2 s`` words that start every
  ``s`` words: a passage of ``s`` words lies whole in one of them.
* *Global order.* The templates' words are ordered by how often the whole
  corpus has them, rarest first (ties by word). Only words of templates can
  overlap a template, so a block is reduced to these, in that order.
* *Prefix filter.* With ``need = ceil(threshold * size)``, a block that holds
  ``need`` of a template's words holds one of its first ``size - need + 1``,
  and that word is among the first ``|block| - need + 1`` of the block. Blocks
  without a prefix word are never built; the others are joined with the
  templates' prefixes word by word.
* *Length filter.* ``|block| >= need``.
* *Positional filter.* The first common word, at place ``i`` of the template
  and ``j`` of the block, leaves at most ``1 + min(size - i, |block| - j) - 1``
  common words; this must reach ``need``. Every qualifying pair keeps at least
  this match.
* *Verification.* The sizes of the intersections of what is left.

Candidate blocks are found and cut inside the row, so texts are never
shuffled. What is joined and grouped are the candidates' words, by a row
number that no two documents share; so neither a hot id nor a text that
repeats gathers anywhere. The prefix table is broadcast up to
:data:`MAX_BROADCAST_ROWS` rows (it has at most one row a template word),
beyond that the join is left to the engine.

Defined results: a null or empty text has no words, no place, null positions,
empty labels and score 0. Repeated rows and null or repeated ids give one row
each. Templates without a word are left out; an empty template list leaves the
phrases. ``score`` is 1 with a phrase, else the largest share of a template
found in a block, 0 if none reaches the threshold.
"""

from __future__ import annotations

import string
from collections.abc import Iterable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

#: everything that is no word character once A-Z are lower-cased
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 0.9
SMALLEST = 8
MAX_BROADCAST_ROWS = 100_000

# The phrases of the scan, and passages of public licenses.
PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                   "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all "
            "of his or her rights to the work worldwide under copyright law"),
    ("gpl", "This work is licensed under the GNU General Public License, version"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), SEPARATORS), "")


def template_rows(templates: Iterable[tuple[str, str]], threshold: float = THRESHOLD) -> list[tuple]:
    """``(template, label, size, need, span, words)`` of each template with a
    word, ``span`` being the step of its blocks and ``words`` distinct."""
    out = []
    for n, (label, text) in enumerate(templates):
        low = text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
        held = "".join(c if c > "\x7f" or c in string.ascii_lowercase + string.digits else " " for c in low).split(" ")
        words = [w for w in held if w]
        if words:
            span = SMALLEST
            while span < len(words):
                span *= 2
            distinct = list(dict.fromkeys(words))
            # a share just above a whole number by rounding is that number
            out.append((n, label, len(distinct), max(1, ceil(threshold * len(distinct) - 1e-9)), span, distinct))
    return out


def _literals(words: Iterable[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def global_order(docs: DataFrame, words: list[str]) -> list[str]:
    """The given words by their number in the corpus, rarest first, ties by
    word. One partially aggregated count; what comes back is a row a word."""
    token = docs.select(F.explode(words_of(F.col("text"))).alias("word"))
    counted = {r["word"]: r["n"] for r in token.where(F.col("word").isin(words)).groupBy("word")
               .agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(words, key=lambda w: (counted.get(w, 0), w))


def _phrase(n: int, phrase: str) -> list[Column]:
    """Places of a phrase in ``words`` joined by two spaces (``joined``, null
    if a word of some phrase is missing): number, first start and last start."""
    parts = phrase.split(" ")
    if any(parts[k:] == parts[:-k] for k in range(1, len(parts))):
        raise ValueError(f"places of {phrase!r} could overlap")
    needle = F.lit(" " + "  ".join(parts) + " ")
    found = F.col("joined").contains(needle)

    def count(text: Column) -> Column:
        return F.size(F.array_remove(F.split(text, " +"), ""))
    places = (F.length("joined") - F.length(F.replace("joined", needle))) / F.length(needle)
    first = count(F.substring_index("joined", " " + "  ".join(parts) + " ", 1))
    after = count(F.substring_index("joined", " " + "  ".join(parts) + " ", -1))
    return [F.when(found, places).otherwise(0).cast("bigint").alias(f"n{n}"),
            F.when(found, first).cast("bigint").alias(f"first{n}"),
            F.when(found, F.col("n_words") - after - len(parts)).cast("bigint").alias(f"last{n}")]


BLOCKS = "array<struct<span:int,start:int,words:array<string>>>"


def _blocks(spans: dict[int, list[str]]) -> Column:
    """The blocks of ``words`` that hold a prefix word of a template of their span."""
    def of(span: int, prefix: list[str]) -> Column:
        probe = _literals(prefix)
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(span))
        cut = F.transform(starts, lambda s: F.struct(
            F.lit(span).alias("span"), s.alias("start"), F.slice("words", s + 1, 2 * span).alias("words")))
        held = F.filter(cut, lambda b: F.arrays_overlap(b["words"], probe))
        return F.when(F.arrays_overlap("words", probe), held).otherwise(F.array().cast(BLOCKS))
    return F.concat(F.array().cast(BLOCKS), *[of(s, p) for s, p in sorted(spans.items())])


def similar_blocks(blocks: DataFrame, rows: list[tuple], order: list[str]) -> DataFrame:
    """``(row, start, template, label, share)``: every pair of a block and a
    template of its span with the needed words in common. ``blocks`` is
    ``(row, span, start, words)``."""
    spark = blocks.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for n, label, size, need, span, words in rows:
        ranked = sorted(words, key=rank.__getitem__)
        index += [(w, i, n, label, size, need, span, ranked) for i, w in enumerate(ranked[:size - need + 1])]
    prefixes = spark.createDataFrame(index, "word string, i int, template int, label string, size int, need int, span int, "
                                            "tokens array<string>")
    if len(index) <= MAX_BROADCAST_ROWS:
        prefixes = F.broadcast(prefixes)
    least = min(r[3] for r in rows)
    # the order of the first array is kept: rarest words first
    known = blocks.select("row", "span", "start", F.array_intersect(_literals(order), "words").alias("known")) \
        .where(F.size("known") >= least)
    probes = known.select("*", F.posexplode(F.slice("known", F.lit(1), F.size("known") - least + 1)).alias("j", "word"))
    size, need = F.size("known"), F.col("need")
    candidates = probes.join(prefixes, ["word", "span"]).where(
        (size >= need) & (F.col("j") <= size - need)
        & (F.lit(1) + F.least(F.col("size") - F.col("i"), size - F.col("j")) - 1 >= need))
    common = F.size(F.array_intersect("known", "tokens"))
    return candidates.withColumn("common", common).where(F.col("common") >= need).select(
        "row", "start", "template", "label", (F.col("common") / F.col("size")).alias("share")).distinct()


def scan(docs: DataFrame, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: Iterable[tuple[str, str]] = PHRASES,
         threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents ``(id, n_words, n_base, first_word, last_word,
    base_labels, labels, score)``, and the blocks found in them ``(id, start,
    template, label, share)``, ``start`` being a word number."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = template_rows(templates, threshold)
    phrases = list(phrases)
    order = global_order(docs, sorted({w for r in rows for w in r[5]})) if rows else []
    rank = {w: i for i, w in enumerate(order)}
    spans: dict[int, list[str]] = {}
    for _, _, size, need, span, words in rows:
        spans.setdefault(span, []).extend(sorted(words, key=rank.__getitem__)[:size - need + 1])

    split = docs.select("id", words_of(F.col("text")).alias("words"))
    heads = _literals(sorted({p.split(" ")[0] for p, _ in phrases}))
    joined = F.when(F.arrays_overlap("words", heads), F.concat(F.lit(" "), F.array_join("words", "  "), F.lit(" ")))
    split = split.select("id", F.size("words").cast("bigint").alias("n_words"), joined.alias("joined"),
                         _blocks({s: sorted(set(p)) for s, p in spans.items()}).alias("blocks"))
    placed = split.select("id", "n_words", "blocks", *[c for n, (p, _) in enumerate(phrases) for c in _phrase(n, p)])
    ns = range(len(phrases))
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(
        *[F.when(F.col(f"n{n}") > 0, F.lit(label)) for n, (_, label) in enumerate(phrases)]).cast("array<string>"))))
    none = F.lit(None).cast("bigint")
    found = written(spark, placed.select(
        F.monotonically_increasing_id().alias("row"), "id", "n_words",
        sum((F.col(f"n{n}") for n in ns), F.lit(0)).cast("bigint").alias("n_base"),
        (F.array_min(F.array(*[F.col(f"first{n}") for n in ns])) if phrases else none).alias("first_word"),
        (F.array_max(F.array(*[F.col(f"last{n}") for n in ns])) if phrases else none).alias("last_word"),
        base.alias("base"), "blocks"), "license-blocks")

    if rows:
        cut = found.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.*")
        hits = written(spark, similar_blocks(cut, rows, order), "license-hits")
    else:
        hits = spark.createDataFrame([], "row bigint, start int, template int, label string, share double")
    of_row = hits.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    joined = found.drop("blocks").join(of_row, "row", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    documents = joined.select(
        "id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
    return documents, found.select("row", "id").join(hits, "row").drop("row")
