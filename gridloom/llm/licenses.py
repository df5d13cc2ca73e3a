"""License scans: an exact set-similarity join of text blocks with notice templates, in DataFrame functions only.

A text (A-Z lower-cased, null as empty) is cut into words at ASCII characters that are no letter or
digit, and into blocks of ``BLOCK`` words, a new one every ``STEP``, so that a notice of up to
``STEP`` words lies whole in one block however its lines are wrapped.  A block matches a template if it
holds at least ``THRESHOLD`` percent of the template's distinct words, all the words that tell the
template from its relatives (a version right behind the license's name), and none that belongs to
another family.  Words that occur in no template cannot
count, so blocks are reduced to the template vocabulary first; then, with all words in the order of
their frequency over all blocks, rarest first:

* length: a block with fewer words than the overlap asked for is dropped;
* prefix: block and template must share a word among the first ``n - overlap + 1`` of either side,
  which turns the search into an equi-join on rare words;
* position: where the first shared word stands bounds the overlap that is still possible.

What remains is counted in full, so the matches are exactly those of comparing every block with
every template.  Beside the templates, phrases are found at every place where their words stand
consecutively in the whole text.  The template table is a constant of bounded size; blocks are
joined with it where they lie.

The score is the largest containment of a matched template; a text with a phrase only has PHRASE_SCORE.

Edge cases: empty texts have no words, no labels and score 0.  Several places, repeated notices and
repeated rows count each.  Extra columns are ignored by the report.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Workspace, ascii_lower

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
THRESHOLD = 85

# The phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Words of a block, and from the start of one block to the next.
BLOCK, STEP = 80, 40
PHRASE_SCORE = 0.5

#: Notices: label, words, the words that a match must hold (they tell versions and relatives apart), words that rule it out.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache 2", ""),
    ("gpl-3.0", "licensed under the gnu general public license version 3", "gnu general 3", "lesser affero"),
    ("gpl-2.0", "licensed under the gnu general public license version 2", "gnu general 2", "lesser affero"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general program", "lesser affero"),
    ("lgpl", "gnu lesser general public license", "lesser", ""),
    ("agpl", "gnu affero general public license", "affero", ""),
    ("mit", "released under the mit license", "mit released", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "granted software", ""),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution binary", ""),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla 2", ""),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc nc", ""),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc sa", ""),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", "commons attribution", "noncommercial sharealike noderivatives"),
    ("cc0", "the author has waived all copyright and related or neighboring rights to this work", "waived neighboring", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered domain", ""),
    ("all-rights-reserved", "all rights reserved", "all rights reserved", ""),
)
#: Words that a label's notice holds in a row: a version number counts only behind its own license's name.
IN_A_ROW = {"apache-2.0": "apache license version 2", "gpl-3.0": "public license version 3", "gpl-2.0": "public license version 2"}


def _places(words: Column, low: Column, phrase: str, label: str) -> Column:
    """(start, label) of every place where the words of ``phrase`` stand consecutively; the loop runs only where they occur at all."""
    want = phrase.split()
    last = F.size(words) - F.lit(len(want))

    def stands(i: Column) -> Column:
        ok = F.lit(True)
        for k, w in enumerate(want):
            ok = ok & (F.get(words, i + F.lit(k)) == F.lit(w))
        return ok

    may = last >= 0
    for w in want:
        may = may & F.contains(low, F.lit(w))
    starts = F.when(may, F.filter(F.sequence(F.lit(0), last), stands)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _needed(words: int, threshold: int) -> int:
    return -(-threshold * words // 100)


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates=TEMPLATES, threshold: int = THRESHOLD, in_a_row: Mapping[str, str] = IN_A_ROW) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` lists (block, label, containment) of every block that meets a template.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "license")
    sets = [(label, sorted(set(text.split())), sorted(set(must.split())), sorted(set(never.split()))) for label, text, must, never in templates]
    vocabulary = sorted({w for _, *parts in sets for part in parts for w in part})
    least = min(_needed(len(t), threshold) for _, t, *_ in sets)
    lit = lambda xs: F.array(*map(F.lit, xs))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", ascii_lower(F.col("text")).alias("low"))
    rows = rows.withColumn("words", F.filter(F.split("low", SEPARATORS), lambda w: w != ""))
    hits = F.concat(*(_places(F.col("words"), F.col("low"), p, label) for p, label in phrases.items()))
    last = F.greatest(F.ceil((F.size("words") - F.lit(STEP)) / F.lit(float(STEP))) - 1, F.lit(0)).cast("int")  # the block that reaches the end
    held = lambda i: F.array_intersect(F.slice("words", i * F.lit(STEP) + F.lit(1), F.lit(BLOCK)), lit(vocabulary))
    blocks = F.filter(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("block"), held(i).alias("held"))), lambda b: F.size(b["held"]) >= least)
    spoken = lambda b: F.concat(F.lit(" "), F.array_join(F.slice("words", b["block"] * F.lit(STEP) + F.lit(1), F.lit(BLOCK)), " "), F.lit(" "))
    row_words = sorted({p.split()[-2] for p in in_a_row.values()}) or [""]
    blocks = F.transform(blocks, lambda b: F.struct(b["block"].alias("block"), b["held"].alias("held"), F.when(F.arrays_overlap(b["held"], lit(row_words)), spoken(b)).alias("spoken")))
    rows = rows.select("rid", "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"), blocks.alias("blocks"))
    rows = ws.keep(rows)

    blocks = rows.select("rid", F.explode("blocks").alias("b")).select("rid", "b.block", "b.held", "b.spoken")
    counted = {r["word"]: r["n"] for r in blocks.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # one row per template word
    order = sorted(vocabulary, key=lambda w: (counted.get(w, 0), w))
    at = {w: i for i, w in enumerate(order)}
    table = []
    for k, (label, words, must, never) in enumerate(sets):
        need = _needed(len(words), threshold)
        words = sorted(words, key=at.__getitem__)
        table += [(w, k, label, i, need, words, must, never, in_a_row.get(label)) for i, w in enumerate(words[: len(words) - need + 1])]
    index = spark.createDataFrame(table, "word string, template int, label string, i int, need int, wanted array<string>, must array<string>, never array<string>, in_a_row string")

    blocks = blocks.withColumn("held", F.array_intersect(lit(order), F.col("held"))).withColumn("size", F.size("held"))
    probes = blocks.select("rid", "block", "held", "spoken", "size", F.posexplode(F.slice("held", F.lit(1), F.col("size") - F.lit(least - 1))).alias("j", "word"))
    left = F.least(F.size("wanted") - F.col("i"), F.col("size") - F.col("j"))
    found = probes.join(F.broadcast(index), "word").where((F.col("size") >= F.col("need")) & (F.col("j") <= F.col("size") - F.col("need")) & (left >= F.col("need")))
    share = F.size(F.array_intersect("held", "wanted"))
    told = (F.size(F.array_except("must", "held")) == 0) & ~F.arrays_overlap("never", "held")
    told = told & (F.col("in_a_row").isNull() | F.coalesce(F.contains("spoken", F.concat(F.lit(" "), "in_a_row", F.lit(" "))), F.lit(False)))
    found = found.where((share >= F.col("need")) & told).select("rid", "block", "label", (share / F.size("wanted")).alias("containment"))
    found = found.groupBy("rid", "block", "label").agg(F.max("containment").alias("containment"))
    found = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("block", "label", "containment"))).alias("matches"))

    base = F.array_sort(F.array_distinct(F.col("hits")["label"]))
    both = F.array_sort(F.array_union(F.col("hits")["label"], F.coalesce(F.col("matches")["label"], F.array().cast("array<string>"))))
    best = F.coalesce(F.array_max(F.col("matches")["containment"]), F.lit(0.0))
    return rows.drop("blocks").join(found, "rid", "left").select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_base"),
        F.array_min(F.col("hits")["start"]).cast("long").alias("first_word"),
        F.array_max(F.col("hits")["start"]).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.greatest(best, F.when(F.size("hits") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
        "matches",
    )
