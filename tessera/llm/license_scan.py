"""Licence scans by diagonal voting. DataFrame functions only.

1. Every place of a text is hashed with the words behind it, as a pair and as a run of four, and joined to the hashes of the
   templates' words. The templates are the constant below, so their side is some hundred rows at every size of the corpus
   and is broadcast; texts are not shuffled. A join counts only if the words are the template's, not merely the hash.
2. A hit votes for its diagonal: its place in the text less that in the template. Votes are put together by row, template
   and diagonal: which of the template's words they cover, as bits, and where they begin and end.
3. A phrase (fewer than PHRASE words) is found where one diagonal covers all of its words. For a longer template,
   neighbouring diagonals, at most SLACK apart, are merged first, so that words may be missing, added or replaced.
4. A span is verified by the share of the template's words that it covers, SHARE at least, and by its own length. The score
   of a row is the largest share among its spans; a base phrase is there whole or not at all, so it scores 1.

Long texts are taken in pieces of PIECE characters that end with a word, each with the next three words behind it, so no
array holds all words of a long text and no place is lost.

Edge cases: a null or empty text has no words, no labels and score 0; equal rows and repeated or null ids are rows of their
own; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER, OTHER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
PIECE = 50_000
#: Words from which a template is found by runs of four, with gaps.
PHRASE = 8
SLACK = 3
SHARE = 0.8
RUN = 4


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return re.findall(LETTER + "+", self.text.translate(str.maketrans(UPPER, LOWER)))

    @property
    def k(self) -> int:
        return 2 if len(self.words) < PHRASE else RUN


#: Phrases and notices as their licences word them. At most 63 words each, two at least.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl-2.0", "GNU General Public License, version 2"),
    Template("gpl-3.0", "GNU General Public License, version 3"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("apache-2.0", "Apache License, Version 2.0"),
    Template("cc-by-4.0", "CC BY 4.0"),
    Template("cc-by-sa", "CC BY-SA"),
    Template("cc-by-nc", "CC BY-NC"),
    Template("cc-by-nd", "CC BY-ND"),
    Template("cc0", "CC0 1.0 Universal"),
    Template("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    Template("apache-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    Template("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense"),
    Template("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc-notice", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("unlicense-notice", "This is free and unencumbered software released into the public domain"),
)


def _grams(df: DataFrame, templates: tuple[Template, ...], k: int) -> DataFrame:
    """The templates' runs of k words, each once: key (its hash), run (its words), found (template, at)."""
    where: dict[tuple[str, ...], list[tuple[int, int]]] = {}
    for t, template in enumerate(templates):
        words = template.words
        if not 2 <= len(words) <= 63:
            raise ValueError(f"a template has 2 to 63 words, not {len(words)}: {template.text}")
        for at in range(len(words) - k + 1) if template.k == k else ():
            where.setdefault(tuple(words[at : at + k]), []).append((t, at))
    rows = df.sparkSession.createDataFrame([(list(run), found) for run, found in where.items()], f"run{k} array<string>, found{k} array<struct<template:int,at:int>>")
    return rows.select(F.xxhash64(*[F.col(f"run{k}")[i] for i in range(k)]).alias(f"key{k}"), f"run{k}", f"found{k}")


def _places(docs: DataFrame) -> DataFrame:
    """id, row, place, n, w0..w3: every place of every text with its word and the three behind; n, the words of a piece, at its first place. A text without words has one row."""
    words = lambda x: F.regexp_extract_all(x, F.lit(LETTER + "+"), F.lit(0))
    cut = f"(?s)(.{{1,{PIECE}}}{LETTER}*)(?=((?:{OTHER}*{LETTER}+){{0,{RUN - 1}}}))"
    long = F.length("low") > PIECE
    parts = docs.select(
        "id",
        F.monotonically_increasing_id().alias("row"),
        F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("low"),
    ).select(
        "id",
        "row",
        F.when(long, F.regexp_extract_all("low", F.lit(cut), F.lit(1))).otherwise(F.array("low")).alias("parts"),
        F.when(long, F.regexp_extract_all("low", F.lit(cut), F.lit(2))).otherwise(F.array(F.lit(""))).alias("next"),
    )
    counts = F.when(F.size("parts") > 1, F.transform("parts", lambda p: F.regexp_count(p, F.lit(LETTER + "+"))))
    pieces = parts.select("id", "row", counts.alias("counts"), F.posexplode(F.arrays_zip("parts", "next")).alias("k", "p"))
    before = F.when(F.col("k") > 0, F.aggregate(F.slice("counts", 1, F.col("k")), F.lit(0).cast("long"), lambda a, n: a + n)).otherwise(0).cast("long")
    split = pieces.select("id", "row", before.alias("before"), words(F.col("p.parts")).alias("own"), words(F.col("p.next")).alias("more"))
    joined = split.select("id", "row", "before", F.size("own").alias("n"), F.when(F.size("more") > 0, F.concat("own", "more")).otherwise(F.col("own")).alias("w"))
    ahead = [F.slice("w", 1 + i, F.size("w")).alias(f"w{i}") for i in range(RUN)]
    zipped = joined.select("id", "row", "before", "n", F.slice(F.arrays_zip(*ahead), 1, F.col("n")).alias("z"))
    each = zipped.select("id", "row", "before", "n", F.posexplode_outer("z").alias("at", "g"))
    return each.select("id", "row", (F.col("before") + F.col("at")).alias("place"), F.when(F.coalesce("at", F.lit(0)) == 0, F.col("n")).alias("n"), *[F.col(f"g.w{i}").alias(f"w{i}") for i in range(RUN)])


def _of(template: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), template)


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """docs: id, text. id, row, template, first, last (places of the first and behind the last word), covered (the template's words), sure; and one line per row with template null and n, its words."""
    rows = _places(docs)
    hits = [F.when(F.col("n").isNotNull(), F.array(F.struct(F.lit(None).cast("int").alias("template"), F.lit(None).cast("int").alias("at")))).otherwise(F.array())]
    for k in (2, RUN):
        rows = rows.withColumn(f"h{k}", F.xxhash64(*[f"w{i}" for i in range(k)]))
        rows = rows.join(F.broadcast(_grams(docs, templates, k)), F.col(f"h{k}") == F.col(f"key{k}"), "left")
        same = functools.reduce(Column.__and__, [F.col(f"w{i}") == F.col(f"run{k}")[i] for i in range(k)])
        hits.append(F.when(F.coalesce(same, F.lit(False)), F.col(f"found{k}")).otherwise(F.array()))
    some = F.col("n").isNotNull() | functools.reduce(Column.__or__, [F.col(f"key{k}").isNotNull() for k in (2, RUN)])
    hit = rows.where(some).select("id", "row", "place", "n", F.explode(F.concat(*hits)).alias("hit")).select("id", "row", "place", "n", "hit.*")
    bits = F.call_function("shiftleft", _of(F.col("template"), [(1 << t.k) - 1 for t in templates]).cast("long"), F.col("at"))
    behind = F.col("place") + _of(F.col("template"), [t.k for t in templates])
    voted = hit.groupBy("row", "id", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(
        F.sum(F.when(F.col("template").isNull(), F.col("n"))).alias("n"), F.bit_or(bits).alias("bits"), F.min("place").alias("first"), F.max(behind).alias("last")
    )
    order = Window.partitionBy("row", "id", "template").orderBy("diagonal")
    slack = _of(F.col("template"), [0 if len(t.words) < PHRASE else SLACK for t in templates])
    alone = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= slack, 0).otherwise(1)
    numbered = voted.withColumn("alone", alone).withColumn("span", F.sum("alone").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("row", "id", "template", "span").agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"), F.min("first").alias("first"), F.max("last").alias("last"))
    size = _of(F.col("template"), [len(t.words) for t in templates])
    covered = F.bit_count("bits")
    sure = F.when(size < PHRASE, covered == size).otherwise((covered >= SHARE * size) & (F.col("last") - F.col("first") <= 2 * size))
    return merged.select("id", "row", "template", "n", "first", "last", covered.alias("covered"), sure.alias("sure"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    found = spans(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), templates)
    base = F.col("sure") & _of(F.col("template"), [t.base for t in templates])
    label = _of(F.col("template"), [t.label for t in templates])
    listed = lambda which: F.array_join(F.sort_array(F.collect_set(F.when(which, label))), ",")
    share = F.col("covered") / _of(F.col("template"), [len(t.words) for t in templates])
    return (
        found.groupBy("row", "id")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first"))).alias("first_word"),
            F.max(F.when(base, F.col("first"))).alias("last_word"),
            listed(base).alias("base_labels"),
            listed(F.col("sure")).alias("labels"),
            F.coalesce(F.max(F.when(F.col("sure"), share)), F.lit(0.0)).alias("score"),
        )
        .drop("row")
        .withColumnRenamed("id", id_column)
    )


def _sql(templates: tuple[Template, ...]) -> str:
    """DuckDB SQL for scan() of documents, for texts of distinct ids."""
    rows = ", ".join("(%d, '%s', %s, %d, %d, %s)" % (t, x.label, str(x.base).lower(), len(x.words), x.k, x.words) for t, x in enumerate(templates))
    run = lambda w, i: f"array_to_string({w}[{i}:{i} + k - 1], ' ')"
    return f"""
WITH templates(template, label, base, size, k, w) AS (VALUES {rows}), grams AS (
  SELECT template, k, i - 1 AS off, {run('w', 'i')} AS gram FROM (SELECT *, unnest(range(1, size - k + 2)) AS i FROM templates)
), split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTER}+') AS w FROM documents
), runs AS (
  SELECT doc_id, k, i - 1 AS place, {run('w', 'i')} AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM split, (VALUES (2), ({RUN})) ks(k))
), covered AS (
  SELECT DISTINCT doc_id, template, k, place - off AS diagonal, place, off FROM runs JOIN grams USING (k, gram)
), diagonals AS (
  SELECT doc_id, template, k, diagonal, min(place) AS first, max(place + k) AS last, list_distinct(flatten(list(range(off, off + k)))) AS words FROM covered GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= CASE WHEN size < {PHRASE} THEN 0 ELSE {SLACK} END THEN 0 ELSE 1 END AS alone
  FROM diagonals JOIN templates USING (template, k)
), numbered AS (
  SELECT *, sum(alone) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM marked
), merged AS (
  SELECT doc_id, template, label, base, size, min(first) AS first, max(last) AS last, len(list_distinct(flatten(list(words)))) AS n FROM numbered GROUP BY doc_id, template, label, base, size, span
), found AS (
  SELECT *, n / size AS share FROM merged WHERE CASE WHEN size < {PHRASE} THEN n = size ELSE n >= {SHARE} * size AND last - first <= 2 * size END
)
SELECT s.doc_id, len(s.w) AS n_words, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
  coalesce(max(share), 0)::DOUBLE AS score
FROM split s LEFT JOIN found USING (doc_id) GROUP BY s.doc_id, s.w
"""


SQL = _sql(TEMPLATES)
