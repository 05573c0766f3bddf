"""License scans: which license templates a document holds, by an exact set-similarity join.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. A template of n words is
looked for in blocks: windows of 2s words that start every s words, s being the power of two next to n
(8 at least), so every run of n words lies in a block as a whole. A template matches a block if the block
holds at least ``percent`` of its distinct words. All such pairs are found, by these filters, none of
which can lose one:

- words that no template has are left out of blocks;
- length: a block needs as many distinct words as the least demanding template of its size asks for;
- order and prefix: words are ordered by how many blocks of the corpus hold them, rare ones first; of a template
  of size t that needs o common words the first t - o + 1 are its prefix, and a match shares one of them with
  the likewise prefix of the block;
- position: behind a shared word both sides must still have o words, this one counted;
- the pairs left are verified on the whole sets.

One pass over the texts writes blocks that pass the length filter and the counts of words (a row per word
and batch); everything after it is joins of these. Templates are the broadcast side, at most ``MAX_WORDS``
words of them at a time; more templates are taken in parts, a pass each. Their order of words is a table of at
most as many rows. Phrases are looked for as runs of words in the same pass.

Results in special cases: NULL and empty texts have no words and no labels; templates without words or label are
ignored; a word run across the end of a text is no match; repeated rows each get a row; an empty table gives
an empty result, no templates leave the phrases; input columns named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from shelfwatch.llm.common import ROW_FILE, ROW_INDEX, identified, pin, without

PERCENT = 80
LEAST_BLOCK = 8
MAX_WORDS = 100_000

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label and notice. Any table of (label, text) may take their place.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def block_step(n_words: int) -> int:
    """Start distance of the blocks for a template of so many words; a block is twice as long."""
    return max(LEAST_BLOCK, 1 << (n_words - 1).bit_length())


def needed(n_distinct: int, percent: int) -> int:
    return -(-percent * n_distinct // 100)


class Plan:
    """What one pass looks for: template words by size of block, phrases by their first word."""

    def __init__(self, templates: list[tuple[int, str, str]], phrases: Mapping[str, str], percent: int):
        self.words: dict[bytes, int] = {}
        self.templates = []  # (number, label, step, distinct word numbers, needed)
        for number, label, text in templates:
            words = words_of(text)
            if words and label:
                ids = sorted({self.words.setdefault(w, len(self.words)) for w in words})
                self.templates.append((number, label, block_step(len(words)), ids, needed(len(ids), percent)))
        n = len(self.words)
        self.steps = {step: (np.isin(np.arange(n), [i for t in self.templates if t[2] == step for i in t[3]]),
                             min(t[4] for t in self.templates if t[2] == step)) for step in sorted({t[2] for t in self.templates})}
        self.phrases = [(words_of(p), label) for p, label in phrases.items() if words_of(p)]

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        out = []
        for phrase, label in self.phrases:
            at, n = -1, len(phrase)
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at:at + n] == phrase:
                    out.append((at, label))
        return out

    def blocks(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per step: (step, words held by blocks, a row per block and word; blocks that pass the length filter)."""
        at = np.flatnonzero(ids >= 0)
        n = len(self.words)
        for step, (own, least) in self.steps.items():
            mine = at[own[ids[at]]]
            block = mine // step
            # A word lies in the block that starts at its step and in the one before; the first block has none before.
            both = np.concatenate((block, block[block > 0] - 1)) * n + np.concatenate((ids[mine], ids[mine[block > 0]]))
            held = np.unique(both)
            block, word = held // n, held % n
            size = np.bincount(block) if len(block) else np.zeros(0, np.int64)
            yield step, block, word, np.flatnonzero(size >= least)


_OF_ROW = "n_words long, n_base long, first_word long, last_word long, base_labels array<string>"
_OF_BLOCK = "step int, block long, words array<int>, word int, n long"


def _scan(rows: DataFrame, plan_of, at: int) -> DataFrame:
    """Three kinds of rows: documents (``step`` and ``word`` NULL), blocks (``step``), counts of words (``word``)."""
    kept = [i for i in range(len(rows.columns)) if i != at]
    fields = [StructField(f"c{i}", rows.schema.fields[i].dataType) for i in kept]
    schema = StructType([*fields, *StructType.fromDDL(_OF_ROW).fields, *StructType.fromDDL(_OF_BLOCK).fields])
    cached: dict = {}
    row_types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
    block_types = [pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "plan" not in cached:
            cached["plan"] = plan_of()
        plan: Plan = cached["plan"]
        for batch in batches:
            own = [batch.column(i) for i in kept]
            counts = np.zeros(len(plan.words), np.int64)
            found, blocks = [], []
            for i, text in enumerate(batch.column(at)):
                words = words_of(text.as_py())
                places = plan.places(words)
                starts = [p for p, _ in places]
                found.append((len(words), len(places), min(starts, default=None), max(starts, default=None), sorted({x for _, x in places})))
                ids = np.fromiter(map(plan.words.get, words, (-1 for _ in words)), np.int64, len(words))
                for step, block, word, full in plan.blocks(ids):
                    counts += np.bincount(word, minlength=len(counts))
                    if len(full):
                        edges = np.searchsorted(block, [full, full + 1])
                        blocks += [(i, step, b, word[s:e].tolist()) for b, s, e in zip(full.tolist(), *edges.tolist())]

            def nothing(n: int, kinds) -> list[pa.Array]:
                return [pa.nulls(n, k) for k in kinds]

            columns = zip(*found) if found else [[] for _ in row_types]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, row_types)], *nothing(len(found), block_types)], names=schema.names)
            if blocks:
                row, step, block, word = zip(*blocks)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([*[c.take(row) for c in own], *nothing(len(row), row_types), pa.array(step, pa.int32()),
                                                  pa.array(block, pa.int64()), pa.array(word, block_types[2]), *nothing(len(row), block_types[3:])], names=schema.names)
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([*nothing(len(seen), [c.type for c in own]), *nothing(len(seen), row_types), *nothing(len(seen), block_types[:3]),
                                              pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=schema.names)

    return rows.toDF(*[f"c{i}" for i in range(len(rows.columns))]).mapInArrow(run, schema)


def _matches(spark: SparkSession, blocks: DataFrame, counts: DataFrame, plan: Plan, keys: list[str]) -> DataFrame:
    """(keys, step, block, template, label, score) for every block and template that match."""
    order = counts.groupBy("word").agg(F.sum("n").alias("n"))
    by_rank = {r["word"]: (r["n"], r["word"]) for r in order.collect()}  # at most a row per word of the templates
    rank = {w: i for i, w in enumerate(sorted(range(len(plan.words)), key=lambda w: by_rank.get(w, (0, w))))}
    rows = []
    for number, label, step, ids, need in plan.templates:
        ranked = sorted(rank[w] for w in ids)
        rows += [(step, ranked[i], i, number, label, need, ranked) for i in range(len(ranked) - need + 1)]
    prefixes = spark.createDataFrame(rows, "of_step int, of_word int, of_place int, template int, label string, need int, of_words array<int>")
    ranks = F.lit([rank[w] for w in range(len(plan.words))])
    least = F.coalesce(*[F.when(F.col("step") == s, F.lit(n)) for s, (_, n) in plan.steps.items()])
    ranked = blocks.select(*keys, "step", "block", F.array_sort(F.transform("words", lambda w: F.element_at(ranks, w + 1))).alias("words"))
    prefix = F.slice("words", F.lit(1), F.size("words") - least + 1)
    spread = ranked.select("*", F.posexplode(prefix).alias("place", "word"))
    pairs = spread.join(F.broadcast(prefixes), (F.col("step") == F.col("of_step")) & (F.col("word") == F.col("of_word")))
    enough = F.least(F.size("words") - F.col("place"), F.size("of_words") - F.col("of_place")) >= F.col("need")
    common = F.size(F.array_intersect("words", "of_words"))
    return (pairs.where(enough).where(common >= F.col("need"))
            .select(*keys, "step", "block", "template", "label", (common.cast("double") / F.size("of_words").cast("double")).alias("score"))
            .dropDuplicates([*keys, "step", "block", "template"]))


def _parts(templates: DataFrame, max_words: int) -> list[DataFrame]:
    """Templates in parts of about ``max_words`` words each; a single longer template is a part of its own size."""
    words = F.size(F.split(F.coalesce("text", F.lit("")), "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"))
    total = templates.agg(F.sum(words)).first()[0]
    n = max(1, -(-int(total or 0) // max_words))
    return [templates.where(F.pmod(F.xxhash64("label", "text"), F.lit(n)) == i) for i in range(n)]


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "label string, text string")


def find_licenses(docs: DataFrame, templates: DataFrame | None = None, percent: int = PERCENT, phrases: Mapping[str, str] = PHRASES,
                  max_words: int = MAX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): one row per document with RESULTS, and one per matching block and template.

    Documents have the columns of ``docs`` without the text, and ``__row_file`` and ``__row_index``, by which matches
    belong to them. ``score`` of a document is 1 with a phrase in it, else the highest share of a template found,
    else 0. A match covers words ``block * step`` to ``block * step + 2 * step``.
    """
    spark = docs.sparkSession
    rows = identified(without(docs, RESULTS))
    at = next(i for i, c in enumerate(rows.columns) if c.lower() == "text")
    names = [c for c in rows.columns if c.lower() != "text"]
    inner = [c if c in (ROW_FILE, ROW_INDEX) else f"c{i}" for i, c in enumerate(rows.columns) if c.lower() != "text"]
    templates = default_templates(spark) if templates is None else templates.select("label", "text")
    found = documents = None
    for part in _parts(templates, max_words):
        held = spark.sparkContext.broadcast([(i, r["label"], r["text"]) for i, r in enumerate(part.distinct().orderBy("label", "text").collect())])
        scanned = pin(_scan(rows, lambda held=held: Plan(held.value, phrases, percent), at), "licenses")
        scanned = scanned.toDF(*inner, *scanned.columns[len(inner):])
        if documents is None:
            documents = scanned.where("step IS NULL AND word IS NULL").select(*inner, *RESULTS[:5])
        plan = Plan(held.value, phrases, percent)
        if plan.templates:
            blocks = scanned.where("step IS NOT NULL").select(ROW_FILE, ROW_INDEX, "step", "block", "words")
            one = _matches(spark, blocks, scanned.where("word IS NOT NULL").select("word", "n"), plan, [ROW_FILE, ROW_INDEX])
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = documents.limit(0).select(ROW_FILE, ROW_INDEX, F.lit(0).alias("step"), F.lit(0).cast("long").alias("block"),
                                          F.lit(0).alias("template"), F.lit("").alias("label"), F.lit(0.0).alias("score"))
    of_row = found.groupBy(F.col(ROW_FILE).alias("__of_file"), F.col(ROW_INDEX).alias("__of_index")).agg(
        F.collect_set("label").alias("__labels"), F.max("score").alias("__score"))  # at most the templates' labels
    joined = documents.join(of_row, (F.col(ROW_FILE) == F.col("__of_file")) & (F.col(ROW_INDEX) == F.col("__of_index")), "left")
    none = F.array().cast("array<string>")
    labels = F.array_join(F.array_sort(F.array_union("base_labels", F.coalesce("__labels", none))), ",")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("__score", F.lit(0.0)))
    return joined.select(*inner, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                         labels.alias("labels"), score.alias("score")).toDF(*names, *RESULTS), found
