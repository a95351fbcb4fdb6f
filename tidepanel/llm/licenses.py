"""License scan: exact set-similarity join of text blocks with notice templates.

The base scan finds places where a fixed phrase's words stand consecutively. The join
finds every block (a run of ``ceil(stretch * n)`` consecutive words, ``n`` the distinct
tokens of a template) holding at least ``ceil(threshold * n)`` of the template's tokens:

* the tokens of all templates are ordered by their frequency in the whole corpus, rarest
  first (one aggregation over all words; the result is bounded by the template vocabulary);
* prefix filter: such a block must hold one of the first ``n - a + 1`` tokens of the
  template in that order (``a`` the overlap wanted), so a text goes on with a template only
  if it holds one of those;
* length filter: a text with fewer words than ``a`` cannot match;
* positional filter: only blocks are looked at that begin at a template token and hold ``a``
  template places (a test of two places); if the rarest token in a block has place ``i`` of
  the order, at most ``n - i`` tokens are shared, so the block goes unless that suffices;
* what is left is verified exactly by its distinct tokens.

Everything after the counts happens inside the row of a text, on the places of template
words only: no join, no shuffle and no copy of the text per hit, so work grows with the
places times the block length however often a text repeats a rare token. Only native
functions are used; the templates are literals of the plan.

Defined results: null or empty text has no words, no labels and score 0; repeated words
count once in a block; repeated documents get equal rows; an empty table gives no rows;
only the id and text columns are read, so clashing extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm import text as T

# Base phrases (words, label).
PHRASES = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

# Notice templates (label, wording); the longer ones are the usual full wordings.
TEMPLATES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
               "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied see "
               "the license for the specific language governing permissions and limitations under the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the "
            "following disclaimer redistributions in binary form must reproduce the above copyright notice this list of "
            "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 3 of the license or at your option "
            "any later version this program is distributed in the hope that it will be useful but without any warranty "
            "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation the "
            "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
            "persons to whom the software is furnished to do so subject to the following conditions the above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
THRESHOLD = 0.85
STRETCH = 1.5


def _places(words: Column, phrase: str) -> Column:
    """Starts (from 0) where the phrase's words stand consecutively."""
    p = phrase.split()
    n = F.size(words)
    hit = F.filter(F.sequence(F.lit(0), F.greatest(n - len(p), F.lit(0))), lambda i: F.slice(words, i + 1, len(p)) == F.array(*map(F.lit, p)))
    return F.when((n >= len(p)) & F.array_contains(words, p[0]), hit).otherwise(F.array().cast("array<int>"))


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by ascending corpus frequency (ties by the token itself).

    The counts cover every word of every document; map-side combining leaves at most one
    row per token and task.
    """
    word = docs.select(F.explode(T.alnum_words(F.col("text"))).alias("w")).where(F.col("w").isin(vocabulary))
    seen = {r["w"]: r["n"] for r in word.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (seen.get(t, 0), t))


def _index(templates: list[tuple[str, str]], order: list[str], threshold: float, stretch: float) -> tuple[Column, list[str]]:
    """Literal array of ``template, label, tokens (ordered), prefix, n, need, block``, and all prefix tokens."""
    rank = {t: i for i, t in enumerate(order)}
    rows, prefixes = [], set()
    for tid, (label, wording) in enumerate(templates):
        tokens = sorted(set(wording.split()), key=rank.__getitem__)
        n = len(tokens)
        need = math.ceil(threshold * n - 1e-9)
        prefix = tokens[:n - need + 1]
        prefixes |= set(prefix)
        rows.append(F.struct(
            F.lit(tid).alias("template"), F.lit(label).alias("label"), F.array(*map(F.lit, tokens)).alias("tokens"),
            F.array(*map(F.lit, prefix)).alias("prefix"), F.lit(n).alias("n"), F.lit(need).alias("need"),
            F.lit(math.ceil(stretch * n)).alias("block")))
    return F.array(*rows), sorted(prefixes)


def _blocks_of(c: Column, marks: Column) -> Column:
    """Blocks of template ``c`` that meet the threshold, from the places of template words."""
    placed = F.filter(
        F.transform(marks, lambda m: F.struct(m["p"].alias("p"), (F.array_position(c["tokens"], m["w"]) - 1).cast("int").alias("place"))),
        lambda x: x["place"] >= 0)

    def blocks(at: Column) -> Column:
        first = lambda k: F.get(at, k)["p"]
        dense = F.when(F.size(at) >= c["need"], F.filter(
            F.sequence(F.lit(0), F.size(at) - c["need"]), lambda k: F.get(at, k + c["need"] - 1)["p"] - first(k) < c["block"]))
        held = F.transform(dense, lambda k: F.struct(first(k).alias("start"), F.transform(
            F.filter(F.slice(at, k + 1, c["block"]), lambda x: x["p"] < first(k) + c["block"]), lambda x: x["place"]).alias("places")))
        near = F.filter(held, lambda h: c["n"] - F.array_min(h["places"]) >= c["need"])
        shared = F.transform(near, lambda h: F.struct(
            c["template"].alias("template"), c["label"].alias("label"), h["start"].cast("long").alias("start"),
            F.size(F.array_distinct(h["places"])).alias("overlap"), c["n"].alias("n")))
        return F.filter(shared, lambda b: b["overlap"] >= c["need"])

    # a one-element transform binds the places, so they are computed once
    return F.flatten(F.filter(F.transform(F.array(placed), blocks), lambda b: b.isNotNull()))


def with_blocks(worded: DataFrame, order: list[str], templates: list[tuple[str, str]], threshold: float, stretch: float) -> DataFrame:
    """Adds ``blocks``: array of ``template, label, start, overlap, n``, to rows with ``words``."""
    index, prefixes = _index(templates, order, threshold, stretch)
    met = T.fixed(worded, present=F.array_intersect("words", F.array(*map(F.lit, prefixes))))
    met = T.fixed(met, cands=F.when(F.size("present") > 0, F.filter(
        index, lambda c: (F.size("words") >= c["need"]) & F.arrays_overlap(F.col("present"), c["prefix"]))))
    marks = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("p"), w.alias("w"))), lambda m: m["w"].isin(order))
    met = T.fixed(met, marks=F.when(F.size("cands") > 0, marks))
    found = F.flatten(F.transform("cands", lambda c: _blocks_of(c, F.col("marks"))))
    met = T.fixed(met, blocks=F.when(F.size("cands") > 0, found))
    return met.drop("present", "cands", "marks")


def _vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({w for _, wording in templates for w in wording.split()})


def similar_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
                   stretch: float = STRETCH) -> DataFrame:
    """``doc_id, key, template, label, start, overlap, score`` of every block that meets the threshold.

    Blocks begin at a template token: any other block meeting the threshold holds the
    tokens of one that does. Rows repeat where documents do.
    """
    worded = T.fixed(docs, words=T.alnum_words(F.col("text"))).select("doc_id", T.text_key(F.col("text")).alias("key"), "words")
    met = with_blocks(worded, token_order(docs, _vocabulary(templates)), templates, threshold, stretch)
    met = met.select("doc_id", "key", F.explode("blocks").alias("b"))
    return met.select("doc_id", "key", "b.template", "b.label", "b.start", "b.overlap", (F.col("b.overlap") / F.col("b.n")).alias("score"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, stretch: float = STRETCH) -> DataFrame:
    """One row per document: base phrase places, base labels, all labels, score.

    ``score`` is the largest containment of a template in a block, 1 where a base phrase
    stands, 0 where nothing was found.
    """
    own = T.documents(docs, id_col, text_col)
    worded = T.fixed(own, words=T.alnum_words(F.col("text"))).select("doc_id", "words")
    met = with_blocks(worded, token_order(own, _vocabulary(templates)), templates, threshold, stretch)
    met = met.select("doc_id", F.size("words").cast("long").alias("n_words"),
                     *[_places(F.col("words"), p).alias(f"at{i}") for i, (p, _) in enumerate(PHRASES)],
                     F.array_distinct(F.transform("blocks", lambda b: b["label"])).alias("block_labels"),
                     F.array_max(F.transform("blocks", lambda b: b["overlap"] / b["n"])).alias("block_score"))
    every = F.concat(*[F.col(f"at{i}") for i in range(len(PHRASES))])
    named = F.filter(F.array(*[F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    out = T.fixed(met, at=every, base=named)
    labels = F.array_sort(F.array_union("base", F.coalesce("block_labels", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"), F.concat_ws(",", labels).alias("labels"),
        F.greatest(F.coalesce("block_score", F.lit(0.0)), F.when(F.size("at") > 0, 1.0).otherwise(0.0)).alias("score"))
