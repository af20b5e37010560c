"""License scans with built-in functions only.

* Fixed phrases: places where the words of a phrase stand consecutively.
* Templates: an exact set-similarity join of text blocks (lines and paragraphs)
  with license notices.  The templates' tokens are counted over all documents
  and put in one global order, rare ones first; tokens outside the templates'
  vocabulary cannot add to an overlap and are left out.  A block is a candidate
  for a template if

  - prefix filter: it holds one of the ``|T| - a + 1`` rarest tokens of the
    template T, where ``a = ceil(t * |T|)`` is the least overlap and ``t`` the
    template's own threshold;
  - length filter: it has at least ``a`` distinct tokens of the vocabulary;
  - positional filter: from the first common token on, both sides have enough
    tokens left to reach ``a``.

  Candidates are verified by the whole intersection; the containment is
  ``|B and T| / |T|``.

The templates are a fixed list, so their tokens, their counts and the joins with
them are bounded whatever the corpus is, and those alone are broadcast.

Defined results: a null text is empty and has no words; texts are read whole;
equal rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters between words: ASCII that is neither digit nor letter.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: label, notice, least containment: fixed texts of notices in common use, one paragraph each.  Short ones must be there whole.
TEMPLATES = (
    ("mit", "released under the mit license", 1.0),
    ("mit", "licensed under the mit license", 1.0),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", 0.8),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", 0.8),
    ("apache-2", "licensed under the apache license version 2 0", 1.0),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", 0.8),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", 0.8),
    ("cc-by-nc", "licensed under cc by nc 4 0", 1.0),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", 0.9),
    ("cc-by", "licensed under cc by 4 0", 1.0),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", 1.0),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", 0.9),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", 0.8),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.8),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", 0.8),
)


def _lower(s: Column) -> Column:
    return F.translate(s, UPPER, LOWER)


def _pieces(text: Column) -> Column:
    return F.filter(F.split(text, GAP, -1), lambda w: w != "")


def _n_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, GAP, -1), "")).cast("long")


def phrase_places(text: Column, phrases=PHRASES) -> Column:
    """Array of structs (at, label): first word of each place, words counted from 0."""
    apart = [tuple(p.split()) for p, _ in phrases]
    guard = "|".join(f"(?<!{WORD})" + GAP.join(p) + f"(?!{WORD})" for p in apart)
    words = F.transform(_pieces(text), _lower)

    def at(words: Column) -> Column:
        spots = F.sequence(F.lit(0), F.size(words) - 1)
        found = []
        for parts, (_, label) in zip(apart, phrases, strict=True):
            hits = F.filter(spots, _stands(words, parts))
            found.append(F.transform(hits, _place(label)))
        return F.concat(*found)

    # One evaluation of the word array: it is the only element of a one-element array.
    once = F.flatten(F.transform(F.array(words), at))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    return F.when(text.rlike(f"(?i){guard}"), once).otherwise(none)


def _stands(words: Column, parts: tuple[str, ...]):
    """Whether ``parts`` stand in ``words`` from an index on."""

    def test(i: Column) -> Column:
        out = F.lit(True)
        for k, p in enumerate(parts):
            out = out & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return out

    return test


def _place(label: str):
    return lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))


def _blocks(text: Column) -> Column:
    """Distinct lines and paragraphs."""
    return F.array_distinct(F.concat(F.split(text, r"\r?\n", -1), F.split(text, r"\r?\n[\x20\t]*\r?\n", -1)))


def template_matches(docs: DataFrame, templates=TEMPLATES, key: str = "key", text_col: str = "text") -> DataFrame:
    """One row per (``key``, label): the best containment of a template in a block of the document."""
    sets = [(i, label, list(dict.fromkeys(notice.split())), least) for i, (label, notice, least) in enumerate(templates)]
    vocabulary = sorted({t for _, _, ts, _ in sets for t in ts})
    text = F.coalesce(F.col(text_col), F.lit(""))
    array = lambda tokens: F.array(*[F.lit(t) for t in tokens])
    words = lambda c: F.split(c, GAP, -1)  # of lower-cased text; empty pieces are in no template
    # ``lower`` is fast and may turn other characters into a-z too, so it finds all and some more: enough for the
    # order and the first filter.  Blocks are lower-cased as the contract says.
    quick = words(F.lower(text))
    present = F.array_intersect(quick, array(vocabulary))
    # As many rows as the vocabulary has tokens.
    counted = docs.select(F.explode(present).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {r["token"]: r["n"] for r in counted}
    order = {t: k for k, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    known = array(sorted(order, key=order.get))

    rows, starters = [], set()
    for i, label, tokens, threshold in sets:
        ranks = sorted(order[t] for t in tokens)
        least = math.ceil(threshold * len(ranks) - 1e-9)
        for pos, r in enumerate(ranks[: len(ranks) - least + 1]):
            rows.append((i, label, ranks, least, r, pos))
            starters.add(next(t for t, k in order.items() if k == r))
    prefixes = docs.sparkSession.createDataFrame(
        rows, "template int, label string, ranks array<int>, least int, rank int, t_pos int"
    )
    # A document that has no prefix token has no block that does.
    first = array(sorted(starters))
    blocks = (
        docs.where(F.arrays_overlap(quick, first))
        .select(F.col(key), F.explode(_blocks(_lower(text))).alias("block"))
        .select(key, F.array_intersect(words(F.col("block")), known).alias("tokens"))
        .where(F.arrays_overlap("tokens", first))
        .select(key, F.array_sort(F.transform("tokens", lambda t: (F.array_position(known, t) - 1).cast("int"))).alias("have"))
    )
    least_of_all = min(r[3] for r in rows)
    probes = blocks.where(F.size("have") >= least_of_all).select(
        key, "have", F.posexplode("have").alias("b_pos", "rank")
    )
    left = F.least(F.size("have") - F.col("b_pos"), F.size("ranks") - F.col("t_pos"))
    pairs = (
        probes.join(F.broadcast(prefixes), "rank")
        .where(F.size("have") >= F.col("least"))
        .where(left >= F.col("least") - F.least("b_pos", "t_pos"))
        .withColumn("overlap", F.size(F.array_intersect("have", "ranks")))
        .where(F.col("overlap") >= F.col("least"))
    )
    return pairs.groupBy(key, "label").agg(F.max(F.col("overlap") / F.size("ranks")).alias("containment"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """Per row of ``docs``: its id, ``n_words``, ``places`` (of the fixed phrases), ``found`` (label to containment).

    Rows are joined with their matches by (id, checksum), so repeated ids with other texts stay apart.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"), text.alias("body"), F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("crc")).alias("key")
    )
    found = (
        template_matches(keyed, templates, text_col="body")
        .groupBy("key")
        .agg(F.map_from_entries(F.collect_list(F.struct("label", "containment"))).alias("found"))
    )
    base = keyed.select("id", "key", _n_words(F.col("body")).alias("n_words"), phrase_places(F.col("body")).alias("places"))
    return base.join(found, "key", "left").select("id", "n_words", "places", "found")
