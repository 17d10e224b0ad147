"""License scans (10): exact set-similarity join of text blocks with license templates.

Native: DataFrame functions only.  Blocks are windows of as many words as the template
has, over the whole text: where lines end plays no part, so a notice wrapped over lines is
met, and words scattered over a long line are not.  A block meets a template of n
distinct words if it holds at least ceil(threshold * n) of them.  The template words
are ordered by their frequency in the whole corpus, rarest first, so a block that
meets a template must hold one of its first n - need + 1 words (prefix filter), have
at least ``need`` distinct words (length filter), and its common words must stand
early enough in the order (positional filter); then the overlap is counted exactly.
The templates are a parameter of fixed size, so they are literals in the plan and
the corpus side isn't moved at all.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of lower-cased text; the second form is the same class, which Java matches many times faster.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FAST = r"[0-9a-z\x80-\x{10FFFF}]++"

#: Phrases whose words, one after another, name a license.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Public license notices, each with its label.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def lowered(text: Column) -> Column:
    """Lower case; null is empty.

    lower() also changes letters beyond A-Z, but every such letter is a word character
    before and after, and none becomes a word of a phrase, so words stand where they
    stood; translate() would be exact too and costs several times as much.
    """
    return F.lower(F.coalesce(text.cast("string"), F.lit("")))


def words_of(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(_FAST), 0)


def _template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", text.lower())))


def _length(text: str) -> int:
    return len(re.findall(r"[0-9a-z]+", text.lower()))


def word_frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of the given words (a parameter of fixed size) stands in all documents,
    between white space and without the marks after it.  Any order keeps the join exact."""
    word = F.explode(F.split(F.replace(lowered(F.col("text")), F.lit("\n"), F.lit(" ")), " "))
    found = docs.select(word.alias("w")).select(F.rtrim("w", F.lit(".,;:!?\")")).alias("w")).where(F.col("w").isin(words))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """The columns of ``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels (empty strings), score 0.  The
    score is 1 where a phrase stands, else the best containment of a met template.
    """
    rows = [(label, _template_words(text), _length(text)) for label, text in templates]
    often = word_frequencies(docs, sorted({w for _, ws, _ in rows for w in ws}))
    rows = [(label, sorted(ws, key=lambda w: (often.get(w, 0), w)), length) for label, ws, length in rows]
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    kept = [c for c in docs.columns if c not in new]
    low = F.col("_low")
    end, begin = r"(?![0-9a-z\x80-\x{10FFFF}])", r"(?<![0-9a-z\x80-\x{10FFFF}])"

    # phrases: only texts that hold one are cut into words
    between = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    phrase = begin + "(?:" + "|".join(between.join(p.split()) for p in PHRASES) + ")" + end
    maybe = (F.contains(low, F.lit("license")) | F.contains(low, F.lit("cc"))) & low.rlike(phrase)
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(kept)]  # so a caller's names can't clash
    df = docs.select(*own, lowered(F.col("text")).alias("_low"))
    df = df.withColumn("_words", F.when(maybe, words_of(low)))
    places = []
    for p, label in PHRASES.items():
        places.append(_places(F.col("_words"), p.split(), label))
    df = df.withColumn("_places", F.when(F.col("_words").isNotNull(), F.flatten(F.array(*places))).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")))

    # templates: a met block holds at least one of ANY n - need + 1 of a template's words, so
    # texts are first probed for that many of the longer words: those that other templates
    # are probed for, too, then the rarer ones
    probes: set[str] = set()
    for _, ws, _ in sorted(rows, key=lambda r: len(r[1])):
        probes |= set(sorted(ws, key=lambda w: (len(w) < 4, w not in probes, ws.index(w)))[: len(ws) - _need(ws, threshold) + 1])
    none = F.array().cast("array<struct<label:string,share:double>>")
    if rows:
        probed = _probe(sorted(w for w in probes if not any(v != w and v in w for v in probes)))
        find = _Templates([(label, ws, _need(ws, threshold), length) for label, ws, length in rows])
        df = df.withColumn("_all", F.when(probed(low), words_of(low)))
        df = df.withColumn("_met", F.coalesce(find.met(F.col("_all")), none))
    else:
        df = df.withColumn("_met", none)

    at = F.transform("_places", lambda x: x["at"])
    base = F.transform("_places", lambda x: x["label"])
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return df.select(
        *[F.col(f"c{k}").alias(c) for k, c in enumerate(kept)],
        F.regexp_count(low, F.lit(_FAST)).cast("long").alias("n_words"),
        F.size("_places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        join(base).alias("base_labels"),
        join(F.concat(base, F.transform("_met", lambda x: x["label"]))).alias("labels"),
        F.when(F.size("_places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("_met", lambda x: x["share"])), F.lit(0.0))).alias("score"),
    )


def _probe(words: list[str]):
    return lambda text: reduce(lambda x, y: x | y, [F.contains(text, F.lit(w)) for w in words])


def _places(words: Column, phrase: list[str], label: str) -> Column:
    """(at, label) wherever the phrase's words stand one after another."""

    def hit(i):
        return _all([F.get(words, i + k) == F.lit(w) for k, w in enumerate(phrase)])

    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), hit)
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


class _Templates:
    """Templates (label, words in the global order, need, length) as literals, with an inverted index of their
    prefixes: what a block costs depends on the templates that it shares a prefix word with, not on their number."""

    def __init__(self, rows: list[tuple[str, list[str], int, int]]):
        places: dict[str, list[int]] = {}
        for k, (_, words, need, _) in enumerate(rows):
            for w in words[: len(words) - need + 1]:
                places.setdefault(w, []).append(k)
        self.all = F.array(*[F.struct(F.lit(label).alias("label"), F.array(*map(F.lit, words)).alias("words"), F.lit(need).alias("need"), F.lit(length).alias("length")) for label, words, need, length in rows])
        self.prefixes = F.array(*map(F.lit, places))
        self.index = F.create_map(*[x for w, own in places.items() for x in (F.lit(w), F.array(*map(F.lit, own)))])

    def candidates(self, block: Column) -> Column:
        """The templates that share a prefix word with a block (prefix filter)."""
        hits = F.array_intersect(self.prefixes, block)
        return F.array_distinct(F.flatten(F.transform(hits, lambda w: F.element_at(self.index, w))))

    @staticmethod
    def held(t: Column, block: Column) -> Column:
        """How many of a template's words a block holds, or 0 where a filter shows that they are too few."""
        common = F.array_intersect(t["words"], block)  # in the template's order
        # length filter; the second common word leaves room for the others (positional filter)
        early = F.coalesce(F.array_position(t["words"], F.get(common, F.lit(1))) + t["need"] - 2 <= F.size(t["words"]), t["need"] < 2)
        return F.when((F.size(block) >= t["need"]) & early, F.size(common)).otherwise(0)

    @staticmethod
    def told(t: Column, count: Column) -> Column:
        return F.when(count >= t["need"], F.struct(t["label"].alias("label"), (count / F.size(t["words"])).cast("double").alias("share")))

    def met(self, words: Column) -> Column:
        """label, share of the templates that a window of a text's words meets.  Windows begin with a template's word,
        and the need-th of its words from there must stand in them; only templates are tried of which the whole
        text holds enough words."""

        def best(t, whole):
            at = F.filter(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_contains(t["words"], F.get(words, k - 1)))
            # bound to a name by transform, as Spark works out again what a lambda mentions
            starts = F.flatten(F.transform(F.array(at), lambda x: F.filter(x, lambda k, j: F.get(x, j + t["need"] - 1) < k + t["length"])))
            counts = F.transform(starts, lambda k: self.held(t, F.array_distinct(F.slice(words, k, t["length"]))))
            enough = F.size(F.array_intersect(t["words"], whole)) >= t["need"]
            return F.when(enough, self.told(t, F.array_max(counts)))

        def tried(whole):
            return F.array_compact(F.transform(self.candidates(whole), lambda i: best(F.get(self.all, i), whole)))

        return F.get(F.transform(F.array(F.array_distinct(words)), tried), F.lit(0))  # one element, worked out once


def _need(words: list[str], threshold: float) -> int:
    return max(1, math.ceil(threshold * len(words) - 1e-9))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def op10_licenses(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).drop("text")


def _sql() -> str:
    lists = ",\n    ".join(
        f"list_transform(list_filter(range(len(ws)), lambda i: {' AND '.join(f'ws[i+{k + 1}] = {w!r}' for k, w in enumerate(p.split()))}), lambda i: {{'at': i, 'label': '{label}'}})"
        for p, label in PHRASES.items()
    )
    met = []
    for label, text in TEMPLATES:
        ws = _template_words(text)
        need, long, counts = _need(ws, 0.8), _length(text), "list_max(list_transform(list_filter(range(len(ws)), lambda i: list_contains({ws}, ws[i+1])), lambda i: len(list_intersect(ws[i+1:i+{long}], {ws}))))"
        share = f"CASE WHEN len(list_intersect(ws, {ws!r})) >= {need} THEN {counts.format(ws=repr(ws), long=long)} END"
        met.append(f"list_transform([{share}], lambda n: {{'label': '{label}', 'share': CASE WHEN n >= {need} THEN n / {float(len(ws))} ELSE 0 END}})")
    return rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, regexp_extract_all(low, '{WORD}') AS ws FROM d),
p AS (SELECT doc_id, len(ws) AS n_words, flatten([
    {lists}]) AS pl,
  list_filter(flatten([{", ".join(met)}]), lambda m: m.share > 0) AS met FROM w)
SELECT doc_id, n_words::BIGINT AS n_words, len(pl)::BIGINT AS n_base,
  list_min(list_transform(pl, lambda x: x.at)) AS first_word, list_max(list_transform(pl, lambda x: x.at)) AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(pl, lambda x: x.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(list_transform(pl, lambda x: x.label), list_transform(met, lambda x: x.label)))), ',') AS labels,
  CASE WHEN len(pl) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(met, lambda x: x.share)), 0.0) END::DOUBLE AS score
FROM p
"""


OP10_SQL = _sql()
