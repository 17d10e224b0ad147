"""Toxicity (2): a weighted lexicon matched by Aho-Corasick on folded text.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters they
stand for, drops invisible characters and turns other marks into blanks.  Lexicon
entries are word beginnings, weighted by their log-odds between toxic and clean
labelled texts; phrases that hold an entry but stand in clean texts only are
exceptions.  A text's weight, alone and per word, enters a two-feature logistic.

Learning reads a bounded sample: about ``sample`` labelled rows at most, chosen by a
hash of their id.  Scoring reads every whole text and nothing else.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction, held_out, learnable, released, small_batches

_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "τ": "t", "ι": "i", "κ": "k", "ε": "e", "υ": "u", "ɑ": "a", "ɡ": "g", "ı": "i", "ⅼ": "l", "ℓ": "l",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "|": "i", "l": "i",
}


class _Fold(dict):
    """Code point to folded text; filled as characters are met (l, 1, | and i fold alike)."""

    def __missing__(self, point: int) -> str:
        import unicodedata

        c = chr(point)
        if unicodedata.category(c) == "Cf":
            out = ""
        else:
            plain = unicodedata.normalize("NFKC", c).lower()
            out = "".join(_LOOKALIKES.get(x, x) for x in plain)
            out = "".join(x if x.isalnum() else " " for x in out)
        if len(self) < 70_000:
            self[point] = out
        return out


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """The folded text between two blanks, with single blanks."""
    return f" {' '.join((text or '').translate(_FOLD).split())} "


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs of overlapping spans, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " beginning" -> weight
    exceptions: list[str] = field(default_factory=list)  # folded phrases, blank before and after
    logistic: tuple[float, float, float] = (-2.0, 1.0, 1.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, w in self.weights.items():
            a.add_word(k, (k, w))
        for k in self.exceptions:
            if k not in self.weights:
                a.add_word(k, (k, 0.0))
        if len(a):
            a.make_automaton()
        return a

    def features(self, automaton, text: str | None) -> tuple[float, float]:
        """Log of the matched weight, and of that per hundred words."""
        folded = fold(text)
        if not len(automaton) or len(folded) < 3:
            return 0.0, 0.0
        best: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (key, weight) in automaton.iter(folded):
            at = end - len(key) + 1
            if weight > 0:
                best[at] = max(best.get(at, 0.0), weight)  # entries that begin together count once
            else:
                excused.append((at, end))
        if excused:
            starts, ends = merged(excused)  # an end is the blank after a phrase, where the next word's entry begins
            best = {at: w for at, w in best.items() if not (k := bisect_right(starts, at)) or at >= ends[k - 1]}
        total = sum(best.values())
        words = folded.count(" ") - 1
        return math.log1p(total), math.log1p(100.0 * total / (words + 20))

    def score(self, x: tuple[float, float]) -> float:
        a, b, c = self.logistic
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * x[0] + c * x[1]))))


def learn(texts: list[str | None], toxic: list[int], longest: int = 10, shortest: int = 4, exceptions: tuple[str, ...] = ()) -> Lexicon:
    """A lexicon from labelled texts; with one class only it is empty and scores are low."""
    bad, good = Counter(), Counter()
    n1 = sum(toxic)
    n0 = len(toxic) - n1
    folded = [fold(t) for t in texts]
    for text, y in zip(folded, toxic, strict=True):
        begins = {w[:k] for w in set(text.split()) for k in range(shortest, min(len(w), longest) + 1)}
        (bad if y else good).update(begins)
    lexicon = Lexicon()
    if not n1 or not n0:
        return lexicon
    base = n1 / len(toxic)

    def strength(t: int, c: int) -> float:  # log-likelihood ratio of the share of toxic texts against the base share
        n, p = t + c, t / (t + c)
        if p <= base:
            return 0.0
        return 2 * (t * math.log(p / base) + (c * math.log((1 - p) / (1 - base)) if c else 0.0)) if n else 0.0

    def ratio(k: str) -> float:
        return math.log((bad[k] + 0.5) / (n1 + 1)) - math.log((good[k] + 0.5) / (n0 + 1))

    fits = {k for k, t in bad.items() if t >= 3 and t >= 0.8 * (t + good[k]) and strength(t, good[k]) > 12}
    for k in sorted(fits, key=len):
        shorter = k[:-1]
        if shorter not in fits:  # the shortest beginning that is telling
            lexicon.weights[f" {k}"] = ratio(k)
    phrases = Counter()
    for text, y in zip(folded, toxic, strict=True):
        words = text.split()
        seen = set()
        for i, w in enumerate(words):
            if any(f" {w[:k]}" in lexicon.weights for k in range(shortest, min(len(w), longest) + 1)):
                seen |= {f" {' '.join(words[max(0, i - 1) : i + 1])} ", f" {' '.join(words[i : i + 2])} "}
        for p in seen:
            if " " in p.strip():
                phrases[p] += -1000 if y else 1
    lexicon.exceptions = sorted([*(p for p, n in phrases.items() if n >= 3), *(fold(p) for p in exceptions)])
    automaton = lexicon.automaton()
    x = np.array([(1.0, *lexicon.features(automaton, t)) for t in texts])
    y, w = np.array(toxic, dtype=float), np.array([-3.0, 1.0, 0.0])
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * 0.5
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.5 * w)
    if w[1] + w[2] > 0:
        lexicon.logistic = tuple(map(float, w))
    return lexicon


def training_rows(docs: DataFrame, labels: DataFrame, sample: int) -> list:
    marks = labels.where(learnable() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    chosen = marks.where(fraction(F.col("doc_id"), 2) < min(1.0, sample / max(n, 1)))
    rows = docs.where(fraction(F.col("doc_id"), 2) < min(1.0, sample / max(n, 1))).select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic").collect()
    return sorted(((r["text"] or "", r["toxic"]) for r in rows))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by the sample it was learned from

    def judge(batches):
        lex = shared.value
        automaton = lex.automaton()
        for batch in batches:
            scores = [lex.score(lex.features(automaton, t)) for at in range(0, batch.num_rows, 64) for t in batch.column(2).slice(at, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(judge), "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 5000) -> DataFrame:
    rows = training_rows(docs, labels, sample)
    return score(docs, learn([t for t, _ in rows], [y for _, y in rows]))
