"""Language identification (9): nearest of several clustered centroids per language.

A text is a vector of hashed byte-trigram counts of its letters, sublinear in the
count, weighted by inverse document frequency, of unit length.  Each language has a
few centroids (spherical k-means); the nearest by cosine wins.  A text too far from
every centroid, measured against texts of its length, is rejected.

Fitting reads a bounded sample: at most about ``per_language`` labelled rows of each
language, chosen by a hash of their id.  Prediction reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fraction, give_back, held_out, learnable, quoted, released, small_batches

BINS = 4096
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def has_letter(text: str | None) -> bool:
    return bool(text and _LETTER.search(text))


def trigram_counts(text: str) -> np.ndarray:
    """Counts of hashed trigrams over the lower-cased text, other ASCII than letters being blanks."""
    a = _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    code = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
    return np.bincount(code, minlength=BINS)


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray  # (languages * k, BINS), unit rows
    owner: np.ndarray  # language of each centroid
    idf: np.ndarray
    least: np.ndarray  # smallest accepted cosine by log2 of the trigram count
    sharpness: float

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score in 0..1, accepted."""
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.full((len(counts), len(self.languages)), -1.0)
        for j, k in enumerate(self.owner):
            best[:, k] = np.maximum(best[:, k], cosine[:, j])
        top = best.argmax(1)
        e = np.exp(self.sharpness * (best - best.max(1, keepdims=True)))
        band = np.minimum(np.log2(np.maximum(counts.sum(1), 1)).astype(int), len(self.least) - 1)
        return top, 1.0 / e.sum(1), best.max(1) >= self.least[band]


def fit(texts: list[str], langs: list[str], clusters: int = 4, slack: float = 0.5) -> Model:
    """``slack`` times the smallest cosine of a training text of its length is still accepted."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs], dtype=int)
    x, n, having = np.empty((len(texts), BINS), np.float32), np.zeros(len(texts), dtype=np.int64), np.zeros(BINS, dtype=np.int64)
    for i, t in enumerate(texts):  # the driver holds one table of this size, no copies
        x[i] = own = trigram_counts(t)
        n[i] = own.sum()
        having += own > 0
    idf = np.log((1 + len(x)) / (1 + having)).astype(np.float32) + 0.05
    model = Model(languages, np.zeros((0, BINS), np.float32), np.zeros(0, int), idf, np.zeros(24), 40.0)
    for at in range(0, len(x), 64):
        x[at : at + 64] = model.vectors(x[at : at + 64])
    centroids, owner = [], []
    for k in range(len(languages)):
        own = x[y == k]
        c = own[np.linspace(0, len(own) - 1, min(clusters, len(own))).astype(int)]
        for _ in range(8):
            near = (own @ c.T).argmax(1)
            c = np.array([own[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        centroids.append(c)
        owner += [k] * len(c)
    if languages:
        model.centroids, model.owner = np.concatenate(centroids).astype(np.float32), np.array(owner)
        cosine = (x @ model.centroids.T).max(1)
        band = np.minimum(np.log2(np.maximum(n, 1)).astype(int), 23)
        for b in range(24):
            near = cosine[(band >= b - 1) & (band <= b + 1)]
            model.least[b] = slack * near.min() if len(near) else 0.0
    return model


def training_rows(docs: DataFrame, per_language: int) -> list:
    """A bounded sample of labelled rows; their number a language is about ``per_language`` at most."""
    labelled = docs.where(learnable() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    chosen = labelled.where(fraction(F.col("doc_id"), 9) < share[F.col("lang")]).select("text", "lang").collect()
    return sorted((r["text"], r["lang"]) for r in chosen if has_letter(r["text"]))


def identify(docs: DataFrame, per_language: int = 400, clusters: int = 4, keep: list | None = None) -> DataFrame:
    """The columns ``keep`` (all) of ``docs`` with lang_pred, score and accepted.

    ``und`` (score 0, not accepted) if the text is null or has no letter, or if nothing
    can be learned.  Rows that repeat are judged alike, each by its text alone.
    """
    small_batches(docs.sparkSession)
    rows = training_rows(docs, per_language)
    model = fit([t for t, _ in rows], [x for _, x in rows], clusters)
    del rows
    give_back()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # languages x clusters x BINS numbers
    kept = docs.select(*(keep or [quoted(c) for c in docs.columns if c not in ("lang_pred", "score", "accepted")]))
    keys = kept.columns

    def judge(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(0).to_pylist()
            lang, score, accepted = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts)
            own = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            for at in range(0, len(own), 64):
                some = own[at : at + 64]
                top, s, ok = m.predict(np.array([trigram_counts(texts[i]) for i in some]))
                for i, k, x, good in zip(some, top, s, ok, strict=True):
                    lang[i], score[i], accepted[i] = m.languages[k], float(x), bool(good)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], names=[*keys, "lang_pred", "score", "accepted"])

    schema = kept.schema.add("lang_pred", "string").add("score", "double").add("accepted", "boolean")
    named = [c.alias(f"c{k}") for k, c in enumerate(keep or [docs[quoted(c)] for c in keys])]  # a caller's names can't clash
    return docs.select(F.col("text").cast("string").alias("t"), *named).mapInArrow(released(judge), schema)


def op9_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; texts go to Python and don't come back."""
    judged = identify(docs.select("doc_id", "text", "lang"), keep=[F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out")])
    return judged.select("doc_id", "held_out", "lang_pred", "score", (~F.col("accepted")).alias("rejected"))
