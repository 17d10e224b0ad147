"""Shrinkage linear discriminant analysis: attribution and detectability.

Everything that Ledoit and Wolf's estimate needs of a class is a sum over its rows: their
number, x, x x', x^2 x' and x^2 (x^2)'.  Tasks add these up for each part, fold and label,
partial sums are merged by an aggregation, and a fold's training sums are those of the
label less the held-out fold's.  What is left is one small solve for each part and fold,
from sums whose size doesn't grow with the rows, and a join that scores the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.scalar import dot


def moments(x: np.ndarray) -> np.ndarray:
    """The sums of some rows that a class is fitted from; those of two sets of rows add up."""
    squares = x * x
    return np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel(), (squares.T @ x).ravel(), (squares.T @ squares).ravel()])


def unpacked(v: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    p = int((np.sqrt(12 * len(v) - 11) - 1) // 6)  # 1 + p + 3 p^2 numbers
    square = v[1 + p :].reshape(3, p, p)
    return v[0], v[1 : 1 + p], *square


def shrunk_covariance(v: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Ledoit and Wolf's (2004) estimate of the rows summed in ``v``, centred and divided by ``scale``, in their own units."""
    n, total, second, third, fourth = unpacked(v)
    p, mean, d = len(total), total / n, 1 / scale**2
    s = (second / n - np.outer(mean, mean)) / np.outer(scale, scale)
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum()
    dm = d * mean
    c = dm @ mean
    length4 = (d @ fourth @ d - 4 * d @ third @ dm + 4 * dm @ second @ dm + 2 * c * (d @ second.diagonal()) - 4 * c * (dm @ total)) / n + c * c
    beta = min(delta, max(0.0, (length4 - (s**2).sum()) / n))
    w = beta / delta if delta > 0 else 0.0
    return ((1 - w) * s + w * mu * np.eye(p)) * np.outer(scale, scale)


def fit(sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of the classes; the covariance is the prior-weighted mean of each class's."""
    whole = sum(sums)
    n, total, second, *_ = unpacked(whole)
    scale = np.sqrt(np.maximum(second.diagonal() / n - (total / n) ** 2, 0.0))
    scale = np.where(scale > 1e-9 * np.sqrt(second.diagonal() / n), scale, 1.0)
    priors = np.array([v[0] for v in sums]) / n
    cov = sum(q * shrunk_covariance(v, scale) for q, v in zip(priors, sums, strict=True))
    means = np.array([unpacked(v)[1] / v[0] for v in sums])
    w = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    return w, -0.5 * (w * means).sum(1) + np.log(priors)


def summed(rows: DataFrame) -> DataFrame:
    """part, fold, label, v: the moments of each, partial sums of tasks merged."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            keys = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(list(k), t) for k, t in zip(keys, (pa.string(), pa.int64(), pa.string()), strict=True)), pa.array(list(held.values()), pa.list_(pa.float64()))], names=["part", "fold", "label", "v"])

        for batch in batches:
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                own = batch.column(3).take(pa.array(at))
                v = moments(own.flatten().to_numpy().reshape(len(at), -1))
                held[key] = held[key] + v if key in held else v
                if len(held) * v.nbytes > 64 << 20:  # what a task holds is bounded
                    yield out()
                    held = {}
        if held:
            yield out()

    slim = rows.select(F.col("part").cast("string"), F.col("fold").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")).where("embedding is not null and label is not null")
    parts = slim.mapInArrow(run, "part string, fold long, label string, v array<double>")
    return parts.groupBy("part", "fold", "label").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v"))


def training(own: DataFrame) -> DataFrame:
    """part, fold, label, t (the label's sums), v (those of the held-out fold; null where it has no such row)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    whole = own.groupBy("part", "label").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("t"))
    return own.select("part", "fold").distinct().join(whole, "part").join(own, ["part", "fold", "label"], "left")


def solved(train: DataFrame) -> DataFrame:
    """part, fold, classes, w, b: the model of each fold, from the part's other folds.

    Folds whose other rows have a single label are left out.  A solve holds the sums of one fold's classes.
    """

    def solve(pdf):
        import pandas as pd

        pdf = pdf.sort_values("label")
        sums = [t if v is None else t - v for t, v in zip(pdf["t"], pdf["v"], strict=True)]
        kept = [(c, v) for c, v in zip(pdf["label"], sums, strict=True) if v[0] > 0.5]
        if len(kept) < 2:
            return pd.DataFrame(columns=["part", "fold", "classes", "w", "b"], dtype=object)
        w, b = fit([v for _, v in kept])
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "fold": [pdf["fold"].iloc[0]], "classes": [[c for c, _ in kept]], "w": [[list(x) for x in w]], "b": [list(b)]})

    return train.groupBy("part", "fold").applyInPandas(solve, "part string, fold long, classes array<string>, w array<array<double>>, b array<double>")


def _judged(rows: DataFrame, models: DataFrame, on: list[str]) -> DataFrame:
    """part, fold, true, classes, lp (the log-probability of each class) of ``rows`` by the models they meet."""
    x = F.col("embedding").cast("array<double>")
    slim = rows.where("embedding is not null and label is not null").select(*[F.col(c) for c in on], F.col("label").cast("string").alias("true"), x.alias("x"))
    both = slim.join(models, on)
    score = F.zip_with(F.transform("w", lambda w: dot(F.col("x"), w)), F.col("b"), lambda s, b: s + b)
    above = both.select("part", "fold", "true", "classes", score.alias("s")).withColumn("s", F.transform("s", lambda v: v - F.array_max("s")))
    norm = F.log(F.aggregate("s", F.lit(0.0), lambda a, v: a + F.exp(v)))
    return above.withColumn("norm", norm).select("part", "fold", "true", "classes", F.transform("s", lambda v: v - F.col("norm")).alias("lp"))


def held_out_scores(rows: DataFrame) -> DataFrame:
    """part, fold, true, classes, lp (the log-probability of each class) of every row whose fold has a model.

    rows: part (an independent problem), fold, label, embedding (of one length in a part; null ones are left out, as
    are null labels).  Sums are of fourth powers, so vectors should lie within some thousand spreads of the origin.
    """
    return _judged(rows, solved(training(summed(rows))), ["part", "fold"])


def against(rows: DataFrame, anchor: str) -> DataFrame:
    """part (a label), fold, true, pred: held-out two-way decisions between each label and ``anchor``.

    rows: fold, label, embedding.  A row is summed once, whatever the number of labels; the anchor's sums
    meet those of each label, and its rows each label's model.
    """
    train = training(summed(rows.withColumn("part", F.lit("all")))).drop("part")
    labels = train.where(F.col("label") != anchor).select("fold", F.col("label").alias("part")).distinct()
    pairs = train.where(F.col("label") != anchor).withColumn("part", F.col("label")).unionByName(train.where(F.col("label") == anchor).join(labels, "fold"))
    models = solved(pairs)
    own, other = rows.where(F.col("label") != anchor).withColumn("part", F.col("label")), rows.where(F.col("label") == anchor)
    return _predicted(_judged(own, models, ["part", "fold"]).unionByName(_judged(other, models, ["fold"])))


def _predicted(judged: DataFrame) -> DataFrame:
    pred = F.get("classes", F.array_position("lp", F.array_max("lp")).cast("int") - 1)
    known = F.array_contains("classes", F.col("true"))
    return judged.select("part", "fold", "true", pred.alias("pred"), F.when(known, _of(F.col("true"))).otherwise(float("nan")).alias("log_p"))


def _of(label: str | Column) -> Column:
    """The log-probability of a label; null where the fold doesn't know it."""
    return F.get("lp", F.array_position("classes", label).cast("int") - 1)


def cross_validated(rows: DataFrame) -> DataFrame:
    """part, fold, true, pred, log_p (of the true label; NaN where the fold doesn't know it) for each held-out row.

    Used for attribution (fold = query) and for two-way detectability (explicit folds).
    """
    return _predicted(held_out_scores(rows))


def class_scores(rows: DataFrame, member: str) -> DataFrame:
    """part, fold, true, own, score: the held-out log-probability that each row is ``member``'s; ``own`` where it is."""
    known = held_out_scores(rows).where(F.array_contains("classes", F.lit(member)))
    return known.select("part", "fold", "true", (F.col("true") == member).alias("own"), _of(F.lit(member)).alias("score"))


def decisions(predictions: DataFrame, positive: str) -> DataFrame:
    """part, true, decision: out-of-fold decision values of two classes, log p(positive) - log p(other), from log_p of the true one."""
    p = F.least(F.exp("log_p"), F.lit(1 - 1e-12))
    odds = F.col("log_p") - F.log(1 - p)
    return predictions.select("part", "true", F.when(F.col("true") == positive, odds).otherwise(-odds).alias("decision"))


def recall(predictions: DataFrame) -> DataFrame:
    """part, true, n, recall."""
    return predictions.groupBy("part", "true").agg(F.count("*").alias("n"), F.avg((F.col("true") == F.col("pred")).cast("int")).alias("recall"))


def hash_split(rows: DataFrame, key: str, by: str, n_test: int = 40, seed: int = 0) -> DataFrame:
    """Adds is_test: the first ``n_test`` rows of each group in the order of md5(seed:key)."""
    from pyspark.sql import Window

    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    return rows.withColumn("is_test", F.row_number().over(Window.partitionBy(by).orderBy(order, key)) <= n_test)
