"""Queries on generated answers: their stance, who gave them, and how providers compare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.operators import ingest as I
from loomwright.operators import likeness as L
from loomwright.operators import personas as P
from loomwright.operators import retrieval as R
from loomwright.operators import statistics as S
from loomwright.plans import index_queries as X


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def _answers(spark, d, k=3):
    c = X.chunks(spark, d, True)
    return P.respond(c, X.chunks(spark, d).select("member"), X.battery(spark, d), P.FirstStatement(), k, prompt=P.index_prompt)


def stance_generated(spark, d):
    """Members by the mean vector of their answers; an empty answer counts as one blank."""
    s = R.project(P.mean_generated(_answers(spark, d), P.DigestVectors(), ("member",)), X._axis(spark, d))
    return R.ranked(s).select("member", _r("stance"), F.col("rank").cast("long").alias("rank"))


def stance_bios(spark, d):
    """Depth 0 of the retrieval curve: members by the vector of their biography."""
    bios = X.chunks(spark, d).select("member").distinct().withColumn("bio", F.concat(F.lit("Biography of "), "member"))
    s = R.on_axis(P.with_vectors(bios, P.DigestVectors(), "bio"), X._axis(spark, d)).select("member", F.col("on_axis").alias("stance"))
    return R.ranked(s).select("member", _r("stance"), F.col("rank").cast("long").alias("rank"))


def _attributed(spark, d):
    a = P.with_vectors(_answers(spark, d), P.DigestVectors(), "response")
    return a.select(F.lit("all").alias("part"), F.col("query_idx").alias("fold"), F.col("member").alias("label"), "embedding")


def identifiability(spark, d):
    """Leave-one-query-out attribution of the answers: each member's recall."""
    return L.recall(L.cross_validated(_attributed(spark, d))).select("true", "n", _r("recall"))


def attribution_scores(spark, d):
    """Held-out log-probabilities of one member's class, on its own answers and on the others'."""
    s = L.class_scores(_attributed(spark, d), "m1")
    return s.groupBy("own").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.round(F.percentile("score", F.lit(0.5)), 6).alias("median"))


def decision_scores(spark, d):
    """Out-of-fold decision values of answers of two members."""
    rows = _attributed(spark, d).where("label in ('m1', 'm2')").withColumn("fold", F.col("fold") % 5)
    return L.decisions(L.cross_validated(rows), "m1").select("true", _r("decision", 4))


def likeness_by_size(spark, d):
    """Recall against the number of chunks: Kendall's tau, and the slope on the logarithm."""
    size = X.chunks(spark, d).groupBy("member").agg(F.count("*").alias("chunks"))
    both = size.join(L.recall(L.cross_validated(_attributed(spark, d))).select(F.col("true").alias("member"), "recall"), "member")
    tau = S.kendall(both, "chunks", "recall", few=True)
    line = both.agg(F.count("*").alias("n"), F.regr_slope("recall", F.log10("chunks")).alias("slope"), F.regr_intercept("recall", F.log10("chunks")).alias("intercept"))
    return line.crossJoin(F.broadcast(tau)).select("n", _r("tau"), _r("slope"), _r("intercept"))  # one row


PROVIDERS = {"long": (8, 12), "short": (4, 3)}


def generator_comparison(spark, d):
    """Accuracy of the conditioned index by provider, answers given, and the best of them."""
    out = []
    for name, (head, said) in PROVIDERS.items():
        answers = P.respond_at(X.chunks(spark, d, True), X._in_office(spark, d), X.battery(spark, d), P.FirstStatement(head, said), briefings=X.conditions(spark, d))
        acc = X._accuracy(X._panel(spark, d, P.committee_index(answers, P.DigestVectors(), X._axis(spark, d))))
        out.append(acc.select(F.lit(name).alias("provider"), "n", _r("accuracy")))
    rows = reduce(lambda a, b: a.unionByName(b), out)
    best = F.row_number().over(Window.orderBy(F.col("accuracy").desc(), "provider")) == 1  # a row a provider
    return rows.withColumn("best", best)


def conformed(spark, d):
    """Events as chunk rows: the columns in order, missing ones null, values that don't cast null."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").cast("string").alias("chunk_id"), F.lit("u").alias("member"), F.col("event_type").alias("probabilitySpeaker"), F.col("value").cast("string").alias("text"), F.when(F.col("event_id") % 2 == 0, "2024-01-05 10:00:00").otherwise("soon").alias("postedAt"), F.lit(1).alias("other"))
    c = I.conform(e)
    return c.agg(F.count("chunk_id").alias("ids"), F.count("probabilitySpeaker").alias("probabilities"), F.count("postedAt").alias("dates"), F.count("text").alias("texts"), F.count("theme").alias("themes")).withColumn("columns", F.lit(",".join(c.columns)))


def _compare_sql():
    parts = [X._BASE, X._score(None, 0)]
    for k, (head, said) in enumerate(PROVIDERS.values()):
        sql = X._index_sql(k).replace("tp1", "tp0").replace("[1:12]", f"[1:{said}]").replace("[1:8]", f"[1:{head}]")
        static = "'" + " ".join(X._STATIC.strip("'").split()[:head]) + "'"
        parts += [sql.replace(X._STATIC, static), X._panel_sql(k, f"ix{k}")]
    rows = " UNION ALL ".join(f"SELECT '{n}' AS provider, {X._acc_sql(k)}" for k, n in enumerate(PROVIDERS))
    return "WITH " + ", ".join(parts) + f", al AS ({rows}) SELECT *, row_number() OVER (ORDER BY accuracy DESC, provider) = 1 AS best FROM al"


_RANK = "row_number() OVER (ORDER BY round(stance, 9) DESC, member)"
_ANS = f"t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member, query_idx ORDER BY rel DESC, chunk_id) AS r FROM sc) WHERE r = 1), an AS (SELECT member, query_idx, {X._answer(X._STATIC)} AS reply FROM t)"
ORACLES = {
    "stance_generated": f"WITH {X._CH}, {X._SC}, {X._AX}, {_ANS}, s AS (SELECT member, avg({X._DOT.format(a=X._VEC.format(t='reply'), b='(SELECT u FROM ax)')}) AS stance FROM an GROUP BY member) SELECT member, round(stance, 6) AS stance, {_RANK} AS rank FROM s",
    "stance_bios": f"WITH {X._CH}, {X._AX}, b AS (SELECT DISTINCT member, 'Biography of ' || member AS bio FROM ch), s AS (SELECT member, {X._DOT.format(a=X._VEC.format(t='bio'), b='(SELECT u FROM ax)')} AS stance FROM b) SELECT member, round(stance, 6) AS stance, {_RANK} AS rank FROM s",
    "generator_comparison": _compare_sql(),
    "conformed": "SELECT count(*) AS ids, 0::BIGINT AS probabilities, count(*) FILTER (event_id % 2 = 0) AS dates, count(value) AS texts, 0::BIGINT AS themes, '" + ",".join(I.CHUNK_COLUMNS) + "' AS columns FROM events",
}
QUERIES = {n: globals()[n] for n in (*ORACLES, "identifiability", "attribution_scores", "decision_scores", "likeness_by_size")}
