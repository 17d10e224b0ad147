"""Queries on vectors: retrieval, stance, rank correlation.  Each is a Spark plan and its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions.scalar import dot, detect_tau
from loomwright.operators import retrieval as R
from loomwright.operators import statistics as S
from loomwright.operators.pruned import CellIndex


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """chunk_id, member, embedding: vectors with their label as member."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("member"), "embedding")


def battery(spark: SparkSession, d: str, n: int = 15) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.where(F.col("vec_id") < n).select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("q"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.when(F.col("label") < 5, "high").otherwise("low").alias("pole"), "embedding")


#: Sizes of the subsets of the battery.
SIZES = (1, 2, 3, 5, 8, 12)


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def topk_retrieve(spark, d):
    t = R.top_k(R.scored(chunks(spark, d), battery(spark, d)).select("query_idx", "member", "chunk_id", "rel"), 3)
    return t.select("query_idx", "member", "chunk_id", F.col("rank").cast("long").alias("rank"), _r("rel"))


def topk_pruned(spark, d):
    """The rows of topk_retrieve from an index of cells, most of which no query reads."""
    t = CellIndex(chunks(spark, d)).top_k(battery(spark, d), 3)
    return t.select("query_idx", "member", "chunk_id", F.col("rank").cast("long").alias("rank"), _r("rel"))


def topk_work(spark, d):
    """How many vectors each query of topk_pruned scores, of how many."""
    return CellIndex(chunks(spark, d)).work(battery(spark, d), 3)


def topk_weighted(spark, d):
    rows = R.scored(chunks(spark, d), battery(spark, d)).select("query_idx", "member", "chunk_id", "rel", (F.pmod("chunk_id", F.lit(900)) / 365.25).alias("age"))
    t = R.top_k_weighted(rows, 3, 0.6, 2.0)
    return t.select("query_idx", "member", "chunk_id", F.col("rank").cast("long").alias("rank"), _r("score", 5))


def axis(spark, d):
    return R.axis(anchors(spark, d)).select(F.col("pos").cast("long").alias("pos"), _r("u"))


def stance_corpus(spark, d):
    s = R.project(R.mean_vectors(chunks(spark, d), ("member",)), R.axis(anchors(spark, d)))
    return R.ranked(s).select("member", _r("stance"), F.col("rank").cast("long").alias("rank"))


def _stance_retrieved(spark, d, k=3):
    each = R.positions_retrieved(chunks(spark, d), battery(spark, d), R.axis(anchors(spark, d)), k)
    return R.ranked(each.groupBy("member").agg(F.avg("stance").alias("stance")))


def stance_retrieved(spark, d):
    return _stance_retrieved(spark, d).select("member", _r("stance"), F.col("rank").cast("long").alias("rank"))


def _external(spark):
    """An outside order of members: m0 first."""
    return spark.range(10).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("member"), F.col("id").alias("ext"))


def _tau(s, spark, by=()):
    return S.kendall(s.join(_external(spark), "member"), "rank", "ext", by, few=True)


def kendall_stance(spark, d):
    return _tau(_stance_retrieved(spark, d), spark).select(_r("tau"))


def kendall_p(spark, d):
    """The exact permutation p-value of the retrieved ranking's tau."""
    s = _stance_retrieved(spark, d).join(_external(spark), "member")
    t = S.kendall(s, "rank", "ext", few=True).crossJoin(F.broadcast(s.agg(F.count("*").alias("n"))))
    return S.two_sided_p(t).select("n", _r("tau"), _r("p"))


def tau_by_depth(spark, d):
    """tau for k = 1..5 in one plan: the ranks up to 5 are made once and reused for each depth."""
    rows = R.scored(R.on_axis(chunks(spark, d), R.axis(anchors(spark, d))), battery(spark, d)).select("query_idx", "member", "chunk_id", "rel", "on_axis")
    ks = spark.range(1, 6).select(F.col("id").alias("k"))
    each = R.top_k(rows, 5).crossJoin(F.broadcast(ks)).where("rank <= k")
    s = each.groupBy("k", "query_idx", "member").agg(F.avg("on_axis").alias("v")).groupBy("k", "member").agg(F.avg("v").alias("stance"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.round("stance", 9).desc(), "member")))
    return _tau(s, spark, ("k",)).select("k", _r("tau"))


def _per_query(spark, d):
    return R.positions_retrieved(chunks(spark, d), battery(spark, d), R.axis(anchors(spark, d)), 3)


def tau_by_topic(spark, d):
    s = _per_query(spark, d).withColumn("rank", F.row_number().over(Window.partitionBy("query_idx").orderBy(F.round("stance", 9).desc(), "member")))
    groups = spark.createDataFrame([(f"s{k}", f"topic {k % 3}") for k in range(4)], "subtopic string, topic string")  # s4 has none
    t = _tau(s, spark, ("query_idx",)).withColumn("subtopic", F.concat(F.lit("s"), (F.col("query_idx") % 5).cast("string")))
    return t.join(F.broadcast(groups), "subtopic").groupBy("topic").agg(F.round(F.avg("tau"), 6).alias("tau"), F.count("*").alias("n"))


def tau_by_query_size(spark, d):
    """tau of the mean stance over subsets of the battery: 40 repetitions of six sizes, drawn by a portable hash."""
    per = _per_query(spark, d)
    reps = spark.range(40).select(F.col("id").alias("rep"))
    draw = battery(spark, d).select("query_idx").crossJoin(F.broadcast(reps))
    order = Window.partitionBy("rep").orderBy(F.md5(F.concat_ws(":", F.lit("s"), "rep", "query_idx").cast("binary")))
    sizes = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in SIZES])).alias("size"))
    draw = draw.withColumn("place", F.row_number().over(order)).crossJoin(F.broadcast(sizes)).where("place <= size")
    s = per.join(F.broadcast(draw), "query_idx").groupBy("size", "rep", "member").agg(F.avg("stance").alias("stance"))
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy("size", "rep").orderBy(F.round("stance", 9).desc(), "member")))
    return _tau(s, spark, ("size", "rep")).groupBy("size").agg(F.round(F.percentile("tau", F.lit(0.5)), 6).alias("median_tau"), F.round(F.avg("tau"), 6).alias("mean_tau"), F.round(F.stddev_pop("tau"), 6).alias("spread"))


def left_join_vectors(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "source")
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    j = docs.join(e, "chunk_id", "left")
    return j.groupBy("source").agg(F.count("*").alias("n"), F.count("embedding").alias("with_vector"), F.round(F.sum(F.coalesce(dot(F.col("embedding"), F.col("embedding")), F.lit(0.0))), 4).alias("squares"))


def confusion_recall(spark, d):
    """Nearest class mean (dot product) of each vector against its label: counts by (true, pred)."""
    c = chunks(spark, d)
    means = R.mean_vectors(c, ("member",)).groupBy("member").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("q")).withColumnRenamed("member", "pred")
    s = c.crossJoin(R.small(means)).withColumn("rel", F.round(dot(F.col("embedding"), F.col("q")), 9))
    best = s.withColumn("r", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("rel").desc(), "pred"))).where("r = 1")
    return best.groupBy(F.col("member").alias("true"), "pred").agg(F.count("*").alias("n"))


def recall_tau(spark, d):
    c = confusion_recall(spark, d)
    a = c.groupBy("true").agg((F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("recall"))
    return a.select("true", _r("recall"), F.round(detect_tau(F.col("recall")), 6).alias("tau"))


_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_CH = "ch AS (SELECT vec_id AS chunk_id, 'm' || label AS member, embedding, label FROM embeddings)"
_B = "bat AS (SELECT vec_id AS query_idx, embedding AS q FROM embeddings WHERE vec_id < {n})"
_SC = f"sc AS (SELECT query_idx, member, chunk_id, embedding, {_DOT.format(a='embedding', b='q')} AS rel FROM ch, bat)"
_TOP = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_idx, member ORDER BY rel DESC, chunk_id) AS rank FROM sc) WHERE rank <= {k})"
_AX = "ad AS (SELECT pos, avg(x) FILTER (label < 5) - avg(x) FILTER (label >= 5) AS d FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY pos), ax AS (SELECT pos, d / ((SELECT sqrt(sum(d*d)) FROM ad) + 1e-12) AS u FROM ad)"
_MV = "mv AS (SELECT {by}, pos, avg(x) AS v FROM (SELECT {by}, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM {src}) GROUP BY {by}, pos)"


def _head(n=15, k=3):
    return f"WITH {_CH}, {_B.format(n=n)}, {_SC}, {_TOP.format(k=k)}, {_AX}"


_RANK = "row_number() OVER ({p} ORDER BY round(stance, 9) DESC, member)"
_TAU = "sum(sign(x.rank - y.rank) * sign(x.ext - y.ext)) / sqrt(sum(abs(sign(x.rank - y.rank))) * sum(abs(sign(x.ext - y.ext))))"

ORACLES = {
    "topk_retrieve": _head() + " SELECT query_idx, member, chunk_id, rank, round(rel, 6) AS rel FROM top",
    "topk_pruned": _head() + " SELECT query_idx, member, chunk_id, rank, round(rel, 6) AS rel FROM top",
    "topk_weighted": f"""WITH {_CH}, {_B.format(n=15)}, {_SC}, z AS (SELECT *, exp(-greatest((chunk_id % 900) / 365.25, 0) / 2.0) AS fresh FROM sc),
        s AS (SELECT *, (rel - avg(rel) OVER w) / (stddev_pop(rel) OVER w) + 0.6 * (fresh - avg(fresh) OVER w) / (stddev_pop(fresh) OVER w) AS score FROM z WINDOW w AS (PARTITION BY query_idx, member)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_idx, member ORDER BY score DESC, chunk_id) AS rank FROM s)
        SELECT query_idx, member, chunk_id, rank, round(score, 5) AS score FROM r WHERE rank <= 3""",
    "axis": f"WITH {_AX} SELECT pos::BIGINT AS pos, round(u, 6) AS u FROM ax",
    "stance_corpus": f"WITH {_CH}, {_AX}, {_MV.format(by='member', src='ch')}, s AS (SELECT member, sum(v*u) AS stance FROM mv JOIN ax USING (pos) GROUP BY member) SELECT member, round(stance, 6) AS stance, {_RANK.format(p='')} AS rank FROM s",
    "stance_retrieved": _head() + f", {_MV.format(by='query_idx, member', src='top')}, m2 AS (SELECT member, pos, avg(v) AS v FROM mv GROUP BY ALL), s AS (SELECT member, sum(v*u) AS stance FROM m2 JOIN ax USING (pos) GROUP BY member) SELECT member, round(stance, 6) AS stance, {_RANK.format(p='')} AS rank FROM s",
    "kendall_stance": _head() + f", {_MV.format(by='query_idx, member', src='top')}, m2 AS (SELECT member, pos, avg(v) AS v FROM mv GROUP BY ALL), s AS (SELECT member, sum(v*u) AS stance FROM m2 JOIN ax USING (pos) GROUP BY member), r AS (SELECT {_RANK.format(p='')} AS rank, substr(member, 2)::INT AS ext FROM s) SELECT round({_TAU}, 6) AS tau FROM r x JOIN r y ON x.ext < y.ext",
    "tau_by_depth": _head(k=5) + f", e AS (SELECT k, query_idx, member, embedding FROM top, (SELECT unnest(range(1, 6)) AS k) WHERE rank <= k), {_MV.format(by='k, query_idx, member', src='e')}, m2 AS (SELECT k, member, pos, avg(v) AS v FROM mv GROUP BY ALL), s AS (SELECT k, member, sum(v*u) AS stance FROM m2 JOIN ax USING (pos) GROUP BY k, member), r AS (SELECT k, {_RANK.format(p='PARTITION BY k')} AS rank, substr(member, 2)::INT AS ext FROM s) SELECT x.k AS k, round({_TAU}, 6) AS tau FROM r x JOIN r y ON x.k = y.k AND x.ext < y.ext GROUP BY x.k",
    "tau_by_topic": _head() + f", {_MV.format(by='query_idx, member', src='top')}, s AS (SELECT query_idx, member, sum(v*u) AS stance FROM mv JOIN ax USING (pos) GROUP BY ALL), r AS (SELECT query_idx, {_RANK.format(p='PARTITION BY query_idx')} AS rank, substr(member, 2)::INT AS ext FROM s), t AS (SELECT x.query_idx AS query_idx, {_TAU} AS tau FROM r x JOIN r y ON x.query_idx = y.query_idx AND x.ext < y.ext GROUP BY x.query_idx) SELECT 'topic ' || (query_idx % 5 % 3) AS topic, round(avg(tau), 6) AS tau, count(*) AS n FROM t WHERE query_idx % 5 < 4 GROUP BY 1",
    "tau_by_query_size": _head() + f", {_MV.format(by='query_idx, member', src='top')}, p AS (SELECT query_idx, member, sum(v*u) AS stance FROM mv JOIN ax USING (pos) GROUP BY ALL), dr AS (SELECT rep, query_idx, row_number() OVER (PARTITION BY rep ORDER BY md5('s:' || rep || ':' || query_idx)) AS place FROM bat, (SELECT unnest(range(40)) AS rep)), s AS (SELECT size, rep, member, avg(stance) AS stance FROM p JOIN dr USING (query_idx), (SELECT unnest([1, 2, 3, 5, 8, 12]) AS size) WHERE place <= size GROUP BY ALL), r AS (SELECT size, rep, {_RANK.format(p='PARTITION BY size, rep')} AS rank, substr(member, 2)::INT AS ext FROM s), t AS (SELECT x.size AS size, x.rep AS rep, {_TAU} AS tau FROM r x JOIN r y ON x.size = y.size AND x.rep = y.rep AND x.ext < y.ext GROUP BY ALL) SELECT size::BIGINT AS size, round(quantile_cont(tau, 0.5), 6) AS median_tau, round(avg(tau), 6) AS mean_tau, round(stddev_pop(tau), 6) AS spread FROM t GROUP BY size",
    "left_join_vectors": f"SELECT source, count(*) AS n, count(embedding) AS with_vector, round(sum(coalesce({_DOT.format(a='embedding', b='embedding')}, 0)), 4) AS squares FROM documents LEFT JOIN embeddings ON doc_id = vec_id GROUP BY source",
    "confusion_recall": f"WITH {_CH}, {_MV.format(by='member', src='ch')}, q AS (SELECT member AS pred, list(v ORDER BY pos) AS q FROM mv GROUP BY member), s AS (SELECT member, pred, row_number() OVER (PARTITION BY chunk_id ORDER BY round({_DOT.format(a='embedding', b='q')}, 9) DESC, pred) AS r FROM ch, q) SELECT member AS \"true\", pred, count(*) AS n FROM s WHERE r = 1 GROUP BY ALL",
    "recall_tau": f"WITH {_CH}, {_MV.format(by='member', src='ch')}, q AS (SELECT member AS pred, list(v ORDER BY pos) AS q FROM mv GROUP BY member), s AS (SELECT member, pred, row_number() OVER (PARTITION BY chunk_id ORDER BY round({_DOT.format(a='embedding', b='q')}, 9) DESC, pred) AS r FROM ch, q), a AS (SELECT member AS \"true\", avg((member = pred)::INT) AS recall FROM s WHERE r = 1 GROUP BY member) SELECT \"true\", round(recall, 6) AS recall, round(2 * greatest(recall, 1 - recall) - 1, 6) AS tau FROM a",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "kendall_p", "topk_work")}
