"""Vector retrieval, pooled representations and their projection on an axis.

Members' vectors stay one row each.  The query side is the small side of every cross
join (a battery of questions); it is broadcast only when its size is below a bound.
Rankings sort (group, chunk_id, score) rows without vectors; the few winners then meet
their vectors.  A mean of vectors projected on an axis is the mean of their projections,
so positions need one number a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.scalar import dot

BATTERY_BOUND = 10_000


def small(df: DataFrame, bound: int = BATTERY_BOUND) -> DataFrame:
    """Broadcast as local rows if it has at most ``bound`` rows; else Spark joins it by blocks.

    The rows are read once, here, so no later plan works them out again.
    """
    rows = df.limit(bound + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= bound else df


def scored(chunks: DataFrame, battery: DataFrame) -> DataFrame:
    """chunks x battery with rel = dot product; chunks without a vector are left out.

    chunks: chunk_id, member, embedding; battery: query_idx, q.  Similarity is the plain
    dot product, so vectors should have unit length.
    """
    return chunks.where("embedding is not null").crossJoin(small(battery)).withColumn("rel", dot(F.col("embedding"), F.col("q")))


def top_k(rows: DataFrame, k: int, by: tuple[str, ...] = ("query_idx", "member"), score: str = "rel") -> DataFrame:
    """The k best rows of each group with ``rank`` from 1; NaN last, ties by chunk_id."""
    good = F.when(~F.isnan(score), F.col(score))
    w = Window.partitionBy(*by).orderBy(good.desc_nulls_last(), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def winners(chunks: DataFrame, battery: DataFrame, k: int) -> DataFrame:
    """query_idx, member, chunk_id, rel, rank of the k best chunks of each member and query, with the chunk's other columns."""
    slim = scored(chunks, battery).select("query_idx", "member", "chunk_id", "rel")
    return top_k(slim, k).join(chunks.drop("member"), "chunk_id")


def first_seen(rows: DataFrame, meetings: DataFrame) -> DataFrame:
    """``rows`` with ``_first``: the first meeting on or after the day they were ``posted``; without those that none sees."""
    seen = small(meetings.select(F.sort_array(F.collect_set("date")).alias("_days")))  # one row
    first = F.expr("filter(_days, d -> d >= posted)")
    return rows.crossJoin(seen).withColumn("_first", F.get(first, F.lit(0))).drop("_days").where("_first is not null")


def expanding_top_k(rows: DataFrame, meetings: DataFrame, k: int, by: tuple[str, ...] = ("member", "query_idx"), score: str = "rel") -> DataFrame:
    """date, rows: the k best of each group among the rows ``posted`` on or before each meeting, with ``rank``.

    Rows go to the first meeting that sees them, and only the k best of each group and
    meeting go on; each meeting then ranks what the meetings up to it kept.  So what is
    paired with the calendar (a small side) no longer grows with the rows.
    """
    days = small(meetings.select("date").distinct())
    kept = top_k(first_seen(rows, meetings), k, (*by, "_first"), score).drop("rank")
    return top_k(kept.join(days, F.col("_first") <= F.col("date")), k, ("date", *by), score).drop("_first")


def layers(pdf, keys: list[str], k: int):
    """Of a pandas table, the rows on the first ``k`` layers of each group of ``keys``: rows that no row of their layer
    or a later one surpasses in relevance (of equals the smaller chunk_id) without being older."""
    import numpy as np

    group = pdf.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
    better = pdf["chunk_id"].rank(method="first", ascending=False).to_numpy()
    worth = np.empty(len(pdf), dtype=np.int64)
    worth[np.lexsort((better, pdf["rel"].to_numpy()))] = np.arange(len(pdf))
    age = pdf["posted"].to_numpy(dtype="datetime64[D]").astype(np.int64)
    order = np.lexsort((-worth, -age, group))
    left = group[order] * np.int64(len(pdf)) + worth[order]
    kept = []
    for _ in range(k):
        if not len(order):
            break
        best = np.maximum.accumulate(left)
        top = np.concatenate([[True], left[1:] > best[:-1]])
        kept.append(order[top])
        order, left = order[~top], left[~top]
    return pdf.iloc[np.sort(np.concatenate(kept))] if kept else pdf


def recency_layers(seen: DataFrame, k: int, by: tuple[str, ...], held: int = 500_000) -> DataFrame:
    """Of rows with ``_first``, those that any mix of relevance and recency can rank among the k best of their group.

    For a given day a row's score is a sum of its relevance and of a function that falls with its age, so a row
    that k others surpass in both never ranks; rows are peeled into k layers.  A task peels what it reads, all
    groups at once and about ``held`` rows at a time, before the shuffle by group and meeting, and again behind it.
    """
    keys = [*by, "_first"]

    def peeled(frames):
        import pandas as pd

        waiting, rows = [], 0
        for pdf in frames:
            waiting.append(pdf)
            rows += len(pdf)
            if rows > held:
                one = layers(pd.concat(waiting), keys, k)
                waiting, rows = ([one], len(one)) if len(one) < held / 2 else ([], 0)
                if not waiting:
                    yield one
        if rows:
            yield layers(pd.concat(waiting), keys, k)

    slim = seen.select(*keys, "chunk_id", "posted", F.col("rel").cast("double").alias("rel"))
    return slim.mapInPandas(peeled, slim.schema).repartition(*keys).mapInPandas(peeled, slim.schema)


def _spreads(seen: DataFrame, days: DataFrame, taus: list[float], by: tuple[str, ...]) -> DataFrame:
    """date, by..., and the mean and spread of relevance (rel) and of recency for each of ``taus`` (r0, r1...) among
    the rows seen by each date.

    Rows are summed once by group and first meeting; recency decays alike for all of them from then on, so each date
    merges numbers, deviations from the merged mean included.
    """
    years = lambda a, b: F.datediff(a, b) / 365.25
    numbers = {"rel": F.col("rel")} | {f"r{i}": F.exp(-years(F.col("_first"), F.col("posted")) / t) for i, t in enumerate(taus)}
    own = seen.select(*by, "_first", *[v.alias(c) for c, v in numbers.items()]).groupBy(*by, "_first")
    own = own.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in numbers], *[(F.var_pop(c) * F.count("*")).alias(f"s_{c}") for c in numbers])
    at = own.join(days, F.col("_first") <= F.col("date"))
    fade = {"rel": F.lit(1.0)} | {f"r{i}": F.exp(-years(F.col("date"), F.col("_first")) / t) for i, t in enumerate(taus)}
    at = at.withColumns({f"m_{c}": F.col(f"m_{c}") * f for c, f in fade.items()} | {f"s_{c}": F.col(f"s_{c}") * f * f for c, f in fade.items()})
    w = Window.partitionBy("date", *by)
    at = at.withColumns({f"mean_{c}": F.sum(F.col("n") * F.col(f"m_{c}")).over(w) / F.sum("n").over(w) for c in numbers})
    off = lambda c: F.sum(F.col(f"s_{c}") + F.col("n") * (F.col(f"m_{c}") - F.col(f"mean_{c}")) ** 2)
    return at.groupBy("date", *by).agg(*[F.first(f"mean_{c}").alias(f"mean_{c}") for c in numbers], *[F.sqrt(off(c) / F.sum("n")).alias(f"sd_{c}") for c in numbers])


def expanding_top_k_weighted(rows: DataFrame, meetings: DataFrame, k: int, settings: list[tuple[float, float]], by: tuple[str, ...] = ("member", "query_idx")) -> DataFrame:
    """beta, tau, date, by..., chunk_id, rel, posted, score, rank: the k best of each group on each meeting's day for each
    setting, by z(relevance) + beta * z(exp(-age / tau)) among the rows ``posted`` on or before it.

    Neither the rows that meet the calendar nor the passes over the rows grow with the settings, and only the layers
    meet the calendar (a small side).  Rows without a day or relevance are left out; ties go to the smaller chunk_id,
    scores being compared at nine decimals.
    """
    taus = sorted({t for _, t in settings})
    days = small(meetings.select("date").distinct())
    seen = first_seen(rows.where("rel is not null and not isnan(rel)"), meetings)
    spread = _spreads(seen, days, taus, by)
    at = recency_layers(seen, k, by).join(days, F.col("_first") <= F.col("date")).join(spread, ["date", *by])
    z = lambda x, c: z_score(x, F.col(f"mean_{c}"), F.col(f"sd_{c}"))
    fresh = lambda t: z(F.exp(-age_in_years(F.col("posted"), F.col("date")) / t), f"r{taus.index(t)}")
    each = F.array(*[F.struct(F.lit(float(b)).alias("beta"), F.lit(float(t)).alias("tau"), F.round(z(F.col("rel"), "rel") + b * fresh(t), 9).alias("score")) for b, t in settings])
    told = at.select("date", *by, "chunk_id", "rel", "posted", F.inline(each))
    return top_k(told, k, ("beta", "tau", "date", *by), "score")


def z_score(x: Column, mean: Column, sd: Column) -> Column:
    """Population z-score; 0 where the spread is at most 1e-9."""
    return F.when(sd > 1e-9, (x - mean) / F.when(sd > 1e-9, sd)).otherwise(0.0)


def top_k_weighted(rows: DataFrame, k: int, beta: float, tau: float, by: tuple[str, ...] = ("query_idx", "member")) -> DataFrame:
    """Ranks by z(relevance) + beta * z(exp(-max(age, 0) / tau)); rows need ``rel`` and ``age`` in years.

    Means and spreads are aggregated before the ranking, with partial sums, so no group is sorted for them.
    """
    rows = rows.withColumn("fresh", F.exp(-F.greatest(F.col("age"), F.lit(0.0)) / tau))
    spread = rows.groupBy(*by).agg(*[f(c).alias(f"_{n}_{c}") for c in ("rel", "fresh") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    z = lambda c: z_score(F.col(c), F.col(f"_mean_{c}"), F.col(f"_sd_{c}"))
    both = rows.join(spread, list(by)).withColumn("score", z("rel") + beta * z("fresh"))
    return top_k(both.select(*rows.columns, "score"), k, by, "score")


def age_in_years(posted: Column, at: Column) -> Column:
    """Whole days from ``posted`` to ``at``, in years of 365.25 days."""
    return F.datediff(at, posted) / 365.25


def mean_vectors(rows: DataFrame, by: tuple[str, ...], vector: str = "embedding") -> DataFrame:
    """Element-wise mean per group, long form: by..., pos, v.  The sums are combined before the shuffle."""
    return rows.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("v"))


def pooled_retrieved(chunks: DataFrame, battery: DataFrame, k: int) -> DataFrame:
    """member, pos, v: mean over queries of the mean of each query's k best vectors."""
    one = mean_vectors(winners(chunks, battery, k), ("query_idx", "member"))
    return one.groupBy("member", "pos").agg(F.avg("v").alias("v"))


def on_axis(chunks: DataFrame, ax: DataFrame) -> DataFrame:
    """``chunks`` with ``on_axis``: each vector's dot product with the axis (one row of numbers, broadcast)."""
    u = ax.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "u"))), lambda p: p["u"]).alias("_u"))
    return chunks.crossJoin(F.broadcast(u)).withColumn("on_axis", dot(F.col("embedding"), F.col("_u"))).drop("_u")


def positions_retrieved(chunks: DataFrame, battery: DataFrame, ax: DataFrame, k: int) -> DataFrame:
    """member, query_idx, stance: the mean position of each query's k best chunks, without moving a vector."""
    rows = scored(on_axis(chunks, ax), battery).select("query_idx", "member", "chunk_id", "rel", "on_axis")
    return top_k(rows, k).groupBy("member", "query_idx").agg(F.avg("on_axis").alias("stance"))


def axis(anchors: DataFrame) -> DataFrame:
    """pos, u: unit vector from the mean of pole 'low' to the mean of pole 'high' (norm + 1e-12)."""
    rows = anchors.select("pole", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.col("x").cast("double"))
    diff = rows.groupBy("pos").agg((F.avg(F.when(F.col("pole") == "high", F.col("x"))) - F.avg(F.when(F.col("pole") == "low", F.col("x")))).alias("d"))
    norm = diff.agg((F.sqrt(F.sum(F.col("d") * F.col("d"))) + 1e-12).alias("norm"))
    return diff.crossJoin(F.broadcast(norm)).select("pos", (F.col("d") / F.col("norm")).alias("u"))  # norm is one row


def project(reps: DataFrame, ax: DataFrame, by: tuple[str, ...] = ("member",)) -> DataFrame:
    """by..., stance = the representation's dot product with the axis (one row a dimension)."""
    return reps.join(small(ax, 1 << 16), "pos").groupBy(*by).agg(F.sum(F.col("v") * F.col("u")).alias("stance"))


def ranked(scores: DataFrame, score: str = "stance", digits: int = 9) -> DataFrame:
    """Adds rank from 1, highest first, ties by member; scores are compared at ``digits`` decimals."""
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(F.round(score, digits).desc(), "member")))
