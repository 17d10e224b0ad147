"""Rank correlation, AUC, as-of joins, walk-forward regression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

def inversions(rank, weight) -> int:
    """The weight of the pairs of a sequence whose earlier rank is the larger one; ranks are 0, 1 and so on, each once.

    Bit by bit from the highest: in a block of ranks that agree in all higher bits, what has the bit and stands before
    what hasn't is an inversion.
    """
    import numpy as np

    total, rank, weight = 0, np.asarray(rank, dtype=np.int64), np.asarray(weight, dtype=np.int64)
    for bit in reversed(range(int(max(len(rank) - 1, 0)).bit_length())):
        one = (rank >> bit) & 1
        before = np.cumsum(weight * one)
        block = rank >> (bit + 1)
        first = np.flatnonzero(np.diff(block, prepend=-1))
        base = np.repeat(np.where(first > 0, before[first - 1], 0), np.diff(first, append=len(rank)))
        total += int((weight * (1 - one) * (before - base)).sum())
        order = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[order], weight[order]
    return total


def _inside(pdf) -> int:
    """Inversions in one range.  Points are distinct, in the order of a, then b (kind 0: of their range by a), against that
    of b, then a; those of a kind-1 range (by b) count if their ranges by a differ."""
    import numpy as np

    a, b, r1 = (pdf[c].to_numpy() for c in ("_a", "_b", "_r1"))
    rank = np.empty(len(pdf), dtype=np.int64)
    rank[np.lexsort((a, b))] = np.arange(len(pdf))
    order = np.lexsort((b, a)) if pdf["_kind"].iloc[0] == 0 else np.lexsort((rank, r1))
    return inversions(rank[order], pdf["_w"].to_numpy()[order])


def _between(pdf) -> int:
    """Inversions between cells (_r1, _r2, _w) whose ranges differ both ways."""
    import numpy as np

    _, column = np.unique(pdf["_r2"].to_numpy(), return_inverse=True)
    row, weight = pdf["_r1"].to_numpy(), pdf["_w"].to_numpy()
    order = np.argsort(row, kind="stable")
    seen, total = np.zeros(column.max() + 1, dtype=np.int64), 0
    for own in np.split(order, np.flatnonzero(np.diff(row[order])) + 1):
        above = seen.sum() - np.cumsum(seen)
        total += int((weight[own] * above[column[own]]).sum())
        np.add.at(seen, column[own], weight[own])
    return total


def _sums_in_place(points: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """by..., s, x, y of small groups, each an array whose pairs are compared."""
    lists = points.groupBy(*by).agg(F.collect_list(F.struct("_a", "_b", "_w")).alias("_p"))
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("s", "x", "y")])

    def against_later(p, i):
        def add(acc, q):
            x, y, w = F.signum(p["_a"] - q["_a"]).cast("long"), F.signum(p["_b"] - q["_b"]).cast("long"), p["_w"] * q["_w"]
            return F.struct((acc["s"] + x * y * w).alias("s"), (acc["x"] + F.abs(x) * w).alias("x"), (acc["y"] + F.abs(y) * w).alias("y"))

        return F.aggregate(F.slice("_p", i + 2, F.size("_p")), zero, add)

    def plus(acc, t):
        return F.struct(*[(acc[c] + t[c]).alias(c) for c in ("s", "x", "y")])

    sums = lists.select(*by, F.aggregate(F.transform("_p", against_later), zero, plus).alias("t"))
    return sums.select(*by, *[F.col(f"t.{c}").cast("decimal(38,0)").alias(c) for c in ("s", "x", "y")])


def _sums_by_ranges(points: DataFrame, by: tuple[str, ...], ranges: int) -> DataFrame:
    """by..., s, x, y of large groups, from tied pairs and inversions.

    Points are cut into ranges of a and of b at the group's approximate quantiles; a value that is a quantile has ranges of
    its own, cut again by the other side's, so ties don't fill a range.  A task holds one range.
    """
    width = 2 * ranges + 2
    place = lambda v, cuts: 2 * F.size(F.filter(cuts, lambda c: c < F.col(v))) + F.array_contains(cuts, F.col(v)).cast("int")
    p = points.withColumns({"_ra": place("_a", F.col("_ca")), "_rb": place("_b", F.col("_cb"))})
    sub = lambda r, other: F.col(r) * width + F.when(F.col(r) % 2 == 1, F.col(other) + 1).otherwise(0)
    p = p.select(*by, "_a", "_b", "_w", sub("_ra", "_rb").alias("_r1"), sub("_rb", "_ra").alias("_r2"))
    both = p.withColumns({"_kind": F.lit(0), "_r": F.col("_r1")}).unionByName(p.withColumns({"_kind": F.lit(1), "_r": F.col("_r2")}))
    schema = StructType([*p.select(*by).schema.fields, StructField("inv", LongType())])

    def counted(count):
        def one(pdf):
            import pandas as pd

            return pd.DataFrame({**{k: pdf[k].iloc[:1] for k in by}, "inv": pd.Series([count(pdf)], index=pdf.index[:1])})

        return one

    parts = both.groupBy(*by, "_kind", "_r").applyInPandas(counted(_inside), schema)
    cells = p.groupBy(*by, "_r1", "_r2").agg(F.sum("_w").alias("_w"))
    grid = cells.groupBy(*by).applyInPandas(counted(_between), schema)  # as many cells as the ranges make
    number = lambda c: F.col(c).cast("decimal(38,0)")
    named = lambda df, what: df.select(*by, F.lit(what).alias("what"), number("v").alias("v"))
    pairs = lambda df, c: df.select(*by, (number(c) * (number(c) - 1) / 2).alias("v"))
    ties = lambda *c: pairs(p.groupBy(*by, *c).agg(F.sum("_w").alias("_w")), "_w")
    every = [named(parts.withColumnRenamed("inv", "v"), "inv"), named(grid.withColumnRenamed("inv", "v"), "inv")]
    every += [named(df, what) for what, df in (("all", ties()), ("a", ties("_a")), ("b", ties("_b")), ("ab", ties("_a", "_b")))]
    of = lambda what: F.coalesce(F.sum(F.when(F.col("what") == what, F.col("v"))), F.lit(0)).cast("decimal(38,0)")
    t = reduce(lambda x, y: x.unionByName(y), every).groupBy(*by).agg(*[of(w).alias(w) for w in ("inv", "all", "a", "b", "ab")])
    s = F.col("all") - F.col("a") - F.col("b") + F.col("ab") - 2 * F.col("inv")
    return t.where(F.col("all") > 0).select(*by, s.cast("decimal(38,0)").alias("s"), (F.col("all") - F.col("a")).cast("decimal(38,0)").alias("x"), (F.col("all") - F.col("b")).cast("decimal(38,0)").alias("y"))


def kendall(rows: DataFrame, a: str, b: str, by: tuple[str, ...] = (), whole: int = 256, ranges: int = 32, few: bool = False) -> DataFrame:
    """by..., tau: Kendall's tau-b over the pairs of each group (plain tau without ties); null without two different values.

    Equal rows are counted first.  A group of up to ``whole`` different rows is one array, whose pairs are compared in
    place; of a larger one inversions are counted, in about a ``ranges``-th of its rows at a time.  Both give the same
    numbers.  ``few`` says that groups are small by their kind (members, meetings), so arrays do for all and the plan is
    one aggregation.  Rows with a null or NaN on either side are left out; groups without other rows are left out, too (without
    ``by`` there is one row whatever there is).
    """
    good = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double")))
    point = [F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")]
    fine = (F.col("x") > 0) & (F.col("y") > 0)
    d = lambda c: F.col(c).cast("double")
    tau = F.when(fine, d("s") / F.sqrt(F.when(fine, d("x") * d("y")))).alias("tau")
    if few:
        return _sums_in_place(good.select(*by, *point, F.lit(1).cast("long").alias("_w")), by).select(*by, tau)
    points = good.groupBy(*by, *point).agg(F.count("*").alias("_w"))
    at = F.array(*[F.lit(k / ranges) for k in range(1, ranges)])
    cuts = points.groupBy(*[F.col(k).alias(f"_by{n}") for n, k in enumerate(by)]).agg(F.count("*").alias("_n"), F.percentile_approx("_a", at, 1000).alias("_ca"), F.percentile_approx("_b", at, 1000).alias("_cb"))
    if by:
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_by{n}")) for n, k in enumerate(by)])
        sized = points.join(cuts, same).drop(*[f"_by{n}" for n in range(len(by))])
    else:
        sized = points.crossJoin(F.broadcast(cuts))  # one row
    small = _sums_in_place(sized.where(F.col("_n") <= whole), by)
    t = small.unionByName(_sums_by_ranges(sized.where(F.col("_n") > whole), by, ranges))
    if not by:  # arrays of nothing make a row as well
        t = t.agg(*[F.sum(c).alias(c) for c in ("s", "x", "y")])
    return t.select(*by, tau)


def permutation_p(n: int, tau: float) -> float:
    """Exact two-sided p-value of tau for n untied items: share of permutations at least as far from 0."""
    import math

    counts = [1]
    for m in range(2, n + 1):
        counts = [sum(counts[max(0, k - m + 1) : k + 1]) for k in range(len(counts) + m - 1)]
    pairs = n * (n - 1) // 2
    away = abs(tau) * pairs
    return min(1.0, sum(c for k, c in enumerate(counts) if abs(pairs - 2 * k) >= away - 1e-9) / math.factorial(n))


def two_sided_p(rows: DataFrame, tau: str = "tau", n: str = "n") -> DataFrame:
    """``rows`` with ``p``: the exact permutation p-value of each (tau, n); for the few rows of a result table."""

    @F.udf("double")
    def p_of(value, items):
        return None if value is None else permutation_p(int(items), float(value))

    return rows.withColumn("p", p_of(F.col(tau), F.col(n)))


def ranged(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` written once, sorted by ranges of ``order``; ``_place`` is the range (above bit 33) and the place in it."""
    from loomwright.sources.shared import stored

    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()), "ranged")


def running_before(rows: DataFrame, order: str, *sums: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``before_<c>``: the sum of each column over the rows of the same ``by`` that come earlier in ``order`` (no ties).

    Ranges are summed in parallel; what earlier ranges hold is a table of one row a range and key.
    """
    placed = ranged(rows, *by, order).withColumn("_part", F.shiftright("_place", 33))
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_all_{c}") for c in sums])
    whole = whole.select(*by, "_part", *[F.coalesce(F.sum(f"_all_{c}").over(upto), F.lit(0)).alias(f"_all_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(whole if by else F.broadcast(whole), [*by, "_part"])  # without keys, one row a range
    return out.select(*rows.columns, *[(F.col(f"_all_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in sums])


def auc(rows: DataFrame, score: str, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., auc by the rank sum; tied scores rank positives first, not averaged; null if a class is absent.

    Rows are counted by score first; a positive is above the negatives of lower scores.
    """
    count = lambda v: F.sum(F.when(F.col(label) == v, 1).otherwise(0)).cast("long")
    by_score = rows.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(count(1).alias("pos"), count(0).alias("neg"))
    r = running_before(by_score, "s", "neg", by=by)
    p, n = F.sum("pos"), F.sum("neg")
    return r.groupBy(*by).agg(F.when((p > 0) & (n > 0), F.sum(F.col("pos") * F.col("before_neg")) / F.when((p > 0) & (n > 0), p * n)).alias("auc"))


def as_of(left: DataFrame, series: DataFrame, on: str, date: str = "date", value: str = "value", out: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
    """left with ``out``: the series' value at its greatest date <= left's ``on``, else null; of equal dates the largest value.

    Dates are days, so what is sorted is the calendar: the distinct days of either side (of
    each key in ``by``), with a running last value.  Rows of ``left`` only look their day up.
    """
    key = [F.col(k) for k in by]
    asked = left.select(F.col(on).cast("date").alias("_t"), *key).where("_t is not null").distinct()
    known = series.where(F.col(value).isNotNull()).groupBy(F.col(date).cast("date").alias("_t"), *key).agg(F.max(F.col(value).cast("double")).alias("_v"))
    both = asked.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast("double")}).unionByName(known.withColumn("_side", F.lit(0)))
    w = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    found = found.select(F.col("_t").alias("_day"), *[F.col(k).alias(f"_by_{k}") for k in by], F.col("_found").alias("_value"))
    match = F.col(on).cast("date") == F.col("_day")
    for k in by:
        match = match & F.col(k).eqNullSafe(F.col(f"_by_{k}"))
    return left.join(found, match, "left").select(*[c for c in left.columns if c != out], F.col("_value").alias(out))


def sign_class(x: Column, band: Column | float) -> Column:
    """1 above the band, -1 below its negative, else 0."""
    return F.when(x > band, 1).when(x < -band, -1).otherwise(0)


def momentum(value: Column, order: str = "i", by: tuple[str, ...] = ()) -> Column:
    """A value less the mean of up to three before it; 0 for the first."""
    return F.coalesce(value - F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-3, -1)), F.lit(0.0))


def walk_forward(rows: DataFrame, x: str, y: str, start: int = 16, m: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds b0, b1, b2 and pred: least squares on the rows before each row, one or two features.

    Closed form from running covariances, null before ``start``; where the features are
    (nearly) collinear the first alone is used.  ``rows`` has an order ``i`` from 0, in each series of ``by``.
    """
    w = Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    c = lambda a, b: F.covar_pop(a, b).over(w)
    m = m or x
    sxx, smm, sxm, sxy, smy = c(x, x), c(m, m), c(x, m), c(x, y), c(m, y)
    det = sxx * smm - sxm * sxm
    full = (det > 1e-9 * sxx * smm) & F.lit(m != x)
    safe = F.when(full, det)
    one = F.when(sxx > 0, sxy / F.when(sxx > 0, sxx)).otherwise(0.0)
    b1 = F.when(full, (sxy * smm - smy * sxm) / safe).otherwise(one)
    b2 = F.when(full, (smy * sxx - sxy * sxm) / safe).otherwise(0.0)
    out = rows.withColumns({"b1": b1, "b2": b2})
    out = out.withColumn("b0", F.avg(y).over(w) - F.col("b1") * F.avg(x).over(w) - F.col("b2") * F.avg(m).over(w))
    ready = F.col("i") >= start
    return out.withColumn("pred", F.when(ready, F.col("b0") + F.col("b1") * F.col(x) + F.col("b2") * F.col(m)))


def dead_band(rows: DataFrame, x: str, y: str, m: str | None = None, start: int = 16, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., i, band, cls: the band in 0, 0.5, ..., 40 whose in-sample classes fit best (the smallest of
    equals), and the class of the prediction with it; 99 before ``start``."""
    fit = walk_forward(rows, x, y, start, m, by)
    mm = m or x
    now = fit.where(F.col("i") >= start).select(*by, F.col("i").alias("now"), "b0", "b1", "b2", "pred")
    past = rows.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("i").alias("then"), F.col(x).alias("_x"), F.col(mm).alias("_m"), F.signum(y).cast("int").alias("_s"))
    earlier = F.col("then") < F.col("now")
    for k in by:
        earlier = earlier & (F.col(k) == F.col(f"_{k}"))
    inner = now.join(past, earlier).withColumn("_fit", F.col("b0") + F.col("b1") * F.col("_x") + F.col("b2") * F.col("_m"))
    bands = rows.sparkSession.range(81).select((F.col("id") * 0.5).alias("band"))
    share = inner.crossJoin(F.broadcast(bands)).groupBy(*by, "now", "band").agg(F.avg((sign_class(F.col("_fit"), F.col("band")) == F.col("_s")).cast("int")).alias("hit"))
    best = share.withColumn("r", F.row_number().over(Window.partitionBy(*by, "now").orderBy(F.col("hit").desc(), "band"))).where("r = 1")
    picked = now.join(best, [*by, "now"]).select(*by, F.col("now").alias("i"), "band", sign_class(F.col("pred"), F.col("band")).alias("cls"))
    return rows.select(*by, "i").join(picked, [*by, "i"], "left").select(*by, "i", "band", F.coalesce("cls", F.lit(99)).alias("cls"))


def lead_lag(rows: DataFrame, a: str, b: str, low: int = -2, high: int = 8, few: bool = False) -> DataFrame:
    """shift, n, r, tau: Pearson and Kendall correlation of a[t] with b[t + shift]; null for fewer than three
    pairs.  Pairs with a null or NaN are left out; ``few`` as in kendall()."""
    shifts = rows.sparkSession.range(low, high + 1).select(F.col("id").alias("shift"))
    x = rows.select("i", F.col(a).alias("_a")).crossJoin(F.broadcast(shifts))
    y = rows.select(F.col("i").alias("j"), F.col(b).alias("_b"))
    j = x.join(y, F.col("j") == F.col("i") + F.col("shift")).where("_a is not null and _b is not null and not isnan(_a) and not isnan(_b)")
    r = j.groupBy("shift").agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("_a", "_b")).alias("r"))
    tau = kendall(j, "_a", "_b", ("shift",), few=few)
    return r.join(tau, "shift", "left").select("shift", "n", "r", F.when(F.col("n") >= 3, F.col("tau")).alias("tau"))
