"""Queries on time series, the calendar and committees; orders by month stand in for macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions.scalar import taylor_gap, vote_of
from loomwright.operators import committee as C
from loomwright.operators import statistics as S


def months(spark: SparkSession, d: str) -> DataFrame:
    """date (month start), value, i: average order price by month."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    m = o.groupBy(F.trunc("o_orderdate", "month").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"))
    return m.withColumn("i", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def panel(spark, d):
    """i, date, x (value in thousands), m (momentum), y (next month's change, rounded)."""
    p = months(spark, d).withColumn("x", F.col("value") / 1000)
    p = p.withColumn("m", S.momentum(F.col("x")))
    return p.withColumn("y", F.rint(F.coalesce(F.lead("x").over(Window.orderBy("i")) - F.col("x"), F.lit(0.0))))


def _days(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.round(F.avg("o_totalprice"), 6).alias("value"))


def _meetings(spark):
    """The 15th of each month from December 1994 to December 2001."""
    return spark.sql("SELECT explode(sequence(DATE'1994-12-15', DATE'2001-12-15', INTERVAL 1 MONTH)) AS date")


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def asof_value(spark, d):
    return S.as_of(_meetings(spark), months(spark, d), "date").select("date", "value")


def asof_offset(spark, d):
    m = _meetings(spark).withColumn("later", F.date_add("date", 8))
    return S.as_of(m, _days(spark, d), "later").select("date", "value")


def yoy_series(spark, d):
    """Per cent change of the latest month's value on the same month a year before (or that month's first)."""
    s = months(spark, d).select("date", "value")
    at = S.as_of(_meetings(spark), s.withColumn("k", F.datediff("date", F.lit("1970-01-01"))).select("date", F.col("k").cast("double").alias("value")), "date", out="k")
    at = at.withColumn("key", F.date_add(F.lit("1970-01-01").cast("date"), F.col("k").cast("int")))
    now = s.select(F.col("date").alias("key"), F.col("value").alias("now"))
    exact = s.select(F.col("date").alias("old"), F.col("value").alias("then"))
    first = s.groupBy(F.trunc("date", "month").alias("month")).agg(F.min_by("value", "date").alias("first"))
    j = at.join(now, "key", "left").join(exact, F.col("old") == F.add_months("key", -12), "left").join(first, F.col("month") == F.trunc(F.add_months("key", -12), "month"), "left")
    return j.select("date", F.round((F.try_divide("now", F.coalesce("then", "first")) - 1) * 100, 6).alias("yoy"))


def briefing(spark, d):
    """One row a meeting: as-of value, year-over-year change and a sentence; null where one is missing."""
    a = asof_value(spark, d).join(yoy_series(spark, d), "date")
    number = lambda c, digits: F.col(c).cast(f"decimal(18,{digits})").cast("string")  # noqa: E731  halves go up, as in SQL
    text = F.concat(F.lit("Conditions as of "), F.col("date").cast("string"), F.lit(": the level is "), number("value", 2), F.lit(", "), number("yoy", 1), F.lit("% over the year."))
    return a.select("date", "value", "yoy", F.when(F.col("value").isNotNull() & F.col("yoy").isNotNull(), text).alias("text"))


def decisions(spark, d):
    s = months(spark, d).select("date", (F.col("value") / 10000).alias("value"))
    m = _meetings(spark).select(F.date_add("date", 10).alias("date"))
    return C.decisions(m, s).select("date", _r("before"), _r("after"), "bps", "label")


def momentum(spark, d):
    w = Window.orderBy("i")
    return panel(spark, d).select("i", _r("m"), F.lag(F.signum("y").cast("int"), 1, 99).over(w).alias("prev"), F.signum("y").cast("int").alias("sign"))


def walkforward_ols1(spark, d):
    return S.walk_forward(panel(spark, d), "x", "y").where("i >= 16").select("i", F.round("pred", 4).alias("pred"))


def walkforward_ols2(spark, d):
    return S.walk_forward(panel(spark, d), "x", "y", m="m").where("i >= 16").select("i", F.round("pred", 4).alias("pred"))


def walkforward_class(spark, d):
    return S.dead_band(panel(spark, d), "x", "y").select("i", _r("band"), "cls")


def lead_lag(spark, d):
    return S.lead_lag(panel(spark, d), "m", "y", few=True).select("shift", "n", _r("r"), _r("tau"))


def lead_lag_level(spark, d):
    """The level of the monthly index against the level of another monthly series up to eight months on and two back."""
    level = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.trunc("l_shipdate", "month").alias("date")).agg(F.round(F.avg(F.col("l_quantity").cast("double")), 4).alias("level"))
    rows = months(spark, d).join(level, "date", "left")
    return S.lead_lag(rows, "value", "level", few=True).select("shift", "n", _r("r"), _r("tau"))


def kendall_tau_b(spark, d):
    return S.kendall(panel(spark, d).withColumn("yr", F.round(F.col("y"))), "x", "yr", few=True).select(_r("tau"))


def base_rate(spark, d):
    c = panel(spark, d).groupBy(F.signum("y").cast("int").alias("cls")).agg(F.count("*").alias("n"))
    return c.agg(F.round(F.max("n") / F.sum("n"), 6).alias("base_rate"), F.sum("n").alias("n"))


def baseline_accuracy(spark, d):
    """Share of right classes where a predictor has spoken, for rows from 24: persistence and walk-forward."""
    p = panel(spark, d)
    w = S.dead_band(p, "x", "y").select("i", "cls")
    j = p.join(w, "i").withColumn("prev", F.lag(F.signum("y").cast("int"), 1, 99).over(Window.orderBy("i"))).withColumn("s", F.signum("y").cast("int")).where("i >= 24")
    parts = [F.round(F.avg(F.when(F.col(c) != 99, (F.col(c) == F.col("s")).cast("int"))), 6).alias(n) for c, n in (("prev", "persistence"), ("cls", "walk_forward"))]
    return j.agg(*parts)


def separation(spark, d):
    """Mean of the index where the next change is up less that where it is down, and the correlation."""
    p = panel(spark, d)
    return p.agg(F.round(F.regr_intercept("y", "x"), 4).alias("intercept"), F.round(F.avg(F.when(F.col("y") > 0, F.col("x"))) - F.avg(F.when(F.col("y") < 0, F.col("x"))), 6).alias("sep"), F.round(F.when(F.count("*") >= 3, F.corr("x", "y")), 6).alias("r"), F.round(F.regr_slope("y", "x"), 6).alias("slope"))


def histogram(spark, d):
    """Densities over 13 bins of [-3, 3] of two samples, standardised together; the last bin is closed."""
    p = panel(spark, d).select("x", F.when(F.col("y") > 0, "up").otherwise("other").alias("sample"))
    stats = p.agg(F.avg("x").alias("mu"), F.stddev_pop("x").alias("sd"))
    z = p.crossJoin(F.broadcast(stats)).select("sample", ((F.col("x") - F.col("mu")) / (F.col("sd") + 1e-9)).alias("z")).where("z between -3 and 3")
    b = z.groupBy("sample", F.least(F.floor((F.col("z") + 3) / (6 / 13)), F.lit(12)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    n = b.groupBy("sample").agg(F.sum("n").alias("all"))
    return b.join(F.broadcast(n), "sample").select("sample", "bin", "n", F.round(F.col("n") / F.col("all") / (6 / 13), 6).alias("density"))  # two rows


def index_by_decision(spark, d):
    p = panel(spark, d).where("date >= DATE'1997-01-01'")
    return p.groupBy(F.signum("y").cast("int").alias("cls")).agg(F.count("*").alias("n"), F.round(F.percentile("x", F.lit(0.5)), 6).alias("median_x"))


def taylor(spark, d):
    p = panel(spark, d)
    return p.select("i", F.round(taylor_gap(F.col("m"), F.lit(4.0), F.col("x") / 100), 6).alias("gap"), F.round(F.log10("x"), 6).alias("log_x"))


def office_range_join(spark, d):
    dates = spark.sql("SELECT explode(sequence(DATE'2010-01-15', DATE'2026-06-15', INTERVAL 3 MONTH)) AS date")
    return C.roles(dates, C.offices(spark), C.rotation(spark))


def voting_roster(spark, d):
    dates = spark.sql("SELECT explode(sequence(DATE'2010-01-15', DATE'2026-06-15', INTERVAL 3 MONTH)) AS date")
    return C.sitting(C.roles(dates, C.offices(spark), C.rotation(spark)), voting_only=True)


def tau_orders(spark, d):
    """Kendall's tau-b of all orders' days and prices in thousands, by priority."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderpriority", F.unix_date(F.to_date("o_orderdate")).alias("day"), F.floor(F.col("o_totalprice") / 1000).alias("price"))
    return S.kendall(o, "day", "price", ("o_orderpriority",)).select("o_orderpriority", _r("tau", 9))


def orders_and_transit(spark, d):
    """Orders of each day and priority, and the orders that are being shipped on that day: from the first line's day to the last's."""
    o = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("date"), "o_orderpriority").agg(F.count("*").alias("orders"))
    line = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey").agg(F.min(F.to_date("l_shipdate")).alias("sent"), F.max(F.to_date("l_shipdate")).alias("done"), F.count("*").alias("lines"))
    spans = line.groupBy("sent", "done").agg(F.count("*").alias("shipping"), F.sum("lines").alias("lines"))
    met = C.interval_join(o.select("date").distinct(), spans, "date", "sent", "done")
    return o.join(met.groupBy("date").agg(F.sum("shipping").alias("shipping"), F.sum("lines").alias("lines")), "date").select("date", "o_orderpriority", "orders", "shipping", "lines")


def _activity(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("member"), F.to_date("ts").alias("posted"), "value", "event_type", "event_id")


def _weeks(spark):
    return spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-31', INTERVAL 5 DAY)) AS date")


def roster(spark, d):
    return C.roster(_activity(spark, d), _weeks(spark))


def committee_index(spark, d):
    """Mean over members of the mean of their values up to the meeting (days are summed first)."""
    day = _activity(spark, d).groupBy("member", "posted").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    j = day.join(F.broadcast(_weeks(spark)), F.col("posted") <= F.col("date")).groupBy("date", "member").agg((F.sum("s") / F.sum("n")).alias("v"), F.sum("n").alias("n"))
    return j.where("n >= 5").groupBy("date").agg(F.round(F.avg("v"), 6).alias("index"), F.count("*").alias("n_members"))


def modal_vote(spark, d):
    v = _activity(spark, d).withColumn("meeting", F.weekofyear("posted"))
    v = v.select("meeting", vote_of(F.concat(F.lit("I would "), F.element_at(F.array(F.lit("Hike."), F.lit("cut"), F.lit("wait")), (F.col("event_id") % 3 + 1).cast("int")))).alias("vote"), F.col("event_id").alias("pos"))
    return C.modal_vote(v)


def auc_rank(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars")
    j = spark.read.parquet(f"{d}/labels.parquet").join(docs, "doc_id")
    return S.auc(j.select("n_chars", "quality"), "n_chars", "quality").select(_r("auc"))


_MO = "mo AS (SELECT date, value, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT date_trunc('month', o_orderdate)::DATE AS date, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1))"
_PA = _MO + ", p0 AS (SELECT *, value / 1000 AS x FROM mo), p1 AS (SELECT *, coalesce(x - avg(x) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS m, lead(x) OVER (ORDER BY i) AS nx FROM p0), p AS (SELECT *, round_even(coalesce(nx - x, 0), 0) AS y FROM p1)"
_ME = "me AS (SELECT unnest(generate_series(DATE '1994-12-15', DATE '2001-12-15', INTERVAL 1 MONTH))::DATE AS date)"
_YOY = "k AS (SELECT me.date, mo.date AS key, mo.value AS now FROM me ASOF LEFT JOIN mo ON me.date >= mo.date), yy AS (SELECT k.date, round((now / o.value - 1) * 100, 6) AS yoy FROM k LEFT JOIN mo o ON o.date = (k.key - INTERVAL 12 MONTH)::DATE)"
_W = "WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_O1 = f"f AS (SELECT *, covar_pop(x, y) OVER w / nullif(covar_pop(x, x) OVER w, 0) AS b1, avg(x) OVER w AS ax, avg(y) OVER w AS ay FROM p {_W}), g AS (SELECT *, ay - b1 * ax AS b0 FROM f)"
_CLS = "CASE WHEN {v} > {b} THEN 1 WHEN {v} < -{b} THEN -1 ELSE 0 END"
_DB = _O1 + f", h AS (SELECT g.i AS now, band, avg(({_CLS.format(v='(g.b0 + g.b1 * q.x)', b='band')} = sign(q.y))::INT) AS hit FROM g JOIN p q ON q.i < g.i, (SELECT unnest(range(81)) * 0.5 AS band) WHERE g.i >= 16 GROUP BY ALL), bb AS (SELECT now, band FROM (SELECT *, row_number() OVER (PARTITION BY now ORDER BY hit DESC, band) AS r FROM h) WHERE r = 1), dc AS (SELECT g.i, bb.band, CASE WHEN bb.band IS NULL THEN 99 ELSE {_CLS.format(v='(b0 + b1 * x)', b='bb.band')} END AS cls FROM g LEFT JOIN bb ON bb.now = g.i)"
_OFF = "o0 AS (SELECT * FROM (VALUES " + ", ".join(f"('{m}', DATE '{s}', {repr(o) if o else 'NULL'})" for m, s, o in C.OFFICES) + ") t(member, start, office)), o AS (SELECT *, lead(start) OVER (PARTITION BY member ORDER BY start) AS stop FROM o0), rot AS (SELECT * FROM (VALUES " + ", ".join(f"('{b}', {m}, {r})" for b, m, r in C.ROTATION) + ") t(bank, md, rm))"
_ACT = "ev AS (SELECT 'u' || (user_id % 20) AS member, ts::DATE AS posted, value, event_id FROM events), wk AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 5 DAY))::DATE AS date)"

ORACLES = {
    "asof_value": f"WITH {_MO}, {_ME} SELECT me.date, mo.value FROM me ASOF LEFT JOIN mo ON me.date >= mo.date",
    "asof_offset": f"WITH {_ME}, dy AS (SELECT o_orderdate::DATE AS date, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1), l AS (SELECT date, date + 8 AS later FROM me) SELECT l.date, dy.value FROM l ASOF LEFT JOIN dy ON l.later >= dy.date",
    "yoy_series": f"WITH {_MO}, {_ME}, {_YOY} SELECT date, yoy FROM yy",
    "briefing": f"WITH {_MO}, {_ME}, {_YOY} SELECT k.date, k.now AS value, yy.yoy, CASE WHEN k.now IS NOT NULL AND yy.yoy IS NOT NULL THEN 'Conditions as of ' || k.date || ': the level is ' || k.now::DECIMAL(18,2) || ', ' || yy.yoy::DECIMAL(18,1) || '% over the year.' END AS text FROM k JOIN yy USING (date)",
    "decisions": f"WITH {_MO}, {_ME}, s AS (SELECT date, value / 10000 AS value FROM mo), mm AS (SELECT date + 10 AS date, date + 18 AS later FROM me), b AS (SELECT mm.date, mm.later, s.value AS before FROM mm ASOF LEFT JOIN s ON mm.date >= s.date), a AS (SELECT b.*, s.value AS a0 FROM b ASOF LEFT JOIN s ON b.later >= s.date), c AS (SELECT date, before, CASE WHEN (SELECT max(date) FROM s) > date THEN a0 END AS after FROM a), e AS (SELECT *, round_even((after - before) * 100, 0)::BIGINT AS bps FROM c) SELECT date, round(before, 6) AS before, round(after, 6) AS after, bps, CASE WHEN bps > 0 THEN 'hike' WHEN bps < 0 THEN 'cut' WHEN bps = 0 THEN 'hold' END AS label FROM e",
    "momentum": f"WITH {_PA} SELECT i, round(m, 6) AS m, lag(sign(y)::INT, 1, 99) OVER (ORDER BY i) AS prev, sign(y)::INT AS sign FROM p",
    "walkforward_ols1": f"WITH {_PA}, {_O1} SELECT i, round(b0 + b1 * x, 4) AS pred FROM g WHERE i >= 16",
    "walkforward_ols2": f"WITH {_PA}, c AS (SELECT *, covar_pop(x, x) OVER w AS sxx, covar_pop(m, m) OVER w AS smm, covar_pop(x, m) OVER w AS sxm, covar_pop(x, y) OVER w AS sxy, covar_pop(m, y) OVER w AS smy, avg(x) OVER w AS ax, avg(m) OVER w AS am, avg(y) OVER w AS ay FROM p {_W}), b AS (SELECT *, (sxy * smm - smy * sxm) / (sxx * smm - sxm * sxm) AS b1, (smy * sxx - sxy * sxm) / (sxx * smm - sxm * sxm) AS b2 FROM c WHERE i >= 16) SELECT i, round(ay - b1 * ax - b2 * am + b1 * x + b2 * m, 4) AS pred FROM b",
    "walkforward_class": f"WITH {_PA}, {_DB} SELECT i, round(band, 6)::DOUBLE AS band, cls::INT AS cls FROM dc",
    "lead_lag_level": f"WITH {_MO}, le AS (SELECT date_trunc('month', l_shipdate)::DATE AS date, round(avg(l_quantity::DOUBLE), 4) AS level FROM lineitem GROUP BY 1), p AS (SELECT i, value, level FROM mo LEFT JOIN le USING (date)), j AS (SELECT shift, a.i AS t, a.value AS m, b.level AS y FROM p a, (SELECT unnest(range(-2, 9)) AS shift) JOIN p b ON b.i = a.i + shift WHERE b.level IS NOT NULL), k AS (SELECT u.shift, sum(sign(u.m - v.m) * sign(u.y - v.y)) / sqrt(sum(abs(sign(u.m - v.m))) * sum(abs(sign(u.y - v.y)))) AS tau FROM j u JOIN j v ON u.shift = v.shift AND u.t < v.t GROUP BY u.shift) SELECT shift, count(*) AS n, round(corr(m, y), 6) AS r, round(any_value(tau), 6) AS tau FROM j JOIN k USING (shift) GROUP BY shift",
    "lead_lag": f"WITH {_PA}, j AS (SELECT shift, a.i AS t, a.m, b.y FROM p a, (SELECT unnest(range(-2, 9)) AS shift) JOIN p b ON b.i = a.i + shift), k AS (SELECT u.shift, sum(sign(u.m - v.m) * sign(u.y - v.y)) / sqrt(sum(abs(sign(u.m - v.m))) * sum(abs(sign(u.y - v.y)))) AS tau FROM j u JOIN j v ON u.shift = v.shift AND u.t < v.t GROUP BY u.shift) SELECT shift, count(*) AS n, round(corr(m, y), 6) AS r, round(any_value(tau), 6) AS tau FROM j JOIN k USING (shift) GROUP BY shift",
    "kendall_tau_b": f"WITH {_PA} SELECT round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / sqrt(sum(abs(sign(a.x - b.x))) * sum(abs(sign(a.y - b.y)))), 6) AS tau FROM p a JOIN p b ON a.i < b.i",
    "base_rate": f"WITH {_PA}, c AS (SELECT sign(y) AS cls, count(*) AS n FROM p GROUP BY 1) SELECT round(max(n) / sum(n), 6) AS base_rate, sum(n)::BIGINT AS n FROM c",
    "baseline_accuracy": f"WITH {_PA}, {_DB}, j AS (SELECT i, cls, lag(sign(y)::INT, 1, 99) OVER (ORDER BY i) AS prev, sign(y) AS s FROM p JOIN dc USING (i)) SELECT round(avg((prev = s)::INT) FILTER (prev <> 99), 6) AS persistence, round(avg((cls = s)::INT) FILTER (cls <> 99), 6) AS walk_forward FROM j WHERE i >= 24",
    "separation": f"WITH {_PA} SELECT round(regr_intercept(y, x), 4) AS intercept, round(avg(x) FILTER (y > 0) - avg(x) FILTER (y < 0), 6) AS sep, round(corr(x, y), 6) AS r, round(regr_slope(y, x), 6) AS slope FROM p",
    "histogram": f"WITH {_PA}, z AS (SELECT CASE WHEN y > 0 THEN 'up' ELSE 'other' END AS sample, (x - avg(x) OVER ()) / (stddev_pop(x) OVER () + 1e-9) AS z FROM p), b AS (SELECT sample, least(floor((z + 3) / (6.0::DOUBLE / 13)), 12)::BIGINT AS bin, count(*) AS n FROM z WHERE z BETWEEN -3 AND 3 GROUP BY ALL) SELECT sample, bin, n, round(n / (sum(n) OVER (PARTITION BY sample)) / (6.0::DOUBLE / 13), 6) AS density FROM b",
    "index_by_decision": f"WITH {_PA} SELECT sign(y)::INT AS cls, count(*) AS n, round(quantile_cont(x, 0.5), 6) AS median_x FROM p WHERE date >= DATE '1997-01-01' GROUP BY 1",
    "taylor": f"WITH {_PA} SELECT i, round(2 + m + 0.5 * (m - 2) - (4.0 - 4.4) - x / 100, 6) AS gap, round(log10(x), 6) AS log_x FROM p",
    "office_range_join": f"WITH {_OFF}, dt AS (SELECT unnest(generate_series(DATE '2010-01-15', DATE '2026-06-15', INTERVAL 3 MONTH))::DATE AS date), mb AS (SELECT DISTINCT member FROM o), h AS (SELECT mb.member, dt.date, office FROM dt CROSS JOIN mb LEFT JOIN o ON o.member = mb.member AND start <= dt.date AND (stop IS NULL OR dt.date < stop)) SELECT member, date, office, coalesce(office IN ('governor', 'chair', 'pres:NY'), false) OR coalesce(year(date) % md = rm, false) AS is_voting, coalesce(office = 'chair', false) AS is_chair FROM h LEFT JOIN rot ON 'pres:' || bank = office",
    "tau_orders": "WITH p AS (SELECT o_orderpriority, o_orderdate::DATE - DATE '1970-01-01' AS day, floor(o_totalprice / 1000) AS price, row_number() OVER () AS i FROM orders) SELECT x.o_orderpriority, round(sum(sign(x.day - y.day) * sign(x.price - y.price)) / (sqrt(sum(abs(sign(x.day - y.day)))) * sqrt(sum(abs(sign(x.price - y.price))))), 9) AS tau FROM p x JOIN p y ON x.o_orderpriority = y.o_orderpriority AND x.i < y.i GROUP BY 1",
    "orders_and_transit": "WITH o AS (SELECT o_orderdate::DATE AS date, o_orderpriority, count(*) AS orders FROM orders GROUP BY ALL), l AS (SELECT min(l_shipdate::DATE) AS sent, max(l_shipdate::DATE) AS done, count(*) AS lines FROM lineitem GROUP BY l_orderkey), s AS (SELECT sent, done, count(*) AS shipping, sum(lines) AS lines FROM l GROUP BY ALL) SELECT date, o_orderpriority, orders, sum(shipping)::BIGINT AS shipping, sum(lines)::BIGINT AS lines FROM o JOIN s ON sent <= date AND date < done GROUP BY ALL",
    "voting_roster": f"WITH {_OFF}, dt AS (SELECT unnest(generate_series(DATE '2010-01-15', DATE '2026-06-15', INTERVAL 3 MONTH))::DATE AS date) SELECT member, date, office FROM dt JOIN o ON start <= dt.date AND (stop IS NULL OR dt.date < stop) LEFT JOIN rot ON 'pres:' || bank = office WHERE office IS NOT NULL AND (office IN ('governor', 'chair', 'pres:NY') OR coalesce(year(date) % md = rm, false))",
    "roster": f"WITH {_ACT} SELECT date, member, count(*)::BIGINT AS n FROM ev JOIN wk ON posted <= date GROUP BY ALL HAVING count(*) >= 5",
    "committee_index": f"WITH {_ACT}, v AS (SELECT date, member, avg(value) AS v FROM ev JOIN wk ON posted <= date GROUP BY ALL HAVING count(value) >= 5) SELECT date, round(avg(v), 6) AS \"index\", count(*) AS n_members FROM v GROUP BY date",
    "modal_vote": f"WITH {_ACT}, c AS (SELECT weekofyear(posted)::INT AS meeting, CASE event_id % 3 WHEN 0 THEN 'hike' WHEN 1 THEN 'cut' ELSE 'hold' END AS vote, count(*) AS n, min(event_id) AS f FROM ev GROUP BY ALL) SELECT meeting, vote, n FROM (SELECT *, row_number() OVER (PARTITION BY meeting ORDER BY n DESC, f) AS r FROM c) WHERE r = 1",
    "auc_rank": "WITH r AS (SELECT quality AS y, row_number() OVER (ORDER BY n_chars, quality DESC) AS r FROM labels JOIN documents USING (doc_id)) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r",
}
QUERIES = {name: globals()[name] for name in ORACLES}
