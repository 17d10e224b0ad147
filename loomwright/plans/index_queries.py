"""Queries on committees over time: conditions, as-of retrieval and answers, votes, accuracy, sweeps.

Vectors stand for chunks, dated by the order of their number twenty years on; labels
stand for ten members of the office table; orders by priority stand for macro series;
deterministic providers that stay in the plan stand for the models.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.operators import committee as C
from loomwright.operators import personas as P
from loomwright.operators import retrieval as R
from loomwright.operators import statistics as S
from loomwright.plans.series_queries import _OFF
from loomwright.sources.shared import stored

BETAS, TAUS, EVAL, WARM_UP = (0.0, 0.6, 1.5), (1.0, 2.0, 4.0), "2019-01-01", 16
#: Without a weight of recency its decay doesn't matter.
SETTINGS = [(b, t) for b in BETAS for t in TAUS if b or t == 2.0]
SETTING = ("beta", "tau")
NAMES = tuple(dict.fromkeys(m for m, _, _ in C.OFFICES))[:10]
SERIES = {"cpi": "1-URGENT", "core_pce": "2-HIGH", "unrate": "3-MEDIUM"}


def _orders(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet")


def chunks(spark, d, text: bool = False):
    """chunk_id, member, embedding, posted, and the text of the document of that number."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("label is not null").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("member"), "embedding")
    e = e.join(_orders(spark, d).select(F.col("o_orderkey").alias("chunk_id"), F.add_months("o_orderdate", 240).alias("posted")), "chunk_id")
    return e.join(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("chunk_id"), "text"), "chunk_id", "left") if text else e


def battery(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id < 15").select(F.col("vec_id").alias("query_idx"), F.col("embedding").alias("q"))
    return e.join(spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_idx"), F.coalesce("text", F.lit("")).alias("question")), "query_idx")


def meetings(spark):
    """The 25th of each month from December 2014 to December 2021."""
    return spark.sql("SELECT explode(sequence(DATE'2014-12-25', DATE'2021-12-25', INTERVAL 1 MONTH)) AS date")


def macro_long(spark, d):
    """series, date, value: four monthly series in one long table."""
    month = F.add_months(F.trunc("o_orderdate", "month"), 240).alias("date")
    name = F.coalesce(*[F.when(F.col("o_orderpriority") == v, k) for k, v in SERIES.items()])
    part = _orders(spark, d).groupBy(name.alias("series"), month).agg(F.sum("o_totalprice").alias("s"), F.count("o_totalprice").alias("n"))
    value = F.round(F.sum("s") / F.sum("n") / 10000, 6).alias("value")
    return part.where("series is not null").groupBy("series", "date").agg(value).unionByName(part.groupBy(F.lit("target").alias("series"), "date").agg(value))


def _asof(spark, series, names, out="value", value="value"):
    asked = meetings(spark).crossJoin(F.broadcast(spark.createDataFrame([(n,) for n in names], "series string")))
    return S.as_of(asked, series, "date", value=value, out=out, by=("series",))


def conditions(spark, d):
    """date, cpi_yoy, core_pce_yoy, unrate, target, briefing: what is known on each meeting's day; null where one is missing."""
    s = macro_long(spark, d)
    key = _asof(spark, s.withColumn("k", F.unix_date("date").cast("double")), ("cpi", "core_pce"), "k", "k").withColumn("key", F.date_from_unix_date(F.col("k").cast("int")))
    now, then = s.select("series", F.col("date").alias("key"), F.col("value").alias("now")), s.select("series", F.add_months("date", 12).alias("key"), F.col("value").alias("then"))
    yoy = key.join(now, ["series", "key"], "left").join(then, ["series", "key"], "left").select("date", F.concat("series", F.lit("_yoy")).alias("series"), F.round((F.try_divide("now", "then") - 1) * 100, 6).alias("value"))
    wide = yoy.unionByName(_asof(spark, s, ("unrate", "target")).select("date", "series", "value"))
    names = ("cpi_yoy", "core_pce_yoy", "unrate", "target")
    wide = wide.groupBy("date").agg(*[F.max(F.when(F.col("series") == n, F.col("value"))).alias(n) for n in names])
    text = F.format_string("Conditions as of %s: prices rise %.1f%%, core prices %.1f%%, unemployment is %.1f%%, the target %.2f%%.", F.col("date").cast("string"), *names)
    return wide.withColumn("briefing", F.when(reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names]), text))


def decided(spark, d):
    """date, before, after, bps, label of the meetings whose decision is known."""
    target = macro_long(spark, d).where("series = 'target'")
    return C.decisions(meetings(spark), target).where("bps is not null")


def _rosters(spark, d):
    return C.roster(chunks(spark, d).select("member", "posted"), decided(spark, d).select("date"))


def _in_office(spark, d):
    """date, member, n of the roster members in office."""
    names = spark.createDataFrame([(f"m{k}", n) for k, n in enumerate(NAMES)], "member string, name string")
    held = C.roles(decided(spark, d).select("date"), C.offices(spark), C.rotation(spark)).where("office is not null").select(F.col("member").alias("name"), "date")
    return _rosters(spark, d).join(F.broadcast(names), "member").join(held, ["name", "date"]).select("date", "member", "n")


def _axis(spark, d):
    anchors = spark.read.parquet(f"{d}/benchmark.parquet").select(F.when(F.col("item_id") % 2 == 0, "high").otherwise("low").alias("pole"), "text")
    return R.axis(P.with_vectors(anchors, P.DigestVectors()))


def _index(spark, d, conditioned, top=None):
    answers = P.respond_at(chunks(spark, d, True), _in_office(spark, d), battery(spark, d), P.FirstStatement(), briefings=conditions(spark, d) if conditioned else None, top=top)
    return P.committee_index(answers, P.DigestVectors(), _axis(spark, d))


def _r(c, n=6):
    return F.round(F.col(c), n).alias(c)


def index_conditioned(spark, d):
    return _index(spark, d, True).select("date", _r("index"), "n_members")


def index_static(spark, d):
    return _index(spark, d, False).select("date", _r("index"), "n_members")


def macro_conditions(spark, d):
    return conditions(spark, d)


def _retrieved(spark, d):
    ax = R.axis(spark.read.parquet(f"{d}/embeddings.parquet").select(F.when(F.col("label") < 5, "high").otherwise("low").alias("pole"), "embedding"))
    rows = R.scored(R.on_axis(chunks(spark, d), ax), battery(spark, d).select("query_idx", "q")).select("query_idx", "member", "chunk_id", "posted", "rel", "on_axis")
    top = R.expanding_top_k(rows, decided(spark, d).select("date"), 3)
    each = top.groupBy("date", "member", "query_idx").agg(F.avg("on_axis").alias("p")).groupBy("date", "member").agg(F.avg("p").alias("p"))
    return each.join(_rosters(spark, d), ["date", "member"]).groupBy("date").agg(F.avg("p").alias("index"), F.count("*").alias("n_members"))


def index_retrieved(spark, d):
    """The control without generation: positions of what is retrieved, for the whole roster."""
    return _retrieved(spark, d).select("date", _r("index"), "n_members")


def _votes(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 15")
    question = e.select(F.lit(0).cast("long").alias("query_idx"), F.lit("How would you vote?").alias("question"), F.col("embedding").alias("q"))
    return P.vote_at(chunks(spark, d, True), _in_office(spark, d), question, P.DigestVotes(), conditions(spark, d))


def direct_vote(spark, d):
    """The committee's modal vote; of equals the one met first, members with most chunks first."""
    v = _votes(spark, d).withColumn("pos", F.row_number().over(Window.partitionBy("date").orderBy(F.col("n").desc(), "member")))
    return C.modal_vote(v.withColumnRenamed("date", "meeting")).withColumnRenamed("meeting", "date")


def persona_answers(spark, d):
    """Every member's answer to every question, from all its chunks; one member has none."""
    members = chunks(spark, d).select("member").distinct().unionByName(spark.createDataFrame([("nobody",)], "member string"))
    return P.respond(chunks(spark, d, True), members, battery(spark, d), P.FirstStatement(), prompt=P.index_prompt)


def persona_answers_alone(spark, d):
    """As persona_answers with k = 0: nothing is retrieved, so the stand-in fails and every answer is empty."""
    a = P.respond(chunks(spark, d, True), chunks(spark, d).select("member").distinct(), battery(spark, d), P.FirstStatement(), k=0, prompt=P.index_prompt)
    return a.groupBy("member").agg(F.count("*").alias("asked"), F.count_if(F.length("response") > 0).alias("answered"))


def _sweep(spark, d, k=3):
    """beta, tau, date, index, n_members: the conditioned index for each setting, from one retrieval."""
    rows = R.scored(chunks(spark, d), battery(spark, d).select("query_idx", "q")).select("query_idx", "member", "chunk_id", "posted", "rel")
    top = R.expanding_top_k_weighted(rows, decided(spark, d).select("date"), k, SETTINGS)
    settings = spark.createDataFrame([(float(b), float(t)) for b, t in SETTINGS], "beta double, tau double")
    answers = P.respond_at(chunks(spark, d, True), _in_office(spark, d), battery(spark, d), P.FirstStatement(), briefings=conditions(spark, d), top=top, settings=settings)
    return P.committee_index(answers, P.DigestVectors(), _axis(spark, d), SETTING)


def _panel(spark, d, index, name="index", by=()):
    """by..., i, date, x, m, bps of the meetings that have an index and decision: a row a meeting, written once, as
    the measures read it several times."""
    w = Window.partitionBy(*by).orderBy("date")
    p = index.join(decided(spark, d).select("date", F.col("bps").cast("double").alias("bps")), "date")
    p = p.select(*by, "date", F.round(name, 9).alias("x"), "bps", (F.row_number().over(w) - 1).cast("long").alias("i"))
    return stored(p.withColumn("m", S.momentum(F.col("x"), by=by)), "panel")


def _accuracy(panel, two=True, by=()):
    """by..., n, accuracy of the walk-forward classes in the evaluation window."""
    c = S.dead_band(panel, "x", "bps", "m" if two else None, WARM_UP, by).select(*by, "i", "cls").join(panel, [*by, "i"])
    good = (F.col("date") >= F.lit(EVAL).cast("date")) & (F.col("cls") != 99)
    return c.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.when(good, (F.col("cls") == F.signum("bps").cast("int")).cast("double"))).alias("accuracy"))


def retrieval_sweep(spark, d):
    """Accuracy of the conditioned index by the weight of recency and its decay."""
    return _accuracy(_panel(spark, d, _sweep(spark, d), by=SETTING), by=SETTING).select(*SETTING, "n", _r("accuracy"))


def accuracy_table(spark, d):
    """Accuracy of the predictors in the evaluation window, and the base rate."""
    cond = conditions(spark, d).where("briefing is not null")
    gap = 2 + F.col("core_pce_yoy") + 0.5 * (F.col("core_pce_yoy") - 2) - (F.col("unrate") - 4.4) - F.col("target")
    frames = {
        "taylor": _accuracy(_panel(spark, d, cond.withColumn("index", gap)), False),
        "retrieved": _accuracy(_panel(spark, d, _retrieved(spark, d))),
        "static": _accuracy(_panel(spark, d, _index(spark, d, False))),
        "conditioned": _accuracy(_panel(spark, d, _index(spark, d, True))),
    }
    p = _panel(spark, d, decided(spark, d).withColumn("index", F.lit(0.0)).select("date", "index")).withColumn("y", F.signum("bps").cast("int"))
    late = F.col("date") >= F.lit(EVAL).cast("date")
    share = lambda c: F.avg(F.when(late & (F.col("i") >= WARM_UP), c.cast("double")))
    one = lambda c: p.agg(F.count("*").alias("n"), c.alias("accuracy"))
    frames["chance"] = one(share(F.col("y") == 0))
    frames["base rate"] = one(F.greatest(*[share(F.col("y") == v) for v in (-1, 0, 1)]))
    p = p.withColumn("prev", F.lag("y", 1, 99).over(Window.orderBy("i")))
    frames["persistence"] = p.agg(F.count("*").alias("n"), F.avg(F.when(late & (F.col("prev") != 99), (F.col("prev") == F.col("y")).cast("double"))).alias("accuracy"))
    v = direct_vote(spark, d).select("date", F.when(F.col("vote") == "hike", 1).when(F.col("vote") == "cut", -1).otherwise(0).alias("v"))
    v = p.join(v, "date", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    frames["direct"] = v.agg(F.count("*").alias("n"), F.avg(F.when(late, (F.col("v") == F.col("y")).cast("double"))).alias("accuracy"))
    rows = [f.withColumn("predictor", F.lit(k)) for k, f in frames.items()]
    return reduce(lambda a, b: a.unionByName(b), rows).select("predictor", "n", _r("accuracy"))


def sensitivity(spark, d, least=40):
    """Ten measures of the conditioned index by the weight of recency and its decay; settings with fewer than ``least``
    meetings are left out."""
    target = _asof(spark, macro_long(spark, d), ("target",)).select("date", F.col("value").alias("target"))
    p = _panel(spark, d, _sweep(spark, d), by=SETTING).join(target, "date")
    w = S.walk_forward(p, "x", "bps", WARM_UP, "m", SETTING).withColumn("late", F.col("date") >= F.lit(EVAL).cast("date"))
    e = F.col("late")
    corr = lambda x, y, c: F.when(F.count_if(c & F.col(x).isNotNull() & F.col(y).isNotNull()) >= 3, F.corr(F.when(c, F.col(x)), F.when(c, F.col(y))))
    up, down = F.avg(F.when(e & (F.col("bps") > 0), F.col("x"))), F.avg(F.when(e & (F.col("bps") < 0), F.col("x")))
    rows = w.groupBy(*SETTING).agg(F.count("*").alias("n"), corr("pred", "bps", e).alias("r_pred"), corr("x", "bps", e).alias("r_idx"), (up - down).alias("sep"), corr("x", "target", F.lit(True)).alias("r_tgt"))
    late = w.where("late").select(*SETTING, F.col("x"), (-F.col("x")).alias("neg"), (F.col("bps") > 0).cast("int").alias("hike"), (F.col("bps") < 0).cast("int").alias("cut"))
    auc = lambda x, y: S.auc(late, x, y, SETTING).withColumnRenamed("auc", f"auc_{y}")
    renamed = p.withColumnRenamed("tau", "decay")
    tau = lambda y, c: S.kendall(renamed, "x", y, ("beta", "decay"), few=True).withColumnsRenamed({"tau": c, "decay": "tau"})
    for one in (auc("x", "hike"), auc("neg", "cut"), tau("target", "tau_tgt"), tau("bps", "tau_bps"), _accuracy(p.drop("target"), by=SETTING).select(*SETTING, F.col("accuracy").alias("acc3"))):
        rows = rows.join(one, list(SETTING), "left")
    return rows.where(F.col("n") >= least).select(*SETTING, "n", *[_r(c) for c in ("acc3", "r_pred", "r_idx", "auc_hike", "auc_cut", "sep", "r_tgt", "tau_tgt", "tau_bps")])


def completions(spark, d):
    """Continuations of held-out quotes, and how many words both sides have left to compare."""
    c = chunks(spark, d, True).withColumnRenamed("text", "quote").withColumn("text", F.col("quote"))
    pool, test = P.held_out(c, 10)
    q = P.with_vectors(pool.select("chunk_id", "member", "text", "quote"), P.DigestVectors())
    done = P.complete_seeded(q, test, P.FirstStatement(), 2, vectors=P.DigestVectors())
    return P.matched(done).select("member", "chunk_id", "generated", "real")


def completion_taus(spark, d):
    """Detectability of the completions, and the floor of real against real."""
    c = chunks(spark, d, True).withColumnRenamed("text", "quote").withColumn("text", F.col("quote"))
    pool, test = P.held_out(c, 40)
    q = P.with_vectors(pool.select("chunk_id", "member", "text", "quote"), P.DigestVectors())
    done = P.complete_seeded(q, test, P.FirstStatement(), 2, vectors=P.DigestVectors())
    return P.detect_taus(done, P.DigestVectors()).select("member", "n", _r("tau"), _r("floor"))


# --- oracles -------------------------------------------------------------------------------

_VEC = "list_transform(range(1, 33), lambda i: (instr('0123456789abcdef', substr(md5({t}), i, 1)) - 8.5)::DOUBLE)"
_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_HEAD = "array_to_string(regexp_split_to_array(trim({t}), '\\s+')[1:{n}], ' ')"
_ME = "me AS (SELECT unnest(generate_series(DATE '2014-12-25', DATE '2021-12-25', INTERVAL 1 MONTH))::DATE AS date)"
_CASE = "CASE o_orderpriority " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in SERIES.items()) + " END"
_LM = f"lm AS (SELECT series, date, round(avg(o_totalprice) / 10000, 6) AS value FROM (SELECT unnest([{_CASE}, 'target']) AS series, (date_trunc('month', o_orderdate) + INTERVAL 240 MONTH)::DATE AS date, o_totalprice FROM orders) WHERE series IS NOT NULL GROUP BY ALL)"
_CO = """ck AS (SELECT a.date, a.series, l.date AS key, l.value FROM (SELECT date, unnest(['cpi', 'core_pce', 'unrate', 'target']) AS series FROM me) a ASOF LEFT JOIN lm l ON a.series = l.series AND a.date >= l.date),
 cw AS (SELECT ck.date, ck.series, ck.value, round((ck.value / o.value - 1) * 100, 6) AS yoy FROM ck LEFT JOIN lm o ON o.series = ck.series AND o.date = (ck.key - INTERVAL 12 MONTH)::DATE),
 cx AS (SELECT date, max(yoy) FILTER (series = 'cpi') AS cpi_yoy, max(yoy) FILTER (series = 'core_pce') AS core_pce_yoy, max(value) FILTER (series = 'unrate') AS unrate, max(value) FILTER (series = 'target') AS target FROM cw GROUP BY date),
 co AS (SELECT *, CASE WHEN cpi_yoy IS NOT NULL AND core_pce_yoy IS NOT NULL AND unrate IS NOT NULL AND target IS NOT NULL THEN printf('Conditions as of %s: prices rise %.1f%%, core prices %.1f%%, unemployment is %.1f%%, the target %.2f%%.', date::VARCHAR, cpi_yoy, core_pce_yoy, unrate, target) END AS briefing FROM cx)"""
_DE = "tg AS (SELECT date, value FROM lm WHERE series = 'target'), d0 AS (SELECT me.date, me.date + 8 AS later, tg.value AS before FROM me ASOF LEFT JOIN tg ON me.date >= tg.date), d1 AS (SELECT d0.date, before, tg.value AS after FROM d0 ASOF LEFT JOIN tg ON later >= tg.date), de AS (SELECT date, round_even((after - before) * 100, 0)::DOUBLE AS bps FROM d1 WHERE before IS NOT NULL AND after IS NOT NULL AND date < (SELECT max(date) FROM tg))"
_CH = "ch AS (SELECT vec_id AS chunk_id, 'm' || label AS member, label, embedding, (o_orderdate + INTERVAL 240 MONTH)::DATE AS posted, coalesce(text, '') AS text FROM embeddings JOIN orders ON o_orderkey = vec_id LEFT JOIN documents ON doc_id = vec_id WHERE label IS NOT NULL), ba AS (SELECT vec_id AS query_idx, embedding AS q FROM embeddings WHERE vec_id < 15)"
_SC = f"sc AS (SELECT query_idx, member, chunk_id, posted, text, {_DOT.format(a='embedding', b='q')} AS rel FROM ch, ba)"
_RO = "ro AS (SELECT date, member, count(*) AS n FROM ch JOIN de ON posted <= date GROUP BY ALL HAVING count(*) >= 5)"
_IN = _OFF + ", nm AS (SELECT * FROM (VALUES " + ", ".join(f"('m{k}', '{n}')" for k, n in enumerate(NAMES)) + ") t(member, name)), io AS (SELECT ro.* FROM ro JOIN nm USING (member) JOIN o ON o.member = nm.name AND o.start <= ro.date AND (o.stop IS NULL OR ro.date < o.stop) WHERE office IS NOT NULL)"
_AX = f"av AS (SELECT item_id % 2 AS low, {_VEC.format(t=chr(39) * 2 + ' || text')} AS v FROM benchmark), ad AS (SELECT pos, avg(x) FILTER (low = 0) - avg(x) FILTER (low = 1) AS d FROM (SELECT low, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM av) GROUP BY pos), ax AS (SELECT list(d / ((SELECT sqrt(sum(d * d)) FROM ad) + 1e-12) ORDER BY pos) AS u FROM ad)"
_BASE = ", ".join((_ME, _LM, _CO, _DE, _CH, _SC, _RO, _IN, _AX))


def _score(beta, k, tau=2.0):
    """Rows of the ranking at weight ``beta`` (None: relevance alone), as CTE tp{k}."""
    if beta is None:
        rows = "SELECT date, member, query_idx, chunk_id, text, rel AS score FROM sc JOIN de ON posted <= date"
    else:
        z = "CASE WHEN stddev_pop({x}) OVER w > 1e-9 THEN ({x} - avg({x}) OVER w) / (stddev_pop({x}) OVER w) ELSE 0 END"
        rows = f"SELECT date, member, query_idx, chunk_id, text, {z.format(x='rel')} + {beta} * {z.format(x='fresh')} AS score FROM (SELECT *, exp(-greatest((date - posted) / 365.25::DOUBLE, 0) / {tau}) AS fresh FROM sc JOIN de ON posted <= date) WINDOW w AS (PARTITION BY date, member, query_idx)"
    return f"tp{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date, member, query_idx ORDER BY score DESC, chunk_id) AS r FROM ({rows})) WHERE r <= 3)"


def _answer(head, text="text"):
    said = _HEAD.format(t=f"split_part({text}, chr(10), 1)", n=12)
    return f"trim(trim(trim(regexp_replace({head} || ' ' || {said}, '\\s+', ' ', 'g')), '\"“”'))"


_STATIC = "'Statements you have made:'"


def _index_sql(k, conditioned=True):
    """CTE ix{k}: date, index, n_members from the best-ranked rows of tp{k}."""
    head = f"coalesce({_HEAD.format(t='briefing', n=8)}, {_STATIC})" if conditioned else _STATIC
    place = _DOT.format(a=_VEC.format(t="reply"), b="(SELECT u FROM ax)")
    return f"an{k} AS (SELECT date, member, {_answer(head)} AS reply FROM tp{k} JOIN io USING (date, member) LEFT JOIN co USING (date) WHERE r = 1), ps{k} AS (SELECT date, member, avg({place}) AS p FROM an{k} GROUP BY ALL), ix{k} AS (SELECT date, avg(p) AS \"index\", count(*) AS n_members FROM ps{k} GROUP BY date)"


_CLS = "CASE WHEN {v} > {b} THEN 1 WHEN {v} < -{b} THEN -1 ELSE 0 END"
_BEFORE = "WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _panel_sql(k, source, name='"index"', two=True):
    """CTEs pa{k} (i, date, x, m, bps), fi{k} (with b0, b1, b2, pred) and cl{k} (with cls)."""
    full = "det > 1e-9 * sxx * smm" if two else "false"
    one = "CASE WHEN sxx > 0 THEN sxy / sxx ELSE 0 END"
    fit = f"b0 + b1 * q.x + b2 * q.m"
    return f"""pa{k} AS (SELECT *, coalesce(x - avg(x) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS m FROM (SELECT date, round({name}, 9) AS x, bps, row_number() OVER (ORDER BY date) - 1 AS i FROM {source} JOIN de USING (date))),
 cv{k} AS (SELECT *, covar_pop(x, x) OVER w AS sxx, covar_pop(m, m) OVER w AS smm, covar_pop(x, m) OVER w AS sxm, covar_pop(x, bps) OVER w AS sxy, covar_pop(m, bps) OVER w AS smy, avg(x) OVER w AS ax_, avg(m) OVER w AS am_, avg(bps) OVER w AS ay_ FROM pa{k} {_BEFORE}),
 dt{k} AS (SELECT *, sxx * smm - sxm * sxm AS det FROM cv{k}),
 bb{k} AS (SELECT *, CASE WHEN {full} THEN (sxy * smm - smy * sxm) / det ELSE {one} END AS b1, CASE WHEN {full} THEN (smy * sxx - sxy * sxm) / det ELSE 0 END AS b2 FROM dt{k}),
 fi{k} AS (SELECT *, ay_ - b1 * ax_ - b2 * am_ AS b0, CASE WHEN i >= {WARM_UP} THEN ay_ - b1 * ax_ - b2 * am_ + b1 * x + b2 * m END AS pred FROM bb{k}),
 hi{k} AS (SELECT g.i AS now, band, avg(({_CLS.format(v=f'({fit})', b='band')} = sign(q.bps))::INT) AS hit FROM fi{k} g JOIN pa{k} q ON q.i < g.i, (SELECT unnest(range(81)) * 0.5::DOUBLE AS band) WHERE g.i >= {WARM_UP} GROUP BY ALL),
 bd{k} AS (SELECT now, band FROM (SELECT *, row_number() OVER (PARTITION BY now ORDER BY hit DESC, band) AS r FROM hi{k}) WHERE r = 1),
 cl{k} AS (SELECT f.*, CASE WHEN band IS NULL THEN 99 ELSE {_CLS.format(v='pred', b='band')} END AS cls FROM fi{k} f LEFT JOIN bd{k} ON now = i)"""


def _acc_sql(k):
    return f"count(*) AS n, round(avg((cls = sign(bps))::INT) FILTER (date >= DATE '{EVAL}' AND cls <> 99), 6) AS accuracy FROM cl{k}"


def _tau_sql(k, a, b):
    return f"(SELECT round(sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b})) / sqrt(sum(abs(sign(x.{a} - y.{a}))) * sum(abs(sign(x.{b} - y.{b})))), 6) FROM pt{k} x JOIN pt{k} y ON x.i < y.i)"


def _auc_sql(k, x, y):
    late = f"FROM pt{k} WHERE date >= DATE '{EVAL}'"
    return f"(SELECT round(sum(p * before) / nullif(sum(p) * sum(n), 0), 6) FROM (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT {x} AS s, count(*) FILTER ({y}) AS p, count(*) FILTER (NOT {y}) AS n {late} GROUP BY 1)))"


def _sense_sql(k, beta, tau):
    late = f"FILTER (date >= DATE '{EVAL}')"
    return f"""SELECT {beta}::DOUBLE AS beta, {tau}::DOUBLE AS tau, count(*) AS n, (SELECT accuracy FROM (SELECT {_acc_sql(k)})) AS acc3, round(corr(pred, bps) {late}, 6) AS r_pred, round(corr(x, bps) {late}, 6) AS r_idx, {_auc_sql(k, 'x', 'bps > 0')} AS auc_hike, {_auc_sql(k, '-x', 'bps < 0')} AS auc_cut,
 round(avg(x) FILTER (date >= DATE '{EVAL}' AND bps > 0) - avg(x) FILTER (date >= DATE '{EVAL}' AND bps < 0), 6) AS sep, round(corr(x, target), 6) AS r_tgt, {_tau_sql(k, 'x', 'target')} AS tau_tgt, {_tau_sql(k, 'x', 'bps')} AS tau_bps FROM pt{k} HAVING count(*) >= 40"""


_PROJ = "pj AS (SELECT sc.*, list_dot_product(embedding::DOUBLE[], (SELECT u FROM eu)) AS p FROM sc JOIN (SELECT chunk_id, embedding FROM ch) USING (chunk_id))"
_EU = "ed AS (SELECT pos, avg(x) FILTER (label < 5) - avg(x) FILTER (coalesce(label >= 5, true)) AS d FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY pos), eu AS (SELECT list(d / ((SELECT sqrt(sum(d * d)) FROM ed) + 1e-12) ORDER BY pos) AS u FROM ed)"
_RET = f"{_EU}, {_PROJ}, rt AS (SELECT date, member, query_idx, avg(p) AS p FROM (SELECT date, pj.*, row_number() OVER (PARTITION BY date, member, query_idx ORDER BY rel DESC, chunk_id) AS r FROM pj JOIN de ON posted <= date) WHERE r <= 3 GROUP BY ALL), ixr AS (SELECT date, avg(p) AS \"index\", count(*) AS n_members FROM (SELECT date, member, avg(p) AS p FROM rt JOIN ro USING (date, member) GROUP BY ALL) GROUP BY date)"
_VOTE = f"vs AS (SELECT member, chunk_id, posted, text, {_DOT.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 15)')} AS rel FROM ch), vt AS (SELECT * FROM (SELECT date, vs.*, row_number() OVER (PARTITION BY date, member ORDER BY rel DESC, chunk_id) AS r FROM vs JOIN de ON posted <= date) WHERE r = 1), vv AS (SELECT date, member, io.n, ['hike', 'cut', 'hold'][instr('0123456789abcdef', substr(md5(split_part(text, chr(10), 1)), 1, 1)) % 3 + 1] AS vote FROM vt JOIN io USING (date, member)), vp AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY n DESC, member) AS pos FROM vv), vm AS (SELECT date, vote, n FROM (SELECT date, vote, count(*) AS n, row_number() OVER (PARTITION BY date ORDER BY count(*) DESC, min(pos)) AS r FROM vp GROUP BY date, vote) WHERE r = 1)"
_GAP = "gp AS (SELECT date, 2 + core_pce_yoy + 0.5 * (core_pce_yoy - 2) - (unrate - 4.4) - target AS gap FROM co WHERE briefing IS NOT NULL)"
_IX = "SELECT date, round(\"index\", 6) AS \"index\", n_members FROM ix{k}"


def _table_sql():
    parts = [_BASE, _RET, _VOTE, _GAP, _score(None, "c"), _index_sql("c"), _score(None, "s"), _index_sql("s", False)]
    parts += [_panel_sql("t", "gp", "gap", False), _panel_sql("r", "ixr"), _panel_sql("s", "ixs"), _panel_sql("c", "ixc")]
    parts.append("py AS (SELECT date, sign(bps) AS y, row_number() OVER (ORDER BY date) - 1 AS i, lag(sign(bps), 1, 99) OVER (ORDER BY date) AS prev FROM de), pv AS (SELECT py.*, CASE vote WHEN 'hike' THEN 1 WHEN 'cut' THEN -1 ELSE 0 END AS v FROM py LEFT JOIN vm USING (date))")
    late, oos = f"date >= DATE '{EVAL}'", f"FILTER (date >= DATE '{EVAL}' AND i >= {WARM_UP})"
    rows = [f"SELECT '{n}' AS predictor, {_acc_sql(k)}" for n, k in (("taylor", "t"), ("retrieved", "r"), ("static", "s"), ("conditioned", "c"))]
    rows.append(f"SELECT 'chance', count(*), round(avg((y = 0)::INT) {oos}, 6) FROM py")
    rows.append("SELECT 'base rate', count(*), round(greatest(" + ", ".join(f"avg((y = {v})::INT) {oos}" for v in (-1, 0, 1)) + "), 6) FROM py")
    rows.append(f"SELECT 'persistence', count(*), round(avg((prev = y)::INT) FILTER ({late} AND prev <> 99), 6) FROM py")
    rows.append(f"SELECT 'direct', count(*), round(avg((v = y)::INT) FILTER ({late}), 6) FROM pv")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(rows)


def _settings_sql(more=lambda k: ()):
    return [_BASE] + [x for k, (b, t) in enumerate(SETTINGS) for x in (_score(b, k, t), _index_sql(k), _panel_sql(k, f"ix{k}"), *more(k))]


def _sweep_sql():
    return "WITH " + ", ".join(_settings_sql()) + " " + " UNION ALL ".join(f"SELECT {b}::DOUBLE AS beta, {t}::DOUBLE AS tau, {_acc_sql(k)}" for k, (b, t) in enumerate(SETTINGS))


def _sensitivity_sql():
    parts = _settings_sql(lambda k: (f"pt{k} AS (SELECT f.*, cx.target FROM fi{k} f JOIN cx USING (date))",))
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(_sense_sql(k, b, t) for k, (b, t) in enumerate(SETTINGS))


ORACLES = {
    "macro_conditions": f"WITH {_ME}, {_LM}, {_CO} SELECT * FROM co",
    "index_conditioned": f"WITH {_BASE}, {_score(None, 0)}, {_index_sql(0)} {_IX.format(k=0)}",
    "index_static": f"WITH {_BASE}, {_score(None, 0)}, {_index_sql(0, False)} {_IX.format(k=0)}",
    "index_retrieved": f"WITH {_BASE}, {_RET} {_IX.format(k='r')}",
    "direct_vote": f"WITH {_BASE}, {_VOTE} SELECT * FROM vm",
    "persona_answers": f"WITH {_CH}, {_SC}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY member, query_idx ORDER BY rel DESC, chunk_id) AS r FROM sc) WHERE r = 1) SELECT member, query_idx, {_answer(_STATIC)} AS response FROM t UNION ALL SELECT 'nobody', query_idx, '' FROM ba",
    "persona_answers_alone": "SELECT 'm' || label AS member, 15::BIGINT AS asked, 0::BIGINT AS answered FROM embeddings JOIN orders ON o_orderkey = vec_id WHERE label IS NOT NULL GROUP BY label",
    "retrieval_sweep": _sweep_sql(),
    "accuracy_table": _table_sql(),
    "sensitivity": _sensitivity_sql(),
}
QUERIES = {n: globals()[n] for n in (*ORACLES, "completions", "completion_taus")}
