import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import scalar as T
from loomwright.operators import committee as C
from loomwright.operators import ingest as I
from loomwright.operators import likeness as L
from loomwright.operators import retrieval as R
from loomwright.operators import statistics as S
from loomwright.sources import pages, readers
from loomwright.streaming import incremental


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_themes_take_the_first_match(spark):
    assert one(spark, T.theme_of, "asset prices") == "Inflation & prices"
    assert one(spark, T.theme_of, "jobless") == "Employment & labor"
    assert one(spark, T.theme_of, "") == "Other" and one(spark, T.theme_of, None) == "Other"


def test_top_k_ties_nulls_and_nan(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", None), (4, "a", [float("nan"), 0.0])], "chunk_id long, member string, embedding array<float>")
    battery = spark.createDataFrame([(0, [1.0, 0.0])], "query_idx long, q array<float>")
    got = R.top_k(R.scored(rows, battery), 5).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 2, 4]


def test_weighted_with_beta_zero_orders_as_relevance(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, "a", 0, float(rng.random()), float(i)) for i in range(20)], "chunk_id long, member string, query_idx long, rel double, age double")
    a = [r["chunk_id"] for r in R.top_k(rows, 5).orderBy("rank").collect()]
    assert a == [r["chunk_id"] for r in R.top_k_weighted(rows, 5, 0.0, 2.0).orderBy("rank").collect()]
    assert R.top_k_weighted(rows.limit(1), 5, 0.6, 2.0).first()["score"] == 0.0


def test_as_of_before_hit_gap_after(spark):
    d = datetime.date
    series = spark.createDataFrame([(d(2020, 1, 10), 1.0), (d(2020, 2, 10), 2.0)], "date date, value double")
    left = spark.createDataFrame([(d(2020, 1, 1),), (d(2020, 1, 10),), (d(2020, 1, 20),), (d(2021, 1, 1),), (None,)], "date date")
    got = {r["date"]: r["value"] for r in S.as_of(left, series, "date").collect()}
    assert got == {d(2020, 1, 1): None, d(2020, 1, 10): 1.0, d(2020, 1, 20): 1.0, d(2021, 1, 1): 2.0, None: None}


def test_walk_forward_is_least_squares(spark):
    rng = np.random.default_rng(1)
    x, m, y = rng.random((3, 40))
    rows = spark.createDataFrame([(i, float(x[i]), float(m[i]), float(y[i])) for i in range(40)], "i long, x double, m double, y double")
    got = {r["i"]: r["pred"] for r in S.walk_forward(rows, "x", "y", 16, "m").collect()}
    for i in (16, 25, 39):
        b = np.linalg.lstsq(np.c_[np.ones(i), x[:i], m[:i]], y[:i], rcond=None)[0]
        assert math.isclose(got[i], b @ [1, x[i], m[i]], rel_tol=1e-8)
    assert got[15] is None


def test_permutation_p():
    assert math.isclose(S.permutation_p(3, 1.0), 2 / 6) and S.permutation_p(5, 0.0) == 1.0


def test_roles(spark):
    d = datetime.date
    dates = spark.createDataFrame([(d(2018, 2, 4),), (d(2018, 2, 5),), (d(2012, 6, 1),), (None,)], "date date")
    r = {(x["member"], x["date"]): x for x in C.roles(dates, C.offices(spark), C.rotation(spark)).collect()}
    assert r["Jerome H. Powell", d(2018, 2, 4)]["is_chair"] is False and r["Jerome H. Powell", d(2018, 2, 5)]["is_chair"] is True
    assert r["Kevin M. Warsh", d(2012, 6, 1)]["office"] is None and r["Kevin M. Warsh", None]["is_voting"] is None


def test_passages():
    assert I.split_passage("") == [] and I.split_passage(None) == [] and I.split_passage(" x ") == ["x"]
    long = "A" * 50 + ". " + "B" * 50 + "."
    assert I.split_passage("short\n\n" + long, 60) == ["short\n\n" + "A" * 50 + ".", "B" * 50 + "."]
    assert I.split_passage("C" * 100, 60) == ["C" * 100]
    paragraphs = ["a" * 20, "b" * 20, "c" * 20, "d" * 20]
    assert I.split_passage("\n\n".join(paragraphs), 50) == ["a" * 20 + "\n\n" + "b" * 20, "c" * 20 + "\n\n" + "d" * 20]


def test_passages_lose_no_word(spark):
    text = " ".join(f"Word{k} and more{'.' if k % 7 == 0 else ''}" for k in range(3000)) + "\n\n" + "tail. " * 2000
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = I.passages(docs).orderBy("pos").collect()
    assert {r["doc_id"] for r in got} == {1} and " ".join(r["passage"] for r in got).split() == text.split() and max(len(r["passage"]) for r in got) <= 6000


def test_numbered_ids_are_dense_on_many_wide_rows(spark, tmp_path):
    rows = spark.range(500_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 512).alias("a"), F.repeat(F.sha2((F.col("id") + 1).cast("string"), 512), 3).alias("b"))
    rows = rows.repartition(64, "k")
    stored = spark.createDataFrame([(41,)], "chunk_id long")
    got = I.numbered(rows, stored, ("a",))
    got.select("chunk_id", "a", "b").write.parquet(f"{tmp_path}/out")
    for frame in (spark.read.parquet(f"{tmp_path}/out"), got):
        x = frame.agg(F.count("chunk_id").alias("n"), F.count_distinct("chunk_id").alias("d"), F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high")).first()
        assert tuple(x) == (500_000, 500_000, 42, 500_041)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.alias("x").join(back.alias("y"), F.col("x.chunk_id") + 1 == F.col("y.chunk_id")).where("x.a > y.a").count() == 0


def test_numbered_takes_empty_sides_and_ties(spark):
    none = spark.createDataFrame([], "chunk_id long")
    rows = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y")], "k int, v string")
    assert sorted(r["chunk_id"] for r in I.numbered(rows, none, ("k",)).collect()) == [0, 1, 2]
    assert I.numbered(rows.limit(0), none, ("k",)).count() == 0


def test_turns_and_clean(spark):
    text = "CHAIR SMITH. Hello there.\n12\n3 of 20 January meeting\nMore\nMR. JONES. No.\nVICE CHAIR SMITH. Again CHAIR SMITH. inside"
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["body"] for r in I.turns(t, F.lit("Smith"), 5).orderBy("pos").collect()] == ["Hello there. More", "Again CHAIR SMITH. inside"]


def test_retry():
    calls = []

    def fail():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        I.Retry(3, sleep=lambda s: None)(fail)
    assert len(calls) == 3


def test_chair_turns(spark):
    text = "CHAIR SMITH. Good afternoon to all.\nSTEVE J. JONES. A question.\nCHAIR SMITH. An answer that\nPage 3 of the meeting\n17\ngoes on. NEIL said no.\nVICE CHAIR SMITHSON. Other."
    t = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r["body"] for r in I.chair_turns(t, F.lit("Smith"), 5).orderBy("pos").collect()] == ["Good afternoon to all.", "An answer that goes on. NEIL said no."]


def test_page_date(spark):
    for text, want in (("Held on June 5, 2020.", datetime.date(2020, 6, 5)), ("JUNE 31, 2020", None), ("x" * 1500 + "June 5, 2020", None), ("may 1 1999", datetime.date(1999, 5, 1)), (None, None)):
        assert one(spark, T.page_date, text) == want


def test_article_text():
    html = '<p>outside</p><div id="article"><p>One <b>two</b></p><div class="video"><p>play</p></div><p class="sr-only">help</p><p>Watch live now</p><p>We return to text later</p><p>Return to text</p><p>Note</p></div>'
    assert pages.article_text(html) == "One two\n\nWe return to text later" and pages.article_text(None) == ""
    assert pages.article_text('<p>a</p><main id="content"><p>b<p>c</p></main>') == "b\n\nc" and pages.article_text("<script>x</script><p>a &amp; b</p>") == "a & b"


def test_page_bodies():
    long = "words " * 100
    html = f"<nav><p>menu</p></nav><p>lead</p><article>{long}<b>end</b></article><div class='my-content-box'>short</div>"
    assert pages.body_text(html) == (long + "end").strip() and pages.body_text("<header><p>h</p></header><p>a\n b</p><p>c</p>") == "a b c"
    assert pages.rendered_text(f"<main><p>{long}</p><p>two</p></main><p>x</p>") == long.strip() + "\n\ntwo" and pages.rendered_text("<p>a</p><p></p><p>b</p>") == "a\n\nb"
    assert pages.body_text(None) == "" and pages.longer_of(None, "pdf") == "pdf"


def test_pages_as_a_table(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", 5), (2, None, None, 6)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"], r["text"]) for r in pages.texts(rows).collect()) == [(1, "a"), (2, "")]


def plain_tau(a, b):
    x, y = np.sign(np.subtract.outer(a, a)), np.sign(np.subtract.outer(b, b))
    n = np.abs(x).sum() * np.abs(y).sum()
    return float((x * y).sum() / math.sqrt(n)) if n else None


def test_inversions():
    r = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 17, 64, 65):
        rank, w = r.permutation(n), r.integers(1, 9, n)
        assert S.inversions(rank, w) == sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if rank[i] > rank[j])


def test_kendall_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 4.0), (None, 2.0), (float("nan"), 3.0)], "a double, b double")
    assert math.isclose(S.kendall(rows, "a", "b").first()["tau"], 2 / math.sqrt(6))
    assert S.kendall(rows.limit(1), "a", "b").first()["tau"] is None and S.kendall(rows.limit(0), "a", "b").first()["tau"] is None
    r = np.random.default_rng(9)
    groups = {"wide": (r.normal(size=700), r.normal(size=700)), "tied": (r.integers(0, 3, 700), r.normal(size=700)), "hot": (np.where(r.random(600) < 0.5, 1.0, r.normal(size=600)), np.where(r.random(600) < 0.6, 2.0, r.integers(0, 40, 600))), "flat": (np.ones(400), r.normal(size=400)), None: (np.arange(30.0), r.permutation(30)), "copies": (r.integers(0, 4, 900), r.integers(0, 4, 900))}
    groups["near"] = (groups["wide"][0], groups["wide"][0] + r.normal(size=700) * 0.1)
    table = [(g, float(x), float(y)) for g, (a, b) in groups.items() for x, y in zip(a, b, strict=True)]
    df = spark.createDataFrame(table, "g string, a double, b double").repartition(5)
    want = {g: plain_tau(np.asarray(a, float), np.asarray(b, float)) for g, (a, b) in groups.items()}
    for whole, ranges in ((256, 32), (5000, 32), (4, 3), (0, 1)):
        got = {x["g"]: x["tau"] for x in S.kendall(df, "a", "b", ("g",), whole, ranges).collect()}
        assert got.keys() == want.keys()
        for g, t in want.items():
            assert got[g] == t if t is None else math.isclose(got[g], t, abs_tol=1e-12), (g, whole)
    assert math.isclose(S.kendall(df.where("g = 'near'"), "a", "b").first()["tau"], want["near"])
    assert math.isclose(S.kendall(df.where("g = 'near'"), "a", "b", few=True).first()["tau"], want["near"])


def test_kendall_of_a_million_rows(spark):
    """b falls with a in blocks of 1,000: pairs inside a block are discordant, all others concordant."""
    n, block = 1_000_000, 1000
    df = spark.range(n).select(F.col("id").alias("a"), (F.floor(F.col("id") / block) * block + block - 1 - F.col("id") % block).alias("b"))
    inside, pairs = n // block * (block * (block - 1) // 2), n * (n - 1) // 2
    assert math.isclose(S.kendall(df, "a", "b").first()["tau"], (pairs - 2 * inside) / pairs, rel_tol=1e-12)


def test_auc_over_ranges(spark):
    rng = np.random.default_rng(4)
    score, label = rng.integers(0, 300, 5000), rng.integers(0, 2, 5000)
    rows = spark.createDataFrame([(int(a), int(b)) for a, b in zip(score, label)], "s long, y int").repartition(7)
    want = np.mean([(score[label == 0] < x).mean() for x in score[label == 1]])
    assert math.isclose(S.auc(rows, "s", "y").first()["auc"], want, rel_tol=1e-12) and S.auc(rows.where("y = 1"), "s", "y").first()["auc"] is None


def test_as_of_by_key_and_clashing_columns(spark):
    d = datetime.date
    series = spark.createDataFrame([("x", d(2020, 1, 10), 1.0), ("y", d(2020, 1, 5), 2.0), ("x", d(2020, 1, 10), 3.0)], "series string, date date, value double")
    left = spark.createDataFrame([("x", d(2020, 1, 12), 9.0), ("x", d(2020, 1, 12), 8.0), ("y", d(2020, 1, 1), 7.0), (None, d(2020, 1, 9), 6.0)], "series string, date date, value double")
    got = sorted((r["series"] or "", r["value"] or 0) for r in S.as_of(left, series, "date", by=("series",)).collect())
    assert got == [("", 0), ("x", 3.0), ("x", 3.0), ("y", 0)]


def test_weighted_ranking_over_time_equals_the_ranking_of_all_rows(spark):
    r, day = np.random.default_rng(6), datetime.date(2020, 1, 1)
    rows = []
    for i in range(900):
        posted = day + datetime.timedelta(days=int(r.integers(0, 700)))
        rows.append((i, f"m{i % 3}", i % 2, posted, float(np.round(r.normal(), 1 if i % 2 else 6))))
    rows += [(1000 + i, "same", 0, day, 0.5) for i in range(9)] + [(2000, "one", 1, day, 0.3), (2001, "late", 1, datetime.date(2030, 1, 1), 0.3), (2002, "one", 1, None, 0.3), (2003, "one", 1, day, None)]
    df = spark.createDataFrame(rows, "chunk_id long, member string, query_idx int, posted date, rel double").repartition(6)
    dates = [day + datetime.timedelta(days=d) for d in (0, 3, 200, 201, 650, 2000)]
    settings = [(b, t) for b in (0.0, 0.6, 1.5, 40.0) for t in (0.3, 2.0)]
    days = spark.createDataFrame([(d,) for d in dates], "date date")
    got = R.expanding_top_k_weighted(df, days, 3, settings)
    found = {}
    for x in got.collect():
        found.setdefault((x["beta"], x["tau"], x["date"], x["member"], x["query_idx"]), []).append((x["rank"], x["chunk_id"]))
    want = {}
    z = lambda v: (v - v.mean()) / v.std() if v.std() > 1e-9 else v * 0
    for d in dates:
        for m, q in {(x[1], x[2]) for x in rows}:
            own = [x for x in rows if x[1] == m and x[2] == q and x[3] and x[3] <= d and x[4] is not None]
            if own:
                rel, age = np.array([x[4] for x in own]), np.array([(d - x[3]).days / 365.25 for x in own])
                for b, t in settings:
                    score = np.round(z(rel) + b * z(np.exp(-age / t)), 9)
                    best = sorted(range(len(own)), key=lambda i: (-score[i], own[i][0]))[:3]
                    want[b, t, d, m, q] = [(k + 1, own[i][0]) for k, i in enumerate(best)]
    assert {k: sorted(v) for k, v in found.items()} == want
    kept = R.recency_layers(R.first_seen(df, days), 3, ("member", "query_idx")).count()
    assert kept < len(rows) / 2


def plain_fit(x, y):
    """Shrinkage discriminant analysis from the rows themselves."""
    classes, scale = np.unique(y), x.std(0)
    scale, cov, means, priors = np.where(scale > 0, scale, 1.0), 0, [], []
    for c in classes:
        own = x[y == c]
        m = own.mean(0)
        z = (own - m) / scale
        n, p = z.shape
        s = z.T @ z / n
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        beta = min(delta, max(0.0, (((z**2).sum(1) ** 2).sum() / n - (s**2).sum()) / (n * p)))
        w = beta / delta if delta > 0 else 0.0
        cov = cov + n / len(x) * np.outer(scale, scale) * ((1 - w) * s + w * mu * np.eye(p))
        means.append(m)
        priors.append(n / len(x))
    w = np.linalg.lstsq(cov, np.array(means).T, rcond=None)[0].T
    return classes, w, -0.5 * (w * np.array(means)).sum(1) + np.log(priors)


def plain_scores(x, y, fold):
    out = {}
    for f in np.unique(fold):
        held = fold == f
        if len(np.unique(y[~held])) < 2:
            continue
        classes, w, b = plain_fit(x[~held], y[~held])
        s = x[held] @ w.T + b
        s = s - s.max(1, keepdims=True)
        lp = s - np.log(np.exp(s).sum(1, keepdims=True))
        for i, row in zip(np.flatnonzero(held), lp, strict=True):
            out[i] = (classes[row.argmax()], dict(zip(classes, row, strict=True)))
    return out


def test_moments_add_up_to_the_fit_of_all_rows(spark):
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(0, 1, (40, 5)), rng.normal(1, 2, (30, 5)), rng.normal(0.5, 1, (9, 5)), rng.normal(2, 1, (1, 5))] + 3
    x[:, 4] = 7.0  # no spread
    y = np.repeat(["a", "b", "c", "d"], [40, 30, 9, 1])
    fold = rng.integers(0, 4, 80)
    w, b = L.fit([L.moments(x[y == c][:3]) + L.moments(x[y == c][3:]) if (y == c).sum() > 3 else L.moments(x[y == c]) for c in "abcd"])
    _, w0, b0 = plain_fit(x, y)
    assert np.allclose(w, w0, rtol=1e-5, atol=1e-7) and np.allclose(b, b0, rtol=1e-5, atol=1e-6)
    rows = [("p", int(f), str(c), v.tolist()) for f, c, v in zip(fold, y, x, strict=True)]
    rows += [("q", int(f) % 2, str(c), (-v).tolist()) for f, c, v in zip(fold, y, x, strict=True)] + [("p", 0, None, x[0].tolist()), ("p", 0, "a", None), ("one", 1, "a", [1.0])]
    df = spark.createDataFrame(rows, "part string, fold long, label string, embedding array<double>").repartition(7)
    got = {part: [] for part in "pq"}
    for r in L.cross_validated(df).collect():
        got[r["part"]].append((r["fold"], r["true"], r["pred"], round(r["log_p"], 5)))
    for part, sign, folds in (("p", 1, fold), ("q", -1, fold % 2)):
        want = [(int(folds[i]), str(y[i]), str(pred), round(float(lp[y[i]]), 5) if y[i] in lp else math.nan) for i, (pred, lp) in plain_scores(sign * x, y, folds).items()]
        assert sorted(map(str, got[part])) == sorted(map(str, want))
    plan = L.cross_validated(df)._jdf.queryExecution().toString()
    assert "partial_aggregate_metrics" in plan or "partial_" in plan
    pairs = L.against(df.where("part = 'p'").select("fold", "label", "embedding"), "a").collect()
    for other in "bcd":
        use = (y == "a") | (y == other)
        want = plain_scores(x[use], y[use], fold[use])
        assert sorted((r["true"], r["pred"]) for r in pairs if r["part"] == other) == sorted((str(y[use][i]), str(pred)) for i, (pred, _) in want.items())


def test_incremental_stream_is_idempotent(spark, tmp_path):
    schema = "postUrl string, postedAt timestamp, member string"
    rows = spark.createDataFrame([("u1", datetime.datetime(2024, 1, 1), "a"), ("u2", datetime.datetime(2024, 1, 2), "b"), ("u1", datetime.datetime(2024, 1, 1), "a")], schema)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows.write.parquet(src)
    for _ in range(2):
        incremental.run_available(spark, src, rows.schema, out, cp)
    assert sorted((r["postUrl"], r["chunk_id"]) for r in spark.read.parquet(out).collect()) == [("u1", 0), ("u2", 1)]
    spark.createDataFrame([("u2", datetime.datetime(2024, 1, 3), "b"), ("u3", datetime.datetime(2024, 1, 3), "b")], schema).write.mode("append").parquet(src)
    incremental.run_available(spark, src, rows.schema, out, cp)
    assert sorted((r["postUrl"], r["chunk_id"]) for r in spark.read.parquet(out).collect()) == [("u1", 0), ("u2", 1), ("u3", 2)]
    late, again = str(tmp_path / "late"), str(tmp_path / "cp2")  # a lost checkpoint: batch numbers start anew, records don't vanish
    spark.createDataFrame([("u9", datetime.datetime(2024, 1, 9), "a"), ("u1", datetime.datetime(2024, 1, 1), "a")], schema).write.parquet(late)
    incremental.run_available(spark, late, rows.schema, out, again)
    assert sorted((r["postUrl"], r["chunk_id"]) for r in spark.read.parquet(out).collect()) == [("u1", 0), ("u2", 1), ("u3", 2), ("u9", 3)]


def test_stream_with_marks(spark, tmp_path):
    schema = "postUrl string, postedAt timestamp, member string"
    day = lambda d: datetime.datetime(2024, 1, d)
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.createDataFrame([("u1", day(5), "a"), ("u2", day(1), "b")], schema).write.parquet(src)
    incremental.run_available(spark, src, spark.createDataFrame([], schema).schema, out, cp, marks=("member",))
    spark.createDataFrame([("u3", day(4), "a"), ("u4", day(4), "b"), (None, day(9), "a"), (None, day(9), "a")], schema).write.mode("append").parquet(src)
    incremental.run_available(spark, src, spark.createDataFrame([], schema).schema, out, cp, marks=("member",))
    assert sorted((r["postUrl"] or "", r["member"]) for r in spark.read.parquet(out).collect()) == [("", "a"), ("", "a"), ("u1", "a"), ("u2", "b"), ("u4", "b")]


def test_class_scores_and_decisions(spark):
    r = np.random.default_rng(4)
    rows = [("p", k % 4, y, (r.normal(size=3) + 6 * (y == "a")).tolist()) for y in "ab" for k in range(20)]
    df = spark.createDataFrame(rows, "part string, fold long, label string, embedding array<double>")
    s = L.class_scores(df, "a").collect()
    assert len(s) == 40 and min(x["score"] for x in s if x["own"]) > max(x["score"] for x in s if not x["own"])
    d = L.decisions(L.cross_validated(df), "a").collect()
    assert all((x["decision"] > 0) == (x["true"] == "a") for x in d) and L.class_scores(df, "z").count() == 0 and L.cross_validated(df.where("label = 'a'")).count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "curated.json").write_text('["one", "two"]')
    (tmp_path / "many.json").write_text('[{"q": "a", "subtopic": "s", "dove_end": "d", "hawk_end": "h"}]')
    (tmp_path / "anchors.json").write_text('{"hawk": ["x", "y"], "dove": []}')
    assert [tuple(r) for r in readers.load_queries(spark, str(tmp_path), "curated").collect()] == [(0, "one"), (1, "two")]
    assert readers.load_queries(spark, str(tmp_path), "pool", "many.json").first().asDict() == {"query_idx": 0, "q": "a", "subtopic": "s", "dove_end": "d", "hawk_end": "h"}
    assert [tuple(r) for r in readers.load_anchors(spark, str(tmp_path / "anchors.json")).collect()] == [("hawk", 0, "x"), ("hawk", 1, "y")]
    with pytest.raises(KeyError):
        readers.load_queries(spark, str(tmp_path), "other")


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("observation_date,X\n2020-01-01,1.5\n2020-02-01,.\n")
    assert [r["value"] for r in readers.macro_csv(spark, str(tmp_path / "a.csv"), "X").collect()] == [1.5]
    (tmp_path / "b.json").write_text('["p", "q"]')
    assert [tuple(r) for r in readers.json_list(spark, str(tmp_path / "b.json")).collect()] == [(0, "p"), (1, "q")]
    with pytest.raises(FileNotFoundError):
        readers.read_config(spark, str(tmp_path), "none")
    with pytest.raises(ValueError):
        readers.load_chunks(spark, str(tmp_path), "other")


def test_attribution_and_detectability_use_every_label(spark, tmp_path):
    from loomwright.plans import text_queries

    r = np.random.default_rng(8)
    rows = [(i, (np.eye(8)[i % 6] * 9 + r.normal(size=8)).tolist(), i % 6) for i in range(180)] + [(180, [0.0] * 8, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {x["true"]: (x["n"], x["recall"]) for x in text_queries.attribution(spark, str(tmp_path)).collect()}
    assert got == {f"m{k}": (30, 1.0) for k in range(6)}
    assert {x["part"]: x["tau"] for x in text_queries.detectability(spark, str(tmp_path)).collect()} == {f"m{k}": 1.0 for k in range(1, 6)}
