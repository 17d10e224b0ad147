import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import ingest as I
from loomwright.operators import personas as P
from loomwright.operators import retrieval as R


@pytest.fixture(scope="module")
def chunks(spark):
    r = np.random.default_rng(3)
    rows = [(k, f"m{k % 2}", f"statement {k} of a member about things, said on day {k} again", r.normal(size=4).tolist(), f"2020-01-{k % 28 + 1:02d}") for k in range(60)]
    return spark.createDataFrame(rows, "chunk_id long, member string, text string, embedding array<double>, posted string").withColumn("posted", F.to_date("posted"))


@pytest.fixture(scope="module")
def battery(spark):
    return spark.createDataFrame([(0, "What now?", [1.0, 0.0, 0.0, 0.0]), (1, "And then?", [0.0, 1.0, 0.0, 0.0])], "query_idx long, question string, q array<double>")


def test_expanding_top_k_equals_each_meeting_alone(spark, chunks, battery):
    days = spark.sql("SELECT explode(sequence(DATE'2019-12-30', DATE'2020-02-05', INTERVAL 5 DAY)) AS date")
    rows = R.scored(chunks, battery).select("query_idx", "member", "chunk_id", "posted", "rel")
    got = {(str(r["date"]), r["query_idx"], r["member"], r["rank"]): r["chunk_id"] for r in R.expanding_top_k(rows, days, 3).collect()}
    want = {}
    for d in [r["date"] for r in days.collect()]:
        for r in R.top_k(rows.where(F.col("posted") <= F.lit(d)), 3).collect():
            want[str(d), r["query_idx"], r["member"], r["rank"]] = r["chunk_id"]
    assert got == want and len(want) > 60


def test_respond_keeps_absent_members_and_failures(spark, chunks, battery):
    class Broken:
        def generate(self, system, user):
            if "What" in user:
                raise OSError
            return f' "{system[:9]}" '

    members = spark.createDataFrame([("m0",), ("nobody",)], "member string")
    got = {(r["member"], r["query_idx"]): r["response"] for r in P.respond(chunks, members, battery, Broken(), 2, bios=spark.createDataFrame([("m0", "a bio")], "member string, bio string")).collect()}
    assert got == {("m0", 0): "", ("m0", 1): "You are m", ("nobody", 0): "", ("nobody", 1): ""}
    with pytest.raises(Exception, match="OSError"):
        I.respond(members.withColumns({"system": F.lit("s")}), Broken(), F.lit("What"), strict=True).collect()
    assert {r["response"] for r in P.respond(chunks, members, battery, P.FirstStatement(), 0).collect()} == {""}


def test_prompts(spark):
    one = spark.range(1).select(F.lit("Q?").alias("q"), F.array(F.lit("a"), F.lit("b")).alias("f"), F.lit(None).cast("string").alias("no"))
    text = one.select(P.index_prompt(F.col("q"), F.col("f"), F.lit("Now.")).alias("a"), P.index_prompt(F.col("q"), F.col("f"), F.col("no")).alias("b"), P.system_prompt(F.lit("X"), F.col("no")).alias("c"), P.vote_prompt(F.col("f"), F.lit("Now.")).alias("d"), P.completion_prompt(F.lit("seed"), F.lit(7)).alias("e"), P.completion_prompt(F.lit("seed"), F.lit(7), F.col("f")).alias("g")).first()
    assert text["a"].startswith("Now.\n\n") and "- a\n- b" in text["a"] and text["b"].startswith("Statements") and "Background" not in text["c"]
    assert "hike" in text["d"] and "7 more words" in text["e"] and text["g"].startswith("Statements")


def test_cache_makes_only_what_is_missing(spark, tmp_path):
    path, made = f"{tmp_path}/cache", []

    def make(rows):
        made.append(rows.count())
        return rows.select("k", (F.col("k") * 10).alias("v"))

    rows = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    assert sorted(r["v"] for r in P.cached(rows, path, ("k",), make).collect()) == [10, 20]
    assert sorted(r["v"] for r in P.cached(rows.unionByName(spark.createDataFrame([(3,)], "k long")), path, ("k",), make).collect()) == [10, 20, 30] and made == [2, 1]


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "Short one. This sentence certainly has more than eight simple words in it. Again a longer sentence follows with enumerated considerations for everyone here."), (2, None)], "doc_id long, text string")
    got = I.extracted(docs, I.SentenceOpinions()).orderBy("opinion_id").collect()
    assert [(r["opinion_id"], r["topic"]) for r in got] == [("opinion-1-1", "certainly"), ("opinion-1-2", "considerations")]

    class Broken:
        def extract(self, passage):
            raise OSError

    assert I.extracted(docs, Broken()).count() == 0


def test_completions_and_detection(spark, chunks):
    quotes = chunks.withColumn("quote", F.col("text"))
    pool, test = P.held_out(quotes, 12)
    assert test.count() == 24 and pool.count() == 36 and pool.join(test, "chunk_id").count() == 0
    pool = P.with_vectors(pool.drop("embedding"), P.DigestVectors())
    done = P.complete_seeded(pool, test, P.FirstStatement(), 2, vectors=P.DigestVectors())
    assert done.count() == 24 and P.complete_seeded(pool, test, P.FirstStatement(), 0).count() == 0
    m = P.matched(done).collect()
    assert all(len(r["generated"].split()) == len(r["real"].split()) >= 3 for r in m)
    taus = P.detect_taus(done, P.DigestVectors()).collect()
    assert {r["member"] for r in taus} == {"m0", "m1"} and all(0 <= r["tau"] <= 1 and 0 <= r["floor"] <= 1 for r in taus)


def test_detect_tells_far_classes_apart_and_defaults(spark):
    r = np.random.default_rng(1)
    rows = [("a", y, k, (r.normal(size=4) + (5 if y == "x" else 0)).tolist()) for y in "xy" for k in range(12)] + [("b", "x", 0, [0.0] * 4), ("b", "y", 0, [1.0] * 4), ("c", "x", 0, [1.0] * 4)]
    got = {x["part"]: x["accuracy"] for x in P.detect(spark.createDataFrame(rows, "part string, label string, key long, embedding array<double>")).collect()}
    assert got["a"] == 1.0 and got["b"] == 0.5 and got["c"] == 0.5


def test_mean_generated_counts_empty_answers(spark):
    a = spark.createDataFrame([("m", "x"), ("m", "")], "member string, response string")
    v = {r["pos"]: r["v"] for r in P.mean_generated(a, P.DigestVectors(), ("member",)).collect()}
    each = P.with_vectors(spark.createDataFrame([("x",), (" ",)], "text string"), P.DigestVectors()).collect()
    assert np.allclose([v[k] for k in range(32)], np.mean([e["embedding"] for e in each], axis=0))


def test_retry_provider_raises_in_the_end():
    calls = []

    class Broken:
        def generate(self, system, user):
            calls.append(1)
            raise OSError

    with pytest.raises(OSError):
        I.Retrying(Broken(), I.Retry(4, sleep=lambda s: None)).generate("s", "u")
    assert len(calls) == 4
