"""Null ids, repeated rows, ties and clashing names in every operator."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomwright.llm import decontam, langid, licenses, neardup, ngramjoin, packing, pii, tokens, toxicity, warc
from loomwright.llm.common import shared_dir

TEXT = "the and of that with shing joe@mail.org said under the apache license today"
ROWS = [
    (None, TEXT, "en", None, None), (None, TEXT, "en", None, None), (None, None, None, None, None), (7, TEXT, None, "s", 1), (7, TEXT, None, "s", 1), (7, "other text entirely", "de", "s", 2),
    (8, "", "en", "s", 0), (9, None, "en", "s", 0), (10, "x" * 5000, "en", "s", 0), (11, " \n\t ", None, "s", 3), (12, "word " * 4000, "en", "s", 4), (-3, "ÄÖÜ ß 日本 🙂", "de", "s", 5),
]
IDS = Counter(r[0] for r in ROWS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)


def ids(rows, name="doc_id"):
    return Counter(r[name] for r in rows)


def same_for_equal_rows(rows, skip=()):
    seen = {}
    for r in rows:
        d = r.asDict()
        key = d["doc_id"]
        if key in (None, 7):  # some of these rows repeat whole
            seen.setdefault(key, Counter())[str({k: v for k, v in d.items() if k not in skip})] += 1
    assert max(seen[7].values()) >= 2 and max(seen[None].values()) >= 2


def test_one_row_a_row(spark, docs):
    labels = spark.createDataFrame([(7, 1), (7, 1), (None, 1), (8, None), (12, 0)], "doc_id long, toxic int")
    for rows in (pii.op1_pii(spark, docs).collect(), toxicity.op2_toxicity(spark, docs, labels).collect(), ngramjoin.op3_ngram_join(spark, docs).collect(), langid.op9_language(spark, docs).collect(), licenses.op10_licenses(spark, docs).collect()):
        assert ids(rows) == IDS
        same_for_equal_rows(rows)


def test_tokens_and_pieces_of_repeated_ids(spark, docs):
    got = tokens.op7_token_table(spark, docs).collect()
    assert ids(got) == IDS
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:k]) for k in range(len(ordered))]
    known = [r["doc_id"] for r in ordered]
    assert known[: IDS[None]] == [None] * IDS[None] and known[IDS[None] :] == sorted(k for k in known if k is not None)
    packed = packing.op4_pack(spark, docs).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == IDS
    taken = Counter()
    for r in packed:
        taken[r["sequence_id"]] += r["length"]
    assert max(taken.values()) <= 2048 and sum(taken.values()) == sum(r["n_tokens"] for r in got)


def test_bounded_token_reads_touch_fewer_pages(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word"), F.col("id").cast("string"), F.lit(" ")), 40).alias("text"))
    path = shared_dir(spark, "pages")
    tokens.write_token_table(docs, path, files=4, row_group_bytes=64 << 10, page_bytes=4 << 10)

    def scanned(low, high):
        df = tokens.read_token_table(spark, path, low, high)
        assert df.count() == high - low + 1
        plan = df._jdf.queryExecution().executedPlan()
        df._jdf.queryExecution().toRdd().count()
        found, todo = 0, [plan]
        while todo:
            p = todo.pop()
            if p.nodeName().startswith("AdaptiveSparkPlan"):
                todo.append(p.executedPlan())
                continue
            if "Scan parquet" in p.nodeName() and "ids" in p.simpleString(10_000):
                found += p.metrics().apply("numOutputRows").value()
            kids = p.children()
            todo += [kids.apply(k) for k in range(kids.size())]
            if p.nodeName().endswith("QueryStage"):
                todo.append(p.plan())
        return found

    few, all_rows = scanned(100, 120), scanned(0, 3999)
    assert 21 <= few < all_rows / 4 and all_rows >= 4000


def test_decontamination_of_nulls_and_repeats(spark, docs):
    bench = [(1, "the and of that with shing joe mail org said under the apache license today"), (1, None), (None, "words words"), (2, ""), (3, "of that with shing joe"), (3, "of that with shing joe")]
    bench = spark.createDataFrame(bench, "item_id long, text string")
    hits = decontam.op5_decontamination(spark, docs, bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in hits) == Counter({(None, 1): 2, (7, 1): 2, (None, 3): 2, (7, 3): 2})
    assert ids(decontam.decontaminate(docs, bench).collect()) == IDS - Counter({None: 2, 7: 2})


def test_warc_of_nulls_and_repeats(spark):
    big = "<p>same</p>" * 200
    rows = [(None, None, None), (None, "u", big), (4, "u", big), (4, "u", big), (2, None, big), (5, "u", "tiny"), (5, "u", "tiny")]
    pages = spark.createDataFrame([(*r, "mine") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = warc.op8_warc(spark, pages).collect()
    assert ids(got, "page_id") == Counter(r[0] for r in rows)
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] >= 1000) == Counter({(4, "response", None): 2, (2, "revisit", 4): 1, (None, "revisit", 4): 1})


def test_near_duplicates_of_nulls_and_repeats(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.99, 0.05], 1), (None, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [], 1), (5, [1.0, 0.0], 2), (6, [2.0, 0.0], 1)]
    got = neardup.op6_near_duplicates(spark, spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, node int")).collect()
    assert ids(got, "vec_id") == Counter(r[0] for r in rows)
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got} >= {(1, 4, 1), (2, 4, 1), (6, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5)}


def test_pipeline_of_nulls_and_repeats(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    firsts = Counter(r["doc_id"] for r in got if r["piece"] == 0)
    assert max(firsts.values()) <= 2 and not {8, 9, 11} & set(firsts) and 7 in firsts and None not in firsts


def test_empty_pipeline(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_items_are_rows(spark, docs):
    bench = spark.createDataFrame([(None, "other text entirely"), (None, "word word word"), (4, "of that with shing joe"), (4, "under the apache license today")], "item_id long, text string")
    for blocks in ({}, {"block_items": 1}, {"block_chars": 30}):
        found = decontam.mark(docs, bench, **blocks).select("doc_id", F.inline("hits")).collect()
        assert Counter((r["doc_id"], r["item_id"]) for r in found) == Counter({(None, 4): 4, (7, 4): 4, (7, None): 1, (12, None): 1})
    assert ids(decontam.decontaminate(docs, bench).collect()) == IDS - Counter({None: 2, 7: 3, 12: 1})


def test_any_column_name(spark, docs):
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("hits", F.lit(2))
    bench = spark.createDataFrame([(1, "other text entirely")], "item_id long, text string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = {"benchmark": lambda: decontam.decontaminate(odd, bench)}.get(name, lambda stage=stage: stage(spark, odd, ""))()
        assert df.columns == odd.columns and df.count() > 0
    assert corpus_pipeline.packing(spark, odd, "").count() >= len(ROWS) - 1
