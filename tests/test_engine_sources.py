import datetime

import pytest
from pyspark.sql import functions as F

from loomwright.sources import listing, readers, sinks

NOW = datetime.datetime(2024, 5, 6, 7, 8)
BODY = "<div id='article'><p>Held by Jane Q. Doe on May 1, 2024.</p><p>" + "word " * 100 + "</p></div>"


def test_feed_to_records(spark):
    class Down:
        def fetch(self, url):
            raise OSError

    raw = '﻿[{"s": "Chair Jane Q. Doe", "d": "5/1/2024", "l": "/a/doe20240501a.htm", "t": "One", "lo": "Here"}, {"s": "Jane Doe", "d": "", "l": "http://o.org/x.htm"}, {"s": "Doe", "l": "/n.htm"}, {"s": "Jane Doe", "d": "1/1/2001", "l": "/old.htm"}, {"s": "jane doe", "d": "6/1/2024", "l": "/empty.htm"}]'
    feed = spark.createDataFrame([(raw,)], "value string")
    shelf = listing.Shelf({"http://b.org/a/doe20240501a.htm": BODY, "http://o.org/x.htm": "<p>Other</p>", "http://b.org/empty.htm": "<script>x</script>"})
    got = listing.feed_records(feed, shelf, "Jane Q. Doe", "speech", "s", "http://b.org", NOW, "2024-01-01").orderBy("record_id").collect()
    assert [(r["record_id"], r["postId"], r["caption"], r["location"]) for r in got] == [("speech-doe20240501a", "doe20240501a", "One", "Here"), ("speech-x", "x", "", "")]
    assert got[0]["text"].startswith("Held by Jane") and got[0]["postedAt"] == datetime.datetime(2024, 5, 1) and got[1]["postedAt"] is None and tuple(got[0].asDict()) == listing.RECORD
    assert listing.feed_records(feed, Down(), "Jane Q. Doe", "speech", "s", "http://b.org", NOW).count() == 0


def test_bio_and_union(spark):
    index = spark.createDataFrame([('<a href="/z.htm">Doe</a><a class="x" href="/bios/doe.htm"><b>Jane</b> Doe</a><a href="/y.htm">Jane Doe</a>',)], "html string")
    bio = listing.bio_record(index, listing.Shelf({"http://b.org/bios/doe.htm": BODY}), "Jane Doe", "http://b.org", NOW)
    r = bio.collect()
    assert [(x["record_id"], x["postedAt"].date()) for x in r] == [("bio-doe", NOW.date())]
    both = listing.union_by_id(bio, bio.withColumn("text", F.lit("later"))).collect()
    assert [x["text"] for x in both] == ["later"]


def test_transcripts_and_presconf(spark):
    meetings = spark.createDataFrame([(datetime.date(2020, 1, 29), "u1"), (datetime.date(2020, 3, 3), "u2"), (datetime.date(2019, 1, 1), "gone")], "date date, url string")
    shelf = listing.Shelf({"u1": "CHAIR DOE. First answer here.\nMS. ROE. No.\nCHAIR DOE. Second answer here.", "u2": "JANE Q DOE. Third answer here."})
    got = listing.spoken_records(meetings, shelf, "Jane Doe", "t", NOW, least=5).orderBy("record_id").collect()
    assert [(r["record_id"], r["text"], r["postedAt"].date().year) for r in got] == [("t-20200129-1", "First answer here.", 2020), ("t-20200129-2", "Second answer here.", 2020)]
    chair = listing.spoken_records(meetings, shelf, "Jane Doe", "t", NOW, chair=True, least=5)
    assert chair.count() == 3 and listing.spoken_records(meetings, shelf, "Jane Doe", "t", NOW, chair=True, least=5, most=1).count() == 0
    assert [r["year"] for r in listing.transcript_years(spark, NOW.date()).collect()] == list(range(2013, 2021))


def test_paging_stops_at_the_first_page_that_adds_nothing(spark):
    rows = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["b", "c"]), (2, ["a"]), (3, ["d"]), (9, ["z"])], "page int, links array<string>")
    assert [r["href"] for r in listing.paged(rows).collect()] == ["a", "b", "c"]
    assert [r["href"] for r in listing.paged(rows, 1).collect()] == ["a", "b"] and listing.paged(rows.limit(0)).count() == 0


def test_bank_pages(spark):
    rows = spark.createDataFrame([("http://k.org/20240501/doe.htm",), ("http://k.org/short.htm",), ("http://k.org/nobody.htm",), (None,)], "url string")
    page = f"<title>Talk | Bank</title><article>{BODY}</article>"
    shelf = listing.Shelf({"http://k.org/20240501/doe.htm": page, "http://k.org/short.htm": "<article><p>Abstract by Doe, June 2, 2023</p></article>", "http://k.org/short.htm.pdf": "By Jane Doe. " + "long text " * 100, "http://k.org/nobody.htm": "x " * 500})
    got = listing.page_records(rows, shelf, "Jane Doe", "bank", NOW, r"/(\d{4})(\d{2})(\d{2})/", attachment=lambda html: "http://k.org/short.htm.pdf" if "Abstract" in html else None).orderBy("postUrl").collect()
    assert [(r["postUrl"], r["caption"]) for r in got] == [("http://k.org/20240501/doe.htm", "Talk"), ("http://k.org/short.htm", "")]
    assert got[0]["postedAt"].date() == datetime.date(2024, 5, 1) and got[1]["text"].startswith("By Jane Doe. long") and got[1]["postedAt"] is None
    slugs = spark.createDataFrame([("", "", "c"), ("a", "b", None), (None, None, "")], "x string, y string, z string")
    assert [r["s"] for r in slugs.select(listing.resolved_slug(F.col("x"), F.col("y"), F.col("z")).alias("s")).collect()] == ["c", "a", None]


def test_series_hub_and_sinks(spark, tmp_path):
    d = datetime.date
    read = lambda y: spark.createDataFrame([("x", d(y, 1, 1), float(y)), ("x", d(2021, 6, 1), float(y))], "series string, date date, value double")
    rows = listing.yearly(read, 2020, 2022)
    assert sorted((r["date"].year, r["date"].month, r["value"]) for r in rows.collect()) == [(2020, 1, 2020.0), (2021, 1, 2021.0), (2021, 6, 2022.0), (2022, 1, 2022.0)]
    table = listing.macro_table([rows, rows.withColumn("series", F.lit("y"))], f"{tmp_path}/macro")
    assert table.count() == 8 and listing.macro_table([rows.limit(0)], f"{tmp_path}/macro").count() == 8 and listing.macro_table([rows], f"{tmp_path}/macro").where("series = 'y'").count() == 4
    chunks = spark.createDataFrame([(1, "Jane Q. Doe", "t"), (2, "Roe", None)], "chunk_id long, member string, text string")
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "chunk_id long, embedding array<double>")
    sinks.append_pair(chunks, vectors, str(tmp_path))
    sinks.append_pair(chunks.limit(0), vectors, str(tmp_path))
    got = {r["chunk_id"]: r for r in sinks.read_pair(spark, str(tmp_path)).collect()}
    assert len(got) == 2 and got[1]["embedding"] == [1.0, 2.0] and got[2]["embedding"] is None and got[2]["theme"] is None
    hub = listing.Hub(lambda config, split: f"{tmp_path}/{config}")
    assert hub.read(spark, "chunks").count() == 2
    sent = []
    assert sinks.publish(chunks, lambda x: sent.append(x.count())) and not sinks.publish(chunks.limit(0), sent.append) and sent == [2]
    sinks.dump(chunks, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    assert readers.read_config(spark, str(tmp_path), "chunks").count() == 2


def test_load_chunks_in_order(spark, tmp_path):
    from loomwright.operators.ingest import HashEmbedding

    spark.createDataFrame([(k, f"text {k % 3}") for k in (3, 1, 2, 0)], "chunk_id long, stance string").write.parquet(f"{tmp_path}/chunks")
    spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings")
    for mode in ("none", "cached", "compute"):
        got = readers.load_chunks(spark, str(tmp_path), mode, HashEmbedding()).collect()
        assert [r["chunk_id"] for r in got] == [0, 1, 2, 3]
    assert all(len(r["embedding"]) == 64 for r in got)
    with pytest.raises(ValueError):
        readers.load_chunks(spark, str(tmp_path), "other")


def test_a_pair_is_committed_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "pair")
    chunks = lambda *ids: spark.createDataFrame([(i, "Jane Doe", f"t{i}") for i in ids], "chunk_id long, member string, text string")
    vectors = lambda *ids: spark.createDataFrame([(i, [float(i)]) for i in ids], "chunk_id long, embedding array<double>")
    sinks.append_pair(chunks(1, 2), vectors(1, 1), root)
    told = lambda: sorted((int(r["chunk_id"]), r["embedding"] and list(r["embedding"])) for r in sinks.read_pair(spark, root).collect())
    assert told() == [(1, [1.0]), (2, None)]
    for step in ("conform", "commit"):  # a run ends between the two sides, or before the commit
        with monkeypatch.context() as m, pytest.raises(RuntimeError):
            m.setattr(sinks, step, lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            sinks.append_pair(chunks(3), vectors(3), root)
        assert told() == [(1, [1.0]), (2, None)]
    sinks.append_pair(chunks(3), vectors(3), root)
    assert told() == [(1, [1.0]), (2, None), (3, [3.0])]
    assert [sinks.commit(spark, root, b) for b in ("x", "y")] == [2, 3] and sinks.committed(spark, root).count() == 4


def test_writers_commit_one_after_another(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        numbers = list(pool.map(lambda k: sinks.commit(spark, str(tmp_path), f"batch{k}"), range(64)))
    assert sorted(numbers) == list(range(64)) and {r["batch"] for r in sinks.committed(spark, str(tmp_path)).collect()} == {f"batch{k}" for k in range(64)}


def test_seen_keys_are_the_state_of_the_stream(spark, tmp_path):
    from loomwright.streaming import incremental

    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    schema = "member string, source string, url string, postedAt timestamp"
    day = lambda d: datetime.datetime(2024, 1, d)

    def ingest(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.run_stateful(spark, src, spark.createDataFrame([], schema).schema, out, cp, ("member", "source", "url"), "postedAt", "10 days")
        return sorted((r["member"], r["source"], r["url"], r["postedAt"].day) for r in spark.read.parquet(out).collect())

    first = [("a", "s", "u1", 5), ("b", "s", "u1", 4)]
    assert ingest(("a", "s", "u1", day(5)), ("a", "s", "u1", day(5)), ("b", "s", "u1", day(4)), ("b", "s", "u2", None)) == first
    more = sorted([*first, ("a", "t", "u1", 6), ("b", "s", "u9", 20)])
    assert ingest(("a", "s", "u1", day(5)), ("a", "t", "u1", day(6)), ("b", "s", "u9", day(20))) == more  # a restart knows what it has seen
    assert ingest(("b", "s", "u9", day(20)), ("c", "s", "old", day(2)), ("c", "s", "new", day(21))) == sorted([*more, ("c", "s", "new", 21)])


def test_interval_join(spark):
    import random

    from loomwright.operators import committee as C

    rnd, day = random.Random(3), lambda d: datetime.date(2020, 1, 1) + datetime.timedelta(days=d)
    points = [(i, day(rnd.randrange(300)) if i else None) for i in range(80)]
    spans = [(j, day(rnd.randrange(-200, 300)), None) for j in range(4)] + [(j, day(a := rnd.randrange(-100, 350)), day(a + rnd.randrange(-3, 120))) for j in range(4, 60)] + [(99, None, day(5)), (98, day(-9000), day(9000))]
    p, s = spark.createDataFrame(points, "i long, at date"), spark.createDataFrame(spans, "j long, start date, stop date")
    want = sorted((i, j) for i, at in points for j, a, b in spans if at and a and a <= at and (b is None or at < b))
    for days in (1, 16, 1000):
        got = C.interval_join(p, s, "at", "start", "stop", days)
        assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("NestedLoop") <= 1  # the one row of the points' range
    assert C.interval_join(p.limit(0), s, "at", "start", "stop").count() == 0


def test_authors_of_a_site(spark):
    names = spark.createDataFrame([("John C. Williams",), ("  Ann   Lee ",), ("Cher",), ("",), (None,)], "n string")
    got = [r["s"] for r in names.select(listing.author_candidates(F.col("n")).alias("s")).collect()]
    assert got == [["john_c_williams", "john_williams"], ["ann_lee"], [], [], []]

    rows = spark.createDataFrame([("a", 0, "Speeches of John Williams"), ("a", 1, None), ("b", 0, "Not found"), ("b", 1, "Williams"), ("c", 0, None)], "site string, page int, title string")
    assert sorted((r["site"], r["page"]) for r in listing.titled(rows, "John Williams", ("site",)).collect()) == [("a", 0), ("a", 1)]
    one = lambda s: listing.titled(rows.where(F.col("site") == s).drop("site"), "John Williams").count()
    assert [one("a"), one("b"), one("c")] == [2, 0, 0]

    page = lambda *links: "".join(f'<a href="{h}">{t}</a>' for h, t in links)
    index = [(0, page(("/review/r1.htm", "Ann Lee: John Williams and others"))), (1, page(("/review/r2.htm", "John C Williams: Rates"), ("/review/r3.htm", "John C Williams: Prices"))), (50, page(("/review/r4.htm", "Ann Lee: Late"))), (2, None)]
    shelf = listing.Shelf({"https://x.org/review/r2.htm": "no author", "https://x.org/review/r3.htm": page(("/about", "x"), ("/author/john_c_williams.htm", "J")), "https://x.org/review/r4.htm": page(("/author/ann_lee.htm", "A"))})
    table = spark.createDataFrame(index, "page int, html string")
    slug = lambda name, most=40: [r["slug"] for r in listing.discovered_slug(table, shelf, name, "https://x.org", most).collect()]
    assert slug("John Williams") == ["john_c_williams"] and slug("Ann Lee") == [] and slug("Ann Lee", 60) == ["ann_lee"] and slug("Bo Ek") == []
