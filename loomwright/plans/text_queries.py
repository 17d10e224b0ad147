"""Queries on texts, the corpus and ingest."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import scalar as T
from loomwright.operators import ingest as I
from loomwright.operators import likeness as L
from loomwright.sources import pages


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def corpus_composition(spark, d):
    """Counts by source, language and length class in one pass over grouping sets."""
    x = _docs(spark, d).select("source", "lang", F.least(F.floor(F.col("n_chars") / 1000), F.lit(10)).cast("string").alias("size"))
    g = x.groupingSets([[F.col("source")], [F.col("lang")], [F.col("size")]], "source", "lang", "size").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dim = F.when(F.col("g") == 3, "source").when(F.col("g") == 5, "lang").otherwise("size")
    return g.select(dim.alias("dim"), F.coalesce("source", "lang", "size").alias("key"), "n").where("key is not null")


def corpus_by_year(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.year(F.try_to_timestamp(F.col("o_orderdate").cast("string"))).alias("year"))
    return o.where("year between 1996 and 2000").groupBy("year").agg(F.count("*").alias("n"))


def theme_bucket(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.groupBy(T.theme_of(F.concat_ws(" ", "p_name", "p_type")).alias("theme")).agg(F.count("*").alias("n"))


def theme_by_language(spark, d):
    low = _docs(spark, d).select("lang", F.lower("text").alias("low"))  # lower-cased once, in a scan of its own
    return low.groupBy("lang", T.theme_of(F.col("low"), lowered=True).alias("theme")).agg(F.count("*").alias("n"))


def seed_words(spark, d):
    x = _docs(spark, d).select("doc_id", F.col("text").alias("q"))
    w = T.words(F.col("q"))
    x = x.withColumns({"n": F.size(w), "seed": T.seed_of(F.col("q"))}).where("n >= 8")
    return x.select("doc_id", "n", "seed", F.greatest(F.lit(1), F.col("n") - F.size(T.words(F.col("seed")))).alias("remaining"))


def matched_lengths(spark, d):
    """Each text's seed and what follows it, cut to the shorter one's number of words, where that is 3 or more."""
    x = _docs(spark, d).select("doc_id", T.words(F.col("text")).alias("w")).withColumn("k", F.greatest(F.lit(4), F.floor(F.size("w") * 0.5).cast("int")))
    x = x.select("doc_id", F.expr("slice(w, k + 1, size(w))").alias("a"), F.expr("slice(w, 1, k)").alias("b")).where("a is not null")
    x = x.withColumn("m", F.least(F.size("a"), F.size("b"))).where("m >= 3")
    return x.select("doc_id", "m", F.array_join(F.expr("slice(a, 1, m)"), " ").alias("a"), F.array_join(F.expr("slice(b, 1, m)"), " ").alias("b"))


def clean_turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", T.clean_turn(F.col("text")).alias("body")).where(F.length("body") >= 80)


def slugify(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", T.slug(F.col("url")).alias("slug"), T.absolute_url(F.regexp_replace("url", "^https?://[^/]+", ""), "https://example.org").alias("url"))


def url_dates(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    u = o.select("o_orderkey", F.concat(F.lit("/review/r"), F.date_format("o_orderdate", "yyMMdd")).alias("u"), F.concat(F.lit("Held on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(".")).alias("t"))
    return u.select("o_orderkey", T.url_date(F.col("u"), r"/review/r(\d{2})(\d{2})(\d{2})").alias("by_url"), T.page_date(F.col("t")).alias("by_text"))


def cache_keys(spark, d):
    return _docs(spark, d).select("doc_id", T.cache_key("m", 64, F.coalesce("text", F.lit(""))).alias("key"))


def clean_replies(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", T.clean_reply(F.concat(F.lit(' "'), "text", F.lit('"\n'))).alias("reply"))


def _records(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("member"), F.col("event_type").alias("source"), F.concat(F.lit("http://x/"), F.floor(F.col("event_id") / 2).cast("string")).alias("postUrl"), F.col("ts").alias("postedAt"), "event_id")


def anti_join_new(spark, d):
    """Late records whose URL is new and that aren't older than their (member, source)'s mark."""
    r = _records(spark, d)
    old, new = r.where("postedAt < '2024-01-10'"), r.where("postedAt >= '2024-01-05'")  # what is stored, and what a later visit finds
    return I.new_records(new, old).select("event_id", "member", "source")


def next_ids(spark, d):
    r = _records(spark, d).withColumn("chunk_id", F.col("event_id"))
    half = F.col("postedAt") < F.lit("2024-01-16").cast("timestamp_ntz")
    return I.numbered(r.where(~half), r.where(half), ("postedAt", "event_id")).select("event_id", "chunk_id")


def high_water_mark(spark, d):
    return _records(spark, d).groupBy("member").agg(F.date_format(F.max("postedAt"), "yyyy-MM-dd").alias("mark"), F.count_distinct("postUrl").alias("urls"))


def opinion_numbers(spark, d):
    c = spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("source_id"), F.col("turn").alias("chunk"), F.lit(0).alias("pos"))
    return I.opinion_ids(c).select("source_id", "chunk", "opinion_id")


def keyed_union(spark, d):
    """Later sources win: orders under their key, then every third overridden."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.lit(0).alias("prio"))
    u = o.unionByName(o.where("k % 3 = 0").select("k", F.lit("X").alias("v"), F.lit(1).alias("prio")))
    return u.groupBy("k").agg(F.max_by("v", "prio").alias("v")).groupBy("v").agg(F.count("*").alias("n"))


def json_fields(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k")).agg(F.count("*").alias("n"))


def link_dates(spark, d):
    """The first link of each date in a page of links, by position."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    h = o.select(F.col("o_custkey").alias("page"), "o_orderkey", F.concat(F.lit('<a href="/f/X'), F.date_format("o_orderdate", "yyyyMMdd"), F.lit('meeting.pdf">')).alias("a"))
    # a page lists one customer's orders, so pages grow in number, not in size
    h = h.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "a"))), lambda x: x["a"]), " ").alias("html"))
    x = h.select("page", F.posexplode(F.regexp_extract_all("html", F.lit(r"X(\d{8})meeting\.pdf"), 1)).alias("pos", "day"))
    r = x.withColumn("r", F.row_number().over(Window.partitionBy("page", "day").orderBy("pos"))).where("r = 1")
    return r.select("page", "pos", F.to_date("day", "yyyyMMdd").alias("day"))


def passages(spark, d):
    """Every passage of every document."""
    return I.passages(_docs(spark, d).select("doc_id", "text"))


def article_text(spark, d):
    return pages.texts(spark.read.parquet(f"{d}/pages.parquet")).select("page_id", "text")


def page_body(spark, d):
    return pages.texts(spark.read.parquet(f"{d}/pages.parquet"), pages.body_text).select("page_id", "text")


def page_rendered(spark, d):
    return pages.texts(spark.read.parquet(f"{d}/pages.parquet"), pages.rendered_text).select("page_id", "text")


def _transcripts(spark, d, user, other):
    """doc_id, text: each conversation as a transcript, its roles as headers."""
    head = F.when(F.col("role") == "user", user).otherwise(other)
    c = spark.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", head.alias("h"), F.regexp_replace("text", "\n", " ").alias("t")))).alias("x"))
    return c.select(F.col("conv_id").alias("doc_id"), F.array_join(F.transform("x", lambda s: F.concat(s["h"], s["t"])), "\n").alias("text"))


def speaker_turns(spark, d):
    return I.turns(_transcripts(spark, d, "CHAIR SMITH. ", "MR. JONES. "), F.lit("Smith")).select("doc_id", "pos", "body")


def chair_turns(spark, d):
    return I.chair_turns(_transcripts(spark, d, "CHAIR SMITH. ", "STEVE J. JONES. "), F.lit("Smith")).select("doc_id", "pos", "body")


def _rows(spark, d):
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.where("label is not null").select(F.lit("all").alias("part"), (F.col("vec_id") % 5).cast("long").alias("fold"), F.concat(F.lit("m"), F.col("label").cast("string")).alias("label"), "embedding")


def attribution(spark, d):
    return L.recall(L.cross_validated(_rows(spark, d))).select("true", "n", F.round("recall", 6).alias("recall"))


def detectability(spark, d):
    """Two-way accuracy of each member against member m0 as tau."""
    a = L.against(_rows(spark, d), "m0").groupBy("part").agg(F.avg((F.col("true") == F.col("pred")).cast("int")).alias("acc"))
    return a.select("part", F.round(T.detect_tau(F.col("acc")), 6).alias("tau"))


def hash_split(spark, d):
    return L.hash_split(_docs(spark, d).select("doc_id", "source"), "doc_id", "source", 10).groupBy("source").agg(F.sum(F.col("is_test").cast("int")).alias("n_test"), F.max(F.when(F.col("is_test"), F.col("doc_id"))).alias("last"))


def responses(spark, d):
    b = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.lit("You are a member.").alias("system"), "text")
    prompt = I.stance_prompt(F.col("text"), F.array(F.col("text")))
    return I.respond(b, I.EchoGeneration(), prompt).select("item_id", "response")


def embedded_texts(spark, d):
    return I.embedded(spark.read.parquet(f"{d}/benchmark.parquet"), I.HashEmbedding()).select("key", F.md5(F.array_join(F.transform("embedding", lambda x: F.format_number(x, 5)), ",").cast("binary")).alias("digest"))


def _theme_sql(col):
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({col}), '{'|'.join(k)}') THEN '{n}'" for n, k in T.THEMES) + " ELSE 'Other' END"


_W = "list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> '')"
_REC = "r AS (SELECT 'u' || (user_id % 10) AS member, event_type AS source, 'http://x/' || (event_id // 2) AS \"postUrl\", ts AS \"postedAt\", event_id FROM events)"
def _clean_sql(col):
    """A turn as one line, in SQL."""
    months = "|".join(T.MONTHS)
    mark = rf"(regexp_matches(lower(s), '^\s*(?:\d+\s+of\s+\d+|page\s+\d+|{months})\b') AND contains(lower(s), 'meeting')) OR regexp_full_match(s, '\d{{1,4}}')"
    lines = f"list_filter(list_transform(string_split({col}, chr(10)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '' AND NOT ({mark}))"
    return f"trim(regexp_replace(array_to_string({lines}, ' '), '\\s+', ' ', 'g'))"


ORACLES = {
    "corpus_composition": "SELECT 'source' AS dim, source AS key, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY ALL UNION ALL SELECT 'lang', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY ALL UNION ALL SELECT 'size', least(n_chars // 1000, 10)::VARCHAR, count(*) FROM documents GROUP BY ALL",
    "corpus_by_year": "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 2000 GROUP BY 1",
    "theme_bucket": f"SELECT {_theme_sql(chr(112) + '_name || chr(32) || p_type')} AS theme, count(*) AS n FROM part GROUP BY 1",
    "theme_by_language": f"SELECT lang, {_theme_sql('text')} AS theme, count(*) AS n FROM documents GROUP BY ALL",
    "seed_words": f"WITH x AS (SELECT doc_id, {_W.format(t='text')} AS w FROM documents) SELECT doc_id, len(w)::INT AS n, array_to_string(w[1:greatest(4, floor(len(w) * 0.5)::INT)], ' ') AS seed, greatest(1, len(w) - greatest(4, floor(len(w) * 0.5)::INT))::INT AS remaining FROM x WHERE len(w) >= 8",
    "matched_lengths": f"WITH w AS (SELECT doc_id, {_W.format(t='text')} AS w FROM documents), k AS (SELECT *, greatest(4, floor(len(w) * 0.5)::INT) AS k FROM w), x AS (SELECT doc_id, w[k + 1:] AS a, w[1:k] AS b FROM k WHERE w IS NOT NULL), y AS (SELECT *, least(len(a), len(b)) AS m FROM x) SELECT doc_id, m::INT AS m, array_to_string(a[1:m], ' ') AS a, array_to_string(b[1:m], ' ') AS b FROM y WHERE m >= 3",
    "clean_turns": "WITH x AS (SELECT conv_id, turn, " + _clean_sql("text") + " AS body FROM conversations) SELECT * FROM x WHERE length(body) >= 80",
    "speaker_turns": "WITH c AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, " + _clean_sql("replace(text, chr(10), ' ')") + " AS body FROM conversations) SELECT doc_id, pos::INT AS pos, body FROM c WHERE role = 'user' AND length(body) >= 80",
    "chair_turns": "WITH c AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, role, " + _clean_sql("replace(text, chr(10), ' ')") + " AS body FROM conversations) SELECT doc_id, pos::INT AS pos, body FROM c WHERE role = 'user' AND length(body) >= 80",
    "slugify": "SELECT page_id, right(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug, 'https://example.org' || regexp_replace(url, '^https?://[^/]+', '') AS url FROM pages",
    "url_dates": "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 2000 THEN (o_orderdate + INTERVAL 100 YEAR)::DATE ELSE o_orderdate::DATE END AS by_url, o_orderdate::DATE AS by_text FROM orders",
    "cache_keys": "SELECT doc_id, sha1('m:64:' || coalesce(text, '')) AS key FROM documents",
    "clean_replies": "SELECT item_id, trim(trim(trim(regexp_replace(' \"' || text || '\"' || chr(10), '\\s+', ' ', 'g')), '\"“”')) AS reply FROM benchmark",
    "anti_join_new": f"WITH {_REC}, o AS (SELECT * FROM r WHERE \"postedAt\" < '2024-01-10'), h AS (SELECT member, source, max(\"postedAt\") AS mark FROM o GROUP BY ALL) SELECT event_id, r.member, r.source FROM r LEFT JOIN h USING (member, source) WHERE \"postedAt\" >= '2024-01-05' AND coalesce(\"postedAt\" >= mark, true) AND NOT EXISTS (SELECT 1 FROM o WHERE o.\"postUrl\" = r.\"postUrl\")",
    "next_ids": f"WITH {_REC} SELECT event_id, (SELECT max(event_id) FROM r WHERE \"postedAt\" < '2024-01-16') + row_number() OVER (ORDER BY \"postedAt\", event_id) AS chunk_id FROM r WHERE \"postedAt\" >= '2024-01-16'",
    "high_water_mark": f"WITH {_REC} SELECT member, strftime(max(\"postedAt\"), '%Y-%m-%d') AS mark, count(DISTINCT \"postUrl\") AS urls FROM r GROUP BY member",
    "opinion_numbers": "SELECT conv_id AS source_id, turn AS chunk, 'opinion-' || conv_id || '-' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS opinion_id FROM conversations",
    "keyed_union": "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS v, count(*) AS n FROM orders GROUP BY 1",
    "json_fields": "SELECT coalesce(json_extract_string(props, '$.k'), '') AS k, count(*) AS n FROM events GROUP BY 1",
    "link_dates": "WITH x AS (SELECT o_custkey AS page, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderdate::DATE AS day FROM orders) SELECT page, min(pos)::INT AS pos, day FROM x GROUP BY page, day",
    "hash_split": "WITH x AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('0:' || doc_id), doc_id) <= 10 AS t FROM documents) SELECT source, sum(t::INT)::BIGINT AS n_test, max(doc_id) FILTER (t) AS last FROM x GROUP BY source",
}
QUERIES = {n: globals()[n] for n in (*ORACLES, "passages", "article_text", "page_body", "page_rendered", "attribution", "detectability", "responses", "embedded_texts")}
