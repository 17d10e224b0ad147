"""Queries on listings, names, links and lookups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwright.functions import scalar as T
from loomwright.operators import ingest as I
from loomwright.operators import retrieval as R
from loomwright.sources import listing, sinks
from loomwright.sources.shared import shared_dir
from loomwright.sources.store import KeyedStore
from loomwright.streaming import incremental


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def unseen_posts(spark, d):
    """Events as posts by a stream that keeps the keys it has seen: one of each user, kind and address."""
    path = f"{d}/events.parquet"
    posts = lambda e: e.select(F.col("ts").cast("timestamp").alias("postedAt"), F.col("user_id").alias("member"), F.col("event_type").alias("source"), F.get_json_object("props", "$.k").alias("address"))
    out = shared_dir(spark, "posts")
    incremental.run_stateful(spark, f"{d}/events.parque[t]", spark.read.parquet(path).schema, out, shared_dir(spark, "posts-seen"), ("member", "source", "address"), "postedAt", prepare=posts)
    return spark.read.parquet(out).groupBy("source").agg(F.count("*").alias("posts"), F.count_distinct("member").alias("members"), F.count_distinct("address").alias("addresses"))


def stored_lengths(spark, d):
    """Lengths of texts from a store by content address that was filled twice, labelled texts first, and compacted."""
    x = _read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("key", T.cache_key("m", 64, F.col("text")))
    store = KeyedStore(spark, shared_dir(spark, "lengths"), "key string, n int", buckets=8)
    make = lambda rows: rows.select("key", F.length("text").alias("n"))
    store.fill(x.join(_read(spark, d, "labels"), "doc_id", "left_semi"), make)
    kept = store.fill(x, make)
    store.compact()
    return x.select("doc_id", "key").join(kept, "key").select("doc_id", "key", "n")


def name_slugs(spark, d):
    """Surnames, shard names and the slugs a site may use for a name."""
    c = _read(spark, d, "customer").select("c_custkey", F.concat(F.col("c_mktsegment"), F.lit(" J. "), F.replace("c_name", F.lit("#"), F.lit(" No."))).alias("name"))
    return c.select("c_custkey", T.surname(F.col("name")).alias("surname"), sinks.shard(F.col("name")).alias("shard"), F.array_join(listing.author_candidates(F.col("name")), "|").alias("slugs"), T.model_slug(F.col("name")).alias("model"))


def page_titles(spark, d):
    """Titles up to the first bar, and the slug of the address."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return _read(spark, d, "pages").select("page_id", listing.title_head(F.concat(title, F.lit(" | Site"))).alias("title"), T.link_slug(F.concat("url", F.lit(".v2.htm"))).alias("slug"))


def page_links(spark, d):
    """The address and label of every link of a page, in order."""
    p = _read(spark, d, "pages")
    return p.select("page_id", F.posexplode(listing.links(F.col("html"))).alias("pos", "a")).select("page_id", "pos", "a.href", "a.label")


def sitemap_urls(spark, d):
    p = _read(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 50).alias("part")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list(F.concat(F.lit("<url><loc> "), "url", F.lit("</loc></url>"))), ""), F.lit("</urlset>")).alias("xml"))
    return listing.sitemap_links(p, r"https?://[^<\s]+")


def _date_pages(spark, d):
    """Pages that name the days of a customer's orders in three ways."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    way = F.element_at(F.array(F.concat(F.lit("presconf"), day), F.concat(F.lit("M"), day, F.lit("meeting")), F.concat(F.lit("minutes"), day)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("page")).agg(F.array_join(F.collect_list(way), " ").alias("html"))


def meeting_days(spark, d):
    return listing.meeting_dates(_date_pages(spark, d), (r"presconf(\d{8})", r"M(\d{8})meeting"), "1996-01-01")


def paged_links(spark, d):
    """Each customer's listing of up to nine pages, of which the later ones repeat a link; up to the first page that adds none."""
    o = _read(spark, d, "orders").select(F.col("o_custkey").alias("site"), (F.col("o_orderkey") % 9).alias("page"), "o_orderkey")
    link = F.concat(F.lit("/a"), F.least("page", F.lit(4)).cast("string"))
    pages = o.groupBy("site", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", link.alias("l")))), lambda x: x["l"]).alias("links"))
    return listing.paged(pages, 7, ("site",)).select("site", "page", "href")


def near_start(spark, d):
    """Texts of 400 characters or more that hold a word near their start, or whose source is named like it."""
    x = _read(spark, d, "documents").where(F.length("text") >= 400)
    return x.where(listing.named_near_start(F.col("text"), "Any Then", F.col("source"))).select("doc_id", F.length("text").alias("n"))


def least_lengths(spark, d):
    """Documents by the length filters of the sources."""
    n = F.length("text")
    return _read(spark, d, "documents").groupBy("source").agg(*[F.count_if(n >= k).alias(f"n{k}") for k in (80, 200, 400)])


def theme_numbers(spark, d):
    """Themes by number through a map; what has none is left out; short labels."""
    numbers = F.create_map(*[x for k, (name, _) in enumerate(T.THEMES) for x in (F.lit(name), F.lit(k))])
    p = _read(spark, d, "part").select(T.theme_of(F.concat_ws(" ", "p_name", "p_type")).alias("theme"))
    p = p.select("theme", F.try_element_at(numbers, F.col("theme")).alias("number")).where("number is not null")
    return p.groupBy("number", T.short_theme(F.col("theme")).alias("label")).agg(F.count("*").alias("n"))


def ages(spark, d):
    at = F.lit("1998-08-02").cast("date")
    o = _read(spark, d, "orders")
    return o.select("o_orderkey", F.round(R.age_in_years(F.to_date("o_orderdate"), at), 6).alias("age"), F.round(F.exp(-F.greatest(R.age_in_years(F.to_date("o_orderdate"), at), F.lit(0.0)) / 2.0), 6).alias("fresh"))


def halves(spark, d):
    """Each conversation's first half of turns against its second."""
    c = _read(spark, d, "conversations")
    w = Window.partitionBy("conv_id")
    x = c.withColumn("first", F.row_number().over(w.orderBy("turn")) <= F.floor(F.count("*").over(w) / 2))
    return x.groupBy("conv_id").agg(F.count_if("first").cast("long").alias("n_first"), F.count_if(~F.col("first")).cast("long").alias("n_second"))


def tidy_texts(spark, d):
    x = _read(spark, d, "documents")
    return x.select("doc_id", F.md5(T.tidy_lines(F.replace("text", F.lit(". "), F.lit(" \n \n"))).cast("binary")).alias("digest"))


def opinions(spark, d):
    """The stand-in's opinions of every passage of every document, numbered."""
    return I.extracted(_read(spark, d, "documents").select("doc_id", "text"), I.SentenceOpinions()).select("doc_id", "opinion_id", "topic", F.length("quote").alias("n"))


_NAME = "c_mktsegment || ' J. ' || replace(c_name, '#', ' No.')"
_WORDS = f"list_filter(string_split(replace(lower({_NAME}), '.', ''), ' '), lambda v: v <> '')"
ORACLES = {
    "name_slugs": f"""WITH x AS (SELECT c_custkey, {_NAME} AS name, {_WORDS} AS w FROM customer), y AS (SELECT *, [array_to_string(w, '_'), w[1] || '_' || w[-1]] AS s FROM x)
        SELECT c_custkey, upper(string_split(name, ' ')[-1]) AS surname, replace(replace(lower(name), ' ', '_'), '.', '') AS shard, array_to_string(list_filter(s, lambda v, i: list_position(s, v) = i), '|') AS slugs, regexp_replace(name, '[^A-Za-z0-9.-]+', '_', 'g') AS model FROM y""",
    "page_titles": "SELECT page_id, trim(string_split(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) || ' | Site', '|')[1]) AS title, CASE WHEN split_part(url || '.v2.htm', '/', -1) = '' THEN url ELSE regexp_replace(split_part(url || '.v2.htm', '/', -1), '\\.[^.]*$', '') END AS slug FROM pages",
    "page_links": r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>')) AS a, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["''][^"'']*["''][^>]*>.*?</a>'), 1) - 1 AS pos FROM pages)
        SELECT page_id, pos::INT AS pos, regexp_extract(a, '(?is)^<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS href, trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS label FROM a""",
    "sitemap_urls": "SELECT DISTINCT url FROM pages",
    "meeting_days": "SELECT DISTINCT o_orderdate::DATE AS date FROM orders WHERE o_orderkey % 3 < 2 AND o_orderdate >= DATE '1996-01-01'",
    "paged_links": """WITH l AS (SELECT DISTINCT o_custkey AS site, o_orderkey % 9 AS page, '/a' || least(o_orderkey % 9, 4) AS href FROM orders WHERE o_orderkey % 9 < 7), f AS (SELECT site, href, min(page) AS page FROM l GROUP BY ALL),
        s AS (SELECT l.site, min(l.page) AS stop FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.site = l.site AND f.page = l.page) GROUP BY l.site) SELECT f.site, f.page, f.href FROM f LEFT JOIN s USING (site) WHERE stop IS NULL OR f.page < stop""",
    "near_start": "SELECT doc_id, length(text)::INT AS n FROM documents WHERE length(text) >= 400 AND (contains(lower(substr(text, 1, 1500)), 'then') OR contains(lower(source), 'then'))",
    "least_lengths": "SELECT source, " + ", ".join(f"count(*) FILTER (length(text) >= {k}) AS n{k}" for k in (80, 200, 400)) + " FROM documents GROUP BY source",
    "theme_numbers": "SELECT list_position([" + ", ".join(f"'{n}'" for n, _ in T.THEMES) + "], theme)::INT - 1 AS number, rtrim(string_split(theme, ' ')[1], '&') AS label, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(p_name || ' ' || p_type), '{'|'.join(k)}') THEN '{n}'" for n, k in T.THEMES) + " ELSE 'Other' END AS theme FROM part) WHERE theme <> 'Other' GROUP BY 1, 2",
    "ages": "SELECT o_orderkey, round(datediff('day', o_orderdate::DATE, DATE '1998-08-02') / 365.25::DOUBLE, 6) AS age, round(exp(-greatest(datediff('day', o_orderdate::DATE, DATE '1998-08-02') / 365.25::DOUBLE, 0) / 2.0), 6) AS fresh FROM orders",
    "halves": "SELECT conv_id, (count(*) // 2)::BIGINT AS n_first, (count(*) - count(*) // 2)::BIGINT AS n_second FROM conversations GROUP BY conv_id",
    "tidy_texts": "SELECT doc_id, md5(regexp_replace(replace(text, '. ', ' ' || chr(10) || ' ' || chr(10)), '\\s+\\n', chr(10), 'g')) AS digest FROM documents",
    "stored_lengths": "SELECT doc_id, sha1('m:64:' || coalesce(text, '')) AS key, length(coalesce(text, ''))::INT AS n FROM documents",
    "unseen_posts": "SELECT source, count(*) AS posts, count(DISTINCT member) AS members, count(DISTINCT address) AS addresses FROM (SELECT DISTINCT user_id AS member, event_type AS source, json_extract_string(props, '$.k') AS address FROM events) GROUP BY source",
}
QUERIES = {n: globals()[n] for n in (*ORACLES, "opinions")}
