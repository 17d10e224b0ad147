"""Documents behind listings: feeds, link pages, sitemaps, transcripts.  Fetching is a provider.

A provider has ``fetch(url) -> str``: the page, or the text of a document; "" where there
is none.  It is called in Arrow batches, some calls at a time; a failed call is "".
Everything else is a plan over the fetched rows.  Clocks are arguments.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from loomwright.functions import scalar as T
from loomwright.operators import ingest as I
from loomwright.sources import pages, readers

#: A record's columns in order.
RECORD = ("record_id", "text", "caption", "handle", "postedAt", "source", "postUrl", "postId", "location", "accessedAt", "probabilitySpeaker")


class Shelf:
    """A provider that knows a few addresses."""

    def __init__(self, texts: dict[str, str]):
        self.texts = texts

    def fetch(self, url: str) -> str:
        return self.texts[url]


def fetched(rows: DataFrame, provider, url: str = "url", out: str = "body", workers: int = 8) -> DataFrame:
    """``rows`` with what the provider has at each address; null addresses and failed calls give ""."""
    names = rows.columns

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor

        def get(address):
            try:
                return provider.fetch(address) or "" if address else ""
            except Exception:
                return ""

        with ThreadPoolExecutor(workers) as pool:
            for batch in batches:
                for at in range(0, batch.num_rows, 8 * workers):
                    b = batch.slice(at, 8 * workers)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(pool.map(get, b.column(names.index(url)).to_pylist())), pa.string())], names=[*names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def text_by(rows: DataFrame, rule: Callable[[str | None], str], body: str = "body", out: str = "text") -> DataFrame:
    """``rows`` with the text that a rule of ``pages`` finds in a page."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                b = batch.slice(at, 100)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([rule(x) for x in b.column(names.index(body)).to_pylist()], pa.string())], names=[*names, out])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def records(rows: DataFrame, kind: str, source: str, handle: str, now: datetime.datetime) -> DataFrame:
    """The record columns of rows with text, url, slug, and where they have them caption, posted, location."""
    have = set(rows.columns)
    get = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    out = {
        "record_id": F.concat(F.lit(f"{kind}-"), F.col("slug")), "text": F.col("text"), "caption": get("caption", "string"), "handle": F.lit(handle), "postedAt": get("posted", "timestamp_ntz"), "source": F.lit(source),
        "postUrl": F.col("url"), "postId": F.col("slug"), "location": get("location", "string"), "accessedAt": F.lit(now).cast("timestamp"), "probabilitySpeaker": F.lit(1.0),
    }
    return rows.select(*[out[c].alias(c) for c in RECORD])


# --- feeds and biographies -----------------------------------------------------------------


def feed_records(feed: DataFrame, provider, speaker: str, kind: str, source: str, base: str, now: datetime.datetime, since=None) -> DataFrame:
    """Records of a JSON feed's items of a speaker (see ``readers.feed``), with their pages' article text; empty bodies are dropped."""
    first, last = name_parts(speaker)
    items = readers.feed(feed, first, last, since)
    link = F.coalesce("l", F.lit(""))
    rows = items.select(T.absolute_url(link, base).alias("url"), T.link_slug(link).alias("slug"), F.coalesce("t", F.lit("")).alias("caption"), "posted", F.coalesce("lo", F.lit("")).alias("location"))
    rows = text_by(fetched(rows, provider), pages.article_text).where(F.length("text") > 0)
    return records(rows, kind, source, speaker, now)


def links(html: Column) -> Column:
    """(href, label) of every anchor of a page, in order; labels without tags, white space collapsed."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"), 0)
    href = lambda a: F.regexp_extract(a, r"(?is)^<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']", 1)
    label = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "(?s)<[^>]*>", " "), r"\s+", " "))
    return F.transform(anchors, lambda a: F.struct(href(a).alias("href"), label(a).alias("label")))


def bio_record(index: DataFrame, provider, speaker: str, base: str, now: datetime.datetime) -> DataFrame:
    """The record of the first link of an index page (html) whose label holds both names; posted today."""
    first, last = name_parts(speaker)
    low = lambda x: F.lower(x["label"])
    mine = F.filter(links(F.col("html")), lambda x: F.contains(low(x), F.lit(first)) & F.contains(low(x), F.lit(last)))
    rows = index.select(F.get(mine, F.lit(0))["href"].alias("href")).where("href is not null")
    rows = rows.select(T.absolute_url(F.col("href"), base).alias("url"), T.link_slug(F.col("href")).alias("slug"), F.lit(f"{speaker} — biography").alias("caption"), F.lit(now.date()).alias("posted"))
    return records(text_by(fetched(rows, provider), pages.article_text).where(F.length("text") > 0), "bio", "bio", speaker, now)


def union_by_id(*parts: DataFrame) -> DataFrame:
    """One row a record_id: of equal ids the later part's."""
    rows = reduce(lambda a, b: a.unionByName(b), [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)])
    last = F.row_number().over(Window.partitionBy("record_id").orderBy(F.col("_part").desc(), "postUrl"))
    return rows.withColumn("_r", last).where("_r = 1").drop("_r", "_part")


def name_parts(name: str) -> tuple[str, str]:
    """First and last word of a name, in lower case; empty where there is none."""
    words = name.lower().split()
    return (words[0], words[-1]) if words else ("", "")


# --- transcripts and press conferences --------------------------------------------------------


def dated_links(html: DataFrame, pattern: str, by: tuple[str, ...] = ("page",)) -> DataFrame:
    """by..., pos, day: the first link of each date on each page (html), by position; group 1 of the pattern is yyyyMMdd."""
    found = html.select(*by, F.posexplode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("pos", "day"))
    r = F.row_number().over(Window.partitionBy(*by, "day").orderBy("pos"))
    return found.withColumn("r", r).where("r = 1").select(*by, "pos", F.to_date(F.try_to_timestamp("day", F.lit("yyyyMMdd"))).alias("day"))


def meeting_dates(html: DataFrame, patterns: Iterable[str], since=None) -> DataFrame:
    """date: every date (yyyyMMdd, group 1) that any pattern finds on any page, once, in order."""
    found = reduce(lambda a, b: a.unionByName(b), [html.select(F.explode(F.regexp_extract_all("html", F.lit(p), 1)).alias("day")) for p in patterns])
    dates = found.select(F.to_date(F.try_to_timestamp("day", F.lit("yyyyMMdd"))).alias("date")).where("date is not null").distinct()
    return (dates.where(F.col("date") >= F.lit(since).cast("date")) if since else dates).orderBy("date")


def transcript_years(spark: SparkSession, now: datetime.date, since: datetime.date | None = None) -> DataFrame:
    """The years with public transcripts: from ``since`` or eleven years back, to four years back."""
    low = since.year if since else now.year - 11
    return spark.range(low, max(low, now.year - 3)).select(F.col("id").cast("int").alias("year"))


def spoken_records(meetings: DataFrame, provider, speaker: str, source: str, now: datetime.datetime, chair: bool = False, least: int = 80, most: int | None = None) -> DataFrame:
    """Records of a speaker's turns in the documents of dated meetings (date, url); what isn't there is skipped.

    With ``most`` only the first meetings in order of date are read.
    """
    rows = meetings.orderBy("date").limit(most) if most else meetings
    text = fetched(rows.select("date", "url"), provider, out="text").where(F.length("text") > 0)
    day = F.date_format("date", "yyyyMMdd").alias("doc_id")
    said = (I.chair_turns if chair else I.turns)(text.select(day, "text"), F.lit(name_parts(speaker)[1]), least)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    said = said.withColumn("n", place).join(text.select(day, "url", F.col("date").alias("posted")), "doc_id")
    return records(said.select(F.col("body").alias("text"), "url", "posted", F.concat_ws("-", "doc_id", "n").alias("slug")), source, source, speaker, now)


# --- banks: listings, sitemaps, pages ----------------------------------------------------------


def author_candidates(name: Column) -> Column:
    """Slugs that a site may use for an author: all names, then first and last; each once.  One name alone has none."""
    w = F.filter(F.split(F.lower(F.replace(name, F.lit("."), F.lit(""))), r"\s+"), lambda x: F.length(x) > 0)
    both = F.array_distinct(F.array(F.array_join(w, "_"), F.concat_ws("_", F.get(w, F.lit(0)), F.try_element_at(w, F.lit(-1)))))
    return F.when(F.size(w) > 1, both).otherwise(F.array().cast("array<string>"))


def titled(listing: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The paged listings (page from 0, title) whose first page's title holds the surname; other sites' pages go."""
    right = listing.where((F.col("page") == 0) & F.contains(F.lower("title"), F.lit(name_parts(name)[1]))).select(*by).distinct()
    return listing.join(right, list(by), "left_semi") if by else listing.join(F.broadcast(right.select(F.lit(1))), F.lit(True), "left_semi")


def discovered_slug(index: DataFrame, provider, name: str, base: str, most: int = 40) -> DataFrame:
    """slug, one row or none: the author's slug on the page behind the first link of an index (page from 0, html; ``most``
    pages) whose label holds both names before its colon, and that leads to an author."""
    first, last = name_parts(name)
    found = index.where(F.col("page") < most).select("page", F.posexplode(links(F.col("html"))).alias("pos", "link"))
    speaker = F.lower(F.substring_index("link.label", ":", 1))
    found = found.where(F.contains(speaker, F.lit(first)) & F.contains(speaker, F.lit(last)))
    behind = fetched(found.select("page", "pos", T.absolute_url(F.col("link.href"), base).alias("url")), provider)
    hrefs = F.transform(links(F.col("body")), lambda x: F.regexp_extract(x["href"], r"/author/([a-z0-9_]+)\.htm", 1))
    slug = F.get(F.filter(hrefs, lambda x: x != ""), F.lit(0))
    return behind.select("page", "pos", slug.alias("slug")).where("slug is not null").orderBy("page", "pos").limit(1).select("slug")


def resolved_slug(cache: Column, candidate: Column, discovered: Column) -> Column:
    """What is known, else the first candidate that answered, else what the index page named; empty is none."""
    some = lambda c: F.when(F.length(c) > 0, c)
    return F.coalesce(some(cache), some(candidate), some(discovered))


def paged(listing: DataFrame, most: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., page, pos, href: the links of paged listings (page from 0, links in order), each where it stands
    first, up to the first page that adds none, and ``most`` pages at most."""
    some = listing.where(F.col("page") < most)
    found = some.select(*by, "page", F.posexplode("links").alias("pos", "href"))
    first = found.groupBy(*by, "href").agg(F.min(F.struct("page", "pos")).alias("at")).select(*by, "at.page", "at.pos", "href")
    new = some.select(*by, "page").join(first.groupBy(*by, "page").agg(F.count("*").alias("new")), [*by, "page"], "left")
    stop = new.groupBy(*by).agg(F.coalesce(F.min(F.when(F.coalesce("new", F.lit(0)) == 0, F.col("page"))), F.lit(most)).alias("stop"))
    upto = first.join(stop, list(by)) if by else first.crossJoin(F.broadcast(stop))  # one row
    return upto.where("page < stop").select(*by, "page", "pos", "href").orderBy(*by, "page", "pos")


def sitemap_links(sitemap: DataFrame, pattern: str) -> DataFrame:
    """url: the addresses of a sitemap (xml) that match, each once, sorted."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("xml", F.lit(rf"<loc>\s*({pattern})\s*</loc>"), 1)))
    return sitemap.select(F.explode(found).alias("url")).distinct().orderBy("url")


def named_near_start(text: Column, name: str, title: Column | None = None, within: int = 1500) -> Column:
    """True if the surname stands in the first characters, or in the title."""
    last = F.lit(name_parts(name)[1])
    here = F.contains(F.lower(F.substring(text, 1, within)), last)
    return F.coalesce(here | F.contains(F.lower(title), last) if title is not None else here, F.lit(False))


def page_records(rows: DataFrame, provider, speaker: str, source: str, now: datetime.datetime, date_pattern: str | None = None, since=None, attachment: Callable[[str | None], str] | None = None, least: int = 400, short: int = 1500) -> DataFrame:
    """Records of listed pages (url): body text, date from the address or else from the page, the lower bound on
    dated pages, and the name near the start or in the title.

    Pages of under ``short`` characters are set against the document they link to
    (``attachment`` gives its address) and the longer text is taken; texts under ``least`` are dropped.
    """
    rows = text_by(fetched(rows.select("url").distinct(), provider), pages.body_text)
    if attachment:
        other = text_by(rows, lambda html: (attachment(html) or "") if html else "", out="_link")
        other = fetched(other.withColumn("_link", F.when((F.length("text") < short) & (F.length("_link") > 0), F.col("_link"))), provider, "_link", "_attached")
        rows = other.withColumn("text", F.when(F.length("_attached") > F.length("text"), F.col("_attached")).otherwise(F.col("text"))).drop("_link", "_attached")
    by_url = T.url_date(F.col("url"), date_pattern) if date_pattern else F.lit(None).cast("date")
    title = title_head(F.regexp_extract("body", r"(?is)<title[^>]*>(.*?)</title>", 1))
    rows = rows.select("url", "text", F.coalesce(by_url, T.page_date(F.col("text"))).alias("posted"), title.alias("caption"), T.slug(F.col("url")).alias("slug"))
    rows = rows.where((F.length("text") >= least) & named_near_start(F.col("text"), speaker, F.col("caption")))
    rows = rows.where(F.coalesce(F.col("posted") >= F.lit(since).cast("date"), F.lit(True))) if since else rows
    return records(rows, source, source, speaker, now)


def title_head(title: Column) -> Column:
    """The part of a title before the first bar, trimmed."""
    return F.trim(F.substring_index(title, "|", 1))


# --- series and hubs ----------------------------------------------------------------------------


def yearly(read: Callable[[int], DataFrame], first: int, last: int) -> DataFrame:
    """series, date, value of a long range, read year by year; of equal dates the later year's reading."""
    parts = [read(y).select("series", "date", "value").withColumn("_year", F.lit(y)) for y in range(first, last + 1)]
    rows = reduce(lambda a, b: a.unionByName(b), parts)
    return rows.groupBy("series", "date").agg(F.max_by("value", "_year").alias("value"))


def macro_table(series: Iterable[DataFrame], path: str) -> DataFrame:
    """series, date, value of several series as one table, written once, a folder a series; later calls read it."""
    from pyspark.errors import AnalysisException

    parts = list(series)
    spark = parts[0].sparkSession
    try:
        return spark.read.schema("date date, value double, series string").parquet(path).select("series", "date", "value")
    except AnalysisException:
        reduce(lambda a, b: a.unionByName(b), [p.select("series", "date", "value") for p in parts]).write.partitionBy("series").parquet(path)
    return spark.read.schema("date date, value double, series string").parquet(path).select("series", "date", "value")


class Hub:
    """A published dataset: the split of a config as a folder that Spark reads.  ``locate`` is the provider."""

    def __init__(self, locate: Callable[[str, str], str]):
        self.locate = locate

    def read(self, spark: SparkSession, config: str, split: str = "train") -> DataFrame:
        return spark.read.parquet(self.locate(config, split))
