"""Readers: parquet configs, JSON settings, macro CSV, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_config(spark: SparkSession, root: str, config: str) -> DataFrame:
    """All parquet files of a config; raises FileNotFoundError if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(f"{root}/{config}")
    except AnalysisException as e:
        raise FileNotFoundError(f"{root}/{config} has no parquet files") from e


def load_chunks(spark: SparkSession, root: str, embeddings: str = "none", provider=None) -> DataFrame:
    """Chunks by chunk_id; ``cached`` joins stored vectors, ``compute`` embeds the stance text (one call a distinct text)."""
    if embeddings not in ("none", "cached", "compute"):
        raise ValueError(f"embeddings: {embeddings!r}")
    chunks = read_config(spark, root, "chunks")
    if embeddings == "cached":
        chunks = chunks.join(read_config(spark, root, "embeddings").select("chunk_id", "embedding"), "chunk_id", "left")
    elif embeddings == "compute":
        from loomwright.functions.scalar import cache_key
        from loomwright.operators.ingest import embedded

        v = embedded(chunks, provider, "stance").select(F.col("key").alias("_key"), "embedding")
        key = cache_key(provider.model, provider.size, F.coalesce("stance", F.lit("")))
        chunks = chunks.join(v, key == F.col("_key"), "left").drop("_key")
    return chunks.orderBy("chunk_id")


def json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """key, value of a JSON object; an absent file gives no rows."""
    from pyspark.errors import AnalysisException

    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], f"key string, value {value}")
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def json_list(spark: SparkSession, path: str, element: str = "string") -> DataFrame:
    """pos, value of a JSON array."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<{element}>")).alias("pos", "value"))


#: Query settings by name, with the type of their elements.
SETTINGS = {"curated": "string", "pool": "struct<q:string,subtopic:string,dove_end:string,hawk_end:string>"}


def load_queries(spark: SparkSession, folder: str, name: str, file: str | None = None) -> DataFrame:
    """query_idx and query (curated), or the pool's q, subtopic and ends, from ``file`` (else name.json) of a
    folder; another name raises KeyError."""
    element = SETTINGS[name]
    rows = json_list(spark, f"{folder}/{file or f'{name}.json'}", element).withColumnRenamed("pos", "query_idx")
    return rows.withColumnRenamed("value", "query") if element == "string" else rows.select("query_idx", "value.*")


def load_anchors(spark: SparkSession, path: str) -> DataFrame:
    """pole, pos, text of a map of lists."""
    return json_map(spark, path, "array<string>").select(F.col("key").alias("pole"), F.posexplode("value").alias("pos", "text"))


def macro_csv(spark: SparkSession, path: str, series: str) -> DataFrame:
    """series, date, value: the date column is observation_date, DATE or the first; other text than numbers is skipped."""
    raw = spark.read.csv(path, header=True)
    date = next((c for c in ("observation_date", "DATE") if c in raw.columns), raw.columns[0])
    value = series if series in raw.columns else raw.columns[1]
    return raw.select(F.lit(series).alias("series"), F.to_date(F.try_to_timestamp(date)).alias("date"), F.expr(f"try_cast(`{value}` AS double)").alias("value")).where("value is not null and date is not null")


def feed(text: DataFrame, first: str, last: str, since=None) -> DataFrame:
    """Items of a JSON feed whose speaker has both names, on or after ``since`` (items without a date stay)."""
    clean = F.regexp_replace("value", "^﻿", "")
    items = text.select(F.inline(F.from_json(clean, "array<struct<s:string,d:string,l:string,t:string,lo:string>>")))
    who = F.lower(F.coalesce("s", F.lit("")))
    items = items.where(F.contains(who, F.lit(first.lower())) & F.contains(who, F.lit(last.lower())))
    posted = F.coalesce(F.try_to_timestamp("d"), F.try_to_timestamp("d", F.lit("M/d/yyyy h:mm:ss a")), F.try_to_timestamp("d", F.lit("M/d/yyyy")))
    items = items.withColumn("posted", F.to_date(posted))
    return items.where(F.coalesce(F.col("posted") >= F.lit(since).cast("date"), F.lit(True))) if since else items
