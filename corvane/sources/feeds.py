"""Feeds: RSS files to normalised items, the source registry, and gazetteer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vocab import CATEGORIES, ENTITIES, REGIONS, TOPICS

ITEM = "title string, link string, description string, pubDate string, category array<string>"
SOURCE = "source_id string, name string, is_wire boolean, default_tz string, language string"

# Registered sources, and the feeds of each.
SOURCES = [
    ("antara", "ANTARA", True, "Asia/Jakarta", "id"),
    ("cnbc", "CNBC Indonesia", False, "Asia/Jakarta", "id"),
    ("cnnid", "CNN Indonesia", False, "Asia/Jakarta", "id"),
    ("republika", "Republika", False, "Asia/Jakarta", "id"),
    ("sindonews", "SINDOnews", False, "Asia/Jakarta", "id"),
]
FEEDS = [
    ("antara", "https://www.antaranews.com/rss/terkini.xml"),
    ("antara", "https://www.antaranews.com/rss/ekonomi.xml"),
    ("antara", "https://www.antaranews.com/rss/politik.xml"),
    ("antara", "https://www.antaranews.com/rss/hukum.xml"),
    ("antara", "https://www.antaranews.com/rss/tekno.xml"),
    ("antara", "https://www.antaranews.com/rss/olahraga.xml"),
    ("antara", "https://www.antaranews.com/rss/dunia.xml"),
    ("cnnid", "https://www.cnnindonesia.com/nasional/rss"),
    ("cnnid", "https://www.cnnindonesia.com/ekonomi/rss"),
    ("cnbc", "https://www.cnbcindonesia.com/rss"),
    ("republika", "https://www.republika.co.id/rss"),
    ("sindonews", "https://sindonews.com/feed"),
]


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, SOURCE)


def registry(spark: SparkSession) -> DataFrame:
    """One row per registered feed."""
    return spark.createDataFrame(FEEDS, "source_id string, feed_url string").join(F.broadcast(sources(spark)), "source_id")


def read_items(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Raw items of RSS files at any depth; files that cannot be parsed give no items instead of an error."""
    reader = spark.readStream if streaming else spark.read
    rows = reader.format("xml").option("rowTag", "item").option("mode", "DROPMALFORMED").schema(ITEM).load(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def file_status(spark: SparkSession, landing: str) -> DataFrame:
    """source_id, files, errors of the feed files in ``landing/<source_id>/``: an error is a file without a whole item."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(landing)
    whole = F.col("value").contains("</item>") & F.col("value").contains("</rss>")
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("source_id"), whole.alias("whole"))
    out = rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("files"), F.sum((~F.col("whole")).cast("long")).alias("errors"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "error").otherwise("ok"))


def normalize(items: DataFrame, source: DataFrame, cap: int = T.EXCERPT) -> DataFrame:
    """Items with their source's columns to normalised rows; items without title or link are dropped.

    ``source`` has source_id, default_tz, language and is joined on the items' source_id.
    """
    rows = items.join(F.broadcast(source.select("source_id", "default_tz", "language", "is_wire")), "source_id")
    rows = rows.withColumn("title", T.element_text(F.col("title"))).withColumn("url", T.element_text(F.col("link")))
    rows = rows.where(F.col("title").isNotNull() & F.col("url").isNotNull())
    return rows.select(
        "source_id", "url", T.canonical_url(F.col("url")).alias("canonical_url"), "title",
        T.excerpt(T.element_text(F.col("description")), cap).alias("excerpt"),
        T.published_at(F.col("pubDate"), F.col("default_tz")).alias("published_at"), F.col("default_tz").alias("published_tz"),
        "language", T.element_text(F.get("category", F.lit(0))).alias("raw_category"), "is_wire",
        *[c for c in ("arrived", "ingest_seq") if c in items.columns],
    )


def topic_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, k) for t, ks in TOPICS.items() for k in ks], "topic string, keyword string")


def category_topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES.items()), "category string, topic string")


def entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITIES, "entity_id string, name string, kind string, acronyms array<string>, aliases array<string>")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region_id string, name string, region_type string, parent_id string, aliases array<string>")


def region_ancestors(spark: SparkSession) -> DataFrame:
    """(region_id, ancestor_id) for every region and all regions above it, itself included."""
    r = regions(spark).select("region_id", "parent_id")
    out = r.select("region_id", F.col("region_id").alias("ancestor_id"))
    step = r.where("parent_id IS NOT NULL").select("region_id", F.col("parent_id").alias("ancestor_id"))
    for _ in range(4):  # country, province, city, district
        out = out.unionByName(step)
        up = r.where("parent_id IS NOT NULL").select(F.col("region_id").alias("ancestor_id"), "parent_id")
        step = step.join(F.broadcast(up), "ancestor_id").select("region_id", F.col("parent_id").alias("ancestor_id"))
    return out.distinct()


def ambiguous_surfaces(entries: DataFrame, key: str = "entity_id") -> DataFrame:
    """Names and aliases that more than one entry claims."""
    s = entries.select(key, F.explode(F.array_union(F.array("name"), "aliases")).alias("surface")).withColumn("surface", F.lower("surface"))
    return s.groupBy("surface").agg(F.countDistinct(key).alias("n")).where("n > 1")
