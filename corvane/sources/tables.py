"""Article tables: first-wins dedup, idempotent appends, derived tables and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import dedup_key, hours


def as_articles(items: DataFrame, arrived) -> DataFrame:
    """Normalised items as article rows; ``arrived`` is the ingest time (a timestamp column)."""
    key = dedup_key(F.col("canonical_url"))
    return items.withColumns({"article_id": key, "dedup_key": key, "first_seen_hours": hours(arrived)})


def first_wins(rows: DataFrame, key: str = "dedup_key", order: str = "ingest_seq") -> DataFrame:
    """The first row of each key; ranking to one row is done before the shuffle as well."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def absent(rows: DataFrame, existing: DataFrame, key: str = "dedup_key") -> DataFrame:
    return rows.join(existing.select(key), key, "left_anti")


def append_new(spark: SparkSession, rows: DataFrame, path: str, key: str = "dedup_key") -> int:
    """Append rows whose key the table does not have yet; the number of rows appended."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    new = rows if old is None else absent(rows, old, key)
    before = 0 if old is None else old.count()
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def with_clusters(articles: DataFrame, clustered: DataFrame, origins: DataFrame) -> DataFrame:
    """Articles with their current cluster and origin, joined at read time instead of updated in place."""
    c = clustered.select("article_id", F.col("cluster_id").alias("content_cluster_id"))
    o = origins.select(F.col("cluster_id").alias("content_cluster_id"), F.col("origin_source_id").alias("original_source_id"))
    return articles.join(c, "article_id", "left").join(o, "content_cluster_id", "left")


def source_status(log: DataFrame) -> DataFrame:
    """source_id, status, article_count, error_count from a log(source_id, seq, status, new)."""
    return log.groupBy("source_id").agg(
        F.max_by("status", "seq").alias("status"), F.sum(F.coalesce("new", F.lit(0))).alias("article_count"),
        F.sum((F.col("status") == "error").cast("long")).alias("error_count"),
    )


def register_actors(registry: DataFrame, enrichments: DataFrame) -> DataFrame:
    """The registry with a record for each gazetteer entity that it did not have."""
    a = enrichments.select(F.explode("actors").alias("a")).where("a.entity_id IS NOT NULL")
    new = a.groupBy(F.col("a.entity_id").alias("entity_id")).agg(F.max("a.display").alias("display"), F.max("a.kind").alias("kind"))
    new = new.join(registry.select("entity_id"), "entity_id", "left_anti")
    off = F.lit(False)
    new = new.select("entity_id", "display", "kind", F.lit(None).cast("string").alias("legal_status"), off.alias("suppressed"), off.alias("is_minor"), off.alias("is_sensitive_victim"))
    return registry.select(new.columns).unionByName(new)
