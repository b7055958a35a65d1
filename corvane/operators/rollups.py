"""Counts of topics, actors and regions over enrichments, and served quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import small_side
from .compliance import hidden_entities, quote_allowed


def topic_rollup(enrichments: DataFrame) -> DataFrame:
    t = enrichments.select(F.explode("topics").alias("t")).select("t.topic", "t.confidence")
    out = t.groupBy("topic").agg(F.count(F.lit(1)).alias("article_count"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return out.orderBy(F.desc("article_count"), "topic")


def region_rollup(enrichments: DataFrame) -> DataFrame:
    r = enrichments.select(F.explode("regions").alias("r")).select("r.name", "r.region_type", "r.confidence")
    out = r.groupBy("name", "region_type").agg(F.count(F.lit(1)).alias("article_count"), F.round(F.avg("confidence"), 4).alias("avg_confidence"))
    return out.orderBy(F.desc("article_count"), "name")


def actor_rollup(enrichments: DataFrame, registry: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Visible actors by identity; display and kind are those of the last mention by ``order``."""
    a = enrichments.select(F.col(order).alias("_seq"), F.explode("actors").alias("a"))
    key = F.coalesce(F.col("a.entity_id"), F.concat(F.lit("key:"), F.col("a.canonical_key")))
    a = a.withColumn("actor_id", key).withColumn("entity_id", F.col("a.entity_id"))
    a = a.join(small_side(hidden_entities(registry)), "entity_id", "left_anti")
    last = F.max_by(F.struct(F.col("a.display").alias("display"), F.col("a.kind").alias("kind")), F.struct("_seq", F.col("a.start")))
    out = a.groupBy("actor_id", "entity_id").agg(F.count(F.lit(1)).alias("article_count"), last.alias("m"))
    out = out.join(small_side(registry.select("entity_id", "legal_status")), "entity_id", "left")
    out = out.select("actor_id", F.col("m.display").alias("display"), F.col("m.kind").alias("kind"), "article_count", "legal_status")
    return out.orderBy(F.desc("article_count"), "display")


def served_quotes(enrichments: DataFrame, registry: DataFrame, speaker_key: str | None = None) -> DataFrame:
    """Quotes that may be served, best first. ``speaker_key`` must occur in the speaker's canonical key."""
    q = enrichments.select("article_id", F.explode("quotes").alias("q")).select("article_id", "q.*")
    q = q.where(quote_allowed(F.col("confidence"), F.col("source_paragraph_url"), F.col("attribution_status")))
    q = q.where(F.col("speaker_display").isNotNull())
    q = q.join(small_side(hidden_entities(registry).withColumnRenamed("entity_id", "speaker_entity_id")), "speaker_entity_id", "left_anti")
    if speaker_key:
        q = q.where(F.col("speaker_key").contains(speaker_key))
    return q.orderBy(F.desc("confidence"), "quote_text")
