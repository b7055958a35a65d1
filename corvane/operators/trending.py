"""Trend boards: bounded scores that count independent origins, never carriers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions.vocab import ACTOR_IMPORTANCE, REGION_IMPORTANCE, WINDOWS
from ..plans.scratch import small_side
from .compliance import hidden_entities

TYPES = ("topic", "actor", "region", "source")
MAX_LIMIT = 100
# Weights of a mention, and of a source's originality.
QUOTED, IN_TITLE, ACTOR_CAP, REGION_CAP, LEAST_ARTICLES = 1.5, 1.3, 2.0, 1.5, 3


def check_request(kind: str, window: str, limit: int) -> tuple[float, float]:
    """Span and half-life of a window; ValueError for a request that is not served."""
    if kind not in TYPES:
        raise ValueError(f"unknown trend type {kind!r}")
    if window not in WINDOWS:
        raise ValueError(f"unknown window {window!r}")
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}")
    return WINDOWS[window]


def in_window(rows: DataFrame, as_of: float, span: float, column: str = "first_seen_hours") -> DataFrame:
    """Rows from ``as_of - span`` to ``as_of``, both included, with their age. The filter is on the stored column."""
    return rows.where(F.col(column).between(as_of - span, as_of)).withColumn("age_hours", F.lit(float(as_of)) - F.col(column))


def trend_scores(mentions: DataFrame, half_life: float, baselines: DataFrame | None = None, scale: float | None = None) -> DataFrame:
    """Scores of all targets of ``mentions(target_id, target_name, origin, age_hours, weight, importance)``.

    Decayed weights are summed per target and origin first, and their logarithms per target, so both shuffles carry
    partial sums. ``baselines(target_id, baseline)`` are mean distinct origins of earlier windows (0 if missing);
    ``scale`` replaces the batch's own 95th percentile.
    """
    w = F.sum(S.decay(F.col("age_hours"), half_life) * F.col("weight"))
    per = mentions.groupBy("target_id", "origin").agg(
        w.alias("w"), F.count(F.lit(1)).alias("n"), F.max("target_name").alias("target_name"), F.max("importance").alias("importance")
    )
    board = per.groupBy("target_id").agg(
        F.max("target_name").alias("target_name"), F.sum(F.log1p("w")).alias("volume"), F.sum("w").alias("weighted_mentions"),
        F.count(F.lit(1)).alias("distinct_sources"), F.sum("n").alias("mentions"), F.max("importance").alias("importance"),
    )
    base = F.lit(0.0)
    if baselines is not None:
        board = board.join(baselines.select("target_id", "baseline"), "target_id", "left")
        base = F.coalesce("baseline", F.lit(0.0))
    n = F.col("distinct_sources")
    board = board.withColumn("burst", S.burst(n, base)).withColumn("raw", S.raw_score(F.col("volume"), n, F.col("importance"), base))
    board = board.withColumn("eligible", S.eligible(F.col("mentions"), n))
    return _scaled(board, scale).drop("baseline")


def _scaled(board: DataFrame, scale: float | None) -> DataFrame:
    if scale is not None:
        return board.withColumn("scale", F.lit(float(scale))).withColumn("score", S.normalized(F.col("raw"), F.col("scale")))
    one = board.agg(S.p95_scale().alias("scale"))
    return board.join(F.broadcast(one)).withColumn("score", S.normalized(F.col("raw"), F.col("scale")))  # one row


def top(board: DataFrame, limit: int, key: str = "target_id") -> DataFrame:
    """The eligible targets with the largest raw scores; ties go to the smaller id."""
    return board.where("eligible").orderBy(F.desc("raw"), F.asc(key)).limit(limit)


def _importance(kind: Column, values: dict[str, float], cap: float) -> Column:
    out = F.lit(1.0)
    for k, v in values.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return F.least(out, F.lit(cap))


def project(articles: DataFrame, enrichments: DataFrame, as_of: float, span: float) -> DataFrame:
    """Articles of a window with their enrichment, origin and age."""
    rows = in_window(articles, as_of, span).join(enrichments.select("article_id", "topics", "actors", "regions", "quotes"), "article_id")
    origin = F.coalesce("original_source_id", "source_id")
    return rows.withColumn("origin", origin).withColumn("is_origin", F.col("original_source_id").isNull() | F.col("original_source_id").eqNullSafe(F.col("source_id")))


def topic_mentions(projected: DataFrame) -> DataFrame:
    t = projected.select("origin", "age_hours", F.explode("topics").alias("t"))
    return t.select(F.col("t.topic").alias("target_id"), F.col("t.topic").alias("target_name"), "origin", "age_hours", F.lit(1.0).alias("weight"), F.lit(1.0).alias("importance"))


def actor_mentions(projected: DataFrame, in_title: bool = False) -> DataFrame:
    """Mentions of actors; a quoted actor weighs more, and with ``in_title`` one named in the headline too."""
    speakers = F.filter(F.transform("quotes", lambda q: q["speaker_entity_id"]), lambda e: e.isNotNull())
    a = projected.select("origin", "age_hours", "title", speakers.alias("speakers"), F.explode("actors").alias("a"))
    key = F.coalesce(F.col("a.entity_id"), F.concat(F.lit("key:"), F.col("a.canonical_key")))
    quoted = F.coalesce(F.array_contains("speakers", F.col("a.entity_id")), F.lit(False))
    weight = F.when(quoted, QUOTED).otherwise(1.0)
    if in_title:
        weight = weight * F.when(F.col("a.start") < F.length("title"), IN_TITLE).otherwise(1.0)
    return a.select(key.alias("target_id"), F.col("a.display").alias("target_name"), "origin", "age_hours", weight.alias("weight"), _importance(F.col("a.kind"), ACTOR_IMPORTANCE, ACTOR_CAP).alias("importance"))


def region_mentions(projected: DataFrame) -> DataFrame:
    r = projected.select("origin", "age_hours", F.explode("regions").alias("r"))
    return r.select(
        F.col("r.region_id").alias("target_id"), F.col("r.name").alias("target_name"), "origin", "age_hours",
        S.clamp(0.5 + F.col("r.confidence"), 0.5, 1.5).alias("weight"), _importance(F.col("r.region_type"), REGION_IMPORTANCE, REGION_CAP).alias("importance"),
    )


def source_scores(articles: DataFrame, half_life: float, baselines: DataFrame | None = None, scale: float | None = None) -> DataFrame:
    """Scores of sources: decayed volume, weighted by the share of articles that a source published first.

    ``articles`` has source_id, age_hours and is_origin.
    """
    per = articles.groupBy("source_id").agg(
        F.sum(S.decay(F.col("age_hours"), half_life)).alias("weighted_volume"), F.count(F.lit(1)).alias("article_count"),
        F.sum(F.col("is_origin").cast("int")).alias("original_count"),
    )
    base = F.lit(0.0)
    if baselines is not None:
        per = per.join(baselines, "source_id", "left")
        base = F.coalesce("baseline", F.lit(0.0))
    share = F.col("original_count") / F.col("article_count")
    raw = F.log1p("weighted_volume") * (0.5 + 0.5 * share) + S.BURST_WEIGHT * S.burst(F.col("article_count"), base)
    per = per.withColumn("raw", raw).withColumn("originality", F.round(share, 4)).withColumn("burst", S.burst(F.col("article_count"), base))
    return _scaled(per.withColumn("eligible", F.col("article_count") >= LEAST_ARTICLES), scale).drop("baseline")


def trending(
    articles: DataFrame, enrichments: DataFrame, kind: str, window: str, as_of: float, limit: int = 20, *,
    registry: DataFrame | None = None, gate: bool = True, baselines: DataFrame | None = None, scale: float | None = None, in_title: bool = False,
) -> DataFrame:
    """A trend board as served. ``gate`` keeps hidden entities of ``registry`` off the actor board."""
    span, half = check_request(kind, window, limit)
    if kind == "source":
        rows = project(articles, enrichments, as_of, span)
        return top(source_scores(rows, half, baselines, scale), limit, "source_id")
    rows = project(articles, enrichments, as_of, span)
    mentions = {"topic": topic_mentions, "region": region_mentions}.get(kind, lambda p: actor_mentions(p, in_title))(rows)
    if kind == "actor" and gate and registry is not None:
        mentions = mentions.join(small_side(hidden_entities(registry).withColumnRenamed("entity_id", "target_id")), "target_id", "left_anti")
    board = top(trend_scores(mentions, half, baselines, scale), limit)
    return board.select(
        F.lit(kind).alias("trend_type"), "target_id", F.col("target_name").alias("name"), F.round("score", 2).alias("score"), F.round("raw", 4).alias("raw"),
        F.round("weighted_mentions", 4).alias("weighted_mentions"), "distinct_sources", F.round("burst", 4).alias("burst_z"), "eligible",
    )


def baselines(mentions: DataFrame, span: float, windows: int) -> DataFrame:
    """Mean distinct origins per target over ``windows`` earlier windows; ``mentions`` has target_id, origin, age_hours.

    Window 0 (the current one) is left out; a window without mentions counts as 0.
    """
    slot = F.floor(F.col("age_hours") / span)
    n = mentions.withColumn("slot", slot).where((F.col("slot") >= 1) & (F.col("slot") <= windows))
    n = n.groupBy("target_id", "slot").agg(F.countDistinct("origin").alias("n"))
    return n.groupBy("target_id").agg((F.sum("n") / windows).alias("baseline"))


def rolling_baseline(counts: DataFrame, windows: int) -> DataFrame:
    """Baseline of each (target_id, bucket, n): the mean of n over the preceding ``windows`` buckets that exist."""
    w = Window.partitionBy("target_id").orderBy("bucket").rowsBetween(-windows, -1)
    return counts.withColumn("baseline", F.coalesce(F.avg("n").over(w), F.lit(0.0)))
