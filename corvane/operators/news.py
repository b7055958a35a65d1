"""Listings of articles: keyset pages and filters."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compliance import attributed


def encode_cursor(hours: float, article_id: str) -> str:
    return base64.urlsafe_b64encode(f"{hours!r}|{article_id}".encode()).decode()


def decode_cursor(cursor: str) -> tuple[float, str]:
    hours, _, article_id = base64.urlsafe_b64decode(cursor.encode()).decode().partition("|")
    return float(hours), article_id


def news_page(articles: DataFrame, limit: int, cursor: str | None = None) -> DataFrame:
    """Up to ``limit`` + 1 articles after a cursor, newest first; one row more than the page says that there is more.

    The filter on first_seen_hours reaches the scan; the order is a top-k, never a full sort.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    if cursor:
        h, i = decode_cursor(cursor)
        at = F.col("first_seen_hours")
        articles = articles.where((at <= h) & ((at < h) | (F.col("article_id") < i)))
    return articles.orderBy(F.desc("first_seen_hours"), F.desc("article_id")).limit(limit + 1)


def served(page: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """A page's rows as served: with the source's name, and only those that can be attributed."""
    rows = page.limit(limit).join(F.broadcast(sources.select("source_id", "name")), "source_id", "left")
    rows = rows.withColumn("source_name", F.coalesce("name", "source_id")).drop("name")
    return rows.where(attributed(F.col("source_name"), F.col("url")))


def search(
    articles: DataFrame, enrichments: DataFrame | None = None, *, q: str | None = None, source: str | None = None, topic: str | None = None,
    actor: str | None = None, region: str | None = None, since: float | None = None, until: float | None = None,
) -> DataFrame:
    """Filters beyond the plain listing: words in title or excerpt, source, topic, actor, region and time."""
    rows = articles
    if since is not None:
        rows = rows.where(F.col("first_seen_hours") >= since)
    if until is not None:
        rows = rows.where(F.col("first_seen_hours") <= until)
    if source:
        rows = rows.where(F.col("source_id") == source)
    if q:
        rows = rows.where(F.lower(F.concat_ws(" ", "title", "excerpt")).contains(q.lower()))
    if enrichments is not None and (topic or actor or region):
        e = enrichments
        if topic:
            e = e.where(F.exists("topics", lambda t: t["topic"] == topic))
        if actor:
            e = e.where(F.exists("actors", lambda a: (a["entity_id"] == actor) | (a["canonical_key"] == actor)))
        if region:
            e = e.where(F.exists("regions", lambda r: r["region_id"] == region))
        rows = rows.join(e.select("article_id"), "article_id", "left_semi")
    return rows
