"""Predicates that every read passes, and the registry behind them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Labels that accuse, outcomes that clear, and the least confidence of a served quote.
ACCUSATORY, CLEARED, QUOTE_FLOOR = ("tersangka", "terdakwa"), ("bebas", "sp3"), 0.75


def label_allowed(label: Column, status: Column) -> Column:
    """An accusing label is not shown once the current status clears the person."""
    return ~(F.coalesce(label.isin(*ACCUSATORY), F.lit(False)) & F.coalesce(status.isin(*CLEARED), F.lit(False)))


def entity_visible(suppressed: Column, minor: Column, victim: Column) -> Column:
    flags = [F.coalesce(c, F.lit(False)) for c in (suppressed, minor, victim)]
    return ~reduce(lambda a, b: a | b, flags)


def hidden_entities(registry: DataFrame) -> DataFrame:
    """Ids of the entities that no read may show; entities without a record are shown."""
    return registry.where(~entity_visible(F.col("suppressed"), F.col("is_minor"), F.col("is_sensitive_victim"))).select("entity_id").distinct()


def quote_allowed(confidence: Column, link: Column, status: Column, verbatim: Column | None = None, floor: float = QUOTE_FLOOR) -> Column:
    """Confident enough, with a link, and verbatim only as published."""
    said = F.lit(True) if verbatim is None else verbatim
    return (confidence >= floor) & (F.coalesce(link, F.lit("")) != "") & ~(said & (F.coalesce(status, F.lit("")) != "as_published"))


def attributed(name: Column, url: Column) -> Column:
    return (F.coalesce(name, F.lit("")) != "") & (F.coalesce(url, F.lit("")) != "")


def latest(versions: DataFrame, key: str = "entity_id", by: str = "version") -> DataFrame:
    """The last version of each row."""
    w = Window.partitionBy(key).orderBy(F.desc(by))
    return versions.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def apply_requests(registry: DataFrame, requests: DataFrame) -> DataFrame:
    """Registry after data-subject requests(entity_id, action, display, legal_status, version).

    All requests of an entity count, in the order of their versions: "erase" suppresses it for good, whatever is
    rectified later; the last display given replaces the old one, and so does the last legal status that a "rectify"
    gives. Protection flags and whatever no request names are carried forward.
    """
    fixed = F.col("action") == "rectify"
    told = requests.groupBy("entity_id").agg(
        F.max_by("display", F.when(F.col("display").isNotNull(), F.col("version"))).alias("_d"),
        F.max_by("legal_status", F.when(fixed & F.col("legal_status").isNotNull(), F.col("version"))).alias("_l"),
        F.max(F.col("action") == "erase").alias("_erased"),
    )
    r = registry.join(told, "entity_id", "full")
    return r.select(
        "entity_id",
        F.coalesce("_d", "display", "entity_id").alias("display"),
        F.coalesce("kind", F.lit("PERSON")).alias("kind"),
        F.coalesce("_l", "legal_status").alias("legal_status"),
        (F.coalesce("suppressed", F.lit(False)) | F.coalesce("_erased", F.lit(False))).alias("suppressed"),
        F.coalesce("is_minor", F.lit(False)).alias("is_minor"),
        F.coalesce("is_sensitive_victim", F.lit(False)).alias("is_sensitive_victim"),
    )
