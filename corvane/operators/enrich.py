"""Enrichment of articles: language, topics, actors, regions and quotes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.text import clean_text, language
from ..functions.vocab import ENTITIES, REGIONS
from .topics import topics

ACTORS = "array<struct<display:string,canonical_key:string,kind:string,entity_id:string,start:int,end:int>>"
PLACES = "array<struct<region_id:string,name:string,region_type:string,confidence:double>>"
QUOTES = (
    "array<struct<quote_text:string,speaker_display:string,speaker_entity_id:string,speaker_key:string,speaker_inferred:boolean,"
    "confidence:double,attribution_status:string,method:string,source_paragraph_url:string,exposable:boolean>>"
)


def region_entries(rows=REGIONS) -> list[tuple[str, str, str, list[str], list[str]]]:
    return [(key, name, kind, [], aliases) for key, name, kind, _, aliases in rows]


def enrich(articles: DataFrame, entities=ENTITIES, places=REGIONS) -> DataFrame:
    """article_id, language, topics, actors, regions, quotes of articles(article_id, title, excerpt, raw_category, canonical_url).

    Language and topics are plain expressions; one Arrow UDF reads names, regions and quotes, and builds its matchers
    once per task. Gazetteers travel with the function; they are a few dozen entries.
    """

    @F.pandas_udf(f"struct<actors:{ACTORS},regions:{PLACES},quotes:{QUOTES}>")
    def read(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        who, where = names.Gazetteer(entities), names.Gazetteer(region_entries(places))
        for title, body, url in batches:
            rows = []
            for t, b, u in zip(title, body, url, strict=True):
                text = f"{t}. {b}"
                rows.append({"actors": names.actors(text, who), "regions": names.regions(t, b, where), "quotes": names.quotes(text, u or "", who)})
            yield pd.DataFrame(rows, columns=["actors", "regions", "quotes"])

    a = articles.select(
        "article_id", clean_text(F.coalesce("title", F.lit(""))).alias("t"), clean_text(F.coalesce("excerpt", F.lit(""))).alias("b"), "raw_category", "canonical_url"
    )
    a = a.withColumn("text", F.concat("t", F.lit(". "), "b"))
    a = a.withColumn("found", read("t", "b", "canonical_url"))
    lang = language(F.col("text"))
    return a.select(
        "article_id", F.when(lang == "unknown", "id").otherwise(lang).alias("language"), topics(F.col("text"), F.col("raw_category")).alias("topics"), "found.*"
    )


def mentions(rows: DataFrame, key: str, text: str, entries) -> DataFrame:
    """(key, entity_id, start, end) of all gazetteer hits in a text column."""

    @F.pandas_udf("array<struct<entity_id:string,start:int,end:int>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        g = names.Gazetteer(entries)
        for texts in batches:
            yield texts.map(lambda t: [{"entity_id": h.owner, "start": h.start, "end": h.end} for h in g.find(t or "")])

    return rows.select(key, F.explode(find(F.col(text))).alias("m")).select(key, "m.*")
