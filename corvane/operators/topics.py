"""Topics of a text by keywords."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vocab import CATEGORIES, TOPICS

# Weight at which confidence is one half, weight of a phrase, floor of a feed's own category, topics kept.
HALF, PHRASE, CATEGORY_FLOOR, KEPT = 3.0, 2, 0.55, 3


def topic_weight(text: Column, keywords: Sequence[str]) -> Column:
    """Sum of the weights of the keywords in lower-case text, each counted once, at word edges.

    A keyword's letters are looked for first; only where they stand somewhere does a pattern look at the word edges.
    """
    hits = [F.when(text.contains(k) & text.rlike(rf"(?U)\b{re.escape(k)}\b"), PHRASE if " " in k else 1).otherwise(0) for k in keywords]
    out = hits[0] if hits else F.lit(0)
    for h in hits[1:]:
        out = out + h
    return out


def all_topics(text: Column, category: Column | None = None, topics: Mapping[str, Sequence[str]] = TOPICS, overrides: Mapping[str, str] = CATEGORIES) -> Column:
    """array<struct<topic, confidence>> of all topics that are hit, best first, then by name.

    The lower-case text and the weights are bound to variables, so each is computed once for a row.
    """
    own = F.lit(None).cast("string")
    if category is not None:
        for k, v in overrides.items():
            own = F.when(F.lower(F.trim(category)) == k, v).otherwise(own)
    named = sorted({*topics, *(overrides.values() if category is not None else ())})
    weights = F.flatten(F.transform(F.array(F.lower(text)), lambda low: F.array(*[topic_weight(low, topics.get(n, ())) for n in named])))

    def scored(name: Column, weight: Column) -> Column:
        floor = F.when(name == own, CATEGORY_FLOOR).otherwise(0.0)
        return F.struct(name.alias("topic"), F.greatest(F.round(F.coalesce(weight, F.lit(0)) / (F.coalesce(weight, F.lit(0)) + HALF), 4), floor).alias("confidence"))

    found = F.zip_with(F.array(*[F.lit(n) for n in named]), weights, scored)
    hit = F.filter(found, lambda t: t["confidence"] > 0)
    order = lambda a, b: F.when(a["confidence"] != b["confidence"], F.when(a["confidence"] > b["confidence"], -1).otherwise(1)).otherwise(
        F.when(a["topic"] < b["topic"], -1).when(a["topic"] > b["topic"], 1).otherwise(0)
    )
    return F.array_sort(hit, order)


def topics(text: Column, category: Column | None = None, kept: int = KEPT, **vocab) -> Column:
    """The best topics of a text."""
    return F.slice(all_topics(text, category, **vocab), 1, kept)
