"""Alert rules against trend boards."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vocab import WINDOWS
from ..plans.scratch import small_side


def board_union(*boards: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), boards)


def watches(rules: DataFrame) -> DataFrame:
    """One row per watched name or id: webhook_id, min_score, window (if rules have one), trend_type, watched (normalised)."""
    own = ["webhook_id", "min_score", *(["window"] if "window" in rules.columns else [])]
    kinds = F.array(*[F.struct(F.lit(k).alias("trend_type"), F.col(c).alias("names")) for k, c in (("topic", "topics"), ("actor", "actors"), ("region", "regions"))])
    w = rules.select(*own, F.explode(kinds).alias("k")).select(*own, "k.trend_type", F.explode("k.names").alias("watched"))
    return w.withColumn("watched", F.lower(F.trim("watched"))).distinct()


def boards_by_window(rules: DataFrame, board_of: Callable[[str], DataFrame]) -> DataFrame:
    """The boards of all distinct windows of the rules, each made once, with ``window``. ``board_of(window)`` makes one.

    The windows that rules can have are the served ones, so their number does not grow with the rules.
    """
    named = [r[0] for r in rules.select("window").where(F.col("window").isin(*WINDOWS)).distinct().orderBy("window").collect()]
    boards = [board_of(w).withColumn("window", F.lit(w)) for w in named]
    return board_union(*boards) if boards else board_of(next(iter(WINDOWS))).withColumn("window", F.lit("")).limit(0)


def firings(rules: DataFrame, board: DataFrame) -> DataFrame:
    """Rules that fire: a watched name or id on the board with at least the rule's score; once per rule and target.

    An equi-join on (type, name or id) replaces the rule by trend product. Where rules and board have a ``window``,
    a rule looks at the board of its own window only.
    """
    own = [c for c in ("window",) if c in rules.columns and c in board.columns]
    keys = F.array_distinct(F.array(F.lower(F.trim("target_id")), F.lower(F.trim("name"))))
    named = board.select(*own, "trend_type", "target_id", "name", "score", F.explode(keys).alias("watched"))
    hit = named.join(small_side(watches(rules.drop(*({"window"} - set(own))))), [*own, "trend_type", "watched"]).where(F.col("score") >= F.col("min_score"))
    out = hit.select("webhook_id", "trend_type", "target_id", "name", "score").distinct()
    return out.orderBy("webhook_id", "trend_type", "target_id")
