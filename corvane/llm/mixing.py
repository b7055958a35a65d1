"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The tree is domain > language > source. Target weights flow down from the root; a node that cannot use its share
(it has too few tokens, even over ``max_epochs`` epochs) hands the shortage to its siblings, and only what the whole
family cannot use goes up to the family's own siblings. Each leaf then takes a token-prefix of a seeded order: full
epochs first, then the prefix of one more epoch.

Scale: one pass over the texts makes a narrow table (leaf, tokens, id). Everything else works on that table or on one
row per leaf. A leaf's prefix is found from sums per hash bucket, which are combined before the shuffle, so a leaf
that holds a third of all rows is spread over all its buckets; only the one bucket that the cut falls into is ordered
row by row. The result of all this is one cut key per leaf, so texts are filtered and never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, small_side

LEAF = ["domain", "lang", "source"]


def _case(key: Column, values: Mapping[str, object], default: object) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def leaf_columns(domains: Mapping[str, str], default_domain: str = "other") -> list[Column]:
    """domain, lang and source of a document; null languages and sources are groups of their own."""
    lang, source = F.coalesce(F.col("lang"), F.lit("und")), F.coalesce(F.col("source"), F.lit("unknown"))
    return [_case(source, domains, default_domain).alias("domain"), lang.alias("lang"), source.alias("source")]


def fill(children: DataFrame, parent: list[str], amount: str) -> DataFrame:
    """Share each parent's ``amount`` among its children in proportion to ``weight``, none above its ``capacity``.

    Water-filling in closed form: in ascending capacity/weight, a child is full if the amount still covers the level
    at which it fills up; the others share the rest by weight. ``children`` has one row per child; adds ``share``.
    """
    w = Window.partitionBy(*parent).orderBy("_r", "_k")
    upto, whole = w.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*parent)
    out = (
        children.withColumn("_r", F.col("capacity") / F.col("weight"))
        .withColumn("_c", F.sum("capacity").over(upto))
        .withColumn("_w", F.sum("weight").over(whole) - F.sum("weight").over(upto))
        .withColumn("_full", F.col("_c") + F.col("_r") * F.col("_w") <= F.col(amount))
        .withColumn("_left", F.col(amount) - F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0.0)).over(whole))
        .withColumn("_open", F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("weight"))).over(whole))
    )
    share = F.when(F.col("_full"), F.col("capacity")).otherwise(F.col("_left") * F.col("weight") / F.col("_open"))
    return out.withColumn("share", share).drop("_r", "_c", "_w", "_full", "_left", "_open")


def budgets(leaves: DataFrame, budget: Column, domain_weights, lang_weights, source_weights, max_epochs: int) -> DataFrame:
    """``share`` (tokens, double) of every leaf; ``leaves`` has domain, lang, source, tokens with tokens > 0."""
    lv = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    total = lv.withColumn("_all", F.sum("tokens").over(Window.partitionBy()))
    total = total.withColumn("budget", F.least(budget * F.col("_all"), F.sum("capacity").over(Window.partitionBy())))
    by_domain = total.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("budget").alias("amount"))
    by_domain = by_domain.withColumn("weight", _case(F.col("domain"), domain_weights, domain_weights.get("*", 1.0)))
    by_domain = fill(by_domain.withColumn("_k", F.col("domain")).withColumn("_root", F.lit(0)), ["_root"], "amount")
    by_lang = total.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    by_lang = by_lang.withColumn("weight", _case(F.col("lang"), lang_weights, lang_weights.get("*", 1.0)))
    by_lang = by_lang.join(by_domain.select("domain", F.col("share").alias("amount")), "domain")
    by_lang = fill(by_lang.withColumn("_k", F.col("lang")), ["domain"], "amount")
    by_source = lv.withColumn("weight", _case(F.col("source"), source_weights, source_weights.get("*", 1.0)))
    by_source = by_source.join(by_lang.select("domain", "lang", F.col("share").alias("amount")), ["domain", "lang"])
    return fill(by_source.withColumn("_k", F.col("source")), ["domain", "lang"], "amount").select(*LEAF, "tokens", "share")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: 32 hex digits, in an order that differs from epoch to epoch."""
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def cuts(narrow: DataFrame, shares: DataFrame, seed: int, max_epochs: int, digits: int = 3) -> DataFrame:
    """One row per leaf: ``full`` epochs that are taken whole, and ``cut``, the last order key of the next epoch."""
    plan = shares.withColumn("full", F.floor(F.col("share") / F.col("tokens") + 1e-9)).withColumn(
        "rest", F.floor(F.greatest(F.lit(0.0), F.col("share") - F.col("full") * F.col("tokens")) + 1e-6)
    )
    # a leaf that is used up takes nothing from a further epoch, not even documents without tokens
    plan = plan.select(*LEAF, "full", F.when(F.col("full") >= max_epochs, -1).otherwise(F.col("rest")).alias("rest"))
    keyed = (
        narrow.join(small_side(plan), LEAF)
        .withColumn("key", order_key(seed, F.col("full"), F.col("doc_id")))
        .withColumn("bucket", F.substring("key", 1, digits))
    )
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("t"), F.first("rest").alias("rest"), F.max("key").alias("last"))
    w = Window.partitionBy(*LEAF).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    below = sums.where(F.col("upto") <= F.col("rest")).groupBy(*LEAF).agg(F.max("last").alias("cut"))
    edge = sums.where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("t") <= F.col("rest")))
    edge = edge.select(*LEAF, "bucket", (F.col("rest") - F.col("upto") + F.col("t")).alias("room"))
    inside = keyed.join(small_side(edge), [*LEAF, "bucket"])
    w = Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("_t", F.sum("n_tokens").over(w)).where(F.col("_t") <= F.col("room"))
    cut = below.unionByName(inside.select(*LEAF, F.col("key").alias("cut"))).groupBy(*LEAF).agg(F.max("cut").alias("cut"))
    return plan.join(cut, LEAF, "left").select(*LEAF, "full", "cut")


def mixture_plan(
    spark: SparkSession, docs: DataFrame, *, domains, domain_weights, lang_weights, source_weights,
    budget_ratio: float, max_epochs: int, seed: int,
) -> tuple[DataFrame, DataFrame]:
    """The narrow table (leaf, doc_id, n_tokens) and the plan (leaf, full, cut), both written to scratch tables."""
    scratch = Scratch(spark, "mix")
    narrow = scratch.save(docs.select(*leaf_columns(domains), F.col("doc_id"), n_words(F.col("text")).alias("n_tokens")), "narrow")
    leaves = narrow.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0")
    shares = scratch.save(
        budgets(leaves, F.lit(float(budget_ratio)), domain_weights, lang_weights, source_weights, max_epochs), "shares"
    )
    return narrow, scratch.save(cuts(narrow, shares, seed, max_epochs), "plan")


def take(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their leaf columns, once for each epoch in which they are selected; adds ``epoch``."""
    hit = rows.join(small_side(plan), LEAF)
    last = F.coalesce(order_key(seed, F.col("full"), F.col("doc_id")) <= F.col("cut"), F.lit(False))
    n = F.col("full") + F.when(last, 1).otherwise(0)
    return (
        hit.withColumn("epoch", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))))
        .withColumn("epoch", F.col("epoch").cast("int"))
        .drop("full", "cut")
    )


#: Production mixture: which domain a source belongs to, and the weights on each level ("*": all others).
DOMAINS = {f"src{i}": ("web" if i < 10 else "books" if i < 15 else "reference") for i in range(20)}
WEIGHTS = {
    "domain_weights": {"web": 0.5, "books": 0.3, "reference": 0.2, "*": 0.05},
    "lang_weights": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15, "*": 0.05},
    "source_weights": {"*": 1.0},
}


def mix(
    spark: SparkSession, docs: DataFrame, *, budget_ratio: float = 0.6, max_epochs: int = 3, seed: int = 17,
    domains: Mapping[str, str] = DOMAINS, weights: Mapping[str, Mapping[str, float]] = WEIGHTS, texts: bool = False,
) -> DataFrame:
    """Select documents so that tokens follow the target weights.

    ``budget_ratio`` is the wanted number of tokens as a share of all tokens, ``max_epochs`` how often a document may
    be repeated. Returns doc_id, domain, lang, source, n_tokens, epoch; with ``texts`` all columns of ``docs`` instead
    (and nothing else), once per epoch.

    Null or empty texts have 0 tokens and are taken with their place in the order; a leaf without any token takes no
    part. A null language counts as "und", a null source as "unknown", a null doc_id as an empty id. Repeated rows of
    one doc_id share a place: either all of them are taken or none. An empty table gives no rows. Columns beyond
    doc_id, text, lang, source are ignored (or passed through with ``texts``), whatever their names.
    """
    narrow, plan = mixture_plan(
        spark, docs, domains=domains, budget_ratio=budget_ratio, max_epochs=max_epochs, seed=seed, **weights
    )
    if not texts:
        return take(narrow, plan, seed).select("doc_id", *LEAF, "n_tokens", "epoch")
    whole = docs.select(*leaf_columns(domains), F.col("doc_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return take(whole, plan, seed).select("_row.*")
