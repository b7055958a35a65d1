"""Near-duplicate articles: 64-bit SimHash, exact banding join, content clusters and their origins."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..plans.scratch import Scratch, small_side
from .graph import components

# Bits and hours within which two articles are copies of each other.
MAX_BITS, WINDOW_HOURS = 3, 48.0


def simhash_blake2b(text: Column) -> Column:
    """SimHash of a text's tokens: each token's 8-byte BLAKE2b votes on every bit, a tie gives 0; no token gives 0."""

    @F.pandas_udf("long")
    def udf(tok: pd.Series) -> pd.Series:
        known: dict[str, np.ndarray] = {}

        def votes(t: str) -> np.ndarray:
            if t not in known:
                bits = np.unpackbits(np.frombuffer(blake2b(t.encode(), digest_size=8).digest(), np.uint8))
                known[t] = bits.astype(np.int32) * 2 - 1
            return known[t]

        def one(ts: np.ndarray) -> int:
            if ts is None or not len(ts):
                return 0
            total = np.sum([votes(t) for t in ts], axis=0)
            return int(np.packbits(total > 0).view(">i8")[0])

        return tok.map(one)

    return udf(tokens(text))


def simhash_md5(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, fp): the same with the first 8 bytes of MD5, by DataFrame functions alone."""
    exploded = rows.select(key, F.explode_outer(tokens(text)).alias("t"))
    h = F.conv(F.substring(F.md5(F.col("t").cast("binary")), 1, 16), 16, -10).cast("long")
    exploded = exploded.select(key, h.alias("h"))
    bit = lambda j: F.sum(F.when(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(1)) == 1, 1).otherwise(F.when(F.col("h").isNotNull(), -1)))
    votes = exploded.groupBy(key).agg(*[bit(j).alias(f"b{j}") for j in range(64)])
    fp = F.lit(0).cast("long")
    for j in range(64):
        fp = fp.bitwiseOR(F.when(F.coalesce(F.col(f"b{j}"), F.lit(0)) > 0, F.lit(1 << j if j < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long"))
    return votes.select(key, fp.alias("fp"))


def segments(articles: DataFrame, hours: float = WINDOW_HOURS) -> DataFrame:
    """Articles with the segment they are in: equal fingerprints whose times have no gap over ``hours``.

    Adds seg (the smallest article_id), t_min and t_max. Members of a segment are linked already, so one node stands
    for all copies of a text. Gaps are found per fingerprint and day-sized slice first, so a text that is copied
    without end is not ordered in a single task: slices are joined by their ends.
    """
    w = Window.partitionBy("fp", "slice").orderBy("first_seen_hours", "article_id")
    run = Window.partitionBy("fp", "slice").orderBy("first_seen_hours", "article_id").rowsBetween(Window.unboundedPreceding, 0)
    a = articles.withColumn("slice", F.floor(F.col("first_seen_hours") / (8 * hours)))
    a = a.withColumn("gap", F.coalesce((F.col("first_seen_hours") - F.lag("first_seen_hours").over(w) > hours).cast("int"), F.lit(0)))
    a = a.withColumn("piece", F.sum("gap").over(run))
    parts = a.groupBy("fp", "slice", "piece").agg(F.min("first_seen_hours").alias("lo"), F.max("first_seen_hours").alias("hi"), F.min("article_id").alias("least"))
    w = Window.partitionBy("fp").orderBy("lo")
    parts = parts.withColumn("cut", F.coalesce((F.col("lo") - F.lag("hi").over(w) > hours).cast("int"), F.lit(0)))
    parts = parts.withColumn("no", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("fp", "no")
    parts = parts.select(
        "fp", "slice", "piece", F.min("least").over(whole).alias("seg"), F.min("lo").over(whole).alias("t_min"), F.max("hi").over(whole).alias("t_max")
    )
    return a.join(parts, ["fp", "slice", "piece"]).drop("slice", "gap", "piece")


def near_pairs(nodes: DataFrame, bits: int = MAX_BITS, hours: float = WINDOW_HOURS) -> DataFrame:
    """Pairs (a, b, distance) of nodes(seg, fp, t_min, t_max) within ``bits`` and ``hours``; a < b.

    Of bits + 1 bands of the fingerprint two such nodes share one, so an equi-join on bands finds every pair.
    """
    bands = bits + 1
    width = 64 // bands
    parts = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(bands)]
    keyed = nodes.select("seg", "fp", "t_min", "t_max", F.posexplode(F.array(*parts)).alias("band", "value"))
    a = keyed.select("band", "value", *[F.col(c).alias(f"{c}_a") for c in ("seg", "fp", "t_min", "t_max")])
    b = keyed.select("band", "value", *[F.col(c).alias(f"{c}_b") for c in ("seg", "fp", "t_min", "t_max")])
    far = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b")))
    close = (F.col("t_min_b") - F.col("t_max_a") <= hours) & (F.col("t_min_a") - F.col("t_max_b") <= hours)
    pairs = a.join(b, ["band", "value"]).where((F.col("seg_a") < F.col("seg_b")) & (far <= bits) & close)
    return pairs.select(F.col("seg_a").alias("a"), F.col("seg_b").alias("b"), far.alias("distance")).distinct()


def content_clusters(
    spark: SparkSession, articles: DataFrame, bits: int = MAX_BITS, hours: float = WINDOW_HOURS, skip_empty: bool = False
) -> DataFrame:
    """Articles with their content cluster: adds cluster_id (the smallest article_id of the component).

    ``articles`` has article_id (sortable), fp and first_seen_hours. Single linkage, independent of order.
    ``skip_empty`` leaves texts without any token (fp 0) apart instead of making them copies of each other.
    """
    scratch = Scratch(spark, "clusters")
    rows = articles.withColumn("_alone", F.lit(skip_empty) & (F.col("fp") == 0))
    placed = scratch.save(segments(rows.where("NOT _alone").drop("_alone"), hours), "segments")
    nodes = placed.select("seg", "fp", "t_min", "t_max").distinct()
    labels = components(scratch, near_pairs(nodes, bits, hours).select("a", "b"))
    out = placed.join(small_side(labels.withColumnRenamed("id", "seg")), "seg", "left")
    out = out.withColumn("cluster_id", F.coalesce("root", "seg")).drop("seg", "root", "t_min", "t_max")
    alone = rows.where("_alone").drop("_alone").withColumn("cluster_id", F.col("article_id"))
    return out.select(alone.columns).unionByName(alone)


def origins(clustered: DataFrame) -> DataFrame:
    """One row per cluster: origin_article_id, origin_source_id, carrier_count, first_seen_hours.

    The origin is the earliest wire article, or the earliest of all if no wire has it; ties go to the smaller id.
    """
    first = F.min(F.struct((~F.col("is_wire")).alias("other"), "first_seen_hours", "article_id", "source_id"))
    out = clustered.groupBy("cluster_id").agg(
        first.alias("o"), F.count(F.lit(1)).alias("carrier_count"), F.min("first_seen_hours").alias("first_seen_hours")
    )
    return out.select(
        "cluster_id", F.col("o.article_id").alias("origin_article_id"), F.col("o.source_id").alias("origin_source_id"), "carrier_count", "first_seen_hours"
    )
