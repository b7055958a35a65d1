"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, known_size, size_of, small_side


#: Edges that make one partition (a few MB). A table of no more is one partition, whose steps need no exchange.
PARTITION_EDGES = 100_000


def _flipped(*pairs: tuple[str, str]) -> Column:
    return F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in pairs])).alias("e")


def components(scratch: Scratch, edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(id, root)`` for every id but the roots themselves.

    Alternates large-star and small-star steps, which take O(log^2 n) rounds at most. Minima are combined
    before each shuffle, and the joins back are plain equi-joins that adaptive execution can split when a node
    is hot. Labels never leave the cluster: the driver sees only a count and a checksum per round. ``root`` is
    the smallest id reachable. Self-loops and repeated edges are harmless. The number of edges never grows, and tables
    have partitions by their size, not by ``spark.sql.shuffle.partitions``: few edges are not dealt to many tasks.
    """
    cur = scratch.sized(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        f"{tag}-0",
    )
    before, size = None, size_of(cur)[0]
    for i in range(1, max_rounds + 1):
        cur = cur.coalesce(max(1, -(-size // PARTITION_EDGES)))
        # large-star: every larger neighbour of u moves to u's smallest neighbour (or u itself)
        both = cur.select(_flipped(("a", "b"), ("b", "a"))).select("e.*")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: u and its smaller neighbours move to the smallest of them
        moved = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        small = moved.select(_flipped(("b", "m"), ("a", "m"))).select("e.*").where("a > b").distinct()
        cur, now = scratch.observed(small, f"{tag}-{i}", F.bit_xor(F.xxhash64("a", "b")).alias("x"))
        scratch.drop(f"{tag}-{i - 1}")
        if now == before or not size_of(cur)[0]:
            return known_size(cur.select(F.col("a").alias("id"), F.col("b").alias("root")), *size_of(cur))
        before = now
    raise RuntimeError("components did not converge")


def extend_components(scratch: Scratch, labels: DataFrame | None, links: DataFrame, tag: str) -> DataFrame:
    """Components ``labels(id, root)`` joined by further ``links(lo, hi)``: (id, root) for all ids but the roots.

    Links are contracted first: of all links between two components one edge between their roots is left, so the
    rounds that follow work on components, however many links hold them together.
    """
    if labels is None:
        return components(scratch, links.select(F.col("lo").alias("a"), F.col("hi").alias("b")), tag)
    edges = links.select("lo", "hi")
    for end, name in (("lo", "a"), ("hi", "b")):
        known = small_side(labels.select(F.col("id").alias(end), F.col("root").alias("_r")), of=labels)
        edges = edges.join(known, end, "left").withColumn(name, F.coalesce("_r", end)).drop("_r")
    met = components(scratch, edges.select("a", "b"), f"{tag}-met")  # saved already
    moved = small_side(met.select(F.col("id").alias("root"), F.col("root").alias("_to")), of=met)
    out = labels.join(moved, "root", "left").select("id", F.coalesce("_to", "root").alias("root"))
    return scratch.sized(out.unionByName(met), tag)
