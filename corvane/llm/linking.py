"""Groups of near-duplicates from shared buckets, without emitting all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, extend_components, known_size, size_of, small_side

#: Rounds of linking to pivots; what is left then goes to ``rest``.
ROUNDS = 4

Verify = Callable[[DataFrame], DataFrame]


def shared_buckets(scratch: Scratch, members: DataFrame) -> DataFrame:
    """The distinct rows of ``members(key, c)`` whose key has more than one c, with ``deg``: how much company c has.

    Counts are combined before the shuffle; one hot key is one row of the counts, and the join back can be split.
    """
    many = members.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    many = scratch.save(many.where("lo < hi").select("key", "cnt"), "many")
    scratch.sweep()
    kept = scratch.save(members.join(small_side(many), "key").select("key", "c", "cnt").distinct(), "kept")
    scratch.drop("many")
    scratch.sweep()
    deg = kept.groupBy("c").agg(F.sum("cnt").alias("deg"))
    out = scratch.save(kept.select("key", "c").join(deg, "c"), "members")
    scratch.drop("kept")
    scratch.sweep()
    return out


def link_groups(
    scratch: Scratch, members: DataFrame, verify: Verify, rest: Callable[[DataFrame], DataFrame], labels: DataFrame | None = None, rounds: int = ROUNDS, least: float = 0.0
) -> DataFrame:
    """Components of the verified links inside buckets: rows (id, root) for all but the roots.

    ``members(key, c, deg)`` has a row for each element of each bucket; ``verify`` gets pairs (lo, hi) and returns
    those that are links; ``labels`` are components known before. In each round every bucket that still holds more
    than one component links its members to its pivot, the member with the most company, which in a group of copies
    is the one that was changed least. The pivot has then been compared with everything in its bucket and leaves it.
    A bucket of n members costs n comparisons a round, not n^2. Of the links only those between different components
    are used, one for each two components.

    The rounds also end when fewer than ``least`` of a round's pairs are links: then buckets hold unrelated members,
    which ``rest`` compares in one step. After the last round a bucket holds its main component (the last pivot's) and
    strays. ``rest`` gets what is left of those buckets (key, c, root, stray) and returns pairs (lo, hi) of a stray and
    another member of another root; it must return every pair that shares a bucket and is a link, and may leave out
    what cannot be one.
    """
    tested: DataFrame | None = None

    def record(pairs: DataFrame, tag: str) -> tuple[int, int]:
        """Tests pairs and extends the components; how many pairs and how many links there were."""
        nonlocal labels, tested
        if tested is not None:
            pairs = pairs.join(small_side(tested), ["lo", "hi"], "left_anti")
        pairs = scratch.sized(pairs, f"pairs-{tag}")
        if not size_of(pairs)[0]:
            return 0, 0
        scratch.sweep()
        found = scratch.sized(verify(pairs), f"links-{tag}")
        if size_of(found)[0]:
            labels = extend_components(scratch, labels, found, f"cc-{tag}")
        failed = pairs.join(small_side(found), ["lo", "hi"], "left_anti")  # links do not come again: their roots are one
        failed = scratch.sized(failed, f"failed-{tag}")
        scratch.drop(f"pairs-{tag}", f"links-{tag}")
        scratch.sweep()  # the driver's heap, too, grows with what is not collected
        both = [size_of(t) for t in (tested, failed) if t is not None]
        tested = known_size(failed if tested is None else tested.union(failed), *map(sum, zip(*both)))
        return size_of(pairs)[0], size_of(found)[0]

    def rooted(rows: DataFrame) -> DataFrame:
        if labels is None:
            return rows.withColumn("root", F.col("c"))
        return rows.join(small_side(labels.withColumnRenamed("id", "c"), of=labels), "c", "left").withColumn("root", F.coalesce("root", "c"))

    last: str | None = None
    for r in range(1, rounds + 1):
        act = rooted(members)
        # most company first; equals by their ids' low bits
        first = F.shiftleft(F.col("deg"), 24) + F.col("c").bitwiseAND(F.lit((1 << 24) - 1))
        pivots = act.withColumn("_o", first).groupBy("key").agg(
            F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.max_by("c", "_o").alias("p"), F.max_by("root", "_o").alias("p_root")
        )
        pivots = pivots.where("_lo < _hi").select("key", "p", "p_root")
        met = scratch.save(act.join(scratch.small(pivots, f"pivots-{r}"), "key"), f"met-{r}")
        scratch.drop(f"pivots-{r}", last or "members")  # all that later rounds read is in ``met``
        last = f"met-{r}"
        members = met.where("c <> p").select("key", "c", "deg", "p_root")
        pairs, links = record(met.where("root <> p_root").select(F.least("p", "c").alias("lo"), F.greatest("p", "c").alias("hi")).distinct(), str(r))
        if not pairs or links < least * pairs:
            break
        members = members.drop("p_root") if r < rounds else members
    if "p_root" in members.columns and not members.isEmpty():
        main = members.select("key", F.col("p_root").alias("c")).distinct()  # where the last pivot's component is now
        main = rooted(main).select("key", F.col("root").alias("main"))
        left = rooted(members.drop("p_root")).join(scratch.small(main, "main"), "key")
        left = scratch.save(left.select("key", "c", "root", (F.col("root") != F.col("main")).alias("stray")), "left")
        keys = scratch.small(left.where("stray").select("key").distinct(), "stray-keys")
        left = scratch.save(left.join(keys, "key", "left_semi"), "strays")
        scratch.drop("left", "main", "stray-keys", *([last] if last else []))
        scratch.sweep()
        record(rest(left).distinct(), "last")
        scratch.drop("strays")
    scratch.drop(*([last] if last else []), "members", *[f"failed-{r}" for r in (*range(1, rounds + 1), "last")])
    return labels if labels is not None else members.select(F.col("c").alias("id"), F.col("c").alias("root")).limit(0)
