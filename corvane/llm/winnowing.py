"""Document fingerprints by winnowing (DataFrame functions only).

A text's words are hashed in runs of K; from every window of W consecutive k-gram hashes the smallest is chosen, the
rightmost of equals, and kept with its position. Two texts that share K + W - 1 consecutive words share a fingerprint
element (the match guarantee), and no match shorter than K words is seen.

All array steps bind their inputs once; the work per text is linear in its length, and a text stays in its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_side

#: Words in a k-gram, k-grams in a window.
K, W = 3, 4
_BLANK = " \t\n\x0b\x0c\r"
_LAST = 2**31 - 1  # positions run down from here, so that the smaller value is the one further right


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Lower-cased words of a text that is not null."""
    bare = F.btrim(F.lower(text), F.lit(_BLANK))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def grams(w: Column, k: int) -> Column:
    """Hashes of all runs of k words; the whole sequence as one if there are fewer."""
    every = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, k)]))
    return F.slice(every, F.lit(1), F.least(F.size(w), F.greatest(F.size(w) - (k - 1), F.lit(1))))


def winnow(text: Column, k: int = K, w: int = W) -> Column:
    """The chosen elements of a text's k-grams in order: 32 hash bits above 31 bits of the position's complement.

    Windows are compared by those hash bits; a text with fewer than ``w`` k-grams has one window.
    """

    def packed(g: Column) -> Column:
        return F.transform(g, lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 31) + (F.lit(_LAST).cast("long") - i))

    def chosen(p: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(p) - (w - 1), F.lit(1)))
        return F.when(F.size(p) == 0, p).otherwise(F.array_distinct(F.transform(starts, lambda i: F.array_min(F.slice(p, i, F.lit(w))))))

    return let(words(text), lambda ws: let(packed(grams(ws, k)), chosen))


def hashes(chosen: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftright(x, 31)))


def positions(chosen: Column) -> Column:
    """Word positions of a fingerprint's k-grams, ascending."""
    return F.transform(chosen, lambda x: F.lit(_LAST).cast("long") - x.bitwiseAND(F.lit(_LAST).cast("long")))


def spelled(chosen: Column) -> Column:
    """A fingerprint as text: position:hash of each element, in hexadecimal."""
    at = F.lit(_LAST).cast("long")
    return F.array_join(F.transform(chosen, lambda x: F.concat(F.hex(at - x.bitwiseAND(at)), F.lit(":"), F.hex(F.shiftright(x, 31)))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' hashes; 1 if both are empty."""
    return let(
        F.struct(hashes(a).alias("a"), hashes(b).alias("b")),
        lambda s: let(
            F.size(F.array_intersect(s["a"], s["b"])).cast("double"),
            lambda n: F.when(F.size(s["a"]) + F.size(s["b"]) == 0, F.lit(1.0)).otherwise(n / (F.size(s["a"]) + F.size(s["b"]) - n)),
        ),
    )


def with_next(spark: SparkSession, docs: DataFrame, derive: dict[str, Column]) -> DataFrame:
    """Each document with the next one's values in ascending doc_id order; after the last comes the first.

    ``docs`` has doc_id and text (not null). ``derive`` adds columns that are computed once per document, before the
    look at the next one; every column but doc_id also comes as next_<name>.

    Documents are dealt into blocks of neighbouring ids (bounds are quantiles, a few hundred numbers), and each
    block also gets the first document of the block after it, so a look ahead never leaves its block. The texts go
    through one exchange.
    """
    h = F.xxhash64("text")
    base = docs.select("doc_id", "text")
    blocks = min(1000, max(2, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    bounds = sorted(set(base.approxQuantile("doc_id", [i / blocks for i in range(1, blocks)], 0.0005)))
    block = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]), lambda b: b <= F.col("doc_id"))) if bounds else F.lit(0)
    base = base.withColumn("block", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(block))
    first = base.groupBy("block").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", h.alias("h"))).alias("f"))
    order = Window.orderBy("block")  # one row per block
    first = first.withColumn("before", F.coalesce(F.lag("block").over(order), F.last("block").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    first = small_side(first.select("block", "before", F.col("f.doc_id").alias("f_id"), F.col("f.h").alias("f_h")))
    tails = base.join(first, "block").where(F.col("doc_id").eqNullSafe(F.col("f_id")) & (h == F.col("f_h")))
    tails = tails.dropDuplicates(["block"]).select("doc_id", "text", F.col("before").alias("block"), F.lit(True).alias("tail"))
    rows = base.withColumn("tail", F.lit(False)).unionByName(tails)
    rows = rows.repartition("block").withColumn("h", h)
    keys = ["block", "tail", F.col("doc_id").asc_nulls_first(), "h"]
    rows = rows.sortWithinPartitions(*keys).withColumns(derive)
    w = Window.partitionBy("block").orderBy(*keys[1:])
    names = ["text", *derive]
    return rows.withColumns({f"next_{n}": F.lead(n).over(w) for n in names}).where("NOT tail").drop("block", "tail", "h")


def fingerprints(spark: SparkSession, docs: DataFrame, k: int = K, w: int = W) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next
    document's text. Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (position:hash, in
    hexadecimal, in the order of the text), near_edited and near_next: Jaccard similarity of the fingerprint's hashes
    with those of the edited text's, and of the next document's, fingerprint.

    Null texts count as empty; a text without words has an empty fingerprint, and two empty ones are alike (1.0). A
    text of fewer than k words is one k-gram. Null ids come first; repeated ids follow one another in an order fixed
    by their texts. A single document is its own next one. An empty table gives no rows. Columns other than doc_id
    and text are not looked at.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(spark, base, {"chosen": winnow(F.col("text"), k, w)})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.withColumn("edited_chosen", winnow(F.col("edited"), k, w))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        spelled(F.col("chosen")).alias("fingerprint"),
        spelled(F.col("edited_chosen")).alias("edited_fingerprint"),
        likeness(F.col("chosen"), F.col("edited_chosen")).alias("near_edited"),
        likeness(F.col("chosen"), F.col("next_chosen")).alias("near_next"),
    )
