"""Near-duplicate documents by SuperMinHash signatures, banding, verification on full sets, and components.

SuperMinHash gives each element of a set one random permutation of the signature's places: in step j the element bids
(j + random number) for the j-th place of its permutation. As step j's bids are all below step j+1's, a signature is
final as soon as every place has a bid, which stops the work after a few steps for all but the smallest sets; and as an
element bids for each place once, the places are correlated such that estimates vary less than with independent hashes.

Documents with the same shingle set form one class at once. The classes' signatures are cut into bands; classes that
agree in a band are candidates. No group emits its pairs: in each round, every bucket that still holds several
components links its members to one pivot (the member with the most neighbours, which in a group of copies is the one
that was changed least), links are verified on full sets, and components grow. A pivot is then done with its bucket. What
is left after the last round are strays; a stray is compared with what it shares a bucket with, by prefix filtering, which makes
a pair only of sets that share one of their rarest shingles.

A pair of similarity s shares no bucket with probability (1 - s^rows)^bands; links of pairs that share one are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, extend_components, small_side
from .linking import link_groups, shared_buckets
from .wordhash import chunks, mix, word_hashes

_U = np.uint64
#: 32 bands of 5 places: a pair at similarity 0.8 is missed with probability 3e-6, one at 0.85 with 2e-8.
BANDS, ROWS = 32, 5


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of lower-cased texts as sorted 64-bit hashes; where each text's set begins.

    A text of fewer than k words is one shingle as a whole; a text without words has none.
    """
    words, begin = word_hashes([t.lower() for t in texts])
    n = np.diff(begin)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), count)
    start = begin[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(n, k)[doc]
    h = np.zeros(len(doc), np.uint64)
    for j in range(k):
        on = j < size
        h[on] = mix(h[on] * _U(0x9FB21C651E98DF25) + words[start[on] + j])
    h = mix(h + size.astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[first], doc[first]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def signatures(elements: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (sets x m) of sets of 64-bit hashes; an empty set's are all -1.

    All sets take a step together. Step j: each element draws one of the places its permutation has not used (a
    Fisher-Yates shuffle, of which only the places touched are kept) and bids for it. Sets whose places are all
    taken drop out.
    """
    sets = len(begin) - 1
    sizes = np.diff(begin)
    best = np.full((sets, m), np.inf)
    flat = best.reshape(-1)
    live = sizes > 0
    owner = np.repeat(np.arange(sets), sizes)
    seed = elements
    perm: np.ndarray | None = None  # the permutations of the elements of live sets, made when a second step is needed
    for j in range(m):
        if not len(seed):
            break
        draw = mix(seed + _U(j * 0x9E3779B97F4A7C15 % 2**64))
        bid = (draw >> _U(11)).astype(np.float64) * 2.0**-53 + j
        pick = j + ((mix(draw) >> _U(32)) * _U(m - j) >> _U(32)).astype(np.int64)
        if perm is None:
            place = pick
        else:
            rows = np.arange(len(seed))
            place = perm[rows, pick].astype(np.int64)
            perm[rows, pick] = perm[rows, j]
            perm[rows, j] = place
        at = owner * m + place
        order = np.lexsort((bid, at))
        at, low = at[order], bid[order]
        lead = np.ones(len(at), bool)
        lead[1:] = at[1:] != at[:-1]
        flat[at[lead]] = np.minimum(flat[at[lead]], low[lead])
        done = ~np.isinf(best).any(axis=1)
        keep = live[owner] & ~done[owner]
        if perm is None:
            seed, owner, pick = seed[keep], owner[keep], pick[keep]
            rows = np.arange(len(seed))
            perm = np.tile(np.arange(m, dtype=np.int16), (len(seed), 1))
            perm[rows, pick] = 0
            perm[rows, 0] = pick
        elif not keep.all():
            seed, owner, perm = seed[keep], owner[keep], perm[keep]
    best[~live] = -1.0
    return best


def _band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per set and band."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(rows):
        h = mix(h * _U(0x9FB21C651E98DF25) + bits[:, :, r])
    return h


def _bytes(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def sketches(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n_shingles, d1, d2, keys): d1 and d2 are a 128-bit digest of the set."""
    for batch in batches:
        texts = _bytes(batch.column(1))
        for lo, hi in chunks(texts, 1 << 19):
            h, begin = shingle_sets(texts[lo:hi], k)
            total = np.zeros((2, len(h) + 1), np.uint64)
            np.cumsum(h, out=total[0, 1:])
            np.cumsum(mix(h ^ _U(0xA0761D6478BD642F)), out=total[1, 1:])
            d = total[:, begin[1:]] - total[:, begin[:-1]]
            keys = _band_keys(signatures(h, begin, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(lo, hi - lo),
                    pa.array(np.diff(begin).astype(np.int64)),
                    pa.array(d[0].view(np.int64)),
                    pa.array(d[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "keys"],
            )


def sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(c, text) to (c, x, s): the whole set, and a hash of it."""
    for batch in batches:
        texts = _bytes(batch.column(1))
        for lo, hi in chunks(texts):
            h, begin = shingle_sets(texts[lo:hi], k)
            total = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(mix(h), out=total[1:])
            x = (total[begin[1:]] - total[begin[:-1]]).view(np.int64)
            s = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(x), s], ["c", "x", "s"])


def near_duplicates(
    spark: SparkSession, docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs(doc_id, text)``.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A document's set holds its distinct k-word
    shingles (the whole sequence if it has fewer than k words). Two documents are linked if 100 * |intersection| >=
    percent * |union|; component_id is the smallest doc_id that can be reached, and kept marks that document.

    Null texts and texts without words have an empty set and are linked with nothing. Rows that repeat a doc_id with
    different texts are one document, which carries the links of all of them; each row is returned. Rows with a
    null doc_id take no part: their component_id is null and they are kept. An empty table gives no rows. Columns
    other than doc_id and text are not looked at.
    """
    scratch = Scratch(spark, "minhash")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"
    sized = scratch.save(known.mapInArrow(lambda b: sketches(b, k, bands, rows), schema), "sketches")
    # one class for each distinct set, named by its smallest doc_id; equal sets have equal keys
    full = sized.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("c"))
    classes = scratch.save(classes, "classes")
    # a doc_id with several texts has several classes, which are one document's: they are linked from the start
    owners = full.join(classes, ["d1", "d2"]).select("doc_id", "c")
    several = scratch.save(owners.groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("most")).where("lo < most"), "several")
    labels = None
    if not several.isEmpty():
        own = owners.join(small_side(several), "doc_id").where("c > lo").select("lo", F.col("c").alias("hi")).distinct()
        labels = extend_components(scratch, None, own, "owners")
    members = full.join(classes, ["d1", "d2"]).where("doc_id = c").select("c", F.explode("keys").alias("key"))
    members = shared_buckets(scratch, members)
    texts = known.join(scratch.small(members.select(F.col("c").alias("doc_id")).distinct(), "ids"), "doc_id", "left_semi")
    sets = texts.mapInArrow(lambda b: sets_of(b, k), "c long, x long, s array<long>")
    sets = scratch.save(sets.dropDuplicates(["c", "x"]).select("c", "s"), "sets")
    scratch.sweep()

    rounds = iter(range(1000))

    def verify(pairs: DataFrame) -> DataFrame:
        one = sets.select(F.col("c").alias("lo"), F.col("s").alias("a")).join(small_side(pairs), "lo")
        his = scratch.small(pairs.select("hi").distinct(), f"his-{next(rounds)}")
        both = one.join(sets.select(F.col("c").alias("hi"), F.col("s").alias("b")).join(his, "hi", "left_semi"), "hi")
        common = F.size(F.array_intersect("a", "b"))
        union = F.size("a") + F.size("b") - common
        return both.where(100 * common >= percent * union).select("lo", "hi").distinct()

    def rest(left: DataFrame) -> DataFrame:
        """Pairs of strays by prefix filtering with positions, which loses no link.

        Shingles are ordered from the rarest to the most common. Sets that reach the similarity share a shingle among
        the first n - ceil(percent * n / 100) + 1 of each, and from their first shared one on enough must be left to
        reach it. What one document alone has comes first, so a set that was changed too much shares none there.
        """
        docs_left = left.groupBy("c").agg(F.max("root").alias("root"), F.max("stray").alias("stray"))
        own = sets.join(scratch.small(docs_left, "docs-left"), "c").select("c", "root", "stray", F.size("s").alias("n"), F.explode("s").alias("x"))
        df = own.groupBy("x").agg(F.count(F.lit(1)).alias("df"))
        order = Window.partitionBy("c").orderBy("df", "x")
        first = own.join(df, "x").withColumn("i", F.row_number().over(order) - 1)
        first = scratch.save(first.where("df > 1").where(F.col("i") <= F.col("n") - F.ceil(F.col("n") * percent / 100)), "prefixes")
        stray, other = first.where("stray"), first.select(*[F.col(k).alias(f"{k}2") for k in ("x", "c", "root", "stray", "n", "i")])
        most = 1 + F.least(F.col("n") - F.col("i") - 1, F.col("n2") - F.col("i2") - 1)
        enough = (100 + percent) * most >= percent * (F.col("n") + F.col("n2"))
        once = ~F.col("stray2") | (F.col("c") < F.col("c2"))
        pairs = stray.join(other, (F.col("x") == F.col("x2")) & (F.col("root") != F.col("root2")) & once & enough)
        return pairs.select(F.least("c", "c2").alias("lo"), F.greatest("c", "c2").alias("hi"))

    labels = link_groups(scratch, members, verify, rest, labels)
    # several classes can have the same name c: they are of one doc_id, and so in one component
    named = classes.join(labels.withColumnRenamed("id", "c"), "c", "left").select("d1", "d2", F.coalesce("root", "c").alias("root"))
    named = scratch.save(named, "named")
    sized = scratch.save(sized.drop("keys"), "sized")
    scratch.sweep()
    scratch.drop("sketches", "classes", "several", "ids", "sets", "docs-left", "prefixes", *[f"his-{k}" for k in range(next(rounds))])
    out = sized.join(named, ["d1", "d2"], "left")
    empty = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    out = out.withColumn("component_id", F.when(empty, F.col("doc_id")).otherwise(F.col("root")))
    kept = F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(spark: SparkSession, docs: DataFrame, *, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the row with the smallest doc_id stays.

    Here each different (doc_id, text) is a document of its own, so a text never goes because another text has the same
    doc_id. Of rows that repeat doc_id and text, and of several texts with the smallest doc_id, one stays. Null doc_ids
    come after all others. Rows without words are linked with nothing and all stay. Columns are unchanged.
    """
    scratch = Scratch(spark, "keep")
    key = F.xxhash64("doc_id", "text")
    found = near_duplicates(spark, docs.select(key.alias("doc_id"), "text"), k=k, percent=percent)
    found = scratch.save(found.where("n_shingles > 0").select(F.col("doc_id").alias("key"), F.col("component_id").alias("root")), "found")
    groups = found.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # rows alone in their group stay
    several = scratch.save(found.join(scratch.small(groups, "groups"), "root", "left_semi").distinct(), "several")
    ids = docs.select(key.alias("key"), "doc_id").join(small_side(several), "key")
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    kept = ids.groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.key").alias("key"))
    kept = scratch.save(kept.withColumn("kept", F.lit(True)), "kept")
    marks = scratch.small(several.select("key").join(small_side(kept), "key", "left"), "marks")
    whole = docs.select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    marked = whole.join(marks.withColumn("_met", F.lit(True)), whole["_key"] == marks["key"], "left")
    alone = marked.where("_met IS NULL").select("_d.*")
    # few rows have a kept key more than once; one of them stays
    copy = F.row_number().over(Window.partitionBy("_key").orderBy(F.to_json("_d")))
    one = marked.where("kept").withColumn("_copy", copy).where("_copy = 1").select("_d.*")
    scratch.drop("found", "groups", "several", "kept")
    return alone.unionByName(one)
