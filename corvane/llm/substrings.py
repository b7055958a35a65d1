"""Exact substring dedup: words covered by a window of words that starts more than once in the corpus.

Every window of ``size`` consecutive words gets a Rabin-Karp hash. Spark counts them in two exchanges:

1. documents are dealt into groups; a group sends each window hash once to the bucket that owns it, so a passage that
   a third of all documents share still arrives at most once per group;
2. a bucket finds the hashes that several groups sent, or one group saw twice, and answers each group with one bit per
   hash, in the order sent.

A group then merges the windows that are repeated into maximal intervals and removes them. Groups and buckets are
sized by the corpus, so neither a group's texts nor a bucket's hashes grow with it.

Hashes have 64 bits, of which 56 and the bucket travel: among n distinct windows about n^2 / 2^62 pairs are expected
to be taken for equal by chance (0.004 for the 140 million windows of half a gigabyte).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .wordhash import chunks, window_hashes, word_hashes

SIZE = 35
#: Bytes of text in a group, and of text whose windows share a bucket (about 1.6 bytes of hashes for each byte).
GROUP_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
_SENT = 7  # bytes of a hash that travel


def _windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows, the text that each is in, and the word of that text at which it starts."""
    hashes, where, at = [], [], []
    for lo, hi in chunks(texts):
        words, begin = word_hashes(texts[lo:hi])
        count = np.maximum(np.diff(begin) - size + 1, 0)
        every = window_hashes(words, size)
        doc = np.repeat(np.arange(hi - lo), count)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        hashes.append(every[begin[doc] + start] if len(doc) else every[:0])
        where.append(doc + lo)
        at.append(start)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(where), np.concatenate(at)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(distinct: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that ascending hashes fall into, and where each begins (with the end): empty buckets cost nothing."""
    full, first = np.unique(_bucket_of(distinct, buckets), return_index=True)
    return full, np.r_[first, len(distinct)]


def _own(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in ascending order, the place of each window's hash among them, and how often each occurs."""
    return np.unique(hashes, return_inverse=True, return_counts=True)


def _texts(table: pa.Table) -> list[bytes]:
    return [(t or "").encode() for t in table.column("text").to_pylist()]


def _in_order(table: pa.Table) -> pa.Table:
    """Rows of a group in an order that does not depend on how they arrived."""
    return table.sort_by([("doc_id", "ascending"), ("h", "ascending")])


def send(table: pa.Table, size: int, buckets: int) -> pa.Table:
    """A group's distinct window hashes: one row per bucket."""
    distinct, _, _ = _own(_windows(_texts(_in_order(table)), size)[0])
    full, cut = _cuts(distinct, buckets)
    low = distinct.view(np.uint8).reshape(-1, 8)[:, :_SENT]
    return pa.table(
        {
            "bucket": pa.array(full, pa.int64()),
            "g": pa.array([table.column("g")[0].as_py()] * len(full), pa.int64()),
            "sent": pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
        }
    )


def answer(table: pa.Table) -> pa.Table:
    """A bucket's answers: for each group, one bit for each hash that it sent: does another group have it too?"""
    blobs = table.column("sent").to_pylist()
    sizes = np.array([len(b) // _SENT for b in blobs])
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :_SENT] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, _SENT)
    hashes = wide.reshape(-1).view(np.uint64)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    more = np.zeros(len(hashes), bool)
    more[order[1:][same]] = True
    more[order[:-1][same]] = True
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "g": table.column("g"),
            "bucket": table.column("bucket"),
            "bits": pa.array([np.packbits(more[e - n : e]).tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()),
        }
    )


def cover(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of ``n`` words lie in a window that starts at one of ``starts``: the union of the intervals."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:n]) > 0


def intervals(gone: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first word, word after the last) of removed words."""
    edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def remove(docs: pa.Table, answers: pa.Table, size: int, buckets: int, kind: pa.DataType) -> pa.Table:
    """A group's documents without the repeated windows."""
    docs = _in_order(docs)
    texts = _texts(docs)
    hashes, where, at = _windows(texts, size)
    distinct, place, count = _own(hashes)
    more = count > 1
    full, cut = _cuts(distinct, buckets)
    spot = dict(zip(full.tolist(), range(len(full)), strict=True))
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        k = spot[b]
        n = cut[k + 1] - cut[k]
        more[cut[k] : cut[k + 1]] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
    hit = more[place] if len(place) else np.zeros(0, bool)
    where, at = where[hit], at[hit]
    begin = np.searchsorted(where, np.arange(len(texts) + 1))
    rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept": [], "removed": []}
    for i, text in enumerate(texts):
        words = text.split()
        starts = at[begin[i] : begin[i + 1]]
        runs: list[tuple[int, int]] = []
        kept = words
        if len(starts):
            runs = intervals(cover(starts, size, len(words)))
            kept, last = [], 0
            for lo, hi in runs:
                kept += words[last:lo]
                last = hi
            kept += words[last:]
        rows["n_words"].append(len(words))
        rows["n_removed"].append(len(words) - len(kept))
        rows["kept"].append(b" ".join(kept))
        rows["removed"].append([{"first": lo, "end": hi} for lo, hi in runs])
    return pa.table(
        {
            "doc_id": docs.column("doc_id").cast(kind),
            "n_words": pa.array(rows["n_words"], pa.int64()),
            "n_removed": pa.array(rows["n_removed"], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in rows["kept"]], pa.string()),
            "kept": pa.array([k.decode() for k in rows["kept"]], pa.string()),
            "removed": pa.array(rows["removed"], pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
        }
    )


def dedup_substrings(spark: SparkSession, docs: DataFrame, size: int = SIZE, texts: bool = True) -> DataFrame:
    """Remove every word that a repeated window of ``size`` words covers.

    Words are runs of anything but ASCII white space, unchanged. A window is repeated if its word sequence also starts
    anywhere else, the same document included; windows are judged on the input. Returns doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), and with ``texts`` also kept (that text) and removed (the
    intervals of word positions).

    Null texts count as empty; texts of fewer than ``size`` words lose nothing. Repeated rows are documents of their
    own and so remove each other's windows; a null doc_id is kept as it is. An empty table gives no rows. Columns
    other than doc_id and text are not looked at.
    """
    known = docs.select(F.col("doc_id"), F.col("text"))
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups, buckets = max(least, -(-total // GROUP_BYTES)), max(least, -(-total // BUCKET_BYTES))
    h = F.xxhash64("doc_id", "text")
    dealt = known.withColumn("h", h).withColumn("g", F.pmod(h, F.lit(groups)).cast("long"))
    sent = dealt.groupBy("g").applyInArrow(lambda t: send(t, size, buckets), "bucket long, g long, sent binary")
    told = sent.groupBy("bucket").applyInArrow(answer, "g long, bucket long, bits binary")
    kind = docs.schema["doc_id"].dataType.simpleString()
    as_arrow = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def last(d: pa.Table, a: pa.Table) -> pa.Table:
        out = remove(d, a, size, buckets, as_arrow) if len(d) else None
        if out is None:
            return pa.table({n: pa.array([], t) for n, t in _KEPT.items()} | {"doc_id": pa.array([], as_arrow)}).select(names)
        return out.select(names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept", "removed"] if texts else [])]
    schema = f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string"
    schema += ", kept string, removed array<struct<first: int, end: int>>" if texts else ""
    return dealt.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(last, schema)


_KEPT = {
    "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string(),
    "removed": pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])),
}
