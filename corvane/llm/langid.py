"""Language identification with language-bitmask n-gram filters.

Every learned language owns one Bloom filter over character n-grams. The filters are bit-sliced: entry ``p`` of the
table is a bitmask whose bit ``l`` says whether position ``p`` is set in the filter of language ``l``. Fetching an
n-gram's positions and and-ing the masks answers for all languages at once. A text's n-grams give one hit count per
language; the hits expected from false positives alone are taken off, and the largest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: n-gram lengths in code points, white space and word edges included.
SIZES = (2, 3, 4)
#: positions in the table (a power of two) and positions per n-gram.
POSITIONS, HASHES = 1 << 21, 2
#: labelled rows that are fitted on, per language (on average: rows are drawn by a hash of their id).
ROWS_PER_LANG = 1200
#: a language contains an n-gram that at least MIN_DOCS of its rows have, at no less than SHARE of the highest rate
#: that any language has it at.
MIN_DOCS, SHARE = 2, 0.25
SLICE = 8  # languages per table: one byte a position
UNDETERMINED = "und"

_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_TOP = 0x110000


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else a space."""
    out = np.full(_TOP, 32, np.uint32)
    for lo in range(0, _TOP, 4096):
        if not 0xD800 <= lo < 0xE000:
            for c in range(lo, lo + 4096):
                if chr(c).isalpha():
                    out[c] = c
    return out


def _clean(text: str) -> np.ndarray:
    """Lower-cased letters of a text as code points; every run of anything else is one space, as are both ends."""
    cp = _letters()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)]
    blank = cp == 32
    keep = np.ones(len(cp), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    return cp[keep].astype(np.uint64)


def _grams(cp: np.ndarray) -> list[np.ndarray]:
    """64-bit keys of all n-grams, one array for each size."""
    out = []
    for n in SIZES:
        if len(cp) >= n:
            key = cp[: len(cp) - n + 1].copy()
            for j in range(1, n):
                key = key * _MULT[0] + cp[j : len(cp) - n + 1 + j]
            key ^= key >> np.uint64(29)
            out.append(key * _MULT[1] + np.uint64(n))
    return out


def _positions(keys: np.ndarray) -> list[np.ndarray]:
    low = np.uint64(POSITIONS - 1)
    return [((keys * m) >> np.uint64(40)) & low if i else (keys >> np.uint64(33)) & low for i, m in enumerate(_MULT)][:HASHES]


@dataclass(frozen=True)
class Model:
    """``tables[s][p]``: mask over languages ``8s..8s+7``; ``false_rate[l]``: chance that a foreign n-gram hits."""

    langs: tuple[str, ...]
    tables: tuple[np.ndarray, ...]
    false_rate: np.ndarray
    fallback: str

    def score(self, text: str | None) -> tuple[str, float]:
        """The language of a text and its share of the corrected hits; ("und", 0) without any letter."""
        if not text or not self.langs:
            return UNDETERMINED, 0.0
        cp = _clean(text)
        if len(cp) < 2:
            return UNDETERMINED, 0.0
        grams = _grams(cp)
        hits, n = np.zeros(len(self.tables) * SLICE), sum(map(len, grams))
        spots = [_positions(k) for k in grams]
        for s, table in enumerate(self.tables):
            seen = np.zeros(256, np.int64)
            for at in spots:
                mask = table[at[0]]
                for more in at[1:]:
                    mask = mask & table[more]
                seen += np.bincount(mask, minlength=256)
            hits[s * SLICE : (s + 1) * SLICE] = seen @ _BITS
        hits = hits[: len(self.langs)]
        true = np.maximum(0.0, (hits - n * self.false_rate) / (1.0 - self.false_rate))
        if not true.any():
            return self.fallback, 0.0
        best = int(true.argmax())
        return self.langs[best], float(true[best] / true.sum())


_BITS = ((np.arange(256)[:, None] >> np.arange(SLICE)) & 1).astype(np.int64)


def build(rows: list[tuple[str, str]]) -> Model:
    """Fit on (text, language) rows; languages are learned in alphabetical order."""
    by: dict[str, list[np.ndarray]] = {}
    for text, lang in rows:
        cp = _clean(text)
        if len(cp) >= 2:
            by.setdefault(lang, []).append(np.unique(np.concatenate(_grams(cp))))
    langs = tuple(sorted(by))
    counted = [np.unique(np.concatenate(by[x]), return_counts=True) for x in langs]
    keys = np.unique(np.concatenate([k for k, _ in counted])) if langs else np.zeros(0, np.uint64)
    rate = np.zeros((len(langs), len(keys)))
    enough = np.zeros(rate.shape, bool)
    for i, (k, n) in enumerate(counted):
        at = np.searchsorted(keys, k)
        rate[i, at] = n / len(by[langs[i]])
        enough[i, at] = n >= min(MIN_DOCS, len(by[langs[i]]))
    held = enough & (rate >= SHARE * rate.max(axis=0, initial=0.0))
    tables = tuple(np.zeros(POSITIONS, np.uint8) for _ in range(-(-len(langs) // SLICE)))
    fill = np.zeros(len(langs))
    for i in range(len(langs)):
        bit, table = np.uint8(1 << (i % SLICE)), tables[i // SLICE]
        for at in _positions(keys[held[i]]):
            table[at] |= bit
        fill[i] = np.count_nonzero(table & bit) / POSITIONS
    fallback = max(langs, key=lambda x: (len(by[x]), x)) if langs else UNDETERMINED
    return Model(langs, tables, fill**HASHES, fallback)


def fit(spark: SparkSession, labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Fit on a bounded sample of ``labelled(doc_id, text, lang)``: about ``rows_per_lang`` rows of each language.

    The counts per language come from all rows; the sample is drawn by a hash of the id, so it does not depend on
    partitioning, and its size does not grow with the table.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return build([])
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, int(min(1.0, rows_per_lang / n) * 2**31))])
    drawn = known.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(5)), F.lit(2**31)) < limits[F.col("lang")])
    return build([(r["text"], r["lang"]) for r in drawn.select("text", "lang").toLocalIterator()])


def predict(spark: SparkSession, model: Model, text: Column) -> Column:
    """Column struct(lang, score) for a text column. The model (2 MB per 8 languages) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for texts in batches:
            yield pd.DataFrame([own.score(t) for t in texts], columns=["lang", "score"])

    return udf(text)


def held_out(doc_id: Column) -> Column:
    """True for rows that are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of ``docs(doc_id, text, lang)``.

    Learns from ``learn_from`` (default: ``docs``) without the held-out rows. Null texts and texts without a letter
    get "und" and score 0, as does everything if there is nothing to learn from. Letters of which no n-gram is known
    give the most frequent language, with score 0. Ties go to the alphabetically first language. Repeated rows are
    predicted alike; an empty table gives no rows; further columns are not looked at.
    """
    base = docs if learn_from is None else learn_from
    model = fit(spark, base.where(~held_out(F.col("doc_id"))))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(spark, model, F.col("text")).alias("_p"))
    return out.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"))


def keep_identified(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language, columns unchanged.

    Rejects texts without a letter (and null texts), and texts of which no n-gram belongs to any learned language.
    """
    model = fit(spark, docs.where(~held_out(F.col("doc_id"))))
    cols = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.select(F.struct(*cols).alias("_row"), predict(spark, model, F.col("text")).alias("_p"))
    return found.where((F.col("_p.lang") != UNDETERMINED) & (F.col("_p.score") > 0)).select("_row.*")
