"""Corpus operators against brute force, on small tables with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bitplanes, html_text, langid, lines, minhash, mixing, neighbours, pieces, substrings, winnowing
from corvane.llm.common import Scratch, components, size_of, small_side
from corvane.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long, c string, key string, row string, tail boolean"


def corpus(seed=3, n=60):
    """Random documents with copies, near copies, shared passages and repeated lines, besides nulls and empty texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeghilmnorstuéß") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    say = lambda k: [rng.choice(words) for _ in range(k)]
    passage, line = say(60), " ".join(say(9))
    texts = []
    for i in range(n):
        kind = i % 6
        body = say(rng.randint(1, 160))
        if kind == 1 and texts:
            body = (rng.choice(texts) or "x").split()  # a copy, with other white space
        elif kind == 2 and texts:
            body = (rng.choice(texts) or "x").split()
            for _ in range(max(1, len(body) // 40)):
                body[rng.randrange(len(body))] = rng.choice(words)
        elif kind == 3:
            body = body[:20] + passage + body[20:]
        text = " ".join(body)
        texts.append(text + "\n" + line if kind == 4 else text)
    texts += [None, "", " \n\t ", "!!!", "eins", "Eins", "a\nb\n\na", "x" * 30_000, "w " * 5_000]
    return [(i * 3, t, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src11", "src17", None, "zz"]), -1, "c", "k", "r", True) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    out = corpus()
    return out + out[5:8]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def texts_of(rows):
    return {r[0]: r[1] for r in rows}


# -- 4


def sets(rows, k):
    out = {}
    for i, t in texts_of(rows).items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, docs, rows, none, k):
    s = sets(rows, k)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(spark, docs, k=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), find(r.doc_id), find(r.doc_id) == r.doc_id)
    assert minhash.near_duplicates(spark, none, k=k).count() == 0


def test_superminhash_is_unbiased_and_complete():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for size, common in ((5, 4), (60, 48), (900, 450)):
        est = []
        for t in range(20):
            p = rng.permutation(pool)
            a, b = np.sort(p[:size]), np.sort(p[size - common : 2 * size - common])
            sig = minhash.signatures(np.concatenate([a, b]), np.array([0, size, 2 * size]), 160)
            assert np.isfinite(sig).all()
            est.append((sig[0] == sig[1]).mean())
        assert abs(np.mean(est) - common / (2 * size - common)) < 0.03
    assert (minhash.signatures(np.zeros(0, np.uint64), np.array([0, 0]), 8) == -1).all()
    alone = minhash.signatures(pool[:1], np.array([0, 1]), 40)
    assert sorted(np.floor(alone[0]).astype(int)) == list(range(40))  # one element bids once for each place


def test_null_ids_and_pivots(spark):
    base = [f"w{i}" for i in range(120)]
    near = []
    for i in range(40):  # copies of a base that are links of the base, but mostly not of each other
        w = list(base)
        for j in random.Random(i).sample(range(120), 6):
            w[j] = f"x{i}_{j}"
        near.append((100 + i, " ".join(w)))
    data = [*near, (500, " ".join(base)), (None, " ".join(base)), (None, None)]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), k=2).collect()}
    assert got == {(i, 100) for i, _ in near} | {(500, 100), (None, None)}


def test_texts_that_share_a_doc_id(spark):
    a, b = "a b c d e f g h i j k l", "m n o p q r s t u v w x y z"
    df = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (3, a), (None, a), (13, None), (13, None)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark, df, k=2).collect()}
    assert got == {(3, 3, True), (5, 3, False), (9, 3, False), (None, None, True), (13, 13, True)}
    # a filter takes each text for itself: neither text is lost
    left = sorted((r.doc_id, r.text) for r in minhash.keep_one(spark, df).collect())
    assert left == [(3, a), (5, b), (13, None), (13, None)]


# -- 7


@pytest.mark.parametrize("size", [3, 35])
def test_substrings(spark, docs, rows, none, size):
    count, words = {}, [(r[0], (r[1] or "").encode().split()) for r in rows]
    for _, w in words:
        for j in range(len(w) - size + 1):
            count[tuple(w[j : j + size])] = count.get(tuple(w[j : j + size]), 0) + 1
    want = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if count[tuple(w[j : j + size])] > 1:
                gone[j : j + size] = [True] * size
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = substrings.dedup_substrings(spark, docs, size).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert all(sum(x["end"] - x["first"] for x in r.removed) == r.n_removed for r in got)
    assert substrings.dedup_substrings(spark, none, size).count() == 0


# -- 8


def fingerprint(text, k, w):
    """The definition, over gram identities instead of hashes: which positions are chosen depends on the hash order."""
    words = text.lower().strip(" \t\n\x0b\x0c\r").split() if text else []
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def test_fingerprints(spark, rows, none):
    data = [r for r in rows if r[0] != 15]
    df = spark.createDataFrame(data, DOCS)
    order = sorted(data, key=lambda r: r[0])
    got = winnowing.fingerprints(spark, df).orderBy("doc_id").collect()
    assert len(got) == len(data)
    by_text = {}
    first = {}
    for r in order:
        first.setdefault(r[0], r[1] or "")
    ids = sorted(first)
    for g in got:
        text = first[g.doc_id]
        nxt = first[ids[(ids.index(g.doc_id) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        assert g.n_chars == len(text)
        if sum(r[0] == g.doc_id for r in data) == 1:
            assert g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(text, set()).add(g.fingerprint)
        assert 0 <= g.near_edited <= 1 and 0 <= g.near_next <= 1
        assert (g.fingerprint == "") == (not text.split())
        grams = fingerprint(text, winnowing.K, winnowing.W)
        spots = [int(x.split(":")[0], 16) for x in g.fingerprint.split()]
        assert spots == sorted(spots) and all(p < len(grams) for p in spots)
        if grams:  # every window has a chosen position
            w = winnowing.W
            assert all(any(s <= p < s + w for p in spots) for s in range(max(1, len(grams) - w + 1)))
    assert all(len(v) == 1 for v in by_text.values())
    assert winnowing.fingerprints(spark, none).count() == 0
    one = winnowing.fingerprints(spark, spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_winnow_takes_the_rightmost_minimum(spark):
    df = spark.createDataFrame([("a b c a b c a b c a b c x y",)], "t string")
    row = df.select(winnowing.winnow(F.col("t"), 3, 4).alias("w"), winnowing.grams(winnowing.words(F.col("t")), 3).alias("g")).first()
    h = [x & 0xFFFFFFFF for x in row.g]
    want = sorted({min(range(s, s + 4), key=lambda i: (h[i], -i)) for s in range(len(h) - 3)})
    assert [2**31 - 1 - (x & (2**31 - 1)) for x in row.w] == want


# -- 1


def edit(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


def test_lines(spark, none):
    long = " ".join(f"wort{i}" for i in range(80))
    near = long.replace("wort40", "wart40")
    data = [
        (1, "Alpha beta, gamma!\nother line here", "a"), (2, "alpha  BETA gamma\n---\nunique words stand here", "b"), (3, long + "\ntail of three", "c"),
        (4, near, "d"), (5, None, "e"), (6, "", "f"), (7, "\n\n", "g"), (8, "same\nsame\nsame", "h"), (9, "alpha beta gamma", "i"), (9, "alpha beta gamma", "i"),
        (None, "other line here\nonly the null id has this", "j"),
    ]
    df = spark.createDataFrame(data, "doc_id long, text string, line string")
    got = {r.doc_id: r for r in lines.dedup_lines(spark, df).collect()}
    assert got[1].text == "Alpha beta, gamma!\nother line here" and got[1].n_removed == 0
    assert got[2].text == "---\nunique words stand here" and (got[2].n_lines, got[2].n_removed) == (3, 1)
    assert got[4].text == "" and got[4].n_removed == 1  # one word of eighty differs by a letter
    assert got[5].text is None and got[5].n_lines == 0 and got[6].text == "" and got[7].text == "\n\n"
    assert got[8].text == "same" and got[8].n_removed == 2 and got[9].text == ""
    twice = spark.createDataFrame([(1, "one line of text\n--"), (1, "one line of text\n--"), (2, "x")], "doc_id long, text string")
    assert sorted(r.text for r in lines.dedup_lines(spark, twice).collect()) == ["--", "one line of text\n--", "x"]  # one occurrence stays
    assert got[None].text == "only the null id has this"
    kept = lines.dedup_lines(spark, df, columns=True)
    assert kept.columns == df.columns and sorted((r.doc_id or 0, r.line) for r in kept.collect()) == [(0, "j"), (1, "a"), (2, "b"), (3, "c"), (5, "e"), (6, "f"), (7, "g"), (8, "h")]
    assert lines.dedup_lines(spark, none).count() == 0 and lines.dedup_lines(spark, none, columns=True).columns == none.columns


def test_simhash_votes(spark):
    """Both halves of a line's SimHash against a count of votes, bit by bit."""
    texts = ["alpha beta gamma delta epsilon", "alone", "a b b b c " * 400 + "z", "word " * 9, " ".join(f"w{i}" for i in range(40)), "one two"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    feats = lines.occurrences(df).select("doc_id", lines.features(F.col("words")).alias("f"), "words").collect()
    keyed = {r.doc_id: r for r in lines.keyed_lines(df).collect()}
    for r in feats:
        assert list(r.f) == sorted(r.f) and len(r.f) == len(r.words)
        sample = [x for x in r.f[: lines.SAMPLE] if x != lines._NONE]
        assert keyed[r.doc_id].n == len(sample) and set(sample[: lines.KEYS]) <= set(keyed[r.doc_id].grams)
        hashed = spark.createDataFrame([(x,) for x in sample], "f long").select(F.xxhash64("f", F.lit(0)).alias("a"), F.xxhash64("f", F.lit(1)).alias("b")).collect()
        for half, got in (("a", keyed[r.doc_id].s0), ("b", keyed[r.doc_id].s1)):
            want = sum(1 << j for j in range(64) if 2 * sum((h[half] & (2**64 - 1)) >> j & 1 for h in hashed) > len(sample))
            assert got & (2**64 - 1) == want


def test_lines_with_changed_words_and_letters(spark):
    """Near copies in the reach of similarity 0.8 are candidates, whatever the length of the line."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuwz") for _ in range(rng.randint(3, 8)))
    data, most = [], 0
    for n in (1, 2, 3, 6, 8, 10, 20, 40, 100):
        for kind in ("word", "letter", "letters"):
            for _ in range(10):
                line = [word() for _ in range(n)]
                other = list(line)
                if kind == "word":
                    for i in rng.sample(range(n), max(1, n // 10)):
                        other[i] = word()
                a, b = " ".join(line), list(" ".join(other))
                if kind != "word":
                    for i in rng.sample([i for i, x in enumerate(b) if x != " "], max(1, len(b) // 20) if kind == "letters" else 1):
                        b[i] = rng.choice("jqvxy")
                b = "".join(b)
                if a != b and edit(a, b) <= max(len(a), len(b)) // 5:
                    data += [(most, a), (most + 1, b)]
                    most += 2
    cjk = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(60))  # no spaces: one word
    data += [(most, cjk), (most + 1, "\u8d77" + cjk[1:30] + "\u8d77" + cjk[31:])]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    missed = [(a, b) for (i, a), (j, b) in zip(data[::2], data[1::2], strict=True) if not got[j]]
    assert len(data) > 300 and len(missed) <= 0.01 * len(data) / 2, (len(missed), missed[:5])


def test_lines_that_share_a_crowded_bucket_only(spark):
    """Forty lines that have one pair of words in common; each has a near copy in which all other words have changed."""
    rng = random.Random(12)
    data = []
    for i in range(20):
        words = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(8)) for _ in range(7)]
        changed = [w[:k] + "z" + w[k + 1 :] for w in words for k in [rng.randrange(8)]]
        a, b = (" ".join(["shared", "phrases", *w]) for w in (words, changed))
        assert edit(a, b) <= len(a) // 5
        data += [(2 * i, a), (2 * i + 1, b)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark, spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {i: i % 2 for i in range(40)}


def test_lines_met_in_cells(spark, monkeypatch):
    """Strays of a crowded bucket against all of it, pair by pair, though the bucket is dealt to many parts; no row is dealt out pair by pair."""
    monkeypatch.setattr(lines, "PART", 5)
    rng = random.Random(6)
    rows = []
    for key, n in ((1, 43), (2, 2), (3, 5), (4, 12)):
        base = "".join(rng.choice("abcdefgh ") for _ in range(40))
        for i in range(n):
            line = list(base)
            for _ in range(rng.randint(0, 14)):
                line[rng.randrange(len(line))] = rng.choice("xyz")
            norm = "".join(line) + "t" * rng.randint(0, 20)
            rows.append((key, rng.getrandbits(40), i % 7, i % 3 > 0, norm))
    df = spark.createDataFrame(rows, "key long, c long, root long, stray boolean, norm string").withColumn("m", F.length("norm"))
    df = df.withColumn("head", lines.head(F.col("norm"))).drop("norm")
    scratch = Scratch(spark, "cells")
    got = [tuple(sorted(r)) for r in lines.met_in_cells(scratch, df).collect()]
    pairs = [(a, b) for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] and a[2] != b[2] and (a[3] or b[3])]
    pairs = spark.createDataFrame([(a[1], len(a[4]), a[4], b[1], len(b[4]), b[4]) for a, b in pairs], "c long, m int, a string, c2 long, m2 int, b string")
    pairs = pairs.withColumn("a", lines.head(F.col("a"))).withColumn("b", lines.head(F.col("b")))
    want = [tuple(sorted(r)) for r in pairs.where(lines.heads_near("a", "m", "b", "m2")).select("c", "c2").collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)


def test_sizes_are_known_without_a_job(spark):
    """A saved table is counted by the job that writes it: neither its size nor whether it is small takes another one."""
    scratch = Scratch(spark, "sizes")
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("sizes"))
    spark.sparkContext.setJobGroup("sizes", "")
    try:
        labels = components(scratch, spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"))
        some = scratch.sized(spark.createDataFrame([("ab", 1), (None, 2), ("c", 3)], "s string, n long"), "some")
        none = scratch.sized(some.where("n > 5"), "none")
        before = jobs()
        assert before > 0 and (size_of(labels)[0], size_of(some)[0], size_of(none)) == (3, 3, (0, 0))
        assert size_of(some)[1] == 3 * (16 + 8 * 2) + 3
        for df in (labels, some, none):
            small_side(df)
        small_side(labels.withColumnRenamed("id", "c"), of=labels)
        assert jobs() == before
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(tuple(r) for r in labels.collect()) == [(2, 1), (3, 1), (8, 7)]


def test_lines_shared_keys(spark):
    """A key has one row for each different line that has it, however often the line is there; keys of one line have none."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    df = spark.createDataFrame([(i, f"{t}\n{t}\n{texts[0]}") for i, t in enumerate(texts)], "doc_id long, text string")
    scratch, holders = Scratch(spark, "keys"), {}
    for r in lines.keyed_lines(df).withColumn("b", lines.blocks(F.col("s0"), F.col("s1"))).collect():
        for key in [*(r.b if r.n else []), *r.grams]:
            holders.setdefault(key, set()).add(r.id)
    holders = {k: v for k, v in holders.items() if len(v) > 1}
    members = lines.shared_keys(scratch, lines.placed_lines(df))
    got = [(r.key, r.c) for r in members.collect()]
    assert holders and len(got) == len(set(got)) and set(got) == {(k, c) for k, v in holders.items() for c in v}
    deg = {c: sum(len(v) for v in holders.values() if c in v) for v in holders.values() for c in v}
    assert {r.c: r.deg for r in members.collect()} == deg
    kept = lines.shared_lines(scratch, lines.placed_lines(df), members).collect()
    assert len(kept) == len(deg) and {r.id for r in kept} == set(deg)


# -- 10


def fill(children, amount):
    """Water-filling by bisection: children as (weight, capacity)."""
    lo, hi = 0.0, max(c / w for w, c in children) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, w * mid) for w, c in children) < amount:
            lo = mid
        else:
            hi = mid
    return [min(c, w * hi) for w, c in children]


def test_mixture(spark, rows, docs, none):
    for ratio, epochs in ((0.3, 1), (0.6, 3), (5.0, 2)):
        got = mixing.mix(spark, docs, budget_ratio=ratio, max_epochs=epochs).collect()
        leaf = lambda r: (mixing.DOMAINS.get(r[3], "other"), r[2] or "und", r[3] or "unknown")
        n = lambda r: len((r[1] or "").encode().split())
        tokens = {}
        for r in rows:
            tokens[leaf(r)] = tokens.get(leaf(r), 0) + n(r)
        tokens = {k: v for k, v in tokens.items() if v}
        amount = min(ratio * sum(tokens.values()), epochs * sum(tokens.values()))
        w = lambda kind, k: mixing.WEIGHTS[kind].get(k, mixing.WEIGHTS[kind]["*"])
        share = {}
        domains = sorted({k[0] for k in tokens})
        cap = lambda *p: epochs * sum(v for k, v in tokens.items() if k[: len(p)] == p)
        for d, a in zip(domains, fill([(w("domain_weights", d), cap(d)) for d in domains], amount), strict=True):
            langs = sorted({k[1] for k in tokens if k[0] == d})
            for x, b in zip(langs, fill([(w("lang_weights", x), cap(d, x)) for x in langs], a), strict=True):
                leaves = sorted(k for k in tokens if k[:2] == (d, x))
                share |= dict(zip(leaves, fill([(1.0, cap(*k)) for k in leaves], b), strict=True))
        taken = {}
        for g in got:
            k = (g.domain, g.lang, g.source)
            taken[k] = taken.get(k, 0) + g.n_tokens
        most = {k: max(n(r) for r in rows if leaf(r) == k) for k in tokens}
        for k in tokens:  # never over the share, and under it by less than one document (or a repeated one)
            assert taken.get(k, 0) <= share[k] + 1e-3 and taken.get(k, 0) > share[k] - 3 * most[k] - 1
        seen = {(g.doc_id, g.epoch) for g in got}
        assert all(e == 0 or (i, e - 1) in seen for i, e in seen) and max(e for _, e in seen) < epochs
    whole = mixing.mix(spark, docs, budget_ratio=0.5, max_epochs=1, texts=True)
    assert whole.columns == docs.columns
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in mixing.mix(spark, docs, budget_ratio=0.5, max_epochs=1).collect())
    assert mixing.mix(spark, none).count() == 0


# -- 5


def test_language(spark, none):
    rng = random.Random(2)
    vocab = {"en": "the and of that with were".split(), "de": "der und nicht die über für".split(), "fr": "le et dans où été que".split()}
    data = [(i, " ".join(rng.choice(vocab[k]) for _ in range(12)), k) for i in range(300) for k in [rng.choice(list(vocab))]]
    data += [(1000, None, "en"), (1001, "", "de"), (1002, "12 34 !?", "fr"), (1003, "the and", None), (None, "der und die", "de"), (1004, "汉字", "en")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(spark, df).collect()}
    for i, _, lang in data[:300]:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0 < got[i].score <= 1
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "en", "de"]
    assert got[1004].lang_pred in vocab and got[1000].score == 0
    kept = {r.doc_id for r in langid.keep_identified(spark, df).collect()}
    assert kept >= {i for i, _, _ in data[:300]} and not kept & {1000, 1001, 1002}
    assert langid.identify(spark, none).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(spark, unlabelled).collect()} == {"und"}


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(spark, df).join(df.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL")
    right, n = got.select(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert right / n > 0.98


def test_more_than_eight_languages():
    rows = [(f"{chr(97 + i)}x{chr(98 + i)}y " * 5, f"l{i:02d}") for i in range(12) for _ in range(3)]
    model = langid.build(rows)
    assert len(model.tables) == 2 and all(model.score(t)[0] == lang for t, lang in rows)


# -- 6


def test_pieces_equal_the_library(spark, docs, rows, none):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["a  b   c ", "▁x", "x\x00y", "12３ 漢字 日本語。", "    return   x", "\U0001f642", "aaaaaaaaaaaaaaaaaaaaaaa"]
    model = pieces.load(path)
    for t, got in zip(odd, model.encode(odd), strict=True):
        assert np.frombuffer(got, "<i4").tolist() == sp.encode(t) and model.decode(sp.encode(t)) == sp.decode(sp.encode(t))
    for r in pieces.encode_documents(docs, path).collect():
        text = texts_of(rows)[r.doc_id] or ""
        assert list(r.piece_ids) == sp.encode(text) and r.n_pieces == len(r.piece_ids) and r.round_trip
    assert pieces.encode_documents(none, path).count() == 0


def test_unigram_viterbi_equals_brute_force():
    rng = random.Random(4)
    vocab = [("<unk>", 0.0, False, True), ("▁", -3.0, False, False)] + [(c, -4.0 - i / 10, False, False) for i, c in enumerate("abcé")]
    vocab += [("▁a", -2.5, False, False), ("ab", -3.3, False, False), ("bcé", -5.1, False, False), ("abc", -4.7, False, False), ("▁ab", -3.9, False, False)]
    for has_bytes in (False, True):
        v = vocab + [(f"<0x{b:02X}>", 0.0, True, False) for b in range(256) if has_bytes]
        m = pieces.PieceModel.of(v)
        for _ in range(200):
            s = "▁" + "".join(rng.choice("abcéz▁") for _ in range(rng.randint(0, 10)))
            ids = m.solve([s.encode()])[0]
            best = [0.0] + [-1e9] * len(s)
            for j in range(1, len(s) + 1):
                for i in range(j):
                    k = m.ids.get(s[i:j])
                    best[j] = max(best[j], best[i] + (m.scores[k] if k is not None else m.bare_score if j - i == 1 and s[i] not in m.ids else -1e9))
            plain = [i for i in ids if not v[i][2] and i != 0]
            bare = sum(c not in m.ids for c in s)
            assert sum(m.scores[i] for i in plain) + bare * m.bare_score == pytest.approx(best[-1])
            if has_bytes:
                assert m.decode(ids) == s.replace("▁", " ")[1:]


# -- 9


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_plane_files(spark, docs, rows, none, mode, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = [*rows, (100_000, "x <|endoftext|> y", "en", "src0", 1, "c", "k", "r", True)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    monkeypatch.setattr(bitplanes, "SHARD_IDS", 4000)
    got = sorted(bitplanes.token_files(spark, docs, path, mode).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(r[0] for r in rows)
    at = 0
    for r in got:
        ids = np.array([*tok.encode(texts_of(rows)[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bitplanes.token_files(spark, none, path, mode).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(0)
    for mode in ("byte", "bit"):
        for n in (0, 1, 7, 8, 9, 1000):
            for top in (2, 50_000, 2**32):
                data = [(5, rng.integers(0, top, n).astype("<u4")), (None, np.zeros(0, "<u4")), (-1, rng.integers(0, top, 3).astype("<u4"))]
                back = list(bitplanes.unpack(bitplanes.pack(data, mode, 16)))
                assert all(a == c and (b == d).all() and len(b) == len(d) for (a, b), (c, d) in zip(data, back, strict=True))
    broken = bitplanes.pack([(1, np.arange(9, dtype="<u4"))])[:-3]
    with pytest.raises(ValueError):
        list(bitplanes.unpack(broken))


def test_cut_pieces_equal_whole_texts():
    rng = random.Random(6)
    e = bitplanes.encoder(tokenizer_file("byte_bpe_50k.json"))
    for _ in range(2000):
        t = "".join(rng.choice(" a\n\tb.1'sé\x1c\x85　—́漢,×ªt_") for _ in range(24))
        assert e.encode(t).tolist() == e.tok.encode(t, add_special_tokens=False).ids
    for t in ("x <|endoftext|> y", "<|endoftext|>", " <|endoftext|>a", "<|endoftext|"):
        assert e.encode(t).tolist() == e.tok.encode(t, add_special_tokens=False).ids


# -- 3

ARTICLE = "<h1>T &lt;1&gt;</h1><p>One long paragraph about boats,\n told well &amp; slowly.</p><p>Second, with <a href='x'>a link</a> in it.</p>"
TEXT = "T <1>\n\nOne long paragraph about boats, told well & slowly.\n\nSecond, with a link in it."


@pytest.mark.parametrize(
    "page",
    [
        f"<nav><a href=/>Home</a></nav><article>{ARTICLE}</article><footer>c</footer>",
        f"<div class='cookie-banner'>We use cookies here</div><div class='post'>{ARTICLE}</div><div id='comments'><p>{'great read ' * 40}</p></div>",
        f"<main><article>{ARTICLE}</article><section class='comments'><article><p>{'no way ' * 30}</p></article></section></main>",
        f"<article>{ARTICLE}<aside>{'see also ' * 50}</aside><form>mail <input></form><script>var a='<p>x</p>'</script></article>",
        f"<ul><li><a href=1>One</a><li><a href=2>Two</a></ul><div class='content'>{ARTICLE}<div class='share'>Tweet this</div></div>",
        f"<style>p{{}}</style><!-- <p>no</p> --><article>{ARTICLE}",
    ],
)
def test_main_text(page):
    assert html_text.main_text(f"<html><head><title>t</title></head><body>{page}</body></html>") == TEXT


def test_quotes_in_unquoted_values_and_deep_nesting():
    page = "<article><p class=x title=it's>five six</p><p>seven's eight</p><p title='a > b' lang=\"c > d\">nine</p></article>"
    assert html_text.main_text(page) == "five six\n\nseven's eight\n\nnine"
    deep = "<div>" * 20_000 + "<article>" + ARTICLE + "</article>" + "</b></p></div>" * 20_000
    assert html_text.main_text(deep) == TEXT


@pytest.mark.parametrize("name", ["svg", "math"])
def test_empty_and_nested_foreign_elements(name):
    before, after = ARTICLE.split("<p>Second")
    for x in (f"<{name} class='i' />", f"<{name}/>", f"<{name}><g><{name} a=1>no</{name}></g>no words here</{name}>", f"<{name}><{name}/>no</{name}>"):
        assert html_text.main_text(f"<html><body><article>{before}{x}<p>Second{after}</article></body></html>") == TEXT


def test_pages(spark):
    data = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<nav>menu</nav>", "x"), (None, "u", "plain words", "x"), (5, "u", "<article><p>" + "w " * 200_000, "x"), (6, "u", "a < b &eacute;<p>c", "x"), (6, "u", "a < b &eacute;<p>c", "x")]
    got = html_text.extract(spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 11), (1, 0), (2, 0), (3, 0), (5, 399_999), (6, 10), (6, 10)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- 2


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)) + rng.integers(0, 4, (1500, 1)) * 3
    x[700:760] = x[700]
    data = [(int(i), [float(v) for v in x[i]], 1) for i in range(1500)]
    data += [(2000, None, 0), (2100, [0.0] * 8, 0), (2200, [float("nan")] * 8, 0), (2300, [None] + [1.0] * 7, 0), (2400, [1.0], 0), (None, [1.0] * 8, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, id int")
    got = {}
    for r in neighbours.nearest(spark, df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 1500, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(want))
        if q == 700:
            assert [i for _, i, _ in found] == list(range(701, 711))  # equal vectors: the smaller ids
    assert hit >= 0.9 * 150
    few = spark.createDataFrame(data[:4], df.schema)
    assert [r.vec_id for r in neighbours.nearest(spark, few).orderBy("rank").collect()] != [] and neighbours.nearest(spark, few).count() == 3
    assert neighbours.nearest(spark, spark.createDataFrame([], df.schema)).count() == 0


def test_neighbours_when_the_search_finds_too_few(spark, monkeypatch):
    """Short lists in a graph of hard vectors find too few: the search goes on with longer ones until the measure is met."""
    x = np.random.default_rng(5).normal(size=(600, 16))
    x[50:70] = x[50]
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "vec_id long, embedding array<double>")
    kept, search = [], neighbours.search

    def counted(scratch, nodes, edges, queries, keep):
        kept.append(keep)
        return search(scratch, nodes, edges, queries, keep)

    monkeypatch.setattr(neighbours, "search", counted)
    monkeypatch.setattr(neighbours, "KEEP", 4)
    monkeypatch.setattr(neighbours, "EXPAND", 2)
    got = {}
    for r in neighbours.nearest(spark, df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        hit += len(set(got[q]) & set([int(i) for i in np.lexsort((np.arange(600), d)) if i != q][:10]))
    assert kept[0] == 4 and len(kept) > 1 and hit >= 0.9 * 60


def test_neighbours_over_shards(spark, monkeypatch):
    """Vectors travel once to build the graphs, however many shards there are; clusters and far scales are found too."""
    monkeypatch.setattr(neighbours, "SHARD", 250)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 12)) * 1e-3 + rng.integers(0, 40, (2000, 1)) * 1e3
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(2000)], "vec_id long, embedding array<double>")
    built = []
    build = neighbours.build_graph

    def seen(scratch, nodes, *rest):
        built.append((nodes.count(), nodes.select("part").distinct().count(), build(scratch, nodes, *rest)))
        return built[-1][2]

    monkeypatch.setattr(neighbours, "build_graph", seen)
    got = {}
    for r in neighbours.nearest(spark, df).collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hit = 0
    for q in range(0, 2000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(2000), d)) if i != q][:10]
        assert all(s == pytest.approx(d[i], rel=1e-12) for s, i in got[q]) and len(got[q]) == 10
        hit += len({i for _, i in got[q]} & set(want))
    assert hit >= 0.9 * 200
    assert built[0][:2] == (2000, 8) and built[0][2].count() == 2000  # one row a vector, its neighbours with it


# -- the pipeline


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stage = {n: f for n, f in corpus_pipeline.STAGES}
    docs = df
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(f(spark, docs, str(tmp_path)).collect(), df.schema)
        assert docs.columns == df.columns, name
    last = {r.doc_id: list(r.piece_ids) for r in stage["SentencePiece encoding"](spark, docs, str(tmp_path)).collect()}
    got = {r.doc_id: list(r.piece_ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == last and 0 < len(got) < df.count()
    s = sets([(r.doc_id, r.text) for r in docs.collect()], 5)
    ids = sorted(s)
    assert not [(a, b) for a in ids for b in ids if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b])]
