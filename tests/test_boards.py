import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import scoring as S
from corvane.operators import alerts, compliance, metering, news, trending


def board(spark, rows, half=8.0, **kw):
    df = spark.createDataFrame([(t, t, o, float(a), 1.0, 1.0) for t, o, a in rows], "target_id string, target_name string, origin string, age_hours double, weight double, importance double")
    return {r.target_id: r for r in trending.trend_scores(df, half, **kw).collect()}


def brute(rows, half=8.0):
    out = {}
    for t in {r[0] for r in rows}:
        per = {}
        for t2, o, a in rows:
            if t2 == t:
                per[o] = per.get(o, 0) + math.exp(-math.log(2) * a / half)
        n = len(per)
        out[t] = sum(math.log1p(w) for w in per.values()) * (1 + min(math.log1p(n) / math.log(21), 1)) + 0.8 * min(n, 5)
    return out


def test_scores_follow_the_formula(spark):
    rows = [("k", f"o{i}", i) for i in range(5)] + [("e", f"o{i % 3}", 10 + i) for i in range(4)] + [("s", "o1", i) for i in range(6)]
    got, want = board(spark, rows), brute(rows)
    for t, raw in want.items():
        assert got[t].raw == pytest.approx(raw, abs=1e-9)
    assert not got["s"].eligible and got["k"].eligible  # one origin is no trend, however often it reports
    assert got["k"].score == pytest.approx(100)


def test_independent_origins_beat_a_dump(spark):
    got = board(spark, [("dump", "wire", 1)] * 40 + [("real", f"o{i}", 1) for i in range(6)])
    assert got["real"].raw > got["dump"].raw


def test_scale_is_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21, 40):
        df = spark.createDataFrame([(float(i + 1),) for i in range(n)], "raw double")
        want = 12.0 if n < 2 else max(sorted(range(1, n + 1))[math.ceil(0.95 * n) - 1], 1.2)
        assert df.agg(S.p95_scale().alias("s")).first().s == want


def test_window_ends_are_included_and_requests_checked(spark):
    df = spark.createDataFrame([(10.0,), (34.0,), (9.9,), (34.1,)], "first_seen_hours double")
    assert trending.in_window(df, 34.0, 24.0).count() == 2
    for bad in (("x", "24h", 5), ("topic", "2h", 5), ("topic", "24h", 0), ("topic", "24h", 101)):
        with pytest.raises(ValueError):
            trending.check_request(*bad)


def test_hidden_actors_do_not_trend(spark):
    arts = spark.createDataFrame([(f"a{i}", f"s{i}", None, 10.0, "t") for i in range(4)], "article_id string, source_id string, original_source_id string, first_seen_hours double, title string")
    person = [{"entity_id": "p", "canonical_key": "p", "display": "P", "kind": "PERSON", "start": 0}]
    schema = "article_id string, topics array<struct<topic:string>>, actors array<struct<entity_id:string,canonical_key:string,display:string,kind:string,start:int>>, regions array<struct<region_id:string>>, quotes array<struct<speaker_entity_id:string>>"
    enr = spark.createDataFrame([(f"a{i}", [], person, [], [{"speaker_entity_id": "p"}]) for i in range(4)], schema)
    reg = spark.createDataFrame([("p", True, False, False)], "entity_id string, suppressed boolean, is_minor boolean, is_sensitive_victim boolean")
    shown = trending.trending(arts, enr, "actor", "24h", 12.0, registry=reg, gate=False).collect()
    assert [r.target_id for r in shown] == ["p"] and shown[0].distinct_sources == 4
    assert trending.trending(arts, enr, "actor", "24h", 12.0, registry=reg).count() == 0


def test_compliance(spark):
    df = spark.createDataFrame([("tersangka", "bebas", False), ("tersangka", None, True), ("terpidana", "sp3", True), (None, "bebas", True)], "l string, s string, ok boolean")
    assert df.where(compliance.label_allowed(F.col("l"), F.col("s")) != F.col("ok")).count() == 0
    q = spark.createDataFrame([(0.75, "u", "as_published", True), (0.7, "u", "as_published", False), (0.9, "", "as_published", False), (0.9, "u", "inferred", False)], "c double, u string, s string, ok boolean")
    assert q.where(compliance.quote_allowed(F.col("c"), F.col("u"), F.col("s")) != F.col("ok")).count() == 0


def test_requests_carry_flags(spark):
    reg = spark.createDataFrame([("a", "A", "PERSON", "tersangka", False, True, False), ("b", "B", "PERSON", None, False, False, False)], "entity_id string, display string, kind string, legal_status string, suppressed boolean, is_minor boolean, is_sensitive_victim boolean")
    req = spark.createDataFrame([("a", "rectify", None, "bebas", 1), ("a", "erase", None, None, 2), ("b", "rectify", "B2", "sp3", 1), ("c", "erase", None, None, 1), ("c", "rectify", "C2", "bebas", 2)], "entity_id string, action string, display string, legal_status string, version int")
    got = {r.entity_id: r for r in compliance.apply_requests(reg, req).collect()}
    assert got["a"].suppressed and got["a"].is_minor and got["a"].legal_status == "bebas"  # a rectification outlives an erasure
    assert got["c"].suppressed and got["c"].display == "C2" and got["c"].legal_status == "bebas"  # and the other way round
    assert got["b"].display == "B2" and got["b"].legal_status == "sp3" and not got["b"].suppressed


def test_pages_cover_everything_once(spark):
    arts = spark.createDataFrame([(f"{i:03d}", float(i % 4)) for i in range(17)], "article_id string, first_seen_hours double")
    seen, cursor = [], None
    while True:
        rows = news.news_page(arts, 5, cursor).collect()
        seen += [(r.first_seen_hours, r.article_id) for r in rows[:5]]
        if len(rows) <= 5:
            break
        cursor = news.encode_cursor(rows[4].first_seen_hours, rows[4].article_id)
    assert seen == sorted(((r.first_seen_hours, r.article_id) for r in arts.collect()), reverse=True)


def test_firings_and_quota(spark):
    b = spark.createDataFrame([("topic", "t1", "Pajak", 50.0), ("actor", "e1", "Pajak", 80.0)], "trend_type string, target_id string, name string, score double")
    r = spark.createDataFrame([("w", [" PAJAK ", "t1"], [], ["e1"], 50.0), ("v", ["pajak"], [], [], 50.1)], "webhook_id string, topics array<string>, actors array<string>, regions array<string>, min_score double")
    assert [(x.webhook_id, x.trend_type, x.target_id) for x in alerts.firings(r, b).collect()] == [("w", "topic", "t1")]
    u = spark.createDataFrame([("k", 999), ("f", 1000), ("o", 5)], "key_hash string, used long")
    k = spark.createDataFrame([("k", "free", None), ("f", "free", None), ("o", "business", 5)], "key_hash string, tier string, quota_override long")
    got = {x.key_hash: (x.allowed, x.remaining, x.alerts_allowed) for x in metering.quota_decision(u, k).collect()}
    assert got == {"k": (True, 0, False), "f": (False, 0, False), "o": (False, 0, True)}
