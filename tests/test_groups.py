import random

import pytest

from corvane.operators import events, neardup
from corvane.operators.graph import components
from corvane.plans.scratch import Scratch


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(200, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.id: r.root for r in components(Scratch(spark, "t"), df).collect()}
    want = roots(201, links)
    assert all(got.get(i, i) == want[i] for i in range(201))


def test_content_clusters_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)] + [0]
    rows = []
    for i in range(120):
        fp = rng.choice(base)
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            fp ^= 1 << rng.randrange(64)
        rows.append((i, fp - (1 << 64) if fp >> 63 else fp, float(rng.choice([0, 48, 96, 97, 144, 200, 248, 300])), f"s{i % 5}", i % 5 == 0))
    links = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and ((a[1] ^ b[1]) & (2**64 - 1)).bit_count() <= 3 and abs(a[2] - b[2]) <= 48]
    want = roots(120, links)
    df = spark.createDataFrame(rows, "article_id long, fp long, first_seen_hours double, source_id string, is_wire boolean")
    out = neardup.content_clusters(spark, df)
    got = {r.article_id: r.cluster_id for r in out.collect()}
    assert got == dict(enumerate(want))
    for o in neardup.origins(out).collect():
        group = [r for r in rows if want[r[0]] == o.cluster_id]
        first = min([r for r in group if r[4]] or group, key=lambda r: (r[2], r[0]))
        assert (o.origin_article_id, o.carrier_count) == (first[0], len(group))


def test_simhash_is_source_independent(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a b c d",), ("A  b, c d!",), ("",), (None,)], "t string")
    got = [r.x for r in df.select(neardup.simhash_blake2b(F.col("t")).alias("x")).collect()]
    assert got[0] == got[1] != 0 and got[2] == got[3] == 0


def test_event_parts_equal_one_pass(spark):
    rng = random.Random(9)
    rows = [(f"a{i:03d}", float(rng.randrange(0, 400)), [f"k{rng.randrange(12)}"] if rng.random() < 0.7 else [], [f"r{rng.randrange(6)}"] if rng.random() < 0.5 else [], [f"t{rng.randrange(3)}"], f"title {i}") for i in range(90)]
    want = {r[0]: r[2] for r in events.assign_in_order(sorted(rows, key=lambda r: (r[1], r[0])))}
    df = spark.createDataFrame(rows, "article_id string, first_seen_hours double, actor_keys array<string>, region_ids array<string>, topics array<string>, title string")
    got = {r.article_id: r.event_id for r in events.assign_events(spark, df).collect()}
    assert got == want


def _plain_rule(rows):
    """The rule with every event there ever was as a candidate."""
    found, out = {}, []
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for article, hours, a, r, t, _ in rows:
        a, r, t = set(a), set(r), set(t)
        best, score = None, events.THRESHOLD
        for name in sorted(found):
            last, b, q, u = found[name]
            gap = abs(hours - last)
            if gap > events.WINDOW_HOURS or not (a & b or (r & q and t & u)):
                continue
            s = events.W_ACTOR * share(a, b) + events.W_REGION * share(r, q) + events.W_TOPIC * share(t, u) + events.W_TIME * max(0.0, 1.0 - gap / events.WINDOW_HOURS)
            if s > score:
                best, score = name, s
        best = best or f"evt_{article}"
        last, b, q, u = found.get(best, (hours, set(), set(), set()))
        found[best] = (max(last, hours), a | b, r | q, t | u)
        out.append((article, best))
    return out


@pytest.mark.parametrize("order", ["by time", "any", "one without a time"])
def test_ended_events_are_let_go_and_nothing_changes(spark, order):
    rng = random.Random(2)
    rows = [(f"a{i:04d}", i * 1.5, [f"k{rng.randrange(9)}"], [f"r{rng.randrange(4)}"], [f"t{rng.randrange(3)}"], "t") for i in range(400)]
    if order == "any":
        rng.shuffle(rows)
    if order == "one without a time":
        rows.append(("z", float("nan"), *rows[0][2:]))
    want = _plain_rule(rows)
    assert [(r[0], r[2]) for r in events.assign_in_order(rows)] == want
    if order != "any":
        assert {(r.article_id, r.event_id) for r in events.assign_events(spark, _event_rows(spark, rows)).collect()} == set(want)


def test_an_article_meets_open_events_only(monkeypatch):
    """40 articles a window: the events looked at do not grow with all there ever were."""
    looked = []
    monkeypatch.setattr(events, "abs", lambda x: looked.append(x) or (x if x >= 0 else -x), raising=False)
    events.assign_in_order([(f"a{i:05d}", i * 1.2, [f"k{i % 90}"], ["r"], [f"t{i % 50}"], "t") for i in range(2000)])
    assert len(looked) <= 2000 * 50


def test_event_rule():
    a = ("a", 0.0, ["x"], [], [], "t")
    assert events.assign_in_order([a, ("b", 48.0, ["x"], [], [], "t")])[1][2] == "evt_a"  # the window's end counts
    assert events.assign_in_order([a, ("b", 48.1, ["x"], [], [], "t")])[1][2] == "evt_b"
    assert events.assign_in_order([a, ("b", 0.0, [], [], [], "t")])[1][2] == "evt_b"  # no key, no candidate
    r = ("a", 0.0, [], ["r"], ["p"], "t")
    assert events.assign_in_order([r, ("b", 0.0, [], ["r"], ["q"], "t")])[1][2] == "evt_b"  # a region needs a topic
    assert events.assign_in_order([r, ("b", 0.0, [], ["r"], ["p"], "t")])[1][2] == "evt_a"


def test_merge_and_split(spark):
    m = spark.createDataFrame([("a", "evt_a"), ("b", "evt_a"), ("c", "evt_c")], "article_id string, event_id string")
    merged, log = events.merge(m, "evt_c", "evt_a")
    assert {r.event_id for r in merged.collect()} == {"evt_a"} and log[1:3] == ("evt_a", "evt_c")
    out, log = events.split(m, "evt_a", ["a"])  # the seed leaves: the rest keeps its event
    assert {r.article_id: r.event_id for r in out.collect()} == {"a": "evt_a_s1", "b": "evt_a", "c": "evt_c"}
    with pytest.raises(ValueError):
        events.split(m, "evt_a", ["c"])
    ops = spark.createDataFrame([("merge", "evt_b", "evt_c"), ("merge", "evt_a", "evt_b")], "kind string, surviving_event_id string, other_event_id string")
    assert {r.event_id for r in events.apply_ops(m, ops).collect()} == {"evt_a"}


def _event_rows(spark, rows):
    return spark.createDataFrame(rows, "article_id string, first_seen_hours double, actor_keys array<string>, region_ids array<string>, topics array<string>, title string")


def test_event_state_over_batches_equals_one_pass(spark):
    rng = random.Random(4)
    rows = [(f"a{i:03d}", float(i * 3), [f"k{rng.randrange(8)}"] if rng.random() < 0.8 else [], [f"r{rng.randrange(4)}"], [f"t{rng.randrange(3)}"], f"title {i}") for i in range(60)]
    want = {r[0]: (r[2], r[3]) for r in events.assign_in_order(rows)}
    state, got = None, {}
    for part in (rows[:20], rows[20:35], rows[35:]):
        df = _event_rows(spark, part)
        placed = events.assign_events(spark, df, state=state)
        got |= {r.article_id: (r.event_id, r.representative_title) for r in placed.collect()}
        state = Scratch(spark, "t").save(events.event_state(placed, df, state, part[-1][1] - events.WINDOW_HOURS), "state")
        assert state.where(state.last_seen_hours < part[-1][1] - events.WINDOW_HOURS).isEmpty()
    assert got == want


def test_an_assigned_article_keeps_its_event():
    a, b = ("a", 0.0, ["x"], [], [], "t"), ("b", 1.0, ["x", "y"], [], [], "u")
    assert [r[2] for r in events.assign_in_order([a, b, a, ("c", 48.5, ["x"], [], [], "v")])] == ["evt_a"] * 4


def test_op_log_in_order(spark):
    m = spark.createDataFrame([("a", "evt_a"), ("b", "evt_a"), ("c", "evt_c"), ("d", "evt_c")], "article_id string, event_id string")
    schema = "seq int, kind string, surviving_event_id string, other_event_id string, moved array<string>"

    def after(*log):
        out = events.apply_ops(m, spark.createDataFrame([(i, *op) for i, op in enumerate(log)], schema))
        assert out.columns == m.columns
        return {r.article_id: r.event_id for r in out.collect()}

    join, part = ("merge", "evt_a", "evt_c", []), ("split", "evt_a", "evt_d", ["d", "b"])
    assert after(join, part) == {"a": "evt_a", "b": "evt_d", "c": "evt_a", "d": "evt_d"}
    assert after(part, join) == {"a": "evt_a", "b": "evt_d", "c": "evt_a", "d": "evt_a"}  # d was not in evt_a yet
    assert after(join, part, ("merge", "evt_a", "evt_d", [])) == dict.fromkeys("abcd", "evt_a")
    assert after(join, part, ("split", "evt_d", "evt_b", ["b"]))["b"] == "evt_b"
    assert after(join, ("merge", "evt_c", "evt_a", [])) == dict.fromkeys("abcd", "evt_c")  # a log that leads back ends
