"""Events: related articles grouped online, in order of arrival, under ids that stay."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.scratch import Scratch, small_side
from .graph import components

# Hours after which an event is closed, weights of the parts of a score, and what it must exceed.
WINDOW_HOURS, THRESHOLD = 48.0, 0.25
W_ACTOR, W_REGION, W_TOPIC, W_TIME, W_TEXT = 0.5, 0.2, 0.2, 0.1, 0.2

Similarity = Callable[[str, str], float]
_ROW = "article_id string, first_seen_hours double, event_id string, representative_title string"


@dataclass
class _Event:
    event_id: str
    title: str
    first: float
    last: float
    actors: set[str] = field(default_factory=set)
    regions: set[str] = field(default_factory=set)
    topics: set[str] = field(default_factory=set)

    def absorb(self, hours: float, actors: set[str], regions: set[str], topics: set[str]) -> None:
        self.actors |= actors
        self.regions |= regions
        self.topics |= topics
        self.first, self.last = min(self.first, hours), max(self.last, hours)


def _jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


class _Board:
    """The events that are open, and the sequential rule for the next article.

    An article may join an event that shares an actor, or a region and a topic, and was active within the window. The
    best score above the threshold wins, of equals the smaller event id; else the article opens its own event. Only
    events that share an actor or region can be candidates, so they are looked up by key. An article that was placed
    before returns its event and changes nothing. An event whose window ended before every article to come is let go,
    so an article meets the events of its window, not all events there ever were.
    """

    def __init__(self, state: Iterable[_Event] = (), similar: Similarity | None = None):
        self.similar = similar
        self.events = {e.event_id: e for e in state}
        self.placed: dict[str, _Event] = {}
        self.by_key: dict[tuple[str, str], set[str]] = {}
        self.ends: list[tuple[float, str]] = []  # a heap: when an event was last active, as it was entered
        for e in self.events.values():
            self._index(e)
            self._enter(e)

    @staticmethod
    def _keys(e: _Event) -> list[tuple[str, str]]:
        return [("a", k) for k in e.actors] + [("r", k) for k in e.regions]

    def _index(self, e: _Event) -> None:
        for k in self._keys(e):
            self.by_key.setdefault(k, set()).add(e.event_id)

    def _enter(self, e: _Event) -> None:
        if e.last == e.last:
            heapq.heappush(self.ends, (e.last, e.event_id))

    def _let_go(self, since: float) -> None:
        """Forget the events that no article from ``since`` on can join."""
        while self.ends and since - self.ends[0][0] > WINDOW_HOURS:
            last, event_id = heapq.heappop(self.ends)
            e = self.events.get(event_id)
            if e is None:
                continue
            if e.last != last:
                self._enter(e)
                continue
            del self.events[event_id]
            for k in self._keys(e):
                if ids := self.by_key.get(k):
                    ids.discard(event_id)
                    if not ids:
                        del self.by_key[k]

    def place(self, row: tuple, since: float, again: bool = True) -> tuple[str, float, str, str]:
        """The outcome for (article_id, hours, actors, regions, topics, title). No article to come, nor this one, is before
        ``since``; ``again`` tells that the article may come again."""
        article_id, hours, actors, regions, topics, title = row
        if article_id in self.placed:
            return article_id, hours, self.placed[article_id].event_id, self.placed[article_id].title
        self._let_go(since)
        a, r, t = set(actors), set(regions), set(topics)
        candidates = set().union(*(self.by_key.get(("a", k), set()) for k in a), *(self.by_key.get(("r", k), set()) for k in r))
        best, score = None, THRESHOLD
        for key in sorted(candidates):
            e = self.events.get(key)
            if e is None:
                continue
            gap = abs(hours - e.last)
            if gap > WINDOW_HOURS or not (a & e.actors or (r & e.regions and t & e.topics)):
                continue
            s = W_ACTOR * _jaccard(a, e.actors) + W_REGION * _jaccard(r, e.regions) + W_TOPIC * _jaccard(t, e.topics) + W_TIME * max(0.0, 1.0 - gap / WINDOW_HOURS)
            if self.similar is not None:
                s += W_TEXT * self.similar(title, e.title)
            if s > score:
                best, score = e, s
        if best is None:
            best = self.events[f"evt_{article_id}"] = _Event(f"evt_{article_id}", title, hours, hours)
            self._enter(best)
        best.absorb(hours, a, r, t)
        self._index(best)
        if again:
            self.placed[article_id] = best
        return article_id, hours, best.event_id, best.title


def assign_in_order(rows: list[tuple], state: list[_Event] | None = None, similar: Similarity | None = None) -> list[tuple[str, float, str, str]]:
    """The sequential rule (see ``_Board``) over rows (article_id, hours, actors, regions, topics, title), already in order."""
    board = _Board(state or (), similar)
    hours = np.array([r[1] for r in rows], np.float64)
    since = np.minimum.accumulate(np.where(np.isnan(hours), -np.inf, hours)[::-1])[::-1]  # whatever the order of times
    return [board.place(r, at) for r, at in zip(rows, since.tolist(), strict=True)]


def _timed(articles: DataFrame) -> bool:
    """Whether every article has a time. One without is in every event's window, so no event ends before it."""
    h = F.col("first_seen_hours")
    return articles.where(h.isNull() | F.isnan(h)).isEmpty()


def independent_parts(spark: SparkSession, scratch: Scratch, articles: DataFrame, rounds: int = 6, timed: bool = True) -> DataFrame:
    """Articles with ``part``: articles of different parts can never meet in an event; and ``again``: whether an
    article_id has more rows.

    Articles meet only through a shared actor or region, and only within the window. Components of shared keys are cut
    where their times have a gap over the window, and again, until the number of parts stays the same; articles that
    are not ``timed`` are not cut. The keys are what is linked, an article's keys to its first: however many articles
    share two keys, that is one link. Gaps are found between the spans of the articles in bins as long as the window.
    """
    twice = scratch.small(articles.groupBy("article_id").count().where("count > 1").select("article_id", F.lit(True).alias("_twice")), "twice")
    own = F.when(F.col("_twice"), F.array(F.concat(F.lit("i:"), F.col("article_id"))))
    none = F.array().cast("array<string>")
    named = [F.transform(c, lambda x: F.coalesce(F.concat(F.lit(f"{c[0]}:"), x), F.lit(c[0]))) for c in ("actor_keys", "region_ids")]
    keys = F.concat(*[F.coalesce(c, none) for c in (*named, own)])
    parted = articles.join(twice, "article_id", "left").withColumns({"ks": F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k))), "again": F.coalesce("_twice", F.lit(False))}).drop("_twice")
    parted = scratch.save(parted.withColumn("part", F.lit(0).cast("long")), "parts")
    before = 1
    for i in range(rounds):
        node = F.when(F.size("ks") > 0, F.xxhash64("part", F.get("ks", F.lit(0)))).otherwise(F.xxhash64("article_id", F.lit("no key")))
        links = parted.where(F.size("ks") > 1).select("part", F.get("ks", F.lit(0)).alias("k"), F.explode(F.slice("ks", 2, F.size("ks") - 1)).alias("l")).distinct()
        labels = components(scratch, links.select(F.xxhash64("part", "l").alias("a"), F.xxhash64("part", "k").alias("b")), f"events-{i}")
        lab = parted.withColumn("n", node).join(small_side(labels.withColumnRenamed("id", "n")), "n", "left").withColumn("c", F.coalesce("root", "n")).drop("n", "root")
        if not timed:
            parted = scratch.save(lab.withColumn("part", F.col("c")).drop("c"), f"parts-{i}")
            break
        lab = scratch.save(lab.withColumn("bin", F.floor(F.col("first_seen_hours") / WINDOW_HOURS)), "labelled")
        spans = lab.groupBy("c", "bin").agg(F.min("first_seen_hours").alias("lo"), F.max("first_seen_hours").alias("hi"))
        w = Window.partitionBy("c").orderBy("bin")
        spans = spans.withColumn("cut", F.coalesce((F.col("lo") - F.lag("hi").over(w) > WINDOW_HOURS).cast("int"), F.lit(0)))
        spans = scratch.small(spans.select("c", "bin", F.xxhash64("c", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("to")), "spans")
        parted = scratch.save(lab.join(spans, ["c", "bin"]).withColumn("part", F.col("to")).drop("c", "bin", "to"), f"parts-{i}")
        now = spans.select("to").distinct().count()
        scratch.drop("labelled", "spans", "parts" if not i else f"parts-{i - 1}")
        if now == before:
            break
        before = now
    return parted.drop("ks")


def event_articles(articles: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Enriched articles as the event rule reads them: article_id, first_seen_hours, actor_keys, region_ids, topics, title, origin."""
    e = enrichments.select(
        "article_id", F.array_distinct(F.transform("actors", lambda a: F.coalesce(a["entity_id"], F.concat(F.lit("key:"), a["canonical_key"])))).alias("actor_keys"),
        F.array_distinct(F.transform("regions", lambda r: r["region_id"])).alias("region_ids"), F.array_distinct(F.transform("topics", lambda t: t["topic"])).alias("topics"),
    )
    origin = F.coalesce("original_source_id", "source_id") if "original_source_id" in articles.columns else F.col("source_id")
    return articles.select("article_id", "first_seen_hours", "title", origin.alias("origin")).join(e, "article_id")


def assign_events(spark: SparkSession, articles: DataFrame, similar: Similarity | None = None, state: DataFrame | None = None) -> DataFrame:
    """article_id, first_seen_hours, event_id, representative_title of articles(article_id, first_seen_hours, actor_keys, region_ids, topics, title).

    The sequential rule runs inside each independent part, so the result equals one global pass. A part whose keys
    chain without end is one task; that is inherent in the rule. Articles stream through it in order: a task holds the
    events that are open, not its part. ``state`` are the events of earlier batches (see ``event_state``): an event
    takes part as a row at its last time with its keys, so it is in the part of every article that may join it.
    """
    columns = ["article_id", "first_seen_hours", "actor_keys", "region_ids", "topics", "title"]
    rows = articles.select(*columns, F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("double").alias("first"))
    if state is not None:
        known = state.select(F.concat(F.lit("event "), "event_id").alias("article_id"), F.col("last_seen_hours").alias("first_seen_hours"), *columns[2:], "event_id", F.col("first_seen_hours").alias("first"))
        rows = rows.unionByName(known)
    timed = _timed(rows)
    parted = independent_parts(spark, Scratch(spark, "events"), rows, timed=timed)
    time = F.coalesce("first_seen_hours", F.lit(float("nan")))
    # a part's events first, then its articles in order
    ordered = parted.repartition("part").sortWithinPartitions("part", F.col("event_id").isNull(), time, F.col("article_id").asc_nulls_last())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, board, known = None, None, []
        for batch in batches:
            got = []
            for r in batch.itertuples(index=False):
                if r.part != part:
                    part, board, known = r.part, None, []
                if r.event_id is not None and r.event_id == r.event_id:
                    known.append(_Event(r.event_id, r.title, r.first, r.first_seen_hours, set(r.actor_keys), set(r.region_ids), set(r.topics)))
                    continue
                if board is None:
                    board, known = _Board(known, similar), []
                row = (r.article_id, r.first_seen_hours, r.actor_keys, r.region_ids, r.topics, r.title)
                got.append(board.place(row, r.first_seen_hours if timed else float("-inf"), r.again))
            yield pd.DataFrame(got, columns=["article_id", "first_seen_hours", "event_id", "representative_title"])

    return ordered.mapInPandas(run, _ROW)


def event_state(placed: DataFrame, articles: DataFrame, state: DataFrame | None = None, open_since: float | None = None) -> DataFrame:
    """Events after a batch: event_id, title, first_seen_hours, last_seen_hours, actor_keys, region_ids, topics.

    ``placed`` is what ``assign_events`` made of ``articles``, ``state`` the events before. Events whose last article
    is older than ``open_since`` are left out: no article from ``open_since`` + 48 hours on can join them.
    """
    keys = ["actor_keys", "region_ids", "topics"]
    rows = placed.select("article_id", "event_id", F.col("representative_title").alias("title")).join(articles.select("article_id", "first_seen_hours", *keys), "article_id")
    rows = rows.select("event_id", "title", F.col("first_seen_hours").alias("lo"), F.col("first_seen_hours").alias("hi"), *keys)
    if state is not None:
        rows = rows.unionByName(state.select("event_id", "title", F.col("first_seen_hours").alias("lo"), F.col("last_seen_hours").alias("hi"), *keys))
    union = [F.array_distinct(F.flatten(F.collect_set(k))).alias(k) for k in keys]
    out = rows.groupBy("event_id").agg(F.min("title").alias("title"), F.min("lo").alias("first_seen_hours"), F.max("hi").alias("last_seen_hours"), *union)
    return out if open_since is None else out.where(F.col("last_seen_hours") >= open_since)


def merge(members: DataFrame, a: str, b: str) -> tuple[DataFrame, tuple]:
    """Members after two events became one, under the smaller id, and the log row (kind, survivor, other, moved)."""
    keep, gone = min(a, b), max(a, b)
    return members.withColumn("event_id", F.when(F.col("event_id") == gone, keep).otherwise(F.col("event_id"))), ("merge", keep, gone, [])


def split(members: DataFrame, event_id: str, moved: list[str]) -> tuple[DataFrame, tuple]:
    """Members after ``moved`` left an event for one of their own, and the log row.

    The new event is named by its smallest article whose name is free; if there is none, a suffix is added.
    """
    here = {r[0] for r in members.where(F.col("event_id") == event_id).select("article_id").where(F.col("article_id").isin(moved)).collect()}
    if not here:
        raise ValueError("nothing to move")
    names = [f"evt_{i}" for i in sorted(here)]
    used = {r[0] for r in members.where(F.col("event_id").isin(names)).select("event_id").distinct().collect()} | {event_id}
    free = [n for n in names if n not in used]
    k = 1
    while not free:
        free = [n for n in [f"{names[0]}_s{k}"] if n not in used]
        k += 1
    new = free[0]
    out = members.withColumn("event_id", F.when((F.col("event_id") == event_id) & F.col("article_id").isin(list(here)), new).otherwise(F.col("event_id")))
    return out, ("split", event_id, new, sorted(here))


def apply_ops(members: DataFrame, ops: DataFrame, order: str = "seq") -> DataFrame:
    """Members after a log of merges and splits, applied by ``order`` (without that column, as the rows stand).

    ``ops`` has kind, surviving_event_id, other_event_id (of a split: the new event) and moved (article ids; may be missing in a log of merges). Editors
    write it, so it is read in order on the driver; the members meet its outcome in two joins, however long it is.
    A merge moves what is in the other event at that time, so logs that lead back to an earlier event end too.
    """
    now: dict[str, str] = {}  # where the members of an event are now
    away: dict[str, list[tuple[str, str]]] = {}  # articles that splits moved: (from, to), in order; from is what they must be in
    spark = members.sparkSession
    for op in (ops.orderBy(order) if order in ops.columns else ops).collect():
        keep, other = op["surviving_event_id"], op["other_event_id"]
        if op["kind"] == "merge":
            now.setdefault(other, other)
            now = {e: keep if at == other else at for e, at in now.items()}
            away = {i: [(f, keep if to == other else to) for f, to in path] for i, path in away.items()}
        elif op["kind"] == "split":
            sources = {keep, *(e for e, at in now.items() if at == keep)} - {e for e, at in now.items() if at != keep}
            for i in op["moved"] or []:
                path = away.setdefault(i, [])
                moved = [(f, other if to == keep else to) for f, to in path]
                away[i] = moved + [(e, other) for e in sorted(sources) if e not in {f for f, _ in path}]
    out = members
    if away:
        rows = [(i, f, to) for i, path in away.items() for f, to in path]
        out = out.join(small_side(spark.createDataFrame(rows, "article_id string, event_id string, _moved string")), ["article_id", "event_id"], "left")
    else:
        out = out.withColumn("_moved", F.lit(None).cast("string"))
    if now:
        out = out.join(small_side(spark.createDataFrame(list(now.items()), "event_id string, _now string")), "event_id", "left")
    else:
        out = out.withColumn("_now", F.lit(None).cast("string"))
    return out.withColumn("event_id", F.coalesce("_moved", "_now", "event_id")).select(members.columns)


def event_summary(members: DataFrame, articles: DataFrame) -> DataFrame:
    """event_id, article_count, distinct_origins, first_seen_hours, last_seen_hours, main_topic.

    ``articles`` has article_id, origin and topics. The main topic is the most frequent; of equals the larger name.
    """
    m = members.select("event_id", "article_id", "first_seen_hours").join(articles.select("article_id", "origin", "topics"), "article_id")
    base = m.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("article_count"), F.countDistinct("origin").alias("distinct_origins"),
        F.min("first_seen_hours").alias("first_seen_hours"), F.max("first_seen_hours").alias("last_seen_hours"),
    )
    t = m.select("event_id", F.explode("topics").alias("topic")).groupBy("event_id", "topic").count()
    t = t.groupBy("event_id").agg(F.max(F.struct("count", "topic")).alias("t")).select("event_id", F.col("t.topic").alias("main_topic"))
    return base.join(t, "event_id", "left")


def list_events(summary: DataFrame, limit: int) -> DataFrame:
    return summary.orderBy(F.desc("last_seen_hours"), "event_id").limit(limit)


def timeline(members: DataFrame, event_id: str) -> DataFrame:
    return members.where(F.col("event_id") == event_id).orderBy("first_seen_hours", "article_id")


def source_breakdown(members: DataFrame, articles: DataFrame) -> DataFrame:
    """event_id, origin, n, is_first, is_most_active: how often each origin reported, and which was first or busiest."""
    m = members.select("event_id", "article_id", "first_seen_hours").join(articles.select("article_id", "origin"), "article_id")
    first = m.groupBy("event_id").agg(F.min(F.struct("first_seen_hours", "article_id", "origin")).alias("f"))
    n = m.groupBy("event_id", "origin").agg(F.count(F.lit(1)).alias("n"))
    most = n.groupBy("event_id").agg(F.max(F.struct("n", "origin")).alias("m"))
    out = n.join(first, "event_id").join(most, "event_id")
    return out.select("event_id", "origin", "n", (F.col("origin") == F.col("f.origin")).alias("is_first"), (F.col("origin") == F.col("m.origin")).alias("is_most_active"))


def pair_quality(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Precision and recall of same-group pairs; both have article_id and event_id. Counts per group replace pairs."""
    pairs = lambda df, *k: df.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).alias("p"))
    both = truth.select("article_id", F.col("event_id").alias("t")).join(found.select("article_id", F.col("event_id").alias("f")), "article_id")
    hit, said, real = pairs(both, "t", "f"), pairs(both, "f"), pairs(both, "t")
    one = hit.select(F.col("p").alias("hit")).join(F.broadcast(said.select(F.col("p").alias("said")))).join(F.broadcast(real.select(F.col("p").alias("real"))))
    return one.select("hit", "said", "real", F.try_divide("hit", "said").alias("precision"), F.try_divide("hit", "real").alias("recall"))
