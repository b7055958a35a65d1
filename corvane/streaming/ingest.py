"""The ingest pipeline as a stream: feed files in; articles, enrichments, clusters, events and a log out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.enrich import enrich
from ..operators.events import WINDOW_HOURS, assign_events, event_articles, event_state
from ..operators.neardup import content_clusters, origins, simhash_blake2b
from ..plans.scratch import Scratch
from ..sources import feeds
from ..sources.tables import append_new, as_articles, first_wins


@dataclass(frozen=True)
class Config:
    """Where a stream reads and writes. ``every`` is the trigger interval; None runs until the input is used up.

    ``cluster_hours`` of articles, up to the newest, are clustered again with every batch; events are kept open for
    ``late_hours`` beyond their window.
    """

    landing: str
    tables: str
    checkpoint: str
    every: str | None = None
    excerpt: int = 300
    cluster_hours: float = 720.0
    late_hours: float = 48.0


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None if there is none yet. Other errors are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def ingest_batch(spark: SparkSession, items: DataFrame, sources: DataFrame, config: Config) -> dict[str, int]:
    """One batch: normalise, keep first occurrences, append unseen articles, enrich exactly those.

    Running a batch again changes nothing: keys are hashes of URLs, and both tables are appended only by keys that
    they do not have. ``items`` has source_id, arrived (timestamp) and ingest_seq besides the item's elements.
    """
    rows = feeds.normalize(items, sources, config.excerpt)
    articles = first_wins(as_articles(rows, F.col("arrived"))).drop("arrived")
    fetched = items.count()
    new = append_new(spark, articles, f"{config.tables}/articles")
    stored = spark.read.parquet(f"{config.tables}/articles")
    todo = stored.join(articles.select("article_id"), "article_id", "left_semi")
    append_new(spark, enrich(todo), f"{config.tables}/enrichments", "article_id")
    fp = simhash_blake2b(F.concat_ws(" ", "title", "excerpt"))
    append_new(spark, todo.select("article_id", "source_id", "is_wire", "first_seen_hours", fp.alias("fp")), f"{config.tables}/fingerprints", "article_id")
    return {"fetched": fetched, "new": new, "duplicates": fetched - new}


def cluster_batch(spark: SparkSession, config: Config) -> int:
    """Cluster the newest articles again; article_id, cluster_id, origin_source_id replace the table ``clusters``.

    Only ``cluster_hours`` up to the newest article are read: the longest window that a board can have. Copies link
    within 48 hours, so an older article keeps the cluster it had when it left the slice. Returns the clusters.
    """
    prints = _table(spark, f"{config.tables}/fingerprints")
    newest = prints.agg(F.max("first_seen_hours")).first()[0] if prints is not None else None
    if newest is None:
        return 0
    found = content_clusters(spark, prints.where(F.col("first_seen_hours") >= newest - config.cluster_hours))
    first = origins(found).select("cluster_id", "origin_source_id")
    now = found.select("article_id", "cluster_id").join(first, "cluster_id").select("article_id", "cluster_id", "origin_source_id")
    scratch = Scratch(spark, "recluster")
    before = _table(spark, f"{config.tables}/clusters")
    if before is not None:
        now = now.unionByName(before.join(now.select("article_id"), "article_id", "left_anti"))
    scratch.save(now, "clusters").write.mode("overwrite").parquet(f"{config.tables}/clusters")
    scratch.drop("clusters")
    return found.select("cluster_id").distinct().count()


def event_batch(spark: SparkSession, batch: int, config: Config) -> None:
    """Assign the articles that have no event yet, from the events that are still open.

    Members and state are written under the number of the batch, and batches before it are read, so that a batch that
    is run again after a failure writes the same rows again. Events older than the window and ``late_hours`` before
    the newest article are closed and leave the state.
    """
    articles, enrichments = (_table(spark, f"{config.tables}/{t}") for t in ("articles", "enrichments"))
    if articles is None or enrichments is None:
        return
    members, states = (_table(spark, f"{config.tables}/{t}") for t in ("event_members", "event_state"))
    pending, state = event_articles(articles, enrichments), None
    if members is not None:
        pending = pending.join(members.where(F.col("batch") < batch).select("article_id"), "article_id", "left_anti")
    if states is not None:
        last = states.where(F.col("batch") < batch).agg(F.max("batch")).first()[0]
        state = states.where(F.col("batch") == last).drop("batch") if last is not None else None
    scratch = Scratch(spark, "event-batch")
    pending = scratch.save(pending, "pending")
    placed = scratch.save(assign_events(spark, pending, state=state), "placed")
    newest = pending.agg(F.max("first_seen_hours")).first()[0]
    since = None if newest is None else newest - WINDOW_HOURS - config.late_hours
    after = event_state(placed, pending, state, since)
    after.write.mode("overwrite").parquet(f"{config.tables}/event_state/batch={batch}")
    placed.write.mode("overwrite").parquet(f"{config.tables}/event_members/batch={batch}")
    scratch.drop("pending", "placed")


def start(spark: SparkSession, sources: DataFrame, config: Config) -> StreamingQuery:
    """Stream feed files from ``landing/<source_id>/*.xml``; each file is read once, a restart goes on where it was.

    A batch is fetched, deduplicated and enriched, the newest articles are clustered again, and pending articles get
    their events. Each batch leaves a row in ``log`` for each of its sources: files without any item count as errors.
    The tables belong to the checkpoint, whose batch numbers they carry.
    """
    items = feeds.read_items(spark, f"{config.landing}/*", streaming=True)
    items = items.withColumn("source_id", F.regexp_extract("file", r"([^/]+)/[^/]+$", 1))
    items = items.withColumn("arrived", F.current_timestamp())

    def batch(df: DataFrame, number: int) -> None:
        report = ingest_batch(spark, df.withColumn("ingest_seq", F.monotonically_increasing_id()), sources, config)
        clusters = cluster_batch(spark, config)
        event_batch(spark, number, config)
        files = feeds.file_status(spark, config.landing)
        log = files.withColumns({k: F.lit(v).cast("long") for k, v in (report | {"clusters": clusters}).items()})
        log.write.mode("overwrite").parquet(f"{config.tables}/log/batch={number}")

    writer = items.writeStream.option("checkpointLocation", config.checkpoint).foreachBatch(batch)
    return (writer.trigger(processingTime=config.every) if config.every else writer.trigger(availableNow=True)).start()


def rolling_mentions(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mentions per target, origin and window of a stream(ts, target_id, origin); late rows are dropped by watermark."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "target_id", "origin").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "target_id", "origin", "n")


def unseen(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; the state behind it is dropped as time goes on."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["dedup_key"])
