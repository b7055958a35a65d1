import os

from pyspark.sql import functions as F

from corvane.sources import feeds, tables
from corvane.streaming import ingest

FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>F</title>
<item><title>Harga &lt;b&gt;beras&lt;/b&gt; naik</title><link>http://n.example/1?utm_source=rss&amp;id=7</link><description>{long}</description><pubDate>Mon, 16 Jun 2026 10:00:00 +0700</pubDate><category>Ekonomi</category></item>
<item><title>Tanpa tautan</title><description>x</description></item>
<item><title>Kedua</title><link>http://n.example/2</link><pubDate>buruk</pubDate></item>
</channel></rss>"""


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_feed_scan(spark, tmp_path):
    write(tmp_path / "antara", "a.xml", FEED.format(long="<p>" * 0 + "k " * 400))
    write(tmp_path / "antara", "bad.xml", "<rss><channel><item><title>x</tit")
    items = feeds.read_items(spark, str(tmp_path / "antara")).withColumn("source_id", F.lit("antara"))
    got = feeds.normalize(items, feeds.sources(spark)).orderBy("url").collect()
    assert [(r.title, r.canonical_url, str(r.published_at)) for r in got] == [("Harga beras naik", "http://n.example/1?id=7", "2026-06-16 03:00:00"), ("Kedua", "http://n.example/2", "None")]
    assert len(got[0].excerpt) <= 300 and got[1].excerpt is None and got[0].raw_category == "Ekonomi"


def test_stream_restart_adds_nothing(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "tables")
    write(land / "antara", "a.xml", FEED.format(long="kata"))
    config = ingest.Config(str(land), out, str(tmp_path / "cp"))
    ingest.start(spark, feeds.sources(spark), config).awaitTermination()
    assert spark.read.parquet(f"{out}/articles").count() == 2 and spark.read.parquet(f"{out}/enrichments").count() == 2
    write(land / "cnnid", "b.xml", FEED.format(long="lain"))  # the same URLs from another carrier
    ingest.start(spark, feeds.sources(spark), config).awaitTermination()
    assert spark.read.parquet(f"{out}/articles").count() == 2 and spark.read.parquet(f"{out}/enrichments").count() == 2


def test_registry_and_logs(spark):
    assert feeds.registry(spark).count() == 12 and feeds.sources(spark).where("is_wire").count() == 1
    assert feeds.regions(spark).count() == 22 and feeds.entities(spark).count() == 35
    up = {r.ancestor_id for r in feeds.region_ancestors(spark).where("region_id = 'reg_bandung'").collect()}
    assert up == {"reg_bandung", "reg_jabar", "reg_id"}
    log = spark.createDataFrame([("s", 1, "ok", 3), ("s", 2, "error", None), ("t", 1, "ok", 1)], "source_id string, seq int, status string, new long")
    got = {r.source_id: (r.status, r.article_count, r.error_count) for r in tables.source_status(log).collect()}
    assert got == {"s": ("error", 3, 1), "t": ("ok", 1, 0)}


def test_first_wins_and_absent(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("m", 3, "c")], "dedup_key string, ingest_seq int, v string")
    assert sorted(r.v for r in tables.first_wins(df).collect()) == ["a", "c"]
    assert [r.v for r in tables.absent(df, df.where("v = 'a'")).collect()] == ["c"]


def test_stream_clusters_events_and_log(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "tables")
    text = FEED.format(long="KPK periksa kasus suap di Medan")
    write(land / "antara", "a.xml", text)
    write(land / "antara", "bad.xml", "<rss><channel><item><title>x</tit")
    config = ingest.Config(str(land), out, str(tmp_path / "cp"))
    ingest.start(spark, feeds.sources(spark), config).awaitTermination()
    write(land / "cnnid", "b.xml", text.replace("n.example/", "o.example/"))  # a carrier's copies under its own URLs
    ingest.start(spark, feeds.sources(spark), config).awaitTermination()
    groups = spark.read.parquet(f"{out}/clusters").groupBy("cluster_id").agg(F.count("*").alias("n"), F.first("origin_source_id").alias("o")).collect()
    assert [(g.n, g.o) for g in groups] == [(2, "antara")] * 2
    members = spark.read.parquet(f"{out}/event_members")
    assert members.count() == members.select("article_id").distinct().count() == 4
    first = {(r.source_id, r.files, r.errors, r.status, r.fetched, r.new) for r in spark.read.parquet(f"{out}/log").where("batch = 0").collect()}
    assert first == {("antara", 2, 1, "error", 3, 2)}
    before = {(r.article_id, r.event_id) for r in members.collect()}
    ingest.event_batch(spark, 1, config)  # the batch once more, as after a failure
    assert {(r.article_id, r.event_id) for r in spark.read.parquet(f"{out}/event_members").collect()} == before


def test_clusters_keep_what_left_the_slice(spark, tmp_path):
    out = str(tmp_path / "t")
    schema = "article_id string, source_id string, is_wire boolean, first_seen_hours double, fp long"
    spark.createDataFrame([("a", "s", False, 0.0, 7), ("b", "t", False, 1.0, 7)], schema).write.parquet(f"{out}/fingerprints")
    config = ingest.Config("", out, "", cluster_hours=100.0)
    assert ingest.cluster_batch(spark, config) == 1
    spark.createDataFrame([("c", "s", False, 500.0, 7)], schema).write.mode("append").parquet(f"{out}/fingerprints")
    assert ingest.cluster_batch(spark, config) == 1
    assert {(r.article_id, r.cluster_id) for r in spark.read.parquet(f"{out}/clusters").collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
