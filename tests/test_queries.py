import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["trending_24h", "trending_baseline", "source_scores", "canonical_urls", "tokens", "neardup_pairs", "topic_top3", "quota", "event_summary", "webhook_firings"]


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(str(round(v, 6) if isinstance(v, float) else v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).fetch_df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_texts_are_read(spark, tmp_path):
    """Words after the 300th character count in the queries that no SQL binds to an excerpt."""
    start = "a title\n" + "plain words here " * 30
    texts = [start + "a b c d e f g h", start + "KPK periksa kasus suap di Medan. " * 9]
    docs = [(i, t, "en", "src3", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    prints = {r.article_id: r.fp for r in entry.queries()["simhash_blake2b"](spark, str(tmp_path)).collect()}
    assert prints[0] != prints[1]
    found = {r.article_id: r for r in entry.queries()["enriched"](spark, str(tmp_path)).collect()}
    assert not found[0].actors and found[1].actors and found[1].regions


def test_erasures_of_customers_without_orders(spark, tmp_path):
    """Customers without an order or status, repeated or null ones, and orders of unknown customers."""
    customers = [(k,) for k in (1, 2, 2, 3, 7, 8, None, None)]
    orders = [(10, 2, "P"), (11, 2, "O"), (12, 3, "F"), (13, 8, None), (14, 99, "F"), (15, None, "P")]
    spark.createDataFrame(customers, "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    found = entry.queries()["erasures"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, con.execute(entry.oracle_sql()["erasures"]).fetchall()))
