from pyspark.sql import functions as F

from corvane.functions import text as T


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(col.alias("x")).first().x


def test_canonical_url(spark):
    cases = {
        " http://a.b/c?utm_source=x&page=2&ref=y#top ": "http://a.b/c?page=2",
        "http://a.b/c": "http://a.b/c",
        "http://a.b/c?x=&fbclid=1": "http://a.b/c",
        "http://a.b/c?q=a%20b&z=1": "http://a.b/c?q=a+b&z=1",
        "http://a.b/c?flag": "http://a.b/c",
    }
    for url, want in cases.items():
        assert one(spark, T.canonical_url(F.col("u")), u=url) == want


def test_cleaning(spark):
    assert one(spark, T.strip_html(F.col("t")), t="<p>a  b</p>\n c") == "a b c"
    assert one(spark, T.element_text(F.col("t")), t="<br/> ") is None
    assert one(spark, T.normalize_quotes(F.col("t")), t="“a” ‘b’ «c»") == "\"a\" 'b' \"c\""
    assert one(spark, T.clean_text(F.col("t")), t="JAKARTA (AG) - Kata <b>dia</b>") == "Kata dia"
    assert one(spark, T.clean_text(F.col("t")), t="Harga naik - pasar") == "Harga naik - pasar"


def test_published_at(spark):
    got = lambda x: str(one(spark, T.published_at(F.col("d"), F.lit("Asia/Jakarta")), d=x))
    assert got("Mon, 16 Jun 2026 10:00:00 +0700") == "2026-06-16 03:00:00"  # a wrong weekday is ignored
    assert got("16 Jun 2026 10:00:00") == "2026-06-16 03:00:00"
    assert got("Tue, 16 Jun 2026 10:00:00 GMT") == "2026-06-16 10:00:00"
    assert got("soon") == "None"


def test_language_and_tokens(spark):
    assert one(spark, T.language(F.col("t")), t="yang dan the") == "id"
    assert one(spark, T.language(F.col("t")), t="the of and yang") == "en"
    assert one(spark, T.language(F.col("t")), t="xyz 12") == "unknown"
    assert one(spark, T.tokens(F.col("t")), t="Ab-c, été 12") == ["ab", "c", "t", "12"]


def test_excerpt_and_link(spark):
    assert one(spark, T.excerpt(F.col("t")), t="é" * 400) == "é" * 300
    assert one(spark, T.deep_link(F.lit("http://x"), F.col("t")), t="a b/c d e f g h i j") == "http://x#:~:text=a%20b/c%20d%20e%20f%20g%20h%20i"
    assert one(spark, T.iso_utc(F.lit(1000.0)), t="") == "1970-02-11T16:00:00Z"
