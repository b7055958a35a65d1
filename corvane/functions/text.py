"""Text, URL and time expressions. All are plain columns and stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import STOPWORDS

#: Characters of an excerpt that may be stored.
EXCERPT = 300
# Query keys that only track, and the prefix of further ones.
TRACKING = ("fbclid", "gclid", "igshid", "ref", "source")
TRACKING_PREFIX = "utm_"
# Typographic quotes and what they become.
QUOTES_FROM, QUOTES_TO = "“”„‟″«»‘’‚‛′", "\"\"\"\"\"\"\"'''''"
# Fixed value: an upper-case place (and agency or outlet) with a dash, at the start of a text.
DATELINE = r"^\s*[A-Z][A-Z][A-Z .'-]{1,28}?,?\s*(?:\([^)]{1,30}\)|[A-Za-z]+\.com)?\s*[-–—]\s+"


def squeeze(x: Column) -> Column:
    """White space of any kind as single spaces, trimmed."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def strip_html(x: Column) -> Column:
    return squeeze(F.regexp_replace(x, "<[^>]+>", " "))


def element_text(x: Column) -> Column:
    """Text of a feed element; null if nothing is left."""
    return F.nullif(strip_html(x), F.lit(""))


def normalize_quotes(x: Column) -> Column:
    return F.translate(x, QUOTES_FROM, QUOTES_TO)


def strip_dateline(x: Column) -> Column:
    return F.ltrim(F.regexp_replace(x, DATELINE, ""))


def clean_text(x: Column) -> Column:
    return strip_dateline(squeeze(normalize_quotes(strip_html(x))))


def excerpt(x: Column, cap: int = EXCERPT) -> Column:
    return F.substring(x, 1, cap)


def within_cap(x: Column, cap: int = EXCERPT) -> Column:
    return x.isNull() | (F.length(x) <= cap)


def canonical_url(url: Column) -> Column:
    """Without fragment and tracking parameters; other parameters in order, re-encoded; blank ones are dropped."""
    bare = F.split_part(F.trim(url), F.lit("#"), F.lit(1))
    path = F.split_part(bare, F.lit("?"), F.lit(1))
    query = F.substr(bare, F.length(path) + 2)

    def decoded(part: Column, i: int) -> Column:
        at = F.instr(part, "=")
        piece = F.substring(part, F.lit(1), at - 1) if i == 0 else F.substr(part, at + 1)
        return F.coalesce(F.try_url_decode(piece), piece)

    def keep(part: Column) -> Column:
        key = decoded(part, 0)
        tracks = key.isin(*TRACKING) | key.startswith(TRACKING_PREFIX)
        return part.contains("=") & (F.substr(part, F.instr(part, "=") + 1) != "") & ~tracks

    kept = F.filter(F.split(query, "&"), keep)
    def encoded(value: Column) -> Column:
        """Form encoding by RFC 3986: ~ stands for itself, * does not; the JVM's encoder has it the other way round."""
        return F.replace(F.replace(F.url_encode(value), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))

    coded = F.transform(kept, lambda p: F.concat(encoded(decoded(p, 0)), F.lit("="), encoded(decoded(p, 1))))
    scheme = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    path = F.when(scheme != "", F.concat(F.lower(scheme), F.substr(path, F.length(scheme) + 1))).otherwise(path)
    return F.when(F.size(coded) > 0, F.concat(path, F.lit("?"), F.array_join(coded, "&"))).otherwise(path)


def dedup_key(url: Column) -> Column:
    """Identity of an article: SHA-256 of its canonical URL."""
    return F.sha2(F.trim(url).cast("binary"), 256)


def published_at(x: Column, zone: Column) -> Column:
    """RFC-822 date to UTC; a date without a zone is in the source's; a bad one is null. The weekday is ignored."""
    bare = F.regexp_replace(F.trim(x), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\b(GMT|UTC|UT|Z)$", "+0000")
    naive = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm")))
    aware = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")))
    return F.coalesce(aware, F.to_utc_timestamp(naive, zone))


def tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.regexp_replace(F.lower(x), "[^0-9a-z]+", " "), " "), lambda t: t != "")


def language(x: Column) -> Column:
    """'id', 'en' or 'unknown', by stop words; a tie is 'id'."""
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-z]+"), F.lit(0))

    def hits(code: str) -> Column:
        return F.size(F.filter(words, lambda t: t.isin(*STOPWORDS[code])))

    return F.when(hits("id") + hits("en") == 0, "unknown").when(hits("en") > hits("id"), "en").otherwise("id")


def hours(ts: Column) -> Column:
    """Hours since the epoch."""
    return F.unix_micros(ts.cast("timestamp")) / 3.6e9


def iso_utc(h: Column) -> Column:
    """Hours since the epoch as ISO text in UTC (the session's zone)."""
    return F.date_format(F.timestamp_micros((h * 3.6e9).cast("long")), "yyyy-MM-dd'T'HH:mm:ssXXX")


def deep_link(url: Column, quote: Column) -> Column:
    """Link to a text fragment: the first eight words of a quote."""
    words = F.array_join(F.slice(F.split(squeeze(quote), " "), 1, 8), " ")
    coded = F.regexp_replace(F.regexp_replace(F.url_encode(words), r"\+", "%20"), "%2F", "/")
    return F.concat(url, F.lit("#:~:text="), coded)
