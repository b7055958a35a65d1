"""DuckDB SQL for the corpus queries that SQL can express over whole tables."""

WS = "[^\\x20\\x09-\\x0D]+"


def _fill(name: str, children: str, parent: str, k: str) -> str:
    """Water-filling of ``amount`` among the children of a parent."""
    return f"""
{name}_a AS (SELECT *, capacity / weight AS r,
    sum(capacity) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {k} ROWS UNBOUNDED PRECEDING) AS c,
    sum(weight) OVER (PARTITION BY {parent})
      - sum(weight) OVER (PARTITION BY {parent} ORDER BY capacity / weight, {k} ROWS UNBOUNDED PRECEDING) AS w FROM {children}),
{name}_b AS (SELECT *, (c + r * w <= amount) AS is_full FROM {name}_a),
{name} AS (SELECT *, CASE WHEN is_full THEN capacity ELSE
    (amount - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {parent})) * weight
    / sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) END AS share FROM {name}_b)"""


def _mix(ratio: float = 0.6, epochs: int = 3, seed: int = 17) -> str:
    domain = "CASE WHEN regexp_full_match(s, 'src[0-9]') THEN 'web' WHEN regexp_full_match(s, 'src1[0-4]') THEN 'books' WHEN regexp_full_match(s, 'src1[5-9]') THEN 'reference' ELSE 'other' END"
    return f"""
WITH d0 AS (SELECT doc_id, coalesce(lang, 'und') AS lang, coalesce(source, 'unknown') AS s,
    len(regexp_extract_all(coalesce(text, ''), '{WS}')) AS n_tokens FROM documents),
d AS (SELECT doc_id, lang, s AS source, n_tokens, {domain} AS domain FROM d0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::DOUBLE AS tokens, sum(n_tokens)::DOUBLE * {epochs} AS capacity
    FROM d GROUP BY ALL HAVING sum(n_tokens) > 0),
tot AS (SELECT least({ratio} * sum(tokens), sum(capacity)) AS amount FROM leaves),
dom0 AS (SELECT domain, sum(capacity) AS capacity, any_value(amount) AS amount, 0 AS one,
    CASE domain WHEN 'web' THEN 0.5 WHEN 'books' THEN 0.3 WHEN 'reference' THEN 0.2 ELSE 0.05 END::DOUBLE AS weight
    FROM leaves, tot GROUP BY domain),
{_fill("dom", "dom0", "one", "domain")},
lng0 AS (SELECT l.domain, l.lang, sum(l.capacity) AS capacity, any_value(dom.share) AS amount,
    CASE l.lang WHEN 'en' THEN 0.55 WHEN 'de' THEN 0.15 WHEN 'fr' THEN 0.15 WHEN 'es' THEN 0.15 ELSE 0.05 END::DOUBLE AS weight
    FROM leaves l JOIN dom USING (domain) GROUP BY l.domain, l.lang),
{_fill("lng", "lng0", "domain", "lang")},
src0 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.capacity, lng.share AS amount, 1.0::DOUBLE AS weight
    FROM leaves l JOIN lng USING (domain, lang)),
{_fill("src", "src0", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, floor(share / tokens + 1e-9) AS f,
    floor(greatest(0, share - floor(share / tokens + 1e-9) * tokens) + 1e-6) AS rest FROM src),
keyed AS (SELECT d.*, f::BIGINT AS f, rest, md5('{seed}:' || f::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')) AS key
    FROM d JOIN plan USING (domain, lang, source)),
cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE UNBOUNDED PRECEDING) AS t FROM keyed),
n AS (SELECT *, f + CASE WHEN f < {epochs} AND t <= rest THEN 1 ELSE 0 END AS times FROM cum)
SELECT doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens, e::INTEGER AS epoch
FROM (SELECT *, unnest(range(times)) AS e FROM n)
"""


ORACLE = {"op10_mix_sources": _mix()}
