"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_SQL: dict[str, str] = {}

_SQL["op1_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|NEXT\])', '\1\\\2\3', 'g') AS erole,
    regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|NEXT\])', '\1\\\2\3', 'g') AS etext,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(etext) + CASE WHEN before IS NULL OR before <> role
    THEN length('<s>[INST]') + length(erole) + length('[/INST]') + length('</s>')
    ELSE length('[NEXT]') END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

_URL_RULES = """
  SELECT * FROM (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
    ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
  ) AS r(verdict, rule_host, rule_path)
"""

_WEIGHT = """
    CASE WHEN sum(pow(good - n * prior, 2)) - sum(n * prior * (1 - prior)) > 0
      THEN greatest(1.0, least(1000.0, sum(n * (n - 1) * prior * (1 - prior))
        / (sum(pow(good - n * prior, 2)) - sum(n * prior * (1 - prior))) - 1))
      ELSE 1000.0 END
"""

_SQL["op3_url_filters"] = rf"""
WITH rules AS ({_URL_RULES}), marks AS (
  SELECT doc_id AS page_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1
    WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS good
  FROM labels GROUP BY doc_id
), named AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good,
    CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host
      WHEN regexp_matches(host, '[^.]+\.(ac|co|com|edu|gov|net|org)\.[a-z][a-z]$')
        THEN regexp_extract(host, '([^.]+\.(?:ac|co|com|edu|gov|net|org)\.[a-z][a-z])$', 1)
      WHEN regexp_matches(host, '[^.]+\.[^.]+$') THEN regexp_extract(host, '([^.]+\.[^.]+)$', 1)
      ELSE host END AS domain
  FROM named LEFT JOIN marks USING (page_id) GROUP BY host
), hosts2 AS (
  SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]+$') THEN ''
    ELSE regexp_extract(domain, '^[^.]*\.(.*)$', 1) END AS suffix FROM hosts
), domains AS (
  SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts2 GROUP BY domain, suffix
), suffixes AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains GROUP BY suffix
), s1 AS (
  SELECT *, (SELECT (sum(good) + 0.5::DOUBLE) / (sum(n) + 1) FROM suffixes) AS prior FROM suffixes
), s2 AS (
  SELECT suffix, ((SELECT {_WEIGHT} FROM s1) * prior + good) / ((SELECT {_WEIGHT} FROM s1) + n) AS m FROM s1
), d1 AS (
  SELECT domains.*, m AS prior FROM domains JOIN s2 USING (suffix)
), d2 AS (
  SELECT domain, ((SELECT {_WEIGHT} FROM d1) * prior + good) / ((SELECT {_WEIGHT} FROM d1) + n) AS m FROM d1
), h1 AS (
  SELECT hosts2.*, m AS prior FROM hosts2 JOIN d2 USING (domain)
), h2 AS (
  SELECT host, (SELECT {_WEIGHT} FROM h1) * prior + good AS a,
    (SELECT {_WEIGHT} FROM h1) * (1 - prior) + n - good AS b FROM h1
), reputation AS (
  SELECT host, a / (a + b) + 2.0 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS upper FROM h2
), fits AS (
  SELECT page_id, first(rule_host || rule_path ORDER BY length(rule_host || rule_path) DESC) AS rule,
    first(verdict ORDER BY length(rule_host || rule_path) DESC) AS verdict
  FROM named, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(fits.verdict,
  CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM named LEFT JOIN fits USING (page_id) LEFT JOIN reputation USING (host)
"""

_SQL["op6_exact_dedup"] = r"""
WITH digests AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), ranked AS (
  SELECT *, first(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM digests
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
"""

_SQL["op9_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), placed AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM placed
), frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT doc_id, line, place, last IS NOT NULL AND doc_id < last AS dropped
  FROM keyed LEFT JOIN frequent USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_SQL["op10_source_mixing"] = r"""
WITH sizes AS (
  SELECT source, CAST(sum(length(coalesce(text, ''))) AS DOUBLE) AS chars FROM documents GROUP BY source
), rates AS (
  SELECT source, CASE WHEN chars > 0
    THEN (1.0::DOUBLE / (SELECT count(*) FROM sizes WHERE chars > 0)) * (SELECT sum(chars) FROM sizes) / chars
    ELSE 1.0::DOUBLE END AS rate
  FROM sizes
), cdf AS (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1.0::DOUBLE)))
    OVER (PARTITION BY source ORDER BY k) AS upto
  FROM (SELECT *, unnest(range(0, CAST(floor(rate + 12 * sqrt(rate) + 40) AS BIGINT) + 1)) AS k FROM rates)
), drawn AS (
  SELECT *, doc_id || ':' || md5(coalesce(text, '')) AS name,
    CAST('0x' || md5('17:' || name)[1:13] AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents
), counted AS (
  SELECT d.doc_id, count(*) AS n FROM drawn d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source AND upto <= u
  GROUP BY d.doc_id
)
SELECT d.* EXCLUDE (name, u), c.copy, md5('18:' || d.name || ':' || c.copy) AS shuffle_key
FROM drawn d JOIN (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM counted) c USING (doc_id)
"""


def _rounds_of_means(rounds: int) -> str:
    """Assignments and centroids in turn: a0, c1, a1, ..."""

    def assignment(t: int) -> str:
        return f"""
d{t} AS MATERIALIZED (
  SELECT r, k, CAST(sum((x - c) * (x - c)) AS BIGINT) AS distance FROM axes JOIN c{t} USING (axis) GROUP BY r, k
), a{t} AS MATERIALIZED (
  SELECT r, first(k ORDER BY distance, k) AS k, min(distance) AS distance FROM d{t} GROUP BY r
)"""

    def update(t: int) -> str:
        return f"""
s{t} AS MATERIALIZED (
  SELECT k, axis, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM axes JOIN a{t - 1} USING (r) GROUP BY k, axis
), c{t} AS MATERIALIZED (
  SELECT c.k, c.axis, CASE WHEN n IS NULL THEN c.c ELSE (s - ((s % n) + n) % n) // n END AS c
  FROM c{t - 1} c LEFT JOIN s{t} USING (k, axis)
)"""

    steps = [assignment(0)]
    for t in range(1, rounds + 1):
        steps += [update(t), assignment(t)]
    return ",".join(steps)


_SQL["op11_centroid_clustering"] = rf"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(
    greatest(least(floor(256.0::DOUBLE * CAST(x AS DOUBLE)), 134217728), -134217728) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64
), axes AS MATERIALIZED (
  SELECT r, unnest(range(64)) AS axis, unnest(v) AS x FROM kept
), chosen AS (
  SELECT r, row_number() OVER (ORDER BY sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), v) - 1 AS k
  FROM kept
), c0 AS MATERIALIZED (
  SELECT k, axis, x AS c FROM axes JOIN chosen USING (r) WHERE k < 40
), {_rounds_of_means(5)}, centroids AS (
  SELECT k, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY axis)) AS centroid_sha256 FROM c5 GROUP BY k
)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, distance,
  CAST(sum(distance) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM kept JOIN a5 USING (r) JOIN centroids USING (k)
"""
