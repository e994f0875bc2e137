"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from crestline.llm import fill_in_middle
from crestline.llm.url_filters import DEFAULT_LOG

#: CRC-32 of a text's bytes, a byte at a time over a table made by the polynomial's rule.
_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_concat([b::BIGINT], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) AS r(b)),
crcs AS (
  SELECT body, xor(list_reduce(list_concat([4294967295::BIGINT],
      list_transform(list_filter(string_split(regexp_replace(hex(encode(body)), '(..)', '0x\\1 ', 'g'), ' '), lambda h: h <> ''),
        lambda h: CAST(h AS BIGINT))),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295) AS crc
  FROM (SELECT DISTINCT coalesce(text, '') AS body FROM documents), crc_table)"""

OP3 = f"""
WITH {_CRC},
rows AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, crc AS text_crc32,
    coalesce('s' || source, 'n') AS stratum,
    CAST('0x' || substr(md5('shards-1:' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || CAST(crc AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM documents JOIN crcs ON body = coalesce(text, '')),
within AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, text_crc32, size) - 1
      + (CAST('0x' || substr(md5('shards-1:' || stratum), 1, 15) AS BIGINT) + 0.5::DOUBLE) / 1152921504606846976::DOUBLE)
    / count(*) OVER (PARTITION BY stratum) AS frac
  FROM rows),
whole AS (
  SELECT *, row_number() OVER (ORDER BY frac, stratum, doc_id NULLS FIRST, text_crc32, size) - 1 AS r, count(*) OVER () AS n FROM within)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST((r * 16) // n AS INTEGER) AS shard,
  CAST(r - ((r * 16) // n * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM whole
"""

#: The exponent by halving, as both limits loosen while it grows; the rest are windows over the readings.
OP2 = f"""
WITH RECURSIVE {_CRC},
rows AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS stratum, crc,
    greatest(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')), 1) AS tokens
  FROM documents JOIN crcs ON body = coalesce(text, '')),
sources AS (SELECT stratum, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE / (SELECT sum(tokens) FROM rows) AS q FROM rows GROUP BY stratum),
target AS (SELECT -sum(q * ln(q)) + 0.5 * (ln(count(*)) + sum(q * ln(q))) AS entropy, min(q) AS least, max(q) AS most FROM sources),
halving AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN held THEN low ELSE mid END, CASE WHEN held THEN mid ELSE high END
  FROM (
    SELECT h.*, (low + high) / 2 AS mid,
      ln(z) - (low + high) / 2 * zl / z <= entropy + 1e-12 AND pow(least / most, (low + high) / 2 - 1) <= 2 + 1e-12 AS held
    FROM halving h, target,
      LATERAL (SELECT sum(pow(q, (h.low + h.high) / 2)) AS z, sum(pow(q, (h.low + h.high) / 2) * ln(q)) AS zl FROM sources) AS sums
    WHERE step < 44)),
chosen AS (
  SELECT CASE WHEN ln(n) <= entropy + 1e-12 AND most / least <= 2 + 1e-12 THEN 0.0 ELSE round((SELECT high FROM halving WHERE step = 44), 6) END AS alpha
  FROM target, (SELECT count(*) AS n FROM sources)),
plan AS (
  SELECT stratum, tokens, alpha, round(p / sum(p) OVER (), 9) AS weight,
    greatest(CAST(round(p * max(tokens / p) OVER ()) AS BIGINT), CAST(tokens AS BIGINT)) AS quota
  FROM (SELECT *, pow(q, alpha) AS p FROM sources, chosen)),
blocks AS (SELECT CAST(greatest(1, round_even(sum(quota) / 131072.0, 0)) AS BIGINT) AS n FROM plan),
readings AS (
  SELECT r.*, CAST(p.tokens AS BIGINT) AS have, alpha, weight, quota, e.epoch,
    CAST('0x' || substr(md5('mix-1:' || e.epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || crc), 1, 15) AS BIGINT) AS h
  FROM rows r JOIN plan p USING (stratum), LATERAL (SELECT unnest(range(0, CAST(ceil(quota::DOUBLE / p.tokens) AS BIGINT))) AS epoch) AS e),
places AS (
  SELECT *, epoch * have + coalesce(sum(tokens) OVER (PARTITION BY epoch, stratum ORDER BY h, doc_id NULLS FIRST, tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM readings),
dealt AS (SELECT p.*, CAST((CAST(place AS HUGEINT) * n) // quota AS BIGINT) AS block FROM places p, blocks WHERE place < quota)
SELECT doc_id, CASE WHEN stratum = 'n' THEN NULL ELSE substr(stratum, 2) END AS source, tokens, alpha, weight, CAST(epoch AS INTEGER) AS epoch, block,
  row_number() OVER (PARTITION BY block ORDER BY
    CAST('0x' || substr(md5('mix-1:' || block || ':' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '~') || ':' || crc), 1, 15) AS BIGINT),
    stratum, doc_id NULLS FIRST, epoch, tokens) - 1 AS slot
FROM dealt
"""

_LOG = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in DEFAULT_LOG)

OP8 = f"""
WITH log(list, effect, kind, pattern, action, effective) AS (VALUES {_LOG}),
entries AS (
  SELECT a.list, a.effect, a.kind, a.pattern, CAST(a.effective AS DATE) AS valid_from,
    (SELECT min(CAST(r.effective AS DATE)) FROM log r WHERE r.action = 'remove' AND r.list = a.list AND r.effect = a.effect
      AND r.kind = a.kind AND r.pattern = a.pattern AND r.effective >= a.effective) AS valid_to
  FROM log a WHERE a.action = 'add'),
captures AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched_at,
    lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages),
hits AS (
  SELECT c.page_id, c.url, e.*, CASE kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END AS narrow
  FROM captures c JOIN entries e
    ON fetched_at >= valid_from AND (valid_to IS NULL OR fetched_at < valid_to)
    AND CASE kind WHEN 'host' THEN host = pattern
      WHEN 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
      ELSE host || path = pattern OR starts_with(host || path, pattern || '/') END),
verdicts AS (
  SELECT page_id, url, count(*) AS n_active, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
    arg_min(struct_pack(r := kind || ' ' || pattern, e := effect),
      struct_pack(a := -length(pattern), b := -narrow, c := CASE effect WHEN 'block' THEN 0 ELSE 1 END, d := list)) AS best
  FROM hits GROUP BY page_id, url)
SELECT c.page_id, c.url, CAST(c.fetched_at AS VARCHAR) AS fetched_at, c.host, coalesce(n_active, 0) AS n_active, coalesce(lists, '') AS lists,
  coalesce(best.r, '') AS rule, coalesce(best.e, '') = 'block' AS blocked
FROM captures c LEFT JOIN verdicts v ON v.page_id = c.page_id AND v.url = c.url
"""

SQL = {
    "op2_temperature_mixing": OP2,
    "op3_stratified_interleaving": OP3,
    "op8_url_temporal_lists": OP8,
    "op13_fill_in_middle": fill_in_middle.SQL,
}
