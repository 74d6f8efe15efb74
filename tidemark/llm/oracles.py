"""DuckDB SQL for the queries that SQL can express."""

from . import lines

#: Recursive reachability over links with cosine 0.9 and more.
OP1 = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
    vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: coalesce(x, 0) <> 0)) AS ok
  FROM embeddings
), n AS (SELECT rid, vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE ok),
links AS (
  SELECT a.rid AS a, b.rid AS b FROM n a JOIN n b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT rid, rid AS other FROM v UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other
), component AS (SELECT r.rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = r.other GROUP BY r.rid),
counted AS (SELECT a AS rid, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(v.vec_id = component_id, true) AS kept
FROM v LEFT JOIN component USING (rid) LEFT JOIN counted USING (rid)
"""

#: All 50-byte strings of all documents, as hexadecimal digits.
OP2 = """
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT rid, place, i, md5_number(h[2 * i + 1 : 2 * i + 100]) AS w FROM (SELECT rid, place, h, unnest(range(len(h) // 2 - 49)) AS i FROM rows WHERE len(h) >= 100)),
first AS (SELECT w, min(place) AS place FROM windows GROUP BY w),
gone AS (SELECT x.rid, x.i FROM windows x JOIN first f ON x.w = f.w WHERE f.place < x.place),
marked AS (SELECT rid, i, i - lag(i, 1, -100) OVER (PARTITION BY rid ORDER BY i) AS step FROM gone),
spans AS (
  SELECT rid, s, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT rid, i, sum(CASE WHEN step > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS s FROM marked) GROUP BY rid, s
), listed AS (SELECT rid, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY rid),
cut AS (
  SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    CASE WHEN starts IS NULL THEN h ELSE
      h[1 : 2 * starts[1]] || array_to_string(list_transform(range(1, len(starts) + 1), lambda k: h[2 * ends[k] + 1 : CASE WHEN k = len(starts) THEN len(h) ELSE 2 * starts[k + 1] END]), '') END AS kept
  FROM rows LEFT JOIN listed USING (rid)
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM cut
"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP3 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
phrases AS (SELECT DISTINCT item_id, w[i + 1 : i + 8] AS p FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 7))) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(p) AS n FROM phrases),
grams AS (SELECT rid, i, n, w[i + 1 : i + n] AS p FROM (SELECT rid, w, n, unnest(range(greatest(0, len(w) - n + 1))) AS i FROM d, sizes)),
found AS (SELECT g.rid, g.i, g.n, p.item_id FROM grams g JOIN phrases p ON g.p = p.p),
hits AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM found) GROUP BY rid),
named AS (SELECT rid, list_sort(list(DISTINCT item_id::VARCHAR)) AS names FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(names), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256, coalesce(len(names), 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

#: CRC-32 of each text, byte by byte, with the table made by its rule.
OP5 = """
WITH step AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
rows AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 8 AS size FROM documents),
summed AS (
  SELECT doc_id, text, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM rows, step
), ordered AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) AS n FROM summed),
placed AS (SELECT *, least(23, (24 * (2 * start + size)) // (2 * total))::INT AS shard FROM ordered)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, n - min(n) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM placed
"""

OP8 = """
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(substr(r, len(regexp_extract(r, '^[^/]*')) + 1), '') AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
numbered AS (SELECT row_number() OVER () AS rid, * FROM parts),
best AS (
  SELECT rid, arg_max(h || p, len(h || p)) AS rule, arg_max(verdict, len(h || p)) AS verdict
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid
)
SELECT page_id, coalesce(host, '') AS host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_lattice": OP1, "op2_substrings": OP2, "op3_decontaminate": OP3, "op5_byte_shards": OP5, "op8_url_filter": OP8, "op10_line_dedup": lines.ORACLE}
