"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from newsgraph.llm import mixing

# Words and windows as the query has them; an item of fewer than 10 words is one window.
OP5 = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(p) AS n FROM windows),
places AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS p
  FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w, lengths WHERE len(w) >= n)),
found AS (SELECT rid, n, i, item_id FROM places JOIN windows USING (p)),
hits AS (
  SELECT rid, count(DISTINCT k) AS n_hit
  FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT rid, n, i FROM found)) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS id FROM found WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""

OP2 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _weight(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _fill(table: str, source: str, parents: str, name: str, weight: str) -> str:
    """Children of one level with their budgets; ``source`` gives (cap, budget) and the names."""
    part = f"PARTITION BY {parents}" if parents else ""
    run = f"({part} ORDER BY CAST(cap AS DOUBLE) / w, {name} RANGE UNBOUNDED PRECEDING)"
    names = f"{parents}, {name}" if parents else name
    return f"""
{table}_w AS (SELECT *, CAST({weight} AS BIGINT) AS w FROM ({source})),
{table}_a AS (
  SELECT *, CAST(sum(cap) OVER {run} - cap AS HUGEINT) AS before,
         CAST(sum(w) OVER ({part}) - sum(w) OVER {run} + w AS HUGEINT) AS rest_w
  FROM {table}_w),
{table}_b AS (
  SELECT *, cap * rest_w + before * w <= CAST(budget AS HUGEINT) * w AS full_up FROM {table}_a),
{table}_c AS (
  SELECT *, budget - sum(CASE WHEN full_up THEN cap ELSE 0 END) OVER ({part}) AS rest,
         CASE WHEN full_up THEN 0 ELSE w END AS open_w FROM {table}_b),
{table}_d AS (
  SELECT *, greatest(sum(open_w) OVER ({part}), 1) AS all_w, sum(open_w) OVER {run} AS upto FROM {table}_c),
{table} AS (
  SELECT {names}, CAST(CASE WHEN full_up THEN cap
         ELSE (rest * upto) // all_w - (rest * (upto - open_w)) // all_w END AS BIGINT) AS budget FROM {table}_d)"""


def _op3() -> str:
    num, den = mixing.SHARE
    d, g, o = (mixing.WEIGHTS[k] for k in ("domain", "language", "origin"))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce({mixing.DOMAIN}, '') AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS origin,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS id,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens
  FROM documents),
leaf AS (
  SELECT domain, language, origin, CAST(sum(n_tokens) AS BIGINT) AS tokens,
         CAST(sum(n_tokens) * {mixing.MAX_EPOCHS} AS BIGINT) AS cap
  FROM d GROUP BY ALL),{_fill("b0", f"SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, (SELECT CAST(least(sum(tokens) * {num} // {den}, sum(cap)) AS BIGINT) FROM leaf) AS budget FROM leaf GROUP BY domain", "", "domain", _weight("domain", d))},{
_fill("b1", "SELECT domain, language, CAST(sum(cap) AS BIGINT) AS cap, any_value(budget) AS budget FROM leaf JOIN b0 USING (domain) GROUP BY domain, language", "domain", "language", _weight("language", g))},{
_fill("b2", "SELECT domain, language, origin, cap, budget FROM leaf JOIN b1 USING (domain, language)", "domain, language", "origin", _weight("origin", o))},
plan AS (
  SELECT domain, language, origin, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole, budget, tokens
  FROM leaf JOIN b2 USING (domain, language, origin)),
k AS (
  SELECT d.*, whole, budget - whole * tokens AS rest, md5(concat_ws(':', '{mixing.SEED}', CAST(whole AS VARCHAR), id)) AS k
  FROM d JOIN plan USING (domain, language, origin)),
s AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto FROM k),
c AS (
  SELECT *, whole + CASE WHEN (rest > 0 OR whole = 0) AND upto <= rest THEN 1 ELSE 0 END AS copies FROM s)
SELECT doc_id, domain, language, origin, n_tokens, CAST(unnest(generate_series(1, copies)) AS INT) AS epoch
FROM c WHERE copies > 0
"""


OP6 = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i, len(l) AS n FROM d WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM x),
r AS (
  SELECT *, i = n OR (h + 257 * coalesce(lag(h, 1) OVER w, 0) + 66049 * coalesce(lag(h, 2) OVER w, 0)) % 4 = 0 AS last
  FROM h WINDOW w AS (PARTITION BY rid ORDER BY i)),
c AS (
  SELECT *, coalesce(sum(CAST(last AS INT)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM r),
chunk AS (SELECT rid, doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t FROM c GROUP BY rid, doc_id, k),
marked AS (
  SELECT *, n >= 2 AND row_number() OVER (PARTITION BY t, n >= 2 ORDER BY doc_id NULLS LAST, rid, k) > 1 AS gone FROM chunk),
doc AS (
  SELECT rid, sum(n) AS n_lines, coalesce(sum(n) FILTER (gone), 0) AS removed, count(*) FILTER (gone) AS chunks,
         coalesce(string_agg(t, chr(10) ORDER BY k) FILTER (NOT gone), '') AS clean
  FROM marked GROUP BY rid)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(removed, 0) AS BIGINT) AS n_lines_removed,
       CAST(coalesce(chunks, 0) AS BIGINT) AS n_chunks_removed, CAST(length(clean) AS BIGINT) AS clean_chars, md5(clean) AS clean_md5
FROM d LEFT JOIN doc USING (rid)
"""

OP9 = r"""
WITH p AS (
  SELECT *, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, md5(coalesce(html, '')) AS digest,
         regexp_extract(url, '^([a-z]+)://([^/?#]*)(.*)$', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/?#]*)(.*)$', 2) AS host,
         regexp_extract(url, '^([a-z]+)://([^/?#]*)(.*)$', 3) AS tail
  FROM pages WHERE page_id IS NOT NULL),
raw AS (
  SELECT page_id * 2 AS record_id, url, page_id * 600 AS ts, true AS response, page_id % 13 <> 12 AS ok,
         CASE WHEN page_id % 10 <> 9 THEN tag END AS etag,
         CASE WHEN page_id % 3 = 0 THEN 'day ' || page_id END AS modified, length(html) AS size, digest, page_id
  FROM p
  UNION ALL
  SELECT page_id * 2 + 1,
         CASE WHEN scheme IN ('http', 'https') THEN upper(scheme) || '://' || upper(host)
              || CASE scheme WHEN 'http' THEN ':80' ELSE ':443' END || regexp_replace(tail, '#.*$', '') || '#again' ELSE url END,
         page_id * 600 + CASE WHEN page_id % 11 = 0 THEN -900 ELSE (page_id % 7) * 43200 + 30 END, false, true,
         CASE WHEN page_id % 10 = 0 THEN 'W/' || tag WHEN page_id % 10 = 1 THEN '"other"' WHEN page_id % 10 NOT IN (2, 9) THEN tag END,
         CASE WHEN page_id % 3 = 0 THEN 'day ' || page_id END, 0, NULL, page_id
  FROM p),
parts AS (
  SELECT *, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 1)) AS s,
         regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 2)), '^.*@', ''), '^www\.', '') AS h,
         regexp_replace(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 3), '/+$', '') AS path,
         list_sort(list_filter(string_split(regexp_replace(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$', 4), '^\?', ''), '&'),
                               lambda q: q <> '' AND NOT starts_with(q, 'utm_'))) AS q
  FROM raw),
rec AS (
  SELECT *, CASE WHEN s = '' THEN trim(url) ELSE
    CASE s WHEN 'http' THEN regexp_replace(h, ':80$', '') WHEN 'https' THEN regexp_replace(h, ':443$', '') ELSE h END
    || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END END AS url_key
  FROM parts),
line AS (
  SELECT *, last_value(CASE WHEN response AND ok THEN record_id END IGNORE NULLS) OVER (
           PARTITION BY url_key ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS near
  FROM rec),
m AS (
  SELECT r.record_id, r.url_key, r.ts, f.record_id AS refers_to, r.page_id, r.etag, f.etag AS fetag, f.size AS fsize, f.digest AS fdigest,
         CASE WHEN f.record_id IS NULL THEN 'no-earlier'
              WHEN CASE WHEN r.etag IS NOT NULL THEN coalesce(regexp_replace(r.etag, '^W/', '') = regexp_replace(f.etag, '^W/', ''), false)
                        WHEN r.modified IS NOT NULL THEN coalesce(r.modified = f.modified, false)
                        ELSE f.etag IS NULL AND f.modified IS NULL END THEN 'resolved'
              ELSE 'mismatch' END AS outcome
  FROM line r LEFT JOIN rec f ON f.record_id = r.near AND r.url_key IS NOT NULL WHERE NOT r.response)
SELECT record_id, url_key, ts, refers_to, outcome,
       concat_ws(';', 'cache-control=max-age=' || page_id % 100,
         'content-length=' || CASE WHEN outcome = 'resolved' THEN coalesce(fsize, 0) ELSE 0 END,
         CASE WHEN outcome = 'resolved' THEN 'content-type=text/html' END, 'date=' || ts,
         'etag=' || CASE WHEN outcome = 'resolved' THEN coalesce(etag, fetag) ELSE etag END, 'expires=' || ts + 3600) AS headers,
       CASE WHEN outcome = 'resolved' THEN fdigest END AS payload_digest
FROM m
"""

OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, rid, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
         ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s
  FROM d),
k AS (SELECT *, CASE WHEN len(s) = 0 THEN rid ELSE min(rid) OVER (PARTITION BY s) END AS k FROM s),
x AS (SELECT k, len(s) AS n, unnest(s) AS e FROM k WHERE rid = k),
links AS (
  SELECT a.k AS u, b.k AS v FROM x a JOIN x b ON a.e = b.e AND a.k <> b.k AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(u, v) AS (SELECT u, u FROM links UNION SELECT r.u, links.v FROM r JOIN links ON r.v = links.u),
c AS (SELECT u, min(v) AS c FROM r GROUP BY u),
m AS (SELECT doc_id, rid, len(s) AS n, coalesce(c, k) AS c FROM k LEFT JOIN c ON c.u = k.k),
o AS (SELECT *, min(doc_id) OVER (PARTITION BY c) AS component_id FROM m)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, component_id IS NOT DISTINCT FROM doc_id AS kept FROM o
"""

OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
x AS (SELECT rid, lang, source, unnest(w) AS t FROM d),
kept AS (SELECT lang, t FROM x GROUP BY lang, t HAVING count(DISTINCT rid) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(t) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang),
c AS (SELECT lang, source, t, count(*) AS c FROM x JOIN kept USING (lang, t) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, t, coalesce(c, 0) AS c,
         CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 1)) // (n + v) AS HUGEINT) AS p
  FROM g JOIN kept USING (lang) JOIN n USING (lang, source) JOIN v USING (lang) LEFT JOIN c USING (lang, source, t)),
q AS (
  SELECT lang, t, CAST(1 + (1000000000::HUGEINT * (sum(c) + 1)) // (any_value(all_n) + any_value(v)) AS HUGEINT) AS q
  FROM p JOIN (SELECT lang, sum(n) AS all_n FROM n GROUP BY lang) USING (lang) JOIN v USING (lang) GROUP BY lang, t),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS s
    FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL) s
  ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
term AS (
  SELECT lang, source, t AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q),
both_parts AS (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term', * FROM term),
r AS (SELECT *, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, encode(item)) AS rank FROM both_parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

OP13 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.vec_id, b.rid AS other, a.label = b.label AS same,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.rid <> b.rid),
p AS (
  SELECT rid, anchor_id, vec_id AS positive_id, other, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id ASC NULLS LAST) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INT) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.rid, p.other ORDER BY s.score DESC, s.vec_id ASC NULLS LAST)
QUALIFY row_number() OVER w <= 10
"""

SQL = {"op2_topk": OP2, "op3_mixing": _op3(), "op5_decontamination": OP5, "op6_line_dedup": OP6, "op9_warc": OP9,
       "op11_minhash": OP11, "op12_divergence": OP12, "op13_hardneg": OP13}
