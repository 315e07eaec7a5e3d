"""DuckDB oracle SQL for every registered query.

The fixture derivations of FIXTURES.md §2 are written once here as SQL CTEs;
each oracle computes the *expected* output from them directly (it never parses
the JSON the Spark side builds), so a Spark parser bug cannot hide behind the
same bug in the oracle.
"""

from __future__ import annotations

import json

from newsgraph.operators import prompts

CTE: dict[str, str] = {}

CTE["ln"] = """
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
       l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn
FROM lineitem"""

CTE["cand"] = """
SELECT o.o_orderkey AS k, 0 AS pos, c.c_name AS name, 'company' AS type,
       CAST(60 + o.o_custkey % 41 AS DOUBLE) / 100 AS confidence,
       c.c_mktsegment AS industry, CAST(NULL AS VARCHAR) AS country
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
     JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT o.o_orderkey, 1, n.n_name, 'location', CAST(60 + o.o_orderkey % 41 AS DOUBLE) / 100,
       NULL, r.r_name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
     JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
UNION ALL
SELECT l.l_orderkey, 2 * l.rn, s.s_name, 'company',
       CAST(50 + (l.l_orderkey * 7 + l.l_partkey * 13) % 51 AS DOUBLE) / 100, NULL, NULL
FROM ln l JOIN supplier s ON l.l_suppkey = s.s_suppkey
UNION ALL
SELECT l.l_orderkey, 2 * l.rn + 1, p.p_name, 'product',
       CAST(50 + (l.l_partkey * 11 + l.rn * 17) % 51 AS DOUBLE) / 100, NULL, NULL
FROM ln l JOIN part p ON l.l_partkey = p.p_partkey"""

# entity rows as the parser must return them (index rule of FIXTURES.md 2.3)
CTE["parsed_ent"] = """
SELECT CAST(k AS VARCHAR) AS article_id, k, pos, name, type,
       CASE WHEN k % 20 = 15 AND pos = 0 THEN 0.9 ELSE confidence END AS confidence,
       industry, CAST(NULL AS VARCHAR) AS role, country, CAST(NULL AS VARCHAR) AS severity,
       CASE WHEN pos <= 1 THEN 1 ELSE 0 END AS n_metadata
FROM cand
WHERE k % 20 NOT IN (17, 18, 19) AND NOT (pos = 0 AND k % 20 IN (13, 14, 16))"""

CTE["kept_ent"] = "SELECT * FROM parsed_ent WHERE confidence >= 0.7"

# entities entering the fact check: candidate entities (2.2) over the threshold
CTE["fc_ent"] = """
SELECT CAST(k AS VARCHAR) AS article_id, k, pos, name, type, confidence, industry, country
FROM cand WHERE confidence >= 0.7"""

CTE["edges"] = """
SELECT l.l_orderkey AS k, CAST(l.l_orderkey AS VARCHAR) AS article_id, l.rn AS pos,
       s.s_name AS subject_name, c.c_name AS object_name, c.c_mktsegment AS object_industry,
       CASE l.l_returnflag WHEN 'A' THEN 'supplies' WHEN 'N' THEN 'delivers_to'
                           WHEN 'R' THEN 'recalls_from' END AS action,
       round(CASE WHEN l.l_returnflag = 'R' THEN -l.l_discount * 10 ELSE l.l_tax * 10 END, 6) + 0.0 AS sentiment,
       CAST(50 + (l.l_orderkey * 3 + l.l_suppkey * 5) % 51 AS DOUBLE) / 100 AS confidence,
       'Line ' || l.rn || ' of order ' || l.l_orderkey AS reasoning
FROM ln l JOIN orders o ON l.l_orderkey = o.o_orderkey
     JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""

# relationship rows as the parser must return them
CTE["parsed_rel"] = """
SELECT * FROM edges
WHERE (k + 7) % 20 NOT IN (17, 18, 19)
  AND NOT (pos = 1 AND (k + 7) % 20 IN (13, 15, 16))
  AND NOT ((k + 7) % 20 = 14 AND pos <> 1)"""

CTE["company_kb"] = """
SELECT 's' || s_suppkey AS kb_id, s_name AS name, s_suppkey % 97 AS popularity, 'en' AS language
FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL SELECT 'c' || c_custkey, c_name, c_custkey % 97, 'en' FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT 'h' || c_custkey, c_name || ' Holdings', c_custkey % 97, 'en'
FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT 'de3', c_name, 0, 'de' FROM customer WHERE c_custkey = 3"""

CTE["wiki_kb"] = """
SELECT 'Q' || n.n_nationkey AS wikidata_id, n.n_name AS label, CAST([] AS VARCHAR[]) AS aliases,
       'nation in region ' || r.r_name AS description, n.n_nationkey % 97 AS popularity, 'en' AS language
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 4 <> 0
UNION ALL
SELECT 'Q' || n.n_nationkey, 'NATION', [n.n_name], 'nation in region ' || r.r_name,
       n.n_nationkey % 97, 'en'
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey % 8 = 4
UNION ALL
SELECT 'Qde8', n.n_name, CAST([] AS VARCHAR[]), 'nation in region ' || r.r_name, n.n_nationkey % 97, 'de'
FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey = 8"""

# search keys: full name 3, alias 2, whitespace-token prefix 1; top 5 per key
_KEYS = """
SELECT {id} AS cid, lower(trim({name})) AS key, 3 AS score, popularity FROM {kb} WHERE language = 'en'
UNION ALL
SELECT cid, a, 2, popularity FROM (
  SELECT {id} AS cid, lower(trim({name})) AS lname, popularity,
         unnest(list_distinct(list_transform({aliases}, lambda x: lower(trim(x))))) AS a
  FROM {kb} WHERE language = 'en') WHERE a <> lname
UNION ALL
SELECT cid, pfx, 1, popularity FROM (
  SELECT cid, popularity, alias_keys, array_to_string(toks[1:i], ' ') AS pfx FROM (
    SELECT {id} AS cid, popularity, toks,
           list_transform({aliases}, lambda x: lower(trim(x))) AS alias_keys,
           unnest(generate_series(1, len(toks) - 1)) AS i
    FROM (SELECT *, string_split_regex(lower(trim({name})), '\\s+') AS toks FROM {kb}
          WHERE language = 'en') WHERE len(toks) > 1))
WHERE NOT list_contains(alias_keys, pfx)"""

CTE["ckeys"] = _KEYS.format(id="kb_id", name="name", kb="company_kb", aliases="CAST([] AS VARCHAR[])")
CTE["wkeys"] = _KEYS.format(id="wikidata_id", name="label", kb="wiki_kb", aliases="aliases")
CTE["ctop"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, popularity DESC, cid) AS rank
FROM ckeys) WHERE rank <= 5"""
CTE["wtop"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, popularity DESC, cid) AS rank
FROM wkeys) WHERE rank <= 5"""

CTE["ccand"] = """
SELECT q.name, t.rank, kb.kb_id, kb.name AS cand_name,
       'org/' || lower(regexp_replace(kb.name, '[^A-Za-z0-9]+', '-', 'g')) AS permalink,
       'Company record ' || kb.kb_id AS short_description
FROM (SELECT DISTINCT name FROM fc_ent WHERE type = 'company') q
JOIN ctop t ON lower(trim(q.name)) = t.key JOIN company_kb kb ON kb.kb_id = t.cid"""

CTE["cverdict"] = """
SELECT q.name, 'company' AS type,
       e.kb_id IS NOT NULL OR coalesce(n.n, 0) > 0 AS validated,
       CAST(CASE WHEN e.kb_id IS NOT NULL THEN 0.95 WHEN n.n > 0 THEN 0.75 END AS DOUBLE) AS v_confidence,
       CASE WHEN e.kb_id IS NOT NULL THEN 'crunchbase_uuid=' || e.kb_id || ';permalink=' || e.permalink
                 || ';short_description=' || e.short_description
            WHEN n.n > 0 THEN 'partial_match=true' ELSE '' END AS v_meta,
       CASE WHEN e.kb_id IS NULL AND coalesce(n.n, 0) = 0 THEN 'not_found' END AS reason
FROM (SELECT DISTINCT name FROM fc_ent WHERE type = 'company') q
LEFT JOIN (SELECT name, count(*) AS n FROM ccand GROUP BY name) n ON n.name = q.name
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank) AS r1
                          FROM ccand WHERE lower(cand_name) = lower(name)) WHERE r1 = 1) e
       ON e.name = q.name"""

CTE["wcand"] = """
SELECT q.name, q.type, t.rank, kb.wikidata_id, kb.label, coalesce(kb.description, '') AS description,
       lower(kb.label) = lower(q.name) AS is_exact,
       contains(lower(coalesce(kb.description, '')), q.type) OR contains(lower(q.name), lower(kb.label)) AS is_fuzzy
FROM (SELECT DISTINCT name, type FROM fc_ent WHERE type IN ('person', 'location', 'event')) q
JOIN wtop t ON lower(trim(q.name)) = t.key JOIN wiki_kb kb ON kb.wikidata_id = t.cid"""

CTE["wverdict"] = """
SELECT q.name, q.type, h.name IS NOT NULL AS validated,
       CAST(CASE WHEN h.is_exact THEN 0.92 WHEN h.name IS NOT NULL THEN 0.80 END AS DOUBLE) AS v_confidence,
       CASE WHEN h.is_exact THEN 'description=' || h.description || ';wikidata_id=' || h.wikidata_id
            WHEN h.name IS NOT NULL THEN 'fuzzy_match=true' ELSE '' END AS v_meta,
       CASE WHEN h.name IS NULL THEN 'not_found' END AS reason
FROM (SELECT DISTINCT name, type FROM fc_ent WHERE type IN ('person', 'location', 'event')) q
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, type ORDER BY rank) AS r1
                          FROM wcand WHERE is_exact OR is_fuzzy) WHERE r1 = 1) h
       ON h.name = q.name AND h.type = q.type"""

CTE["verdict"] = """
SELECT * FROM cverdict UNION ALL SELECT * FROM wverdict
UNION ALL SELECT DISTINCT name, type, true, NULL, 'skipped=true', NULL FROM fc_ent
WHERE type NOT IN ('company', 'person', 'location', 'event')"""

# entity metadata text merged with the verdict's (sorted k=v;...)
CTE["checked"] = """
SELECT e.article_id, e.k, e.pos, e.name, e.type,
       CASE WHEN v.validated AND v.v_confidence IS NOT NULL THEN least(e.confidence, v.v_confidence)
            ELSE e.confidence END AS confidence,
       v.validated, v.reason,
       CASE WHEN NOT v.validated THEN coalesce(e.mtext, '')
            ELSE array_to_string(list_sort(list_filter(
                   string_split(coalesce(e.mtext, '') || ';' || v.v_meta, ';'), lambda x: x <> '')), ';')
       END AS metadata
FROM (SELECT *, CASE WHEN industry IS NOT NULL THEN 'industry=' || industry
                     WHEN country IS NOT NULL THEN 'country=' || country ELSE '' END AS mtext
      FROM fc_ent) e
JOIN verdict v ON v.name = e.name AND v.type = e.type"""

CTE["flags"] = """
SELECT article_id, k,
       coalesce(string_agg(CASE WHEN NOT validated THEN name || ' (' || type || '): ' || reason END,
                           ' | ' ORDER BY pos), '') AS hallucination_flags,
       count(*) FILTER (WHERE NOT validated) AS n_flags,
       count(*) FILTER (WHERE validated) AS n_valid
FROM checked GROUP BY article_id, k"""

_ORDER = ["ln", "cand", "parsed_ent", "kept_ent", "fc_ent", "edges", "parsed_rel", "company_kb", "wiki_kb",
          "ckeys", "wkeys", "ctop", "wtop", "ccand", "cverdict", "wcand", "wverdict", "verdict",
          "checked", "flags"]


def with_ctes(body: str, *names: str, **override: str) -> str:
    """Prefix ``body`` with the named CTEs (in dependency order); ``override`` swaps a body."""
    wanted = set(names)
    cte = {**CTE, **override}
    parts = [f"{n} AS ({cte[n]}\n)" for n in _ORDER if n in wanted]
    parts += [f"{n} AS ({cte[n]}\n)" for n in names if n not in _ORDER]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


_ENT = ("ln", "cand", "parsed_ent")
_KB = ("company_kb", "wiki_kb", "ckeys", "wkeys", "ctop", "wtop", "ccand", "cverdict", "wcand",
       "wverdict", "verdict")

SQL: dict[str, str] = {}

SQL["entities_parsed"] = with_ctes("""
SELECT article_id, CAST(pos AS BIGINT) AS pos, name, type, round(confidence, 6) AS confidence,
       industry, role, country, severity, CAST(n_metadata AS BIGINT) AS n_metadata
FROM parsed_ent""", *_ENT)

SQL["entities_confident"] = with_ctes("""
SELECT article_id, CAST(pos AS BIGINT) AS pos, name, type, round(confidence, 6) AS confidence,
       industry, role, country, severity, CAST(n_metadata AS BIGINT) AS n_metadata
FROM kept_ent""", *_ENT, "kept_ent")

SQL["entities_rejected"] = with_ctes("""
SELECT CAST(o_orderkey AS VARCHAR) AS article_id, CAST(-1 AS BIGINT) AS pos,
       CASE o_orderkey % 20 WHEN 17 THEN 'bad_json' WHEN 18 THEN 'no_entities_key' END AS reason
FROM orders WHERE o_orderkey % 20 IN (17, 18)
UNION ALL
SELECT article_id, CAST(pos AS BIGINT), CASE k % 20 WHEN 13 THEN 'confidence' WHEN 14 THEN 'name'
                                                      WHEN 16 THEN 'metadata' END
FROM (SELECT CAST(k AS VARCHAR) AS article_id, k, pos FROM cand) WHERE pos = 0 AND k % 20 IN (13, 14, 16)""",
                                   "ln", "cand")

SQL["company_verdicts"] = with_ctes("""
SELECT name, validated, round(v_confidence, 6) AS v_confidence, v_meta AS metadata, reason
FROM cverdict""", "ln", "cand", "fc_ent", *_KB)

SQL["wiki_verdicts"] = with_ctes("""
SELECT name, type, validated, round(v_confidence, 6) AS v_confidence, v_meta AS metadata, reason
FROM wverdict""", "ln", "cand", "fc_ent", *_KB)

SQL["no_key_verdicts"] = with_ctes("""
SELECT name, false AS validated, 'no_api_key' AS reason
FROM (SELECT DISTINCT name FROM fc_ent WHERE type = 'company')""", "ln", "cand", "fc_ent")

SQL["entities_validated"] = with_ctes("""
SELECT article_id, CAST(pos AS BIGINT) AS pos, name, type, round(confidence, 6) AS confidence,
       validated, reason, metadata
FROM checked""", "ln", "cand", "fc_ent", *_KB, "checked")

SQL["hallucination_flags"] = with_ctes("""
SELECT article_id, hallucination_flags, CAST(n_flags AS BIGINT) AS n_flags,
       n_flags = 0 AS fact_check_passed
FROM flags""", "ln", "cand", "fc_ent", *_KB, "checked", "flags")

CTE["imp"] = """
SELECT CAST(k AS VARCHAR) AS article_id, k, status,
       CASE WHEN status = 'ok' THEN 'Order ' || k || ' changed hands. Its customer is affected.'
            WHEN status = 'bad_json' THEN 'Unable to generate impact summary due to processing error.'
            ELSE 'Processing error occurred.' END AS summary,
       CASE WHEN status <> 'ok' THEN 1 WHEN idx = 15 THEN 7 ELSE 1 + k % 10 END AS severity,
       CASE WHEN status = 'ok' THEN c_mktsegment ELSE 'Unknown' END AS affected_sectors,
       CASE WHEN status = 'ok' AND k % 2 = 1 THEN c_name ELSE '' END AS key_stakeholders
FROM (SELECT o.o_orderkey AS k, (o.o_orderkey + 13) % 20 AS idx, c.c_name, c.c_mktsegment,
             CASE (o.o_orderkey + 13) % 20 WHEN 13 THEN 'severity_range' WHEN 14 THEN 'severity'
                  WHEN 16 THEN 'summary_length' WHEN 17 THEN 'bad_json' WHEN 18 THEN 'affected_sectors'
                  WHEN 19 THEN 'missing' ELSE 'ok' END AS status
      FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"""

CTE["kb_errors"] = """
SELECT s_name AS name, 'company' AS type, 'network' AS kind FROM supplier WHERE s_suppkey % 11 = 0
UNION ALL SELECT s_name, 'company', 'http_status' FROM supplier WHERE s_suppkey % 13 = 0 AND s_suppkey % 11 <> 0
UNION ALL SELECT n_name, 'location', 'http_status' FROM nation WHERE n_nationkey % 5 = 1"""

CTE["ent_agg"] = """
SELECT article_id, count(*) AS n_kept, count(*) FILTER (WHERE validated) AS n_valid,
       coalesce(string_agg(CASE WHEN validated THEN name END, '|' ORDER BY pos), '') AS entity_names,
       coalesce(string_agg(CASE WHEN NOT validated THEN name || ' (' || type || '): ' || reason END,
                           ' | ' ORDER BY pos), '') AS flags,
       count(*) FILTER (WHERE NOT validated) AS n_flags
FROM checked GROUP BY article_id"""

CTE["rel_final"] = """
SELECT * FROM parsed_rel WHERE confidence >= 0.7
  AND article_id IN (SELECT article_id FROM kept_ent GROUP BY article_id HAVING count(*) >= 2)"""

CTE["rel_agg"] = """
SELECT article_id, count(*) AS n_rel,
       string_agg(subject_name || '>' || upper(action) || '>' || object_name, '|' ORDER BY pos) AS rel_text
FROM rel_final GROUP BY article_id"""

CTE["events_flat"] = """
SELECT CAST(o.o_orderkey AS VARCHAR) AS article_id,
       CAST(coalesce(e.n_valid, 0) AS BIGINT) AS n_entities,
       coalesce(e.entity_names, '') AS entity_names,
       CAST(CASE WHEN e.article_id IS NULL THEN 0 ELSE coalesce(r.n_rel, 0) END AS BIGINT) AS n_relationships,
       CASE WHEN e.article_id IS NULL THEN '' ELSE coalesce(r.rel_text, '') END AS relationship_text,
       CASE WHEN e.article_id IS NULL THEN 'No significant entities or impact detected.' ELSE i.summary END AS summary,
       CAST(CASE WHEN e.article_id IS NULL THEN 1 ELSE i.severity END AS BIGINT) AS severity,
       CASE WHEN e.article_id IS NULL THEN '' ELSE i.affected_sectors END AS affected_sectors,
       CASE WHEN e.article_id IS NULL THEN '' ELSE i.key_stakeholders END AS key_stakeholders,
       coalesce(e.n_flags, 0) = 0 AS fact_check_passed,
       coalesce(e.flags, '') AS hallucination_flags,
       'gpt-4-turbo-preview' AS llm_model_used
FROM orders o LEFT JOIN ent_agg e ON e.article_id = CAST(o.o_orderkey AS VARCHAR)
     LEFT JOIN rel_agg r ON r.article_id = e.article_id
     LEFT JOIN imp i ON i.article_id = e.article_id"""

_ORDER += ["imp", "kb_errors", "ent_agg", "rel_final", "rel_agg", "events_flat"]

_REL_SELECT = """
SELECT article_id, CAST(pos - 1 AS BIGINT) AS pos,
       subject_name, 'company' AS subject_type, CAST(0.9 AS DOUBLE) AS subject_confidence,
       CAST(NULL AS VARCHAR) AS subject_industry,
       object_name, 'company' AS object_type, CAST(0.9 AS DOUBLE) AS object_confidence, object_industry AS object_industry,
       upper(action) AS action, round(sentiment, 6) AS sentiment, round(confidence, 6) AS confidence,
       reasoning
FROM {src}"""

SQL["relationships_parsed"] = with_ctes(_REL_SELECT.format(src="parsed_rel"), "ln", "edges", "parsed_rel")
SQL["relationships_confident"] = with_ctes(
    _REL_SELECT.format(src="parsed_rel WHERE confidence >= 0.7"), "ln", "edges", "parsed_rel")
SQL["relationships_gated"] = with_ctes(_REL_SELECT.format(src="rel_final"),
                                       *_ENT, "kept_ent", "edges", "parsed_rel", "rel_final")

SQL["relationships_rejected"] = with_ctes("""
SELECT CAST(o_orderkey AS VARCHAR) AS article_id, CAST(-1 AS BIGINT) AS pos,
       CASE (o_orderkey + 7) % 20 WHEN 17 THEN 'bad_json' WHEN 18 THEN 'relationships_not_list' END AS reason
FROM orders WHERE (o_orderkey + 7) % 20 IN (17, 18)
UNION ALL
SELECT article_id, CAST(0 AS BIGINT), CASE (k + 7) % 20 WHEN 13 THEN 'sentiment' WHEN 15 THEN 'subject.confidence'
                                                      WHEN 16 THEN 'action' END
FROM edges WHERE pos = 1 AND (k + 7) % 20 IN (13, 15, 16)""", "ln", "edges")

SQL["impacts_parsed"] = with_ctes("""
SELECT article_id, summary, CAST(severity AS BIGINT) AS severity, affected_sectors, key_stakeholders, status
FROM imp""", "imp")

SQL["kb_candidates"] = with_ctes("""
SELECT name, 'company' AS type, CAST(rank AS BIGINT) AS rank, kb_id AS cand_id, cand_name AS cand_label
FROM ccand
UNION ALL
SELECT name, type, CAST(rank AS BIGINT), wikidata_id, label FROM wcand""", "ln", "cand", "fc_ent", *_KB)

SQL["error_verdicts"] = with_ctes("""
SELECT v.name, v.type, CASE WHEN e.kind IS NOT NULL THEN false ELSE v.validated END AS validated,
       CASE WHEN e.kind = 'network' THEN 'api_error'
            WHEN e.kind IS NOT NULL AND v.type = 'company' THEN 'not_found'
            WHEN e.kind IS NOT NULL THEN 'api_error' ELSE v.reason END AS reason
FROM verdict v LEFT JOIN kb_errors e ON e.name = v.name AND e.type = v.type""",
                                  "ln", "cand", "fc_ent", *_KB, "kb_errors")

_EVENT_CTES = (*_ENT, "kept_ent", "fc_ent", "edges", "parsed_rel", *_KB, "checked", "imp", "ent_agg",
               "rel_final", "rel_agg", "events_flat")
_FC_FROM_PARSED = "SELECT article_id, k, pos, name, type, confidence, industry, country FROM kept_ent"

SQL["graph_events_flat"] = with_ctes("SELECT * FROM events_flat", *_EVENT_CTES, fc_ent=_FC_FROM_PARSED)

SQL["minimal_events"] = with_ctes("""
SELECT CAST(o_orderkey AS VARCHAR) AS article_id, 'No significant entities or impact detected.' AS summary,
       CAST(1 AS BIGINT) AS severity, true AS fact_check_passed, 'gpt-4-turbo-preview' AS llm_model_used
FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT article_id FROM kept_ent)""",
                                  *_ENT, "kept_ent")

# ---------------------------------------------------------------- articles / ingest

CTE["doc_art"] = """
SELECT doc_id, sha256(url) AS article_id, url,
       split_part(text, '.', 1) AS title, text AS content, source,
       TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS published_date
FROM (SELECT *, 'https://' || source || '.example.org/d/' || doc_id AS url FROM documents)"""

SQL["articles_validated"] = with_ctes("""
SELECT doc_id, article_id, url, substring(title, 1, 100) AS title_preview, source,
       CAST(epoch(published_date) AS BIGINT) AS published_epoch,
       CAST(CASE WHEN doc_id % 10 = 7 THEN epoch(TIMESTAMP '2024-06-01 00:00:00')
                 ELSE epoch(published_date) + doc_id % 600 END AS BIGINT) AS fetch_epoch,
       CAST(1 AS BIGINT) AS n_tags, CAST(length(content) AS BIGINT) AS content_chars
FROM doc_art WHERE doc_id % 10 IN (0, 1, 6, 7)""", "doc_art")

SQL["articles_quarantine"] = with_ctes("""
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN '' ELSE article_id END AS article_id,
       CASE doc_id % 10 WHEN 2 THEN 'title' WHEN 3 THEN 'url' WHEN 4 THEN 'published_date'
            WHEN 5 THEN 'tags' WHEN 8 THEN 'author' WHEN 9 THEN 'bad_json' END AS reason
FROM doc_art WHERE doc_id % 10 IN (2, 3, 4, 5, 8, 9)""", "doc_art")

_URL_RE = r"^(?i)(https?)://([^\s/?#@]+@)?([^\s/?#:@]+)(:[0-9]{1,5})?([/?#]\S*)?$"
_NORM_URL = (f"CASE WHEN regexp_matches(url, '{_URL_RE}') THEN lower(regexp_extract(url, '{_URL_RE}', 1)) || '://' || regexp_extract(url, '{_URL_RE}', 2)"
             f" || lower(regexp_extract(url, '{_URL_RE}', 3)) || CASE lower(regexp_extract(url, '{_URL_RE}', 1)) || regexp_extract(url, '{_URL_RE}', 4)"
             f" WHEN 'http:80' THEN '' WHEN 'https:443' THEN '' ELSE regexp_extract(url, '{_URL_RE}', 4) END"
             f" || CASE WHEN regexp_extract(url, '{_URL_RE}', 5) = '' THEN '/'"
             f" WHEN starts_with(regexp_extract(url, '{_URL_RE}', 5), '/') THEN regexp_extract(url, '{_URL_RE}', 5)"
             f" ELSE '/' || regexp_extract(url, '{_URL_RE}', 5) END END")


def _unescape(x: str) -> str:
    for ent, ch in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "),
                    ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]:
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


_TEXT = "html"
for _pat in [r"(?is)<head[^>]*>.*?</head>", r"(?is)<script[^>]*>.*?</script>",
             r"(?is)<style[^>]*>.*?</style>", r"(?is)<nav[^>]*>.*?</nav>", r"(?s)<!--.*?-->"]:
    _TEXT = f"regexp_replace({_TEXT}, '{_pat}', ' ', 'g')"
_TEXT = _collapse(_unescape(f"regexp_replace({_TEXT}, '<[^>]*>', ' ', 'g')"))
_TITLE = _collapse(_unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))

CTE["crawled"] = """
SELECT page_id, html, CASE page_id % 23 WHEN 3 THEN NULL WHEN 7 THEN 'ftp://files.example.org/' || page_id
         WHEN 11 THEN 'no address' WHEN 13 THEN 'https:///nohost' ELSE url END AS url
FROM pages"""
_ORDER += ["crawled", "page_art"]

CTE["page_art"] = f"""
SELECT page_id, url_norm, sha256(url_norm) AS article_id, {_TITLE} AS title,
       {_TEXT} AS content, regexp_extract(url_norm, '^https?://([^/:?#]+)', 1) AS source
FROM (SELECT *, {_NORM_URL} AS url_norm FROM crawled)"""

SQL["page_articles"] = with_ctes("""
SELECT page_id, article_id, title, source, CAST(length(content) AS BIGINT) AS content_chars,
       md5(content) AS content_md5
FROM page_art WHERE url_norm IS NOT NULL""", "crawled", "page_art")

SQL["article_ids"] = with_ctes("SELECT page_id, url_norm AS url, article_id FROM page_art", "crawled", "page_art")

SQL["page_quarantine"] = with_ctes("""
SELECT p.page_id, p.url, 'url' AS reason FROM crawled p JOIN page_art a ON a.page_id = p.page_id WHERE a.url_norm IS NULL""", "crawled", "page_art")

# batch order: file 1, file 3, then files 2, 4 and 5; a copy within 7 days of a published one goes
SQL["stream_dedup"] = """
WITH doc AS (SELECT doc_id, sha256('https://' || source || '.example.org/d/' || doc_id) AS article_id,
                    TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id % 600 AS BIGINT)) AS base FROM documents)
SELECT article_id, CAST(file_no AS BIGINT) AS file_no, CAST(epoch(ts) AS BIGINT) AS fetch_epoch FROM (
  SELECT article_id, 1 AS file_no, base AS ts FROM doc
  UNION ALL SELECT article_id, 3, base + INTERVAL 20 DAY FROM doc WHERE doc_id % 50 = 0
  UNION ALL SELECT article_id, 5, base - INTERVAL 10 DAY FROM doc WHERE doc_id % 9 = 0)"""

SQL["dedup_articles"] = "WITH RECURSIVE " + """
doc AS (SELECT doc_id, sha256('https://' || source || '.example.org/d/' || doc_id) AS article_id,
               TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id % 600 AS BIGINT)) AS base
        FROM documents),
s AS (SELECT article_id, base AS ts, 1 AS file_no FROM doc
      UNION ALL SELECT article_id, base + INTERVAL 1 DAY, 2 FROM doc WHERE doc_id % 10 = 0
      UNION ALL SELECT article_id, base + INTERVAL 20 DAY, 3 FROM doc WHERE doc_id % 50 = 0),
kept(article_id, ts) AS (
  SELECT article_id, min(ts) FROM s GROUP BY article_id
  UNION ALL
  SELECT s.article_id, min(s.ts) FROM kept k JOIN s ON s.article_id = k.article_id
         AND s.ts > k.ts + INTERVAL 7 DAY GROUP BY s.article_id)
SELECT s.article_id, CAST(min(s.file_no) AS BIGINT) AS file_no, CAST(epoch(s.ts) AS BIGINT) AS fetch_epoch
FROM s JOIN kept k ON k.article_id = s.article_id AND k.ts = s.ts
GROUP BY s.article_id, s.ts"""

# ---------------------------------------------------------------- requests / responses

_NL2 = "chr(10) || chr(10)"


def _shots(system: str, examples: list, key: str) -> str:
    """SQL literal of the fixed messages before the last one."""
    turns = ["system|" + system]
    for ex in examples:
        turns += ["user|Article: " + ex["article"], "assistant|" + json.dumps(ex[key], ensure_ascii=False)]
    return "'" + "\n\n".join([*turns, "user|"]).replace("'", "''") + "'"


_ENTITY_SHOTS = _shots(prompts.ENTITY_SYSTEM_PROMPT, prompts.ENTITY_EXAMPLES, "entities")
_CAUSAL_SHOTS = _shots(prompts.CAUSAL_SYSTEM_PROMPT, prompts.CAUSAL_EXAMPLES, "relationships")
_IMPACT_SHOTS = _shots(prompts.IMPACT_SYSTEM_PROMPT, prompts.IMPACT_EXAMPLES, "impact_summary")

CTE["ent_ctx"] = """
SELECT article_id, count(*) AS n,
       '[' || string_agg('{"name":"' || name || '","type":"' || type || '"}', ',' ORDER BY pos) || ']' AS ctx
FROM fc_ent GROUP BY article_id"""

CTE["val_ctx"] = """
SELECT article_id,
       '[' || string_agg('{"name":"' || name || '","type":"' || type || '","industry":'
                         || coalesce('"' || industry || '"', 'null') || '}', ',' ORDER BY pos) || ']' AS ctx
FROM checked_ind WHERE validated GROUP BY article_id"""

CTE["checked_ind"] = """
SELECT c.*, f.industry FROM checked c JOIN fc_ent f ON f.article_id = c.article_id AND f.pos = c.pos"""

CTE["fx_rel"] = """
SELECT * FROM edges WHERE confidence >= 0.7
  AND article_id IN (SELECT article_id FROM fc_ent GROUP BY article_id HAVING count(*) >= 2)"""

CTE["rel_ctx"] = """
SELECT article_id,
       '[' || string_agg('{"subject":"' || subject_name || '","action":"' || upper(action) || '","object":"'
                         || object_name || '","sentiment":' || CAST(sentiment AS VARCHAR) || '}',
                         ',' ORDER BY pos) || ']' AS ctx
FROM fx_rel GROUP BY article_id"""

_ORDER += ["checked_ind", "ent_ctx", "val_ctx", "fx_rel", "rel_ctx"]

SQL["entity_requests"] = with_ctes(f"""
SELECT article_id, 'entity' AS stage, CAST(4 AS BIGINT) AS n_messages, md5(u) AS user_md5, md5({_ENTITY_SHOTS} || u) AS messages_md5,
       'gpt-4-turbo-preview' AS model, CAST(0.1 AS DOUBLE) AS temperature, 'json_object' AS response_format
FROM (SELECT *, 'Article: ' || content || {_NL2} || 'Extract all entities as JSON array:' AS u FROM doc_art)""", "doc_art")

SQL["causal_requests"] = with_ctes(f"""
SELECT article_id, 'mapping' AS stage, CAST(6 AS BIGINT) AS n_messages, md5(u) AS user_md5, md5({_CAUSAL_SHOTS} || u) AS messages_md5,
       'gpt-4-turbo-preview' AS model, CAST(0.2 AS DOUBLE) AS temperature, 'json_object' AS response_format
FROM (SELECT *, 'Article: Order ' || article_id || {_NL2} || 'Known Entities: ' || ctx || {_NL2}
                || 'Extract causal relationships between these entities as JSON array:' AS u FROM ent_ctx) WHERE n >= 2""", "ln", "cand", "fc_ent", "ent_ctx")

_IMPACT_REQ = f"""
SELECT article_id, 'impact' AS stage, CAST(6 AS BIGINT) AS n_messages, md5(u) AS user_md5, md5({_IMPACT_SHOTS} || u) AS messages_md5,
       'gpt-4-turbo-preview' AS model, CAST(0.3 AS DOUBLE) AS temperature, 'json_object' AS response_format
FROM (SELECT e.article_id, 'Article: Order ' || e.article_id || {_NL2} || 'Entities: ' || coalesce(v.ctx, '[]')
             || chr(10) || 'Relationships: ' || coalesce(r.ctx, '[]') || {_NL2} || 'Generate impact summary as JSON:' AS u
      FROM (SELECT DISTINCT article_id FROM fc_ent) e
      LEFT JOIN val_ctx v ON v.article_id = e.article_id LEFT JOIN rel_ctx r ON r.article_id = e.article_id)"""

_REQ_CTES = ("ln", "cand", "fc_ent", "edges", *_KB, "checked", "checked_ind", "ent_ctx", "val_ctx",
             "fx_rel", "rel_ctx")

SQL["impact_requests"] = with_ctes(_IMPACT_REQ, *_REQ_CTES)

SQL["responses_attached"] = with_ctes("""
SELECT CAST(k AS VARCHAR) AS article_id, stage,
       CASE WHEN idx = 19 THEN 'missing' ELSE 'ok' END AS status,
       CAST(CASE WHEN idx = 19 THEN 0 ELSE tok END AS BIGINT) AS tokens_used
FROM (
  SELECT o_orderkey AS k, 'entity' AS stage, o_orderkey % 20 AS idx, 200 + o_orderkey % 97 AS tok FROM orders
  UNION ALL
  SELECT o_orderkey, 'mapping', (o_orderkey + 7) % 20, 300 + o_orderkey % 89 FROM orders
  WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT article_id FROM fc_ent GROUP BY article_id HAVING count(*) >= 2)
  UNION ALL
  SELECT o_orderkey, 'impact', (o_orderkey + 13) % 20, 150 + o_orderkey % 83 FROM orders
  WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT article_id FROM fc_ent))""", "ln", "cand", "fc_ent")

# ---------------------------------------------------------------- text: mentions

_LABELS = "['ORG', 'PERSON', 'GPE', 'LOC', 'EVENT', 'MONEY', 'PRODUCT']"
_MONEY_RE = r"[$€£][0-9][0-9,]*(\.[0-9]+)?( ?(billion|million|thousand|bn|mn|m|k))?"

CTE["gaz"] = f"""
SELECT phrase, {_LABELS}[length(phrase) % 7 + 1] AS label
FROM (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\\p{{L}}]+')) AS phrase FROM benchmark)
WHERE length(phrase) >= 6
UNION ALL SELECT 'apache license', 'PRODUCT' UNION ALL SELECT 'general public license', 'PRODUCT'
UNION ALL SELECT 'the&&&', 'ORG' UNION ALL SELECT 'mail2.example.com', 'ORG' UNION ALL SELECT 'unmapped phrase', 'NORP'"""

CTE["labelmap"] = """
SELECT * FROM (VALUES ('ORG', 'company'), ('PERSON', 'person'), ('GPE', 'location'), ('LOC', 'location'),
                      ('EVENT', 'event'), ('MONEY', 'financial_instrument'), ('PRODUCT', 'product')) t(label, type)"""

_SPANS = """
SELECT doc_id, i, m AS tok, pre, post,
       sum(length(pre) + length(m)) OVER (PARTITION BY doc_id ORDER BY i
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS end_
FROM (SELECT doc_id, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS pre, unnest(ps[2:len(ms) + 1]) AS post,
             unnest(generate_series(0, len(ms) - 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(text, '{re}') AS ms, string_split_regex(text, '{re}') AS ps
            FROM documents))"""

CTE["tok"] = _SPANS.format(re=r"[\p{L}\p{N}\p{M}]+")
CTE["money_tok"] = _SPANS.format(re=_MONEY_RE)

# each phrase is searched in each text that holds it, blanks and tabs in any number
CTE["hit"] = r"""
SELECT *, sum(length(pre) + length(m)) OVER (PARTITION BY doc_id, phrase ORDER BY i) AS end_
FROM (SELECT doc_id, text, phrase, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS pre, unnest(generate_series(0, len(ms) - 1)) AS i
      FROM (SELECT doc_id, text, phrase, regexp_extract_all(text, re) AS ms, string_split_regex(text, re) AS ps
            FROM (SELECT doc_id, text, phrase, '(?i)' || replace(regexp_escape(phrase), '\ ', '[ \t]+') AS re
                  FROM (SELECT *, regexp_replace(lower(text), '[ \t]+', ' ', 'g') AS low FROM documents)
                       JOIN (SELECT DISTINCT lower(phrase) AS phrase FROM gaz) ON contains(low, phrase))))"""

_WORD = r"regexp_full_match({x}, '[\p{{L}}\p{{N}}\p{{M}}]')"
CTE["mcand"] = rf"""
SELECT doc_id, end_ - length(m) AS start, end_, m AS name, hit.phrase, g.label, lm.type
FROM hit JOIN gaz g ON lower(g.phrase) = hit.phrase JOIN labelmap lm ON lm.label = g.label
WHERE NOT ({_WORD.format(x="substr(hit.phrase, 1, 1)")} AND end_ > length(m) AND {_WORD.format(x="substr(text, CAST(end_ - length(m) AS INT), 1)")})
  AND NOT ({_WORD.format(x="right(hit.phrase, 1)")} AND {_WORD.format(x="substr(text, CAST(end_ + 1 AS INT), 1)")})"""

CTE["mall"] = """
SELECT doc_id, start, end_ AS "end", name, phrase, label, type, CAST(0.75 AS DOUBLE) AS confidence FROM mcand
UNION ALL
SELECT doc_id, end_ - length(tok), end_, tok, lower(tok), 'MONEY', 'financial_instrument', 0.75 FROM money_tok"""

# spans of a text from the longest on, each added unless one taken before overlaps it
CTE["mkept"] = """
SELECT doc_id, unnest(list_reduce(spans, lambda a, b: CASE
         WHEN len(list_filter(a, lambda y: y.s < b[1].e AND y.e > b[1].s)) > 0 THEN a ELSE list_concat(a, b) END)) AS k
FROM (SELECT doc_id, list([{'s': start, 'e': "end"}] ORDER BY start - "end", start) AS spans
      FROM (SELECT DISTINCT doc_id, start, "end" FROM mall) GROUP BY doc_id)"""

CTE["mentions"] = """
SELECT m.* FROM mall m JOIN mkept ON mkept.doc_id = m.doc_id AND mkept.k.s = m.start AND mkept.k.e = m."end\""""

_ORDER += ["gaz", "labelmap", "tok", "money_tok", "hit", "mcand", "mall", "mkept", "mentions"]
_MENTION_CTES = ("gaz", "labelmap", "money_tok", "hit", "mcand", "mall", "mkept", "mentions")

_BODY = {}
_BODY["mentions"] = """
SELECT doc_id, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", name, label, type,
       round(confidence, 6) AS confidence
FROM mentions"""
SQL["mentions"] = with_ctes(_BODY["mentions"], *_MENTION_CTES)

SQL["mention_entities"] = with_ctes("""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_start, phrase, type) - 1 AS BIGINT) AS pos,
       name, phrase, type, CAST(mentions AS BIGINT) AS mentions, CAST(first_start AS BIGINT) AS first_start,
       round(confidence, 6) AS confidence
FROM (SELECT doc_id, phrase, type, arg_min(name, start) AS name, count(*) AS mentions,
             min(start) AS first_start, max(confidence) AS confidence
      FROM mentions GROUP BY doc_id, phrase, type)""", *_MENTION_CTES)

# marks with the 40 characters before and the text after them; sentences lie between those that end one
CTE["mark"] = _SPANS.format(re="[.!?]+")
CTE["stop"] = r"""
SELECT x.doc_id, x.end_
FROM (SELECT m.doc_id, m.tok, m.end_, any_value(text) AS text, bool_or(k.s <= m.end_ - length(m.tok) AND m.end_ < k.e) AS inside,
             coalesce(bool_or(k.s <= m.end_ - length(m.tok) AND m.end_ = k.e), false) AS at_end,
             right(left(any_value(text), CAST(m.end_ - length(m.tok) AS INT)), 40) AS before, substr(any_value(text), CAST(m.end_ + 1 AS INT)) AS after
      FROM mark m JOIN documents d ON d.doc_id = m.doc_id LEFT JOIN mkept ON mkept.doc_id = m.doc_id GROUP BY m.doc_id, m.i, m.tok, m.end_) x
WHERE NOT coalesce(inside, false) AND CASE
  WHEN at_end THEN regexp_matches(after, '^\s*(\p{Lu}|$)')
  WHEN tok <> '.' OR after = '' THEN true
  WHEN regexp_matches(before, '[\p{L}\p{N}]$') AND regexp_matches(after, '^[\p{L}\p{N}]') THEN false
  WHEN regexp_matches(before, '(?i)(^|[^\p{L}\p{N}.])(mr|mrs|ms|dr|prof|st|gen|sen|rep|gov|vs|e\.g|i\.e)$') THEN false
  WHEN regexp_matches(before, '(^|[^\p{L}\p{N}.])\p{Lu}$') THEN false
  WHEN regexp_matches(before, '(?i)(^|[^\p{L}\p{N}.])(inc|corp|co|ltd|llc|plc|bros|cie|jr|sr|u\.s|u\.k|approx|etc)$') THEN regexp_matches(after, '^\s*(\p{Lu}|$)')
  ELSE true END"""
CTE["sent"] = """
SELECT doc_id, start, end_, trim(substr(text, CAST(start + 1 AS INT), CAST(end_ - start AS INT))) AS tok
FROM (SELECT doc_id, coalesce(lag(end_) OVER (PARTITION BY doc_id ORDER BY end_), 0) AS start, end_
      FROM (SELECT doc_id, end_ FROM stop UNION SELECT doc_id, length(text) FROM documents WHERE length(text) > 0)) JOIN documents USING (doc_id)"""
CTE["verbs"] = """
SELECT doc_id, end_ - length(tok) AS at_, action, sentiment
FROM tok JOIN (VALUES ('is', 'IS', 0.0), ('was', 'WAS', 0.0), ('are', 'ARE', 0.0), ('from', 'COMES_FROM', 0.1),
                      ('with', 'WORKS_WITH', 0.3), ('by', 'AFFECTED_BY', -0.2)) x(verb, action, sentiment) ON lower(tok) = verb"""
_ORDER += ["mark", "stop", "sent", "verbs"]

_BODY["lexicon_relations"] = """
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1 AS BIGINT) AS pos, subject_name, action,
       object_name, CAST(sentiment AS DOUBLE) AS sentiment, CAST(0.75 AS DOUBLE) AS confidence, reasoning
FROM (SELECT v.*, s.name AS subject_name, s.start AS s_start, o.name AS object_name, o.start AS o_start,
             n.start AS n_start, n.end_ AS n_end, n.tok AS reasoning
      FROM verbs v ASOF JOIN mentions s ON s.doc_id = v.doc_id AND v.at_ >= s."end"
           ASOF JOIN mentions o ON o.doc_id = v.doc_id AND v.at_ < o.start
           ASOF JOIN sent n ON n.doc_id = v.doc_id AND v.at_ >= n.start)
WHERE s_start >= n_start AND o_start < n_end"""
SQL["lexicon_relations"] = with_ctes(_BODY["lexicon_relations"], *_MENTION_CTES, "tok", "mark", "stop", "sent", "verbs")

# the same over texts made of orders, with their own gazetteer
_ORDER_TEXTS = {"documents": """
SELECT o_orderkey AS doc_id, CASE o_orderkey % 6
         WHEN 0 THEN 'Apache License Terms Office Trade Relations was paid $' || p || ' million by ' || c_mktsegment
                     || ' buyers. An Unmapped Phrase is from General Public License holders!'
         WHEN 1 THEN 'Apache License Terms Office deals with profit from General Public License, worth €' || p || ' million pounds sterling.'
         WHEN 2 THEN c_mktsegment || ' demand is with profit. £' || p || ',000 was from Apache' || chr(9)
                     || 'License? Yes, by Trade Relations with profit'
         WHEN 3 THEN 'Acme Inc. acquired AT&T from 3M Corp. with $4.2 billion in Beta. S&P 500 was by Coca-Cola Co. '
                     || c_mktsegment || ' is from Beta'
         WHEN 4 THEN 'Dr. Smith is with J. Doe from U.S. Steel. ACME  Inc. was by 3Mx and AT&Tx or ' || c_mktsegment
                     || ' and 3m? Yahoo! is with AT&T. Beta Inc. Acme inc was with (3M)'
         ELSE 'Unmapped phrase was nothing.' END AS text
FROM (SELECT *, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS p FROM orders) JOIN customer ON c_custkey = o_custkey""",
                "gaz": """
SELECT DISTINCT lower(c_mktsegment) AS phrase, 'ORG' AS label FROM customer
UNION ALL SELECT * FROM (VALUES ('apache license', 'PRODUCT'), ('license terms office', 'ORG'), ('office trade relations', 'ORG'),
  ('trade relations', 'EVENT'), ('general public license', 'PRODUCT'), ('with profit', 'EVENT'),
  ('million pounds sterling', 'GPE'), ('unmapped phrase', 'NORP'), ('acme inc', 'PRODUCT'), ('acme inc.', 'ORG'), ('at&t', 'ORG'),
  ('3m corp', 'ORG'), ('3m', 'ORG'), ('coca-cola co.', 'ORG'), ('s&p 500', 'PRODUCT'), ('beta', 'GPE'), ('yahoo!', 'ORG'),
  ('smith', 'PERSON'), ('j. doe', 'PERSON'), ('u.s. steel', 'ORG'))"""}
_ORDER.insert(0, "documents")
for _name, _of, _more in (("order_mentions", "mentions", ()), ("order_relations", "lexicon_relations", ("tok", "mark", "stop", "sent", "verbs"))):
    SQL[_name] = with_ctes(_BODY[_of], "documents", *_MENTION_CTES, *_more, **_ORDER_TEXTS)

SQL["impact_rollup"] = with_ctes("""
SELECT e.article_id,
       CAST(coalesce(r.n_rel, 0) AS VARCHAR) || ' causal links connect ' || e.n_ent || ' entities.'
         || CASE WHEN coalesce(r.n_rel, 0) > 0
                 THEN ' Most exposed: ' || array_to_string(r.objs[1:greatest(r.k, 1)], ', ')
                      || CASE WHEN len(r.objs) > greatest(r.k, 1) THEN ' and ' || (len(r.objs) - greatest(r.k, 1)) || ' more' ELSE '' END || '.'
                 ELSE ' No party is exposed.' END AS summary,
       CAST(CASE WHEN coalesce(r.n_rel, 0) = 0 THEN 1
                 ELSE least(10, greatest(1, 1 + floor(5 * r.mx) + least(4, len(r.objs)))) END AS BIGINT) AS severity,
       coalesce(array_to_string(e.sectors, '|'), '') AS affected_sectors,
       coalesce(array_to_string(r.objs, '|'), '') AS key_stakeholders,
       CAST(coalesce(r.n_rel, 0) AS BIGINT) AS n_relationships
FROM (SELECT article_id, count(*) AS n_ent,
             list_sort(list_distinct(list(industry) FILTER (WHERE industry IS NOT NULL))) AS sectors
      FROM fc_ent GROUP BY article_id) e
LEFT JOIN (SELECT article_id, sum(n) AS n_rel, max(mx) AS mx, count(*) FILTER (upto <= 400) AS k,
                  list(object_name ORDER BY mx DESC, n DESC, object_name) AS objs
           FROM (SELECT *, sum(length(object_name) + 2) OVER (PARTITION BY article_id ORDER BY mx DESC, n DESC, object_name) AS upto
                 FROM (SELECT article_id, object_name, count(*) AS n, max(abs(sentiment)) AS mx FROM fx_rel GROUP BY 1, 2))
           GROUP BY article_id) r ON r.article_id = e.article_id""",
                                 "ln", "cand", "fc_ent", "edges", "fx_rel")

# ---------------------------------------------------------------- graph

CTE["ent_ts"] = """
SELECT f.*, o.o_orderdate AS ts FROM fc_ent f JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = f.article_id"""

CTE["gedges"] = """
SELECT lower(trim(subject_name)) AS src, upper(action) AS action, lower(trim(object_name)) AS dst,
       count(*) AS n, sum(sentiment) AS sentiment_sum, max(confidence) AS confidence,
       min(article_id) AS first_article, max(article_id) AS last_article
FROM fx_rel GROUP BY 1, 2, 3"""

_ORDER += ["ent_ts", "gedges"]
_G = ("ln", "cand", "fc_ent", "edges", "fx_rel", "gedges")

SQL["graph_nodes"] = with_ctes("""
SELECT lower(trim(name)) AS key, type, min(name) AS name, round(max(confidence), 6) AS confidence,
       CAST(count(*) AS BIGINT) AS mentions, CAST(epoch(min(ts)) AS BIGINT) AS first_seen,
       CAST(epoch(max(ts)) AS BIGINT) AS last_seen,
       max(CASE WHEN industry IS NOT NULL THEN {'ts': ts, 'v': industry} END).v AS industry,
       max(CASE WHEN country IS NOT NULL THEN {'ts': ts, 'v': country} END).v AS country
FROM ent_ts GROUP BY 1, 2""", "ln", "cand", "fc_ent", "ent_ts")

SQL["graph_edges"] = with_ctes("""
SELECT src, action, dst, CAST(n AS BIGINT) AS n, round(sentiment_sum, 6) AS sentiment_sum,
       round(sentiment_sum / n, 6) AS sentiment_avg, round(confidence, 6) AS confidence,
       first_article, last_article
FROM gedges""", *_G)

SQL["edge_articles"] = with_ctes("""
SELECT DISTINCT lower(trim(subject_name)) AS src, upper(action) AS action, lower(trim(object_name)) AS dst, article_id
FROM fx_rel""", "ln", "cand", "fc_ent", "edges", "fx_rel")

SQL["node_stats"] = with_ctes("""
SELECT coalesce(o.key, i.key) AS key, CAST(coalesce(o.out_edges, 0) AS BIGINT) AS out_edges,
       CAST(coalesce(i.in_edges, 0) AS BIGINT) AS in_edges, CAST(coalesce(o.out_weight, 0) AS BIGINT) AS out_weight,
       CAST(coalesce(i.in_weight, 0) AS BIGINT) AS in_weight, round(coalesce(o.out_sentiment, 0.0), 6) AS out_sentiment,
       round(coalesce(i.in_sentiment, 0.0), 6) AS in_sentiment
FROM (SELECT src AS key, count(*) AS out_edges, sum(n) AS out_weight, sum(sentiment_sum) AS out_sentiment
      FROM gedges GROUP BY src) o
FULL JOIN (SELECT dst AS key, count(*) AS in_edges, sum(n) AS in_weight, sum(sentiment_sum) AS in_sentiment
           FROM gedges GROUP BY dst) i ON o.key = i.key""", *_G)

_TRACE_EDGES = """
SELECT DISTINCT src, dst FROM (
  SELECT src, dst FROM gedges
  UNION ALL SELECT lower(trim(c.c_name)), lower(trim(n.n_name)) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL SELECT lower(trim(n.n_name)), lower(trim(r.r_name)) FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

SQL["impact_trace"] = "WITH RECURSIVE " + ",\n".join(
    f"{n} AS ({CTE[n]}\n)" for n in _G) + f""",
te AS ({_TRACE_EDGES}),
tr(seed, node, depth) AS (
  SELECT lower(trim(s_name)), lower(trim(s_name)), 0 FROM supplier
  UNION
  SELECT tr.seed, te.dst, tr.depth + 1 FROM tr JOIN te ON te.src = tr.node WHERE tr.depth < 3)
SELECT seed, node, CAST(min(depth) AS BIGINT) AS depth FROM tr GROUP BY seed, node"""

# ---------------------------------------------------------------- curation

CTE["ui"] = """
SELECT e.user_id, s.s_name AS name,
       sum(e.value * CASE e.event_type WHEN 'purchase' THEN 3.0 WHEN 'signup' THEN 2.0 WHEN 'error' THEN 0.5 ELSE 1.0 END) AS weight
FROM events e JOIN supplier s
  ON s.s_suppkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT) % (SELECT count(*) FROM supplier)
GROUP BY 1, 2"""

CTE["vecs_u"] = """
SELECT u.user_id, CAST(e.embedding AS DOUBLE[]) AS v
FROM (SELECT DISTINCT user_id FROM events) u
JOIN embeddings e ON e.vec_id = u.user_id % (SELECT count(*) FROM embeddings)"""

CTE["vecs_a"] = """
SELECT CAST(o.o_orderkey AS VARCHAR) AS article_id, o.o_orderdate AS published, CAST(e.embedding AS DOUBLE[]) AS v
FROM orders o JOIN embeddings e ON e.vec_id = o.o_orderkey % (SELECT count(*) FROM embeddings)"""

CTE["ge"] = "SELECT DISTINCT src, dst FROM gedges"

CTE["reach"] = """
SELECT lower(trim(name)) AS seed, lower(trim(name)) AS node, 0 AS depth FROM (SELECT DISTINCT name FROM ui)
UNION
SELECT r.seed, ge.dst, r.depth + 1 FROM reach r JOIN ge ON ge.src = r.node WHERE r.depth < 3"""

CTE["gm"] = """
SELECT ui.user_id, ps.article_id, min(ps.depth) AS graph_depth,
       array_to_string(list_sort(list_distinct(list('Follows ' || ui.name))), '|') AS match_reasons
FROM ui JOIN (SELECT r.seed, ae.article_id, min(r.depth) AS depth
              FROM reach r JOIN (SELECT DISTINCT article_id, lower(trim(name)) AS node FROM fc_ent) ae
                ON ae.node = r.node GROUP BY 1, 2) ps ON ps.seed = lower(trim(ui.name))
GROUP BY 1, 2"""

_CUR = ("ln", "cand", "fc_ent", "edges", "fx_rel", "gedges", "ui", "vecs_u", "vecs_a", "ge")


def _recursive(body: str, names: tuple, rec: str = "reach(seed, node, depth)", after: tuple = ("gm",)) -> str:
    parts = [f"{n} AS ({CTE[n]}\n)" for n in names]
    parts.append(f"{rec} AS ({CTE['reach']}\n)")
    parts += [f"{n} AS ({CTE[n]}\n)" for n in after]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


SQL["user_interests"] = with_ctes("SELECT user_id, name, round(weight, 6) AS weight FROM ui", "ui")

SQL["graph_match"] = _recursive("""
SELECT ui.user_id, r.node, CAST(min(r.depth) AS BIGINT) AS graph_depth,
       array_to_string(list_sort(list_distinct(list('Follows ' || ui.name))), '|') AS match_reasons,
       CAST(coalesce(max(a.n), 0) AS BIGINT) AS n_articles
FROM ui JOIN reach r ON r.seed = lower(trim(ui.name))
LEFT JOIN (SELECT lower(trim(name)) AS node, count(DISTINCT article_id) AS n FROM fc_ent GROUP BY 1) a ON a.node = r.node
GROUP BY 1, 2""", _CUR, after=())

SQL["vector_topk"] = with_ctes("""
SELECT user_id, article_id, score, CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, article_id) AS rank
  FROM (SELECT u.user_id, a.article_id, round(list_cosine_similarity(u.v, a.v), 6) AS score
        FROM vecs_u u, vecs_a a)) WHERE rank <= 10""", "vecs_u", "vecs_a")

# the query asks for buckets that find every item of the queries it samples: the exact top k
SQL["vector_topk_lsh"] = SQL["vector_topk"]

_FEED = """
SELECT user_id, article_id, relevance_score, CAST(graph_depth AS BIGINT) AS graph_depth, match_reasons,
       CAST(rank AS BIGINT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY relevance_score DESC, article_id) AS rank
  FROM (SELECT gm.*, round(0.7 / (1 + gm.graph_depth)
                           + 0.3 * greatest(0.0, coalesce(list_cosine_similarity(u.v, a.v), 0.0)), 6) AS relevance_score
        FROM gm LEFT JOIN vecs_u u ON u.user_id = gm.user_id LEFT JOIN vecs_a a ON a.article_id = gm.article_id
        {where})) WHERE rank <= 20"""

SQL["user_feed"] = _recursive(_FEED.format(where=""), _CUR)
SQL["user_feed_events"] = _recursive("SELECT CAST(user_id AS VARCHAR) AS key, CAST(user_id AS VARCHAR) AS user_id, article_id, "
    "relevance_score, match_reasons, graph_depth, CAST(epoch(TIMESTAMP '2024-06-01 00:00:00') AS BIGINT) AS epoch FROM ("
    + _FEED.format(where="") + ")", _CUR)
SQL["fresh_feed"] = _recursive(_FEED.format(
    where="WHERE a.published > (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOURS"), _CUR)

# ---------------------------------------------------------------- metrics

SQL["stage_counts"] = with_ctes("""
SELECT 'entities_total' AS metric, CAST(count(*) AS BIGINT) AS value FROM parsed_ent
UNION ALL SELECT 'entities_high_confidence', count(*) FILTER (WHERE confidence >= 0.7) FROM parsed_ent
UNION ALL SELECT 'relationships_total', count(*) FROM parsed_rel
UNION ALL SELECT 'relationships_high_confidence', count(*) FILTER (WHERE confidence >= 0.7) FROM parsed_rel
UNION ALL SELECT 'factcheck_total', count(*) FROM checked
UNION ALL SELECT 'factcheck_validated', count(*) FILTER (WHERE validated) FROM checked
UNION ALL SELECT 'factcheck_hallucinations', count(*) FILTER (WHERE NOT validated) FROM checked""",
                                 "ln", "cand", "parsed_ent", "fc_ent", "edges", "parsed_rel", *_KB, "checked")

SQL["token_usage"] = with_ctes("""
SELECT model, stage, CAST(sum(tok) AS BIGINT) AS tokens, CAST(count(*) FILTER (WHERE idx <> 19) AS BIGINT) AS responses
FROM (SELECT 'gpt-4-turbo-preview' AS model, stage, idx, CASE WHEN idx = 19 THEN 0 ELSE tok END AS tok FROM (
  SELECT 'entity' AS stage, o_orderkey % 20 AS idx, 200 + o_orderkey % 97 AS tok FROM orders
  UNION ALL
  SELECT 'mapping', (o_orderkey + 7) % 20, 300 + o_orderkey % 89 FROM orders
  WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT article_id FROM fc_ent GROUP BY article_id HAVING count(*) >= 2)
  UNION ALL
  SELECT 'impact', (o_orderkey + 13) % 20, 150 + o_orderkey % 83 FROM orders
  WHERE CAST(o_orderkey AS VARCHAR) IN (SELECT article_id FROM fc_ent)))
GROUP BY ROLLUP (model, stage)""", "ln", "cand", "fc_ent")

SQL["article_metrics"] = with_ctes("""
SELECT article_id, n_entities AS entity_count, n_relationships AS relationship_count, severity,
       CAST(CASE WHEN hallucination_flags = '' THEN 0
                 ELSE len(string_split(hallucination_flags, ' | ')) END AS BIGINT) AS n_flags,
       CASE WHEN severity BETWEEN 1 AND 3 THEN 'minor' WHEN severity BETWEEN 4 AND 6 THEN 'significant'
            WHEN severity BETWEEN 7 AND 8 THEN 'major' WHEN severity BETWEEN 9 AND 10 THEN 'crisis' END AS severity_band,
       fact_check_passed, CAST(epoch(TIMESTAMP '2024-06-01 00:00:00') - epoch(o.o_orderdate) AS DOUBLE) AS processing_seconds
FROM events_flat e JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = e.article_id""", *_EVENT_CTES, fc_ent=_FC_FROM_PARSED)

SQL["pipeline_windowed"] = with_ctes("""
SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, CAST(o.o_orderdate AS TIMESTAMP))) AS BIGINT) AS window_start,
       o.o_orderstatus AS source, CAST(count(*) AS BIGINT) AS articles,
       CAST(sum(CASE WHEN hallucination_flags = '' THEN 0 ELSE len(string_split(hallucination_flags, ' | ')) END) AS BIGINT) AS flags,
       round(avg(severity), 6) AS mean_severity
FROM events_flat e JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = e.article_id GROUP BY 1, 2""",
                                     *_EVENT_CTES, fc_ent=_FC_FROM_PARSED)

SQL["hallucination_rate"] = with_ctes("""
SELECT c.type, o.o_orderstatus AS source, CAST(count(*) AS BIGINT) AS n,
       CAST(count(*) FILTER (WHERE NOT c.validated) AS BIGINT) AS flagged,
       round(avg(CASE WHEN c.validated THEN 0.0 ELSE 1.0 END), 6) AS rate
FROM checked c JOIN orders o ON CAST(o.o_orderkey AS VARCHAR) = c.article_id
GROUP BY CUBE (c.type, o.o_orderstatus)""", "ln", "cand", "fc_ent", *_KB, "checked")

SQL["events_windowed"] = """
SELECT CAST(epoch(time_bucket(INTERVAL 15 MINUTE, ts)) AS BIGINT) AS window_start, event_type,
       CAST(count(*) AS BIGINT) AS n, round(sum(value), 6) AS total_value,
       CAST(count(DISTINCT user_id) AS BIGINT) AS users
FROM events GROUP BY 1, 2"""

SQL["stream_graph_events"] = SQL["graph_events_flat"]

# the same tables, built batch by batch
for _name in ("graph_nodes", "graph_edges"):
    SQL[f"{_name}_incremental"] = SQL[_name]
SQL["pipeline_windowed_stream"] = SQL["pipeline_windowed"]
SQL["entities_validated_batches"] = f"""
SELECT *, CAST(min(CAST(article_id AS BIGINT) % 3) OVER (PARTITION BY name, type) AS BIGINT) AS looked_up_in
FROM ({SQL["entities_validated"]})"""
SQL["responses_generated"] = f"""
SELECT article_id, stage, messages_md5 AS content, n_messages AS tokens_used FROM ({SQL["entity_requests"]})
UNION ALL SELECT article_id, stage, messages_md5, n_messages FROM ({SQL["causal_requests"]})"""
