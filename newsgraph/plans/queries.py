"""Registered queries: ``(spark, sf_dir) -> DataFrame`` per operator group.

Every query reads the driver tables (or data Spark derives from them by the
FIXTURES.md formulas) and returns flat, typed columns whose names match the
oracle SQL in ``newsgraph.plans.oracle``: integers as BIGINT, doubles rounded to
6 places, lists joined into text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.config import Config
from newsgraph.functions.maps import map_text
from newsgraph.operators import factcheck as fc
from newsgraph.operators import filters, parse
from newsgraph.plans import fixtures as fx
from newsgraph.session import configure, cut_lineage, stored
from newsgraph.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _t(spark: SparkSession, sf_dir: str) -> Tables:
    configure(spark)
    return Tables(spark, sf_dir)


def _r6(c: str):
    return F.round(F.col(c), 6).alias(c)


def _entity_cols(df: DataFrame) -> DataFrame:
    return df.select("article_id", F.col("pos").cast("bigint").alias("pos"), "name", "type",
                     _r6("confidence"), "industry", "role", "country", "severity",
                     F.size("metadata").cast("bigint").alias("n_metadata"))


def parsed_entities(t: Tables) -> DataFrame:
    ents, _ = parse.parse_entities(fx.responses_fixture(t))
    return ents


def kept_entities(t: Tables) -> DataFrame:
    """Candidate entities (2.2) after the confidence gate, in Entity shape."""
    c = fx.cand_entities(t)
    meta = (F.when(F.col("industry").isNotNull(), F.create_map(F.lit("industry"), F.col("industry")))
            .when(F.col("country").isNotNull(), F.create_map(F.lit("country"), F.col("country")))
            .otherwise(F.create_map().cast("map<string,string>")))
    e = c.select("article_id", "pos", "name", "type", "confidence", meta.alias("metadata"),
                 "industry", F.lit(None).cast("string").alias("role"), "country",
                 F.lit(None).cast("string").alias("severity"))
    return filters.by_confidence(e)


# ------------------------------------------------------------------ parsing

@query
def entities_parsed(spark, sf_dir):
    return _entity_cols(parsed_entities(_t(spark, sf_dir)))


@query
def entities_confident(spark, sf_dir):
    return _entity_cols(filters.by_confidence(parsed_entities(_t(spark, sf_dir))))


@query
def entities_rejected(spark, sf_dir):
    _, q = parse.parse_entities(fx.responses_fixture(_t(spark, sf_dir)))
    return q.select("article_id", F.coalesce(F.col("pos"), F.lit(-1)).cast("bigint").alias("pos"),
                    "reason")


@query
def relationships_rejected(spark, sf_dir):
    _, q = parse.parse_relationships(fx.responses_fixture(_t(spark, sf_dir)))
    return q.select("article_id", F.coalesce(F.col("pos"), F.lit(-1)).cast("bigint").alias("pos"), "reason")


# ------------------------------------------------------------------ fact check

@query
def company_verdicts(spark, sf_dir):
    t = _t(spark, sf_dir)
    names = kept_entities(t).filter(F.col("type") == "company")
    v = fc.company_verdicts(names, fx.company_kb(t))
    return v.select("name", "validated", _r6("v_confidence"),
                    map_text(F.col("v_metadata")).alias("metadata"), "reason")


@query
def wiki_verdicts(spark, sf_dir):
    t = _t(spark, sf_dir)
    keys = kept_entities(t).filter(F.col("type").isin("person", "location", "event"))
    v = fc.wiki_verdicts(keys, fx.wiki_kb(t))
    return v.select("name", "type", "validated", _r6("v_confidence"),
                    map_text(F.col("v_metadata")).alias("metadata"), "reason")


@query
def no_key_verdicts(spark, sf_dir):
    t = _t(spark, sf_dir)
    names = kept_entities(t).filter(F.col("type") == "company")
    return fc.company_verdicts(names, None).select("name", "validated", "reason")


def _checked(t: Tables) -> DataFrame:
    return fc.validate_entities(kept_entities(t), fx.company_kb(t), fx.wiki_kb(t))


@query
def entities_validated(spark, sf_dir):
    c = _checked(_t(spark, sf_dir))
    return c.select("article_id", F.col("pos").cast("bigint").alias("pos"), "name", "type",
                    _r6("confidence"), "validated", "reason",
                    map_text(F.col("metadata")).alias("metadata"))


@query
def entities_validated_batches(spark, sf_dir):
    """The fact check in three batches of articles, the last one replayed, with a verdict store between them:
    each batch looks up the keys that no earlier one did."""
    from newsgraph.operators.factcheck import apply_verdicts, stored_verdicts, top_keys, verdict_state
    t = _t(spark, sf_dir)
    kept = stored(kept_entities(t))
    company, wiki = cut_lineage(top_keys(fx.company_kb(t), "kb_id", "name")), cut_lineage(top_keys(fx.wiki_kb(t), "wikidata_id", "label"))
    store, out, looked = verdict_state(spark, _scratch(spark, "verdicts"), 16), [], []
    for n in (0, 1, 2, 2):
        some = kept.where(F.col("article_id").cast("bigint") % 3 == n)
        v, new = stored_verdicts(store, n, "kb-1", some, company, wiki)
        out = [*out[:n], stored(apply_verdicts(some, v))]
        looked = [*looked[:n], new.withColumn("batch", F.lit(n))]
    checked = out[0].unionByName(out[1]).unionByName(out[2])
    first = looked[0].unionByName(looked[1]).unionByName(looked[2])
    return checked.join(first, ["name", "type"]).select(
        "article_id", F.col("pos").cast("bigint").alias("pos"), "name", "type", _r6("confidence"), "validated", "reason",
        map_text(F.col("metadata")).alias("metadata"), F.col("batch").cast("bigint").alias("looked_up_in"))


def flags_table(t: Tables) -> DataFrame:
    f = fc.flags(_checked(t))
    return f.select("article_id",
                    F.array_join("hallucination_flags", " | ").alias("hallucination_flags"),
                    F.size("hallucination_flags").cast("bigint").alias("n_flags"),
                    "fact_check_passed")


@query
def hallucination_flags(spark, sf_dir):
    return flags_table(_t(spark, sf_dir))


# ------------------------------------------------------------------ relationships / impact

def _rel_cols(df: DataFrame) -> DataFrame:
    cols = ["article_id", F.col("pos").cast("bigint").alias("pos")]
    for end in ("subject", "object"):
        cols += [F.col(f"{end}.name").alias(f"{end}_name"), F.col(f"{end}.type").alias(f"{end}_type"),
                 F.round(F.col(f"{end}.confidence"), 6).alias(f"{end}_confidence"),
                 F.col(f"{end}.industry").alias(f"{end}_industry")]
    cols += ["action", _r6("sentiment"), _r6("confidence"), "reasoning"]
    return df.select(*cols)


def parsed_relationships(t: Tables) -> DataFrame:
    rels, _ = parse.parse_relationships(fx.responses_fixture(t))
    return rels


@query
def relationships_parsed(spark, sf_dir):
    return _rel_cols(parsed_relationships(_t(spark, sf_dir)))


@query
def relationships_confident(spark, sf_dir):
    return _rel_cols(filters.by_confidence(parsed_relationships(_t(spark, sf_dir))))


@query
def relationships_gated(spark, sf_dir):
    t = _t(spark, sf_dir)
    rels = filters.by_confidence(parsed_relationships(t))
    kept = filters.by_confidence(parsed_entities(t))
    return _rel_cols(filters.min_entities(rels, kept, 2))


@query
def impacts_parsed(spark, sf_dir):
    t = _t(spark, sf_dir)
    arts = t.orders.select(F.col("o_orderkey").cast("string").alias("article_id"))
    imp = parse.parse_impacts(fx.responses_fixture(t), arts)
    return imp.select("article_id", "summary", F.col("severity").cast("bigint").alias("severity"),
                      F.array_join("affected_sectors", "|").alias("affected_sectors"),
                      F.array_join("key_stakeholders", "|").alias("key_stakeholders"), "status")


# ------------------------------------------------------------------ search / errors

@query
def kb_candidates(spark, sf_dir):
    t = _t(spark, sf_dir)
    ents = kept_entities(t)
    comp = fc.search_kb(ents.filter(F.col("type") == "company").select("name").distinct(),
                        fx.company_kb(t), "kb_id", "name")
    wiki = fc.search_kb(ents.filter(F.col("type").isin("person", "location", "event"))
                        .select("name", "type").distinct(), fx.wiki_kb(t), "wikidata_id", "label")
    return comp.select("name", F.lit("company").alias("type"), F.col("rank").cast("bigint").alias("rank"),
                       F.col("kb_id").alias("cand_id"), F.col("cand_name").alias("cand_label")) \
        .unionByName(wiki.select("name", "type", F.col("rank").cast("bigint").alias("rank"),
                                 F.col("wikidata_id").alias("cand_id"), F.col("label").alias("cand_label")))


@query
def error_verdicts(spark, sf_dir):
    t = _t(spark, sf_dir)
    v = fc.verdicts(kept_entities(t), fx.company_kb(t), fx.wiki_kb(t), fx.kb_errors(t))
    return v.select("name", "type", "validated", "reason")


# ------------------------------------------------------------------ graph events

def order_batch(t: Tables, cfg: Config = Config(), checkpoint: bool = True):
    from newsgraph.plans.process import process_batch
    arts = fx.order_articles(t).drop("file_no")
    return process_batch(arts, fx.responses_fixture(t), fx.company_kb(t), fx.wiki_kb(t),
                         cfg=cfg, as_of=F.lit("2024-06-01 00:00:00").cast("timestamp"),
                         checkpoint=checkpoint)


@query
def graph_events_flat(spark, sf_dir):
    from newsgraph.operators.assemble import flatten_events
    return flatten_events(order_batch(_t(spark, sf_dir)).events)


@query
def minimal_events(spark, sf_dir):
    from newsgraph.operators.assemble import minimal_events as mk
    t = _t(spark, sf_dir)
    arts = fx.order_articles(t)
    ev = mk(arts, filters.by_confidence(parsed_entities(t)))
    return ev.select("article_id", F.col("impact_summary.summary").alias("summary"),
                     F.col("impact_summary.severity").cast("bigint").alias("severity"),
                     "fact_check_passed", "llm_model_used")


# ------------------------------------------------------------------ articles / ingest

AS_OF = "2024-06-01 00:00:00"


def _validated_docs(t: Tables):
    from newsgraph.sources.articles import decode_events, validate_articles
    msgs = fx.doc_article_messages(t)
    return validate_articles(decode_events(msgs), as_of=F.lit(AS_OF).cast("timestamp"),
                             keep=("doc_id",))


@query
def articles_validated(spark, sf_dir):
    from newsgraph.sources.articles import article_preview
    valid, _ = _validated_docs(_t(spark, sf_dir))
    v = article_preview(valid)
    return v.select("doc_id", "article_id", "url", "title_preview", "source",
                    F.unix_seconds("published_date").alias("published_epoch"),
                    F.unix_seconds("fetch_timestamp").alias("fetch_epoch"),
                    F.size("tags").cast("bigint").alias("n_tags"),
                    F.char_length("content").cast("bigint").alias("content_chars"))


@query
def articles_quarantine(spark, sf_dir):
    _, q = _validated_docs(_t(spark, sf_dir))
    return q.select("doc_id", F.coalesce("article_id", F.lit("")).alias("article_id"), "reason")


@query
def page_articles(spark, sf_dir):
    from newsgraph.sources.ingest import pages_to_articles
    a = pages_to_articles(fx.crawled_pages(_t(spark, sf_dir)))
    return a.select("page_id", "article_id", "title", "source",
                    F.char_length("content").cast("bigint").alias("content_chars"),
                    F.md5("content").alias("content_md5"))


@query
def article_ids(spark, sf_dir):
    from newsgraph.sources.ingest import article_id
    from newsgraph.sources.articles import normalize_url
    p = fx.crawled_pages(_t(spark, sf_dir))
    return p.select("page_id", normalize_url(F.col("url")).alias("url"),
                    article_id(F.col("url")).alias("article_id"))


@query
def page_quarantine(spark, sf_dir):
    from newsgraph.sources.ingest import page_quarantine as bad
    return bad(fx.crawled_pages(_t(spark, sf_dir)))


@query
def edge_articles(spark, sf_dir):
    from newsgraph.operators.graph import edge_articles as links
    return links(fixture_relationships(_t(spark, sf_dir)))


@query
def stream_dedup(spark, sf_dir):
    """First copies, copies 20 days on, then late arrivals: a day after, 3 and 10 days before
    a copy that is already published; the last batch is replayed."""
    from newsgraph.config import Config
    from newsgraph.streaming.stream import dedup_against_seen
    t = _t(spark, sf_dir)
    s = fx.dup_stream(t).drop("title", "source")
    first = s.filter("file_no = 1")
    late = [first.filter(f"doc_id % {m} = 0").withColumn("fetch_timestamp", F.expr(f"fetch_timestamp - INTERVAL {d} DAYS"))
                 .withColumn("file_no", F.lit(n)) for n, d, m in ((4, 3, 7), (5, 10, 9))]
    batches = [first, s.filter("file_no = 3"), s.filter("file_no = 2").unionByName(late[0]).unionByName(late[1])]
    seen, out = _scratch(spark, "seen"), []
    for n, batch in [*enumerate(batches), (2, batches[2])]:
        # a later batch may remove the state that this one read
        kept = cut_lineage(dedup_against_seen(spark, batch, seen, n, Config()).select("article_id", "file_no", "fetch_timestamp"))
        out = [*out[:n], kept]
    done = out[0].unionByName(out[1]).unionByName(out[2])
    return done.select("article_id", F.col("file_no").cast("bigint").alias("file_no"),
                       F.unix_seconds("fetch_timestamp").alias("fetch_epoch"))


@query
def dedup_articles(spark, sf_dir):
    from newsgraph.sources.ingest import ttl_keep
    s = fx.dup_stream(_t(spark, sf_dir))
    kept = ttl_keep(s, "article_id", "fetch_timestamp", 7, tie=["file_no"])
    return kept.select("article_id", F.col("file_no").cast("bigint").alias("file_no"),
                       F.unix_seconds("fetch_timestamp").alias("fetch_epoch"))


# ------------------------------------------------------------------ requests / responses

def _req_cols(df: DataFrame) -> DataFrame:
    from newsgraph.operators.prompts import with_messages
    return with_messages(df).select("article_id", "stage", F.size("messages").cast("bigint").alias("n_messages"),
                     F.md5(F.element_at("messages", -1)["content"]).alias("user_md5"),
                     F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws("|", m["role"], m["content"])),
                                        "\n\n")).alias("messages_md5"),
                     "model", _r6("temperature"), "response_format")


def fixture_relationships(t: Tables) -> DataFrame:
    """Edges (2.5) in relationship shape, over the threshold, for articles with 2+ entities."""
    e = fx.edges_fixture(t)
    rel = e.select("article_id", "pos", F.struct(F.col("subject_name").alias("name")).alias("subject"),
                   F.upper("action").alias("action"),
                   F.struct(F.col("object_name").alias("name")).alias("object"), "sentiment",
                   "confidence")
    return filters.min_entities(filters.by_confidence(rel), kept_entities(t), 2)


@query
def entity_requests(spark, sf_dir):
    from newsgraph.operators.prompts import entity_requests as build
    return _req_cols(build(fx.doc_articles(_t(spark, sf_dir))))


@query
def causal_requests(spark, sf_dir):
    from newsgraph.operators.prompts import causal_requests as build
    t = _t(spark, sf_dir)
    return _req_cols(build(fx.order_articles(t), kept_entities(t)))


@query
def impact_requests(spark, sf_dir):
    from newsgraph.operators.prompts import impact_requests as build
    t = _t(spark, sf_dir)
    kept = kept_entities(t)
    arts = fx.order_articles(t).join(kept.select("article_id"), "article_id", "left_semi")
    valid = _checked(t).filter(F.col("validated"))
    return _req_cols(build(arts, valid, fixture_relationships(t)))


@query
def responses_attached(spark, sf_dir):
    a = _attached(_t(spark, sf_dir))
    return a.select("article_id", "stage", "status",
                    F.coalesce("tokens_used", F.lit(0)).cast("bigint").alias("tokens_used"))


def _digest_model(batch):
    """Stand-in model: answers with the digest of the chat that it was given."""
    import hashlib

    import pandas as pd
    chats = ["\n\n".join(f"{m['role']}|{m['content']}" for m in chat) for chat in batch["messages"]]
    return pd.DataFrame({"article_id": batch["article_id"], "stage": batch["stage"],
                         "content": [hashlib.md5(c.encode()).hexdigest() for c in chats],
                         "tokens_used": [len(chat) for chat in batch["messages"]], "error": None})


@query
def responses_generated(spark, sf_dir):
    """Entity and causal requests through the model hook, with a model that returns the digest of its chat."""
    from newsgraph.operators import prompts as pr
    from newsgraph.operators.responses import generate
    t = _t(spark, sf_dir)
    reqs = pr.entity_requests(fx.doc_articles(t)).unionByName(pr.causal_requests(fx.order_articles(t), kept_entities(t)))
    return generate(reqs, _digest_model).select("article_id", "stage", "content", F.col("tokens_used").cast("bigint").alias("tokens_used"))


# ------------------------------------------------------------------ text: mentions

def doc_mentions(t: Tables) -> DataFrame:
    from newsgraph.operators.tagging import tag_mentions
    return tag_mentions(t.documents.select("doc_id", "text"), fx.gazetteer(t), "doc_id", "text", money=True)


@query
def mentions(spark, sf_dir):
    m = doc_mentions(_t(spark, sf_dir))
    return m.select("doc_id", F.col("start").cast("bigint").alias("start"),
                    F.col("end").cast("bigint").alias("end"), "name", "label", "type", _r6("confidence"))


@query
def mention_entities(spark, sf_dir):
    from newsgraph.operators.tagging import mentions_to_entities
    e = mentions_to_entities(doc_mentions(_t(spark, sf_dir)), "doc_id")
    return e.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "name", "phrase", "type",
                    F.col("mentions").cast("bigint").alias("mentions"),
                    F.col("first_start").cast("bigint").alias("first_start"), _r6("confidence"))


@query
def lexicon_relations(spark, sf_dir):
    from newsgraph.operators.relations import lexicon_relations as lex_rel
    t = _t(spark, sf_dir)
    docs = t.documents.select("doc_id", "text")
    return _relation_cols(lex_rel(docs, doc_mentions(t), fx.lexicon(spark), "doc_id", "text"))


def _relation_cols(r: DataFrame) -> DataFrame:
    return r.select("doc_id", F.col("pos").cast("bigint").alias("pos"),
                    F.col("subject.name").alias("subject_name"), "action",
                    F.col("object.name").alias("object_name"), _r6("sentiment"), _r6("confidence"),
                    "reasoning")


def order_mentions_table(t: Tables, texts: DataFrame) -> DataFrame:
    from newsgraph.operators.tagging import tag_mentions
    return tag_mentions(texts, fx.order_gazetteer(t), "doc_id", "text", money=True)


@query
def order_mentions(spark, sf_dir):
    t = _t(spark, sf_dir)
    m = order_mentions_table(t, fx.order_texts(t))
    return m.select("doc_id", F.col("start").cast("bigint").alias("start"),
                    F.col("end").cast("bigint").alias("end"), "name", "label", "type", _r6("confidence"))


@query
def order_relations(spark, sf_dir):
    from newsgraph.operators.relations import lexicon_relations as lex_rel
    t = _t(spark, sf_dir)
    texts = fx.order_texts(t)
    return _relation_cols(lex_rel(texts, order_mentions_table(t, texts), fx.lexicon(spark), "doc_id", "text"))


@query
def impact_rollup(spark, sf_dir):
    from newsgraph.operators.impact import rollup_impact
    t = _t(spark, sf_dir)
    kept = kept_entities(t)
    arts = fx.order_articles(t).join(kept.select("article_id"), "article_id", "left_semi")
    r = rollup_impact(arts, kept, fixture_relationships(t))
    return r.select("article_id", "summary", F.col("severity").cast("bigint").alias("severity"),
                    F.array_join("affected_sectors", "|").alias("affected_sectors"),
                    F.array_join("key_stakeholders", "|").alias("key_stakeholders"),
                    F.col("n_relationships").cast("bigint").alias("n_relationships"))


# ------------------------------------------------------------------ graph

def _entity_ts(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_orderkey").cast("string").alias("article_id"),
                        F.col("o_orderdate").cast("timestamp").alias("ts"))
    return kept_entities(t).join(o, "article_id")


def graph_edges_table(t: Tables) -> DataFrame:
    from newsgraph.operators.graph import upsert_edges
    return upsert_edges(fixture_relationships(t))


@query
def graph_nodes(spark, sf_dir):
    from newsgraph.operators.graph import node_view, upsert_nodes
    return _node_cols(node_view(upsert_nodes(_entity_ts(_t(spark, sf_dir)), ts_col="ts")))


def _node_cols(n: DataFrame) -> DataFrame:
    return n.select("key", "type", "name", _r6("confidence"), F.col("mentions").cast("bigint").alias("mentions"),
                    F.unix_seconds("first_seen").alias("first_seen"),
                    F.unix_seconds("last_seen").alias("last_seen"), "industry", "country")


@query
def graph_edges(spark, sf_dir):
    from newsgraph.operators.graph import edge_view
    return _edge_cols(edge_view(graph_edges_table(_t(spark, sf_dir))))


def _edge_cols(e: DataFrame) -> DataFrame:
    return e.select("src", "action", "dst", F.col("n").cast("bigint").alias("n"), _r6("sentiment_sum"),
                    _r6("sentiment_avg"), _r6("confidence"), "first_article", "last_article")


def _in_batches(rows: DataFrame, state, upsert_one) -> DataFrame:
    """Three batches by article, the last one replayed; the snapshot afterwards."""
    rows = stored(rows)
    for n in (0, 1, 2, 2):
        upsert_one(state, rows.where(F.col("article_id").cast("bigint") % 3 == n), n)
    return state.read(2)


@query
def graph_nodes_incremental(spark, sf_dir):
    """``graph_nodes`` from a stored snapshot that batches of articles are merged into."""
    from newsgraph.operators.graph import node_state, node_view, upsert_nodes_incremental
    state = node_state(spark, _scratch(spark, "nodes"), 16)
    return _node_cols(node_view(_in_batches(_entity_ts(_t(spark, sf_dir)), state, upsert_nodes_incremental)))


@query
def graph_edges_incremental(spark, sf_dir):
    """``graph_edges`` from a stored snapshot that batches of articles are merged into."""
    from newsgraph.operators.graph import edge_state, edge_view, upsert_edges_incremental
    state = edge_state(spark, _scratch(spark, "edges"), 16)
    return _edge_cols(edge_view(_in_batches(fixture_relationships(_t(spark, sf_dir)), state, upsert_edges_incremental)))


@query
def node_stats(spark, sf_dir):
    from newsgraph.operators.graph import node_stats as stats
    s = stats(graph_edges_table(_t(spark, sf_dir)))
    return s.select("key", *[F.col(c).cast("bigint").alias(c) for c in
                             ("out_edges", "in_edges", "out_weight", "in_weight")],
                    _r6("out_sentiment"), _r6("in_sentiment"))


def trace_edges(t: Tables) -> DataFrame:
    """Graph edges plus customer LOCATED_IN nation and nation IN region, as (src, dst)."""
    from newsgraph.operators.graph import node_key
    c = t.customer.select("c_name", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    loc = c.join(n, c.c_nationkey == n.n_nationkey).select(
        node_key(F.col("c_name")).alias("src"), node_key(F.col("n_name")).alias("dst"))
    inr = n.join(r, n.n_regionkey == r.r_regionkey).select(
        node_key(F.col("n_name")).alias("src"), node_key(F.col("r_name")).alias("dst"))
    return graph_edges_table(t).select("src", "dst").unionByName(loc).unionByName(inr)


@query
def impact_trace(spark, sf_dir):
    from newsgraph.operators.graph import impact_trace as trace, node_key
    t = _t(spark, sf_dir)
    seeds = t.supplier.select(node_key(F.col("s_name")).alias("seed"), node_key(F.col("s_name")).alias("node"))
    tr = trace(seeds, trace_edges(t), 3)
    return tr.select("seed", "node", F.col("depth").cast("bigint").alias("depth"))


# ------------------------------------------------------------------ curation

def _vectors(t: Tables):
    """(user vectors, article vectors): embeddings row key % count(embeddings) (2.12)."""
    emb = t.embeddings.select("vec_id", "embedding")
    n = emb.count()  # one number, used as a modulus
    users = t.events.select("user_id").distinct()
    uv = users.join(emb, (users.user_id % n) == emb.vec_id).select("user_id", F.col("embedding").alias("vec"))
    o = t.orders.select("o_orderkey")
    av = o.join(emb, (o.o_orderkey % n) == emb.vec_id).select(
        F.col("o_orderkey").cast("string").alias("article_id"), F.col("embedding").alias("vec"))
    return uv, av


def interests_table(t: Tables) -> DataFrame:
    from newsgraph.operators.curate import interests
    return interests(fx.interactions(t))


@query
def user_interests(spark, sf_dir):
    return interests_table(_t(spark, sf_dir)).select("user_id", "name", _r6("weight"))


@query
def graph_match(spark, sf_dir):
    """Factored matches: the nodes each user reaches, with the number of articles that name them."""
    from newsgraph.operators.curate import matched_nodes
    from newsgraph.operators.graph import node_key
    t = _t(spark, sf_dir)
    n = kept_entities(t).groupBy(node_key(F.col("name")).alias("node")).agg(F.countDistinct("article_id").alias("n_articles"))
    return matched_nodes(interests_table(t), graph_edges_table(t), about=n).select(
        "user_id", "node", F.col("graph_depth").cast("bigint").alias("graph_depth"),
        F.array_join("match_reasons", "|").alias("match_reasons"), F.coalesce("n_articles", F.lit(0)).cast("bigint").alias("n_articles"))


@query
def vector_topk(spark, sf_dir):
    from newsgraph.operators.vectors import vector_topk as topk
    uv, av = _vectors(_t(spark, sf_dir))
    r = topk(uv.withColumnRenamed("user_id", "qid"), av.withColumnRenamed("article_id", "iid"), 10)
    return r.select(F.col("qid").alias("user_id"), F.col("iid").alias("article_id"), _r6("score"),
                    F.col("rank").cast("bigint").alias("rank"))


@query
def vector_topk_lsh(spark, sf_dir):
    from newsgraph.operators.vectors import lsh_topk
    uv, av = _vectors(_t(spark, sf_dir))
    # as many buckets as find every item of the sampled queries: compared with the exact top k
    r = lsh_topk(uv.withColumnRenamed("user_id", "qid"), av.withColumnRenamed("article_id", "iid"), 10, recall=1.0)
    return r.select(F.col("qid").alias("user_id"), F.col("iid").alias("article_id"), _r6("score"),
                    F.col("rank").cast("bigint").alias("rank"))


def _feed_cols(f: DataFrame) -> DataFrame:
    return f.select(F.col("user_id").cast("bigint").alias("user_id"), "article_id", _r6("relevance_score"),
                    F.col("graph_depth").cast("bigint").alias("graph_depth"),
                    F.array_join("match_reasons", "|").alias("match_reasons"),
                    F.col("rank").cast("bigint").alias("rank"))


@query
def user_feed(spark, sf_dir):
    from newsgraph.operators.curate import graph_feed
    t = _t(spark, sf_dir)
    uv, av = _vectors(t)
    return _feed_cols(graph_feed(interests_table(t), kept_entities(t), graph_edges_table(t), uv, av,
                                 as_of=F.lit(AS_OF).cast("timestamp")))


@query
def user_feed_events(spark, sf_dir):
    """The feed written as JSON user-feed events and read back."""
    from newsgraph.operators.curate import graph_feed
    from newsgraph.sources.sinks import write_user_feed
    t = _t(spark, sf_dir)
    uv, av = _vectors(t)
    path = _scratch(spark, "feed")
    write_user_feed(graph_feed(interests_table(t), kept_entities(t), graph_edges_table(t), uv, av,
                               as_of=F.lit(AS_OF).cast("timestamp")), "parquet", path, 0, encoded=True)
    e = F.from_json("value", "user_id string, article_id string, relevance_score double, match_reasons array<string>, "
                             "graph_depth bigint, timestamp timestamp").alias("e")
    back = spark.read.parquet(path).select("key", e)
    return back.select("key", "e.user_id", "e.article_id", F.round("e.relevance_score", 6).alias("relevance_score"),
                       F.array_join("e.match_reasons", "|").alias("match_reasons"), "e.graph_depth",
                       F.unix_seconds("e.timestamp").alias("epoch"))


@query
def fresh_feed(spark, sf_dir):
    from newsgraph.operators.curate import fresh, graph_feed
    t = _t(spark, sf_dir)
    uv, av = _vectors(t)
    ts = t.orders.select(F.col("o_orderkey").cast("string").alias("article_id"),
                         F.col("o_orderdate").cast("timestamp").alias("published"))
    as_of = F.lit(t.orders.agg(F.max(F.col("o_orderdate").cast("timestamp"))).first()[0])
    # articles are filtered first: only fresh ones are matched
    recent = fresh(ts, "published", as_of).select("article_id")
    ents = kept_entities(t).join(recent, "article_id", "left_semi")
    return _feed_cols(graph_feed(interests_table(t), ents, graph_edges_table(t), uv, av, as_of=as_of))


# ------------------------------------------------------------------ metrics

@query
def stage_counts(spark, sf_dir):
    from newsgraph.operators.metrics import stage_counts as counts
    t = _t(spark, sf_dir)
    return counts(parsed_entities(t), parsed_relationships(t), _checked(t))


def _attached(t: Tables) -> DataFrame:
    from newsgraph.operators import prompts as pr
    from newsgraph.operators.responses import attach
    arts = fx.order_articles(t)
    kept = kept_entities(t)
    gated = arts.join(kept.select("article_id"), "article_id", "left_semi")
    reqs = pr.entity_requests(arts).unionByName(pr.causal_requests(arts, kept)) \
        .unionByName(pr.impact_requests(gated, _checked(t).filter(F.col("validated")),
                                        fixture_relationships(t)))
    return attach(reqs, fx.responses_fixture(t))


@query
def token_usage(spark, sf_dir):
    from newsgraph.operators.metrics import token_usage as usage
    u = usage(_attached(_t(spark, sf_dir)))
    return u.select("model", "stage", F.col("tokens").cast("bigint").alias("tokens"),
                    F.col("responses").cast("bigint").alias("responses"))


@query
def article_metrics(spark, sf_dir):
    from newsgraph.operators.metrics import article_metrics as am
    t = _t(spark, sf_dir)
    fetched = fx.order_articles(t).select("article_id", "fetch_timestamp")
    m = am(order_batch(t).events.join(fetched, "article_id"), "fetch_timestamp", "processing_timestamp")
    return m.select("article_id", *[F.col(c).cast("bigint").alias(c) for c in
                                    ("entity_count", "relationship_count", "severity", "n_flags")],
                    "severity_band", "fact_check_passed", _r6("processing_seconds"))


@query
def pipeline_windowed(spark, sf_dir):
    """Articles, flags and mean severity of the graph events per publication interval and source."""
    from newsgraph.operators.metrics import windowed
    t = _t(spark, sf_dir)
    src = fx.order_articles(t).select("article_id", "source", "published_date")
    w = windowed(order_batch(t).events.join(src, "article_id"), "published_date", ["source"], "15 minutes",
                 [F.count("*").alias("articles"), F.sum(F.size("hallucination_flags")).alias("flags"),
                  F.avg("impact_summary.severity").alias("mean_severity")])
    return w.select(F.unix_seconds("window.start").alias("window_start"), "source",
                    F.col("articles").cast("bigint").alias("articles"),
                    F.col("flags").cast("bigint").alias("flags"), _r6("mean_severity"))


@query
def pipeline_windowed_stream(spark, sf_dir):
    """``pipeline_windowed`` from a stream over the written graph events: closed windows in append mode;
    the stream is restarted for a last event a year on, which closes them all."""
    from newsgraph.streaming.stream import run_metrics
    t = _t(spark, sf_dir)
    src = fx.order_articles(t).select("article_id", "source", "published_date")
    events = order_batch(t).events.join(src, "article_id").select("published_date", "source", "hallucination_flags", "impact_summary")
    base = _scratch(spark, "metrics")
    events.write.parquet(f"{base}/events")
    shape = spark.read.parquet(f"{base}/events")
    end = shape.agg((F.max("published_date") + F.expr("INTERVAL 1 YEAR")).alias("published_date")).select(
        "published_date", F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("hallucination_flags"),
        F.lit(None).cast(shape.schema["impact_summary"].dataType).alias("impact_summary"))
    end = cut_lineage(end)
    for last in (False, True):
        if last:
            end.write.mode("append").parquet(f"{base}/events")
        stream = spark.readStream.schema(shape.schema).parquet(f"{base}/events")
        for q in run_metrics(stream, f"{base}/closed", f"{base}/late", f"{base}/checkpoint", "published_date", "15 minutes"):
            q.awaitTermination()
    return spark.read.parquet(f"{base}/closed").select(
        F.unix_seconds("window.start").alias("window_start"), "source", "articles", "flags", _r6("mean_severity"))


@query
def hallucination_rate(spark, sf_dir):
    from newsgraph.operators.metrics import hallucination_rate as rate
    t = _t(spark, sf_dir)
    src = t.orders.select(F.col("o_orderkey").cast("string").alias("article_id"),
                          F.col("o_orderstatus").alias("source"))
    r = rate(_checked(t).join(src, "article_id"))
    return r.select("type", "source", F.col("n").cast("bigint").alias("n"),
                    F.col("flagged").cast("bigint").alias("flagged"), _r6("rate"))


@query
def events_windowed(spark, sf_dir):
    from newsgraph.operators.metrics import windowed
    ev = _t(spark, sf_dir).events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type",
                                         "value", "user_id")
    w = windowed(ev, "ts", ["event_type"], "15 minutes",
                 [F.count("*").alias("n"), F.sum("value").alias("total_value"),
                  F.countDistinct("user_id").alias("users")])
    return w.select(F.unix_seconds("window.start").alias("window_start"), "event_type",
                    F.col("n").cast("bigint").alias("n"), _r6("total_value"),
                    F.col("users").cast("bigint").alias("users"))


# ------------------------------------------------------------------ streaming

def _scratch(spark, name: str) -> str:
    """A fresh folder under the shared checkpoint dir (never a machine-local temp dir)."""
    import uuid
    from newsgraph.session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/newsgraph-{name}-{uuid.uuid4().hex}"


@query
def stream_graph_events(spark, sf_dir):
    """Structured-path articles as JSON-lines files -> landing stream (availableNow, 8 files
    per micro-batch) -> foreachBatch pipeline -> JSON graph events, read back."""
    from newsgraph.operators.assemble import flatten_events
    from newsgraph.operators.responses import ResponseStore
    from newsgraph.sources.ingest import read_landing
    from newsgraph.sources.sinks import GRAPH_EVENT_FIELDS, JSON_OPTS
    from newsgraph.streaming.stream import run_stream
    t = _t(spark, sf_dir)
    base = _scratch(spark, "stream")
    arts = fx.order_articles(t)
    msg = F.to_json(F.struct(
        "article_id", "url", "title", "content", "source",
        F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_date"),
        F.date_format("fetch_timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fetch_timestamp"), "tags"))
    arts.select(msg.alias("value"), "file_no").write.partitionBy("file_no").text(f"{base}/landing")
    stream = read_landing(spark, f"{base}/landing", max_files=8)
    # static inputs of a long-running stream are materialised once, not re-derived per batch; KBs as ranked keys
    store = ResponseStore(spark, f"{base}/responses")
    for stage in fx.STAGES:  # one by one: the shuffles of a stage are dropped before the next
        store.append(fx.responses_fixture(t).where(F.col("stage") == stage))
    q = run_stream(stream, store, cut_lineage(fc.top_keys(fx.company_kb(t), "kb_id", "name")),
                   cut_lineage(fc.top_keys(fx.wiki_kb(t), "wikidata_id", "label")), sink=f"{base}/events", checkpoint=f"{base}/checkpoint",
                   trigger={"availableNow": True}, as_of=F.lit(AS_OF).cast("timestamp"), encoded=True)
    q.awaitTermination()
    shape = order_batch(t, checkpoint=False).events.select(*GRAPH_EVENT_FIELDS).schema
    back = spark.read.parquet(f"{base}/events").select(F.from_json("value", shape, JSON_OPTS).alias("e"))
    return flatten_events(back.select("e.*"))
