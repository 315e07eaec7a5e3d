"""Fact checking as lookup joins against reference tables.

The reference calls two remote search APIs per distinct entity.  Here the
reference data are tables (``company_kb``, ``wiki_kb``), the search is a
blocked equi-join on normalised keys, and verdicts are aggregates over the
ranked candidates.  Lookups happen once per distinct (name, type) and are
joined back to every mention, which is the table form of the reference memo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.config import CANDIDATE_LIMIT, COMPANY_TYPE, WIKI_TYPES, Config
from newsgraph.functions.maps import merge_maps
from newsgraph.session import cut_lineage
from newsgraph.streaming.state import BucketState

# Verdict confidences and reasons of the reference.
COMPANY_EXACT_CONF = 0.95
COMPANY_PARTIAL_CONF = 0.75
WIKI_EXACT_CONF = 0.92
WIKI_FUZZY_CONF = 0.80
REASON_NO_KEY = "no_api_key"
REASON_NOT_FOUND = "not_found"
REASON_API_ERROR = "api_error"
REASON_UNKNOWN = "unknown"
SCORE_EXACT, SCORE_ALIAS, SCORE_PREFIX = 3, 2, 1

VERDICT_COLS = ["name", "type", "validated", "v_confidence", "v_metadata", "reason"]


def _norm(c: Column) -> Column:
    return F.lower(F.trim(c))


def kb_keys(kb: DataFrame, id_col: str, name_col: str, language: str | None = "en") -> DataFrame:
    """Explode each KB row into its search keys with a score.

    keys: lower(full name) -> 3, lower(alias) -> 2, whitespace-token prefixes -> 1.
    Duplicates within a row are removed in the array (no shuffle).
    """
    if language is not None and "language" in kb.columns:
        kb = kb.filter(F.col("language") == language)
    lname = _norm(F.col(name_col))
    tokens = F.split(lname, r"\s+")
    n = F.size(tokens)
    prefixes = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1),
                                         lambda i: F.array_join(F.slice(tokens, 1, i), " "))) \
                .otherwise(F.array().cast("array<string>"))
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) \
        if "aliases" in kb.columns else F.array().cast("array<string>")
    alias_keys = F.array_distinct(F.filter(F.transform(aliases, _norm), lambda a: a != lname))
    prefix_keys = F.filter(prefixes, lambda p: ~F.array_contains(alias_keys, p))
    keys = F.concat(
        F.array(F.struct(lname.alias("key"), F.lit(SCORE_EXACT).alias("score"))),
        F.transform(alias_keys, lambda a: F.struct(a.alias("key"), F.lit(SCORE_ALIAS).alias("score"))),
        F.transform(prefix_keys, lambda p: F.struct(p.alias("key"), F.lit(SCORE_PREFIX).alias("score"))))
    return kb.withColumn("k", F.explode(keys)).select("*", "k.key", "k.score").drop("k")


def top_keys(kb: DataFrame, id_col: str, name_col: str, limit: int = CANDIDATE_LIMIT,
             language: str | None = "en") -> DataFrame:
    """Best ``limit`` KB rows per key, ranked by (score desc, popularity desc, id).

    Ranking on the KB side before the join bounds the fan-out of a hot key; the
    row_number filter is planned as a WindowGroupLimit, so most rows of a hot
    key are dropped before the shuffle.
    """
    keys = kb_keys(kb, id_col, name_col, language)
    w = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("popularity"), F.asc(id_col))
    return keys.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def search_kb(queries: DataFrame, kb: DataFrame, id_col: str, name_col: str,
              limit: int = CANDIDATE_LIMIT, language: str | None = "en",
              how: str = "inner") -> DataFrame:
    """Candidates for each query name: queries(name, ...) -> + key, rank, KB columns.

    Both sides are hash-partitioned on ``key``; a later group by (key, name)
    reuses that partitioning, so verdicts need no further shuffle.  ``kb`` may
    be the output of ``top_keys``, stored once for many searches.
    """
    q = queries.withColumn("key", _norm(F.col("name")))
    ranked = {"key", "rank"} <= set(kb.columns)
    top = kb.filter(F.col("rank") <= limit) if ranked else top_keys(kb, id_col, name_col, limit, language)
    top = top.withColumnRenamed(name_col, "cand_name") if name_col == "name" else top
    return q.join(top, "key", how)


def company_verdicts(names: DataFrame, kb: DataFrame | None, limit: int = CANDIDATE_LIMIT,
                     language: str | None = "en") -> DataFrame:
    """Per distinct company name: exact (0.95) / partial (0.75) / not_found."""
    names = names.select("name").distinct()
    if kb is None:  # no KB configured: every company fails, as without an API key
        return names.select(
            "name", F.lit(COMPANY_TYPE).alias("type"), F.lit(False).alias("validated"),
            F.lit(None).cast("double").alias("v_confidence"),
            F.create_map().cast("map<string,string>").alias("v_metadata"),
            F.lit(REASON_NO_KEY).alias("reason"))
    return company_verdict(search_kb(names, kb, "kb_id", "name", limit, language, how="left"), limit)


def company_verdict(cands: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Verdict from ranked candidates (key, name, rank, kb_id, cand_name, permalink,
    short_description; NULL candidate columns = no candidate).  An exact name
    wins wherever it ranks among the candidates; any candidate is a partial match."""
    if "key" not in cands.columns:
        cands = cands.withColumn("key", _norm(F.col("name")))
    seen = F.col("kb_id").isNotNull() & (F.col("rank") <= limit)   # the search returns `limit`
    exact = seen & (F.lower(F.col("cand_name")) == F.lower(F.col("name")))
    v = cands.groupBy("key", "name").agg(
        F.min(F.when(exact, F.struct("rank", "kb_id", "permalink", "short_description"))).alias("ex"),
        F.count(F.when(seen, F.col("kb_id"))).alias("n_cand"))
    has_exact, has_any = F.col("ex").isNotNull(), F.coalesce(F.col("n_cand"), F.lit(0)) > 0
    meta = (F.when(has_exact, F.create_map(
                F.lit("crunchbase_uuid"), F.col("ex.kb_id"), F.lit("permalink"), F.col("ex.permalink"),
                F.lit("short_description"), F.coalesce(F.col("ex.short_description"), F.lit(""))))
            .when(has_any, F.create_map(F.lit("partial_match"), F.lit("true")))
            .otherwise(F.create_map().cast("map<string,string>")))
    return v.select(
        "name", F.lit(COMPANY_TYPE).alias("type"), (has_exact | has_any).alias("validated"),
        F.when(has_exact, F.lit(COMPANY_EXACT_CONF)).when(has_any, F.lit(COMPANY_PARTIAL_CONF))
         .cast("double").alias("v_confidence"),
        meta.alias("v_metadata"),
        F.when(has_exact | has_any, F.lit(None).cast("string")).otherwise(F.lit(REASON_NOT_FOUND))
         .alias("reason"))


def wiki_verdicts(keys: DataFrame, kb: DataFrame, limit: int = CANDIDATE_LIMIT,
                  language: str | None = "en") -> DataFrame:
    """Per distinct (name, type): first candidate in rank order that hits.

    exact label -> 0.92 with id/description; type word in description or label
    inside the name -> 0.80 fuzzy; otherwise not_found.
    """
    keys = keys.select("name", "type").distinct()
    return wiki_verdict(search_kb(keys, kb, "wikidata_id", "label", limit, language, how="left"), limit)


def wiki_verdict(cands: DataFrame, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Verdict from ranked candidates (key, name, type, rank, wikidata_id, label,
    description): the first candidate in rank order that hits decides."""
    c = cands if "key" in cands.columns else cands.withColumn("key", _norm(F.col("name")))
    lname, llabel = F.lower(F.col("name")), F.lower(F.coalesce(F.col("label"), F.lit("")))
    desc = F.coalesce(F.col("description"), F.lit(""))
    cand = F.col("wikidata_id").isNotNull() & (F.col("rank") <= limit)
    exact = cand & (llabel == lname)
    fuzzy = cand & (F.contains(F.lower(desc), F.col("type")) | F.contains(lname, llabel))
    first = F.min(F.when(exact | fuzzy, F.struct(
        "rank", (~exact).alias("not_exact"), "wikidata_id", desc.alias("description"))))
    v = c.groupBy("key", "name", "type").agg(first.alias("hit"))
    hit, is_exact = F.col("hit").isNotNull(), ~F.col("hit.not_exact")
    meta = (F.when(hit & is_exact, F.create_map(
                F.lit("wikidata_id"), F.col("hit.wikidata_id"),
                F.lit("description"), F.col("hit.description")))
            .when(hit, F.create_map(F.lit("fuzzy_match"), F.lit("true")))
            .otherwise(F.create_map().cast("map<string,string>")))
    return v.select(
        "name", "type", hit.alias("validated"),
        F.when(hit & is_exact, F.lit(WIKI_EXACT_CONF)).when(hit, F.lit(WIKI_FUZZY_CONF))
         .cast("double").alias("v_confidence"),
        meta.alias("v_metadata"),
        F.when(hit, F.lit(None).cast("string")).otherwise(F.lit(REASON_NOT_FOUND)).alias("reason"))


def _with_errors(keys: DataFrame, errors: DataFrame | None, verdicts: DataFrame,
                 company: bool) -> DataFrame:
    """Source errors override verdicts: company network -> api_error, HTTP -> not_found;
    wiki: both -> api_error."""
    if errors is None:
        return verdicts
    # one kind per key; a network failure outranks an HTTP status (deterministic on retries)
    e = errors.groupBy("name", "type").agg(
        F.max((F.col("kind") == "network").cast("int")).alias("net")).select(
        "name", "type", F.when(F.col("net") == 1, "network").otherwise("http_status").alias("kind"))
    j = verdicts.join(e, ["name", "type"], "left")
    failed = F.col("kind").isNotNull()
    reason = F.when(failed & (F.col("kind") == "network"), F.lit(REASON_API_ERROR)) \
              .when(failed, F.lit(REASON_NOT_FOUND if company else REASON_API_ERROR)) \
              .otherwise(F.col("reason"))
    return j.select(
        "name", "type", (~failed & F.col("validated")).alias("validated"),
        F.when(failed, F.lit(None).cast("double")).otherwise(F.col("v_confidence")).alias("v_confidence"),
        F.when(failed, F.create_map().cast("map<string,string>")).otherwise(F.col("v_metadata"))
         .alias("v_metadata"),
        reason.alias("reason"))


def verdicts(entities: DataFrame, company_kb: DataFrame | None, wiki_kb: DataFrame | None,
             kb_errors: DataFrame | None = None, cfg: Config = Config()) -> DataFrame:
    """One verdict per distinct (name, type), routed by type."""
    other = entities.select("name", "type").distinct().filter(~F.col("type").isin(COMPANY_TYPE, *WIKI_TYPES)).select("name", "type", *_skipped())
    return _searched(entities, company_kb, wiki_kb, kb_errors, cfg).unionByName(other)


def _skipped() -> list[Column]:
    """The verdict of a type that no source is asked about."""
    return [F.lit(True).alias("validated"), F.lit(None).cast("double").alias("v_confidence"),
            F.create_map(F.lit("skipped"), F.lit("true")).alias("v_metadata"), F.lit(None).cast("string").alias("reason")]


def _searched(entities: DataFrame, company_kb: DataFrame | None, wiki_kb: DataFrame | None,
              kb_errors: DataFrame | None, cfg: Config) -> DataFrame:
    """Verdicts of the companies and of the types that the wiki knows."""
    keys = entities.select("name", "type").distinct()
    comp_keys = keys.filter(F.col("type") == COMPANY_TYPE)
    wiki_keys = keys.filter(F.col("type").isin(*WIKI_TYPES))
    cv = company_verdicts(comp_keys, company_kb, cfg.candidate_limit, cfg.kb_language)
    if company_kb is not None:
        cv = _with_errors(comp_keys, kb_errors, cv, company=True)
    if wiki_kb is None:
        wv = wiki_keys.select("name", "type", F.lit(False).alias("validated"),
                              F.lit(None).cast("double").alias("v_confidence"),
                              F.create_map().cast("map<string,string>").alias("v_metadata"),
                              F.lit(REASON_API_ERROR).alias("reason"))
    else:
        wv = _with_errors(wiki_keys, kb_errors,
                          wiki_verdicts(wiki_keys, wiki_kb, cfg.candidate_limit, cfg.kb_language),
                          company=False)
    return cv.select(VERDICT_COLS).unionByName(wv.select(VERDICT_COLS))


VERDICT_STATE = ("name string, type string, kb_version string, validated boolean, v_confidence double, "
                 "v_metadata map<string,string>, reason string")


def verdict_state(spark: SparkSession, path: str, n_buckets: int = 64) -> BucketState:
    return BucketState(spark, path, ["name", "type"], VERDICT_STATE, n_buckets)


def stored_verdicts(state: BucketState, batch_id: int, kb_version: str, entities: DataFrame, company_kb: DataFrame | None,
                    wiki_kb: DataFrame | None, kb_errors: DataFrame | None = None, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Verdicts of a batch's entities and the keys that were looked up for them.

    The memo of the reference, which spans messages, as a table across batches:
    keys that the store has under the same ``kb_version`` keep their verdict
    (errors included), only the others are searched, and their verdicts are
    merged into the buckets that the batch touches.  Verdicts of another KB
    version are dropped from a bucket when it is rewritten.
    """
    keys = cut_lineage(entities.select("name", "type").distinct())
    touched = state.touched(keys)
    held = state.read(batch_id - 1, touched).where(F.col("kb_version") == kb_version)
    new = cut_lineage(keys.join(held.select("name", "type"), ["name", "type"], "left_anti"))
    found = cut_lineage(verdicts(new, company_kb, wiki_kb, kb_errors, cfg).withColumn("kb_version", F.lit(kb_version)))
    state.write(batch_id, held.unionByName(found), touched)
    # the state after the batch is there for two more batches
    return state.read(batch_id, touched).join(keys, ["name", "type"], "left_semi").select(VERDICT_COLS), new


def apply_verdicts(entities: DataFrame, v: DataFrame) -> DataFrame:
    """Join verdicts back to every entity row: clip confidence, merge metadata."""
    return _settle(entities.join(v, ["name", "type"], "left"))


def _settle(j: DataFrame) -> DataFrame:
    conf = F.when(F.col("v_confidence").isNull(), F.col("confidence")) \
            .otherwise(F.least("confidence", "v_confidence"))
    validated = F.coalesce(F.col("validated"), F.lit(False))
    meta = F.when(validated, merge_maps(F.col("metadata"), F.col("v_metadata"))) \
            .otherwise(F.col("metadata"))
    out = j.withColumn("confidence", F.when(validated, conf).otherwise(F.col("confidence"))) \
           .withColumn("metadata", meta).withColumn("validated", validated) \
           .withColumn("reason", F.when(~validated, F.coalesce("reason", F.lit(REASON_UNKNOWN))))
    return out.drop("v_confidence", "v_metadata")


def validate_entities(entities: DataFrame, company_kb: DataFrame | None, wiki_kb: DataFrame | None,
                      kb_errors: DataFrame | None = None, cfg: Config = Config(), store: BucketState | None = None,
                      batch_id: int = 0, kb_version: str = "") -> DataFrame:
    """entities + validated, reason; confidence clipped, metadata merged (J7-J10).

    With ``store``, verdicts of earlier batches are used again (see ``stored_verdicts``).
    Entities of a type that no source is asked about need no key: they are not
    moved to a verdict, since all have the same.
    """
    if store is not None:
        return apply_verdicts(entities, stored_verdicts(store, batch_id, kb_version, entities, company_kb, wiki_kb, kb_errors, cfg)[0])
    # a join finds no verdict for a NULL name
    skipped = F.coalesce(F.col("name").isNotNull() & ~F.col("type").isin(COMPANY_TYPE, *WIKI_TYPES), F.lit(False))
    asked = entities.filter(~skipped)
    checked = apply_verdicts(asked, _searched(asked, company_kb, wiki_kb, kb_errors, cfg))
    return checked.unionByName(_settle(entities.filter(skipped).select("*", *_skipped())))


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, flagged) halves of one verdict table."""
    return checked.filter(F.col("validated")), checked.filter(~F.col("validated"))


def flag_text() -> Column:
    """"{name} ({type}): {reason}" as the reference writes it."""
    return F.concat(F.col("name"), F.lit(" ("), F.col("type"), F.lit("): "), F.col("reason"))


def flags(checked: DataFrame) -> DataFrame:
    """Per article: hallucination_flags in entity order, duplicates kept; passed = no flags.

    One row per article present in ``checked`` (all-valid articles get an empty list).
    """
    flagged = F.when(~F.col("validated"), F.struct("pos", flag_text().alias("flag")))
    f = checked.groupBy("article_id").agg(
        F.transform(F.array_sort(F.collect_list(flagged)), lambda x: x["flag"])
         .alias("hallucination_flags"))
    return f.withColumn("fact_check_passed", F.size("hallucination_flags") == 0)
