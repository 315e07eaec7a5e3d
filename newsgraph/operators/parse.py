"""Model responses -> typed tables (entities, relationships, impact summaries).

Each response is parsed once into a VARIANT; every field is then read in one
projection.  Rows that fail validation are not lost: they come back with a
``reason`` so callers can route them to a quarantine table.

Validation follows the reference's pydantic models in lax mode:
strings must be JSON strings, floats accept numbers / booleans / numeric
strings, ints must be integral, ranges are closed, unknown keys are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgraph.config import SEVERITY_LEVELS
from newsgraph.functions import variant as V

# Fallback impact summaries of the reference.
FALLBACK_BAD_JSON = "Unable to generate impact summary due to processing error."
FALLBACK_ERROR = "Processing error occurred."
FALLBACK_SECTORS = ["Unknown"]

HOISTED = ("industry", "role", "country", "severity")
ENTITY_FIELDS = ["name", "type", "confidence", "metadata", *HOISTED]

ENTITY_TYPE = (
    "struct<name:string,type:string,confidence:double,metadata:map<string,string>,"
    "industry:string,role:string,country:string,severity:string>"
)



def _first_failure(checks: list[tuple[str, Column]]) -> Column:
    """Name of the first failing check, NULL when all pass."""
    out = F.lit(None).cast("string")
    for name, ok in reversed(checks):
        out = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(out)
    return out


# An object's fields are read with the list that holds it: one cast gives an array of
# structs of VARIANTs, and no element is rebuilt as a VARIANT of its own.  Kinds and
# typed values, and checks with the typed struct, are two projections more, so no read
# sits inside a conditional branch and nothing is evaluated twice.

ENTITY_KEYS = ("name", "type", "confidence", "metadata")


def _variants(*names: str) -> str:
    return ",".join(f"{n}:variant" for n in names)


ENTITY_READ = f"struct<{_variants(*ENTITY_KEYS)}>"
END_READ = f"struct<{_variants(*ENTITY_KEYS, *HOISTED)}>"
RELATIONSHIP_READ = (f"struct<subject:{END_READ},object:{END_READ},action:variant,sentiment:double,confidence:double,"
                     "reasoning:variant>")


def _entity_raw(struct_col: str, p: str, hoist_from_metadata: bool) -> list[Column]:
    """Sub-values of an Entity from its field struct (NULL: no object)."""
    s = F.col(struct_col)
    out = [s.isNotNull().alias(f"{p}is_obj"), s["name"].alias(f"{p}name_v"),
           s["type"].alias(f"{p}type_v"), s["confidence"].alias(f"{p}conf_v"),
           s["metadata"].alias(f"{p}meta_v")]
    if hoist_from_metadata:   # industry/role/country/severity come from metadata only
        m = V.fields(s["metadata"], HOISTED)
        return out + [m[k].alias(f"{p}{k}_v") for k in HOISTED]
    return out + [s[k].alias(f"{p}{k}_v") for k in HOISTED]


def _entity_typed(p: str) -> list[Column]:
    c = lambda n: F.col(f"{p}{n}")
    out = [c("is_obj"),
           V.kind(c("name_v")).alias(f"{p}name_k"), F.try_variant_get(c("name_v"), "$", "string").alias(f"{p}name"),
           V.kind(c("type_v")).alias(f"{p}type_k"), F.try_variant_get(c("type_v"), "$", "string").alias(f"{p}type"),
           V.lax_double(c("conf_v")).alias(f"{p}conf"),
           c("meta_v").isNull().alias(f"{p}meta_absent"), V.is_object(c("meta_v")).alias(f"{p}meta_obj"),
           V.string_map(c("meta_v")).alias(f"{p}meta")]
    for k in HOISTED:
        out += [c(f"{k}_v").isNull().alias(f"{p}{k}_absent"), V.kind(c(f"{k}_v")).alias(f"{p}{k}_k"),
                F.try_variant_get(c(f"{k}_v"), "$", "string").alias(f"{p}{k}")]
    return out


def _entity_checks(p: str) -> tuple[list[tuple[str, Column]], Column]:
    c = lambda n: F.col(f"{p}{n}")
    checks = [("not_object", c("is_obj")), ("name", c("name_k") == "STRING"),
              ("type", c("type_k") == "STRING"), ("confidence", V.in_range(c("conf"), 0.0, 1.0)),
              ("metadata", c("meta_absent") | c("meta_obj"))]
    for k in HOISTED:
        checks.append((k, c(f"{k}_absent") | c(f"{k}_k").isin("STRING", "VOID")))
    sev = F.when(c("severity_k") == "STRING", c("severity"))
    checks.append(("severity_value", sev.isNull() | sev.isin(*SEVERITY_LEVELS)))
    meta = F.when(c("meta_absent"), F.create_map().cast("map<string,string>")).otherwise(c("meta"))
    value = F.struct(c("name").alias("name"), c("type").alias("type"), c("conf").alias("confidence"),
                     meta.alias("metadata"),
                     *[F.when(c(f"{k}_k") == "STRING", c(k)).alias(k) for k in HOISTED])
    return checks, value


def _responses(responses: DataFrame, stage: str) -> DataFrame:
    r = responses.filter(F.col("stage") == stage).select(
        "article_id", "content", "error",
        F.try_parse_json(F.concat(F.lit("["), F.col("content"), F.lit("]"))).alias("_wrapped"))
    one = F.size(V.as_array(F.col("_wrapped"))) == 1
    return r.select("article_id", "content", "error",
                    F.when(one, V.get(F.col("_wrapped"), "$[0]")).alias("root"))


def _emit_if(df: DataFrame, cond: Column, *cols: Column) -> DataFrame:
    """Rows of ``cols`` where ``cond`` holds, without a Filter node.

    A filter over computed columns is pushed below their projection and makes
    Catalyst evaluate every VARIANT read twice (once in the filter, once in the
    projection); exploding a 0/1-element array keeps one pass, and what ``cols``
    compute is computed for the emitted rows alone.
    """
    return df.select("*", F.explode(F.when(cond, F.array(F.lit(True)))).alias("_emit")).select(*cols)


def _root_elements(responses: DataFrame, stage: str, key: str, read: str, wrap_object: bool) -> DataFrame:
    """One row per element of each response, and one for a response that has no list.

    Columns: article_id, failed (why there is no list, else NULL), text (the
    content of such a response), pos, el (the fields by ``read``) and v (the
    element itself).  The list is read at its place in the wrapped text, so the
    root is not rebuilt.
    """
    r = responses.filter(F.col("stage") == stage).select(
        "article_id", "content", "error",
        F.try_parse_json(F.concat(F.lit("["), F.col("content"), F.lit("]"))).alias("w"))
    at = lambda path, ddl: F.try_variant_get(F.col("w"), path, ddl)
    probe = "struct<_probe:int>"
    r = r.select("*", F.coalesce(F.size(at("$", f"array<{probe}>")) == 1, F.lit(False)).alias("_one"),
                 at("$[0]", probe).isNotNull().alias("_is_obj"), at(f"$[0].{key}", f"array<{read}>").alias("_listed"))
    obj, listed = F.col("_one") & F.col("_is_obj"), F.col("_one") & F.col("_listed").isNotNull()
    # a key without a list
    other = obj & ~listed & at(f"$[0].{key}", "variant").isNotNull()
    r = r.select("*", obj.alias("_obj"), listed.alias("_has_list"), other.alias("_other"))
    obj, listed, other = F.col("_obj"), F.col("_has_list"), F.col("_other")
    bare = F.col("_one") & ~obj

    def elements(ddl: str, by_key: Column) -> Column:
        e = F.when(listed, by_key).when(bare, at("$[0]", f"array<{ddl}>"))
        # relationships: a lone object is one element; entities: an object without the key yields nothing
        return e.when(obj & ~other, F.array(at("$[0]", ddl))) if wrap_object else e

    r = r.select("article_id", "content", "error", "_one", "_obj", "_has_list", "_other", "w",
                 elements(read, F.col("_listed")).alias("els"))
    failed = (F.when(F.col("error").isNotNull(), "call_error").when(F.col("content").isNull(), "no_content")
              .when(~F.col("_one"), "bad_json").when(other, f"{key}_not_list"))
    if not wrap_object:
        failed = failed.when(obj & ~listed, f"no_{key}_key")
    failed = failed.when(F.col("els").isNull(), "not_a_list")
    r = r.select("article_id", "content", failed.alias("failed"), "els", elements("variant", at(f"$[0].{key}", "array<variant>")).alias("vs"))
    ok = F.col("failed").isNull()
    one = F.posexplode(F.when(ok, F.arrays_zip("els", "vs")).otherwise(F.array(F.lit(None).cast(f"struct<els:{read},vs:variant>"))))
    return r.select("article_id", "failed", F.when(~ok, F.col("content")).alias("text"), one.alias("pos", "_e")).select(
        "article_id", "failed", "text", F.when(F.col("failed").isNull(), F.col("pos")).cast("int").alias("pos"),
        F.col("_e.els").alias("el"), F.col("_e.vs").alias("v"))


def _rejected(el: DataFrame, stage: str) -> DataFrame:
    raw = F.when(F.col("failed").isNull(), F.to_json("v")).otherwise(F.col("text"))
    return _emit_if(el, F.col("reason").isNotNull(), F.lit(stage).alias("stage"), F.col("article_id"), F.col("pos"),
                    raw.alias("raw"), F.col("reason"))


_KEEP = ["article_id", "failed", "text", "pos", "v"]


def _reason(checks: list[tuple[str, Column]]) -> Column:
    """Why a row is rejected (NULL: valid): its response's fault, or the first check that fails."""
    return F.when(F.col("failed").isNotNull(), F.col("failed")).otherwise(_first_failure(checks))


def entity_elements(responses: DataFrame) -> DataFrame:
    """All entity elements, and responses without any list, with a ``reason`` (NULL = valid).

    Root shapes: ``[...]`` or ``{"entities": [...]}`` give elements; any other shape
    gives none (an object without the key yields nothing, as in the reference).
    """
    ok = _root_elements(responses, "entity", "entities", ENTITY_READ, wrap_object=False)
    raw = ok.select(*_KEEP, *_entity_raw("el", "e_", hoist_from_metadata=True))
    typed = raw.select(*_KEEP, *_entity_typed("e_"))
    checks, value = _entity_checks("e_")
    return typed.select(*_KEEP, _reason(checks).alias("reason"), value.alias("e"))


def parse_entities(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (entities, quarantine).  entities: article_id, pos, <Entity fields>."""
    el = entity_elements(responses)
    good = _emit_if(el, F.col("reason").isNull(), F.col("article_id"), F.col("pos"),
                    *[F.col(f"e.{c}").alias(c) for c in ENTITY_FIELDS])
    return good, _rejected(el, "entity")


def relationship_elements(responses: DataFrame) -> DataFrame:
    """Relationship elements, and responses without any list; a lone object without the key is one relationship."""
    ok = _root_elements(responses, "mapping", "relationships", RELATIONSHIP_READ, wrap_object=True)
    r = F.col("el")
    raw = ok.select(*_KEEP, r.isNotNull().alias("is_obj"),
                    r["action"].alias("action_v"), r["sentiment"].alias("sentiment"),
                    r["confidence"].alias("confidence"), r["reasoning"].alias("reas_v"),
                    *_entity_raw("el.subject", "s_", hoist_from_metadata=False),
                    *_entity_raw("el.object", "o_", hoist_from_metadata=False))
    typed = raw.select(
        *_KEEP, "is_obj",
        V.kind(F.col("action_v")).alias("action_k"),
        F.try_variant_get(F.col("action_v"), "$", "string").alias("action"),
        "sentiment", "confidence",
        V.kind(F.col("reas_v")).alias("reas_k"),
        F.try_variant_get(F.col("reas_v"), "$", "string").alias("reasoning"),
        *_entity_typed("s_"), *_entity_typed("o_"))
    s_checks, subj = _entity_checks("s_")
    o_checks, obj = _entity_checks("o_")
    checks = [("not_object", F.col("is_obj"))]
    checks += [(f"subject.{n}", c) for n, c in s_checks]
    checks += [("action", F.col("action_k") == "STRING")]
    checks += [(f"object.{n}", c) for n, c in o_checks]
    checks += [("sentiment", V.in_range(F.col("sentiment"), -1.0, 1.0)),
               ("confidence", V.in_range(F.col("confidence"), 0.0, 1.0)),
               ("reasoning", F.col("reas_k") == "STRING")]
    return typed.select(
        *_KEEP, _reason(checks).alias("reason"),
        subj.alias("subject"), F.upper(F.col("action")).alias("action"), obj.alias("object"),
        "sentiment", "confidence", "reasoning")


def parse_relationships(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """-> (relationships, quarantine).  Action is upper-cased as in the reference."""
    el = relationship_elements(responses)
    good = _emit_if(el, F.col("reason").isNull(),
                    *[F.col(c) for c in ["article_id", "pos", "subject", "action", "object",
                                         "sentiment", "confidence", "reasoning"]])
    return good, _rejected(el, "mapping")


def parse_impacts(responses: DataFrame, articles: DataFrame | None = None) -> DataFrame:
    """One ImpactSummary per response (or per article when ``articles`` is given).

    status 'ok' keeps the parsed summary; 'bad_json' takes fallback 1; any other
    failure (missing row, call error, wrong shape, range, type) takes fallback 2.
    """
    r = _responses(responses, "impact")
    if articles is not None:
        r = articles.select("article_id").join(r, "article_id", "left") \
            .withColumn("missing", F.col("root").isNull() & F.col("content").isNull()
                        & F.col("error").isNull())
    else:
        r = r.withColumn("missing", F.lit(False))
    root = F.col("root")
    r = r.withColumn("_f", V.fields(root, ("summary", "severity", "affected_sectors",
                                            "key_stakeholders")))
    f = F.col("_f")
    r = r.select("*", f.isNotNull().alias("_obj"), f["summary"].alias("summary_v"),
                 f["severity"].alias("severity_v"), f["affected_sectors"].alias("sectors_v"),
                 f["key_stakeholders"].alias("stake_v"))
    r = r.select("*", F.when(V.kind(F.col("summary_v")) == "STRING",
                             F.try_variant_get(F.col("summary_v"), "$", "string")).alias("summary_s"),
                 V.lax_int(F.col("severity_v")).alias("severity_i"),
                 V.string_list(F.col("sectors_v")).alias("sectors_l"),
                 F.when(F.col("stake_v").isNull(), F.array().cast("array<string>"))
                  .otherwise(V.string_list(F.col("stake_v"))).alias("stake_l"))
    summary, severity = F.col("summary_s"), F.col("severity_i")
    sectors, stake = F.col("sectors_l"), F.col("stake_l")
    status = (F.when(F.col("missing"), "missing")
              .when(F.col("error").isNotNull(), "call_error")
              .when(F.col("content").isNull(), "no_content")
              .when(root.isNull(), "bad_json")
              .when(~F.col("_obj"), "not_object")
              .when(summary.isNull(), "summary")
              .when(F.char_length(summary) > 500, "summary_length")
              .when(severity.isNull(), "severity")
              .when((severity < 1) | (severity > 10), "severity_range")
              .when(sectors.isNull(), "affected_sectors")
              .when(stake.isNull(), "key_stakeholders")
              .otherwise("ok"))
    ok = F.col("status") == "ok"
    fallback = F.when(F.col("status") == "bad_json", F.lit(FALLBACK_BAD_JSON)) \
                .otherwise(F.lit(FALLBACK_ERROR))
    return r.withColumn("status", status).select(
        "article_id",
        F.when(ok, summary).otherwise(fallback).alias("summary"),
        F.when(ok, severity.cast("int")).otherwise(F.lit(1)).alias("severity"),
        F.when(ok, sectors).otherwise(F.array(*[F.lit(x) for x in FALLBACK_SECTORS]))
         .alias("affected_sectors"),
        F.when(ok, stake).otherwise(F.array().cast("array<string>")).alias("key_stakeholders"),
        "status")
