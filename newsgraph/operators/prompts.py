"""Model request tables: one row per (article, stage) with its chat messages.

Model calls are table-in / table-out: these functions build the ``requests``
table; whatever serves the model fills a ``responses`` table that joins back
on (article_id, stage).  A request holds the article's own message and the
digest of its stage's template (system and few-shot messages); the whole chat
is put together where the model is called.  Contexts (entities,
relationships) are aggregated per article and serialised with ``to_json``
(the reference renders them with Python ``str()``; JSON is what a model reads).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsgraph.config import Config

# ----------------------------------------------------------------------------
# System prompts, few-shot examples and message templates of the
# reference (text as written there; examples rendered as JSON).
# ----------------------------------------------------------------------------

ENTITY_SYSTEM_PROMPT = """You are an expert financial news analyst specializing in extracting structured entities from business articles.

Your task is to identify and classify entities into these categories:
- **Companies**: Business entities (include industry)
- **People**: Individuals (include their role/title)
- **Locations**: Countries, cities, regions (include geopolitical context)
- **Events**: Significant occurrences (include severity: low/medium/high/critical)

CRITICAL RULES:
1. Only extract entities EXPLICITLY mentioned in the text
2. DO NOT infer or hallucinate entities not present
3. For companies, always research their primary industry
4. Assign confidence scores: 0.9+ for explicit mentions, 0.7-0.9 for inferred context
5. If unsure about an entity's type, mark confidence < 0.7

Output format: JSON array of entities with:
{
  "name": "string",
  "type": "company|person|location|event",
  "confidence": 0.0-1.0,
  "metadata": {
    "industry": "string" (for companies),
    "role": "string" (for people),
    "country": "string" (for locations),
    "severity": "low|medium|high|critical" (for events)
  }
}
"""

ENTITY_EXAMPLES = [
    {
        "article": "Tesla CEO Elon Musk announced a $25 billion investment in a new Gigafactory in Austin, Texas. The move comes as the EV manufacturer faces increased competition from Chinese automaker BYD.",
        "entities": [
            {"name": "Tesla", "type": "company", "confidence": 0.98, "metadata": {"industry": "Electric Vehicles"}},
            {"name": "Elon Musk", "type": "person", "confidence": 0.98, "metadata": {"role": "CEO of Tesla"}},
            {"name": "Austin", "type": "location", "confidence": 0.95, "metadata": {"country": "United States"}},
            {"name": "Texas", "type": "location", "confidence": 0.95, "metadata": {"country": "United States"}},
            {"name": "BYD", "type": "company", "confidence": 0.92, "metadata": {"industry": "Electric Vehicles"}},
            {"name": "Gigafactory Investment", "type": "event", "confidence": 0.90, "metadata": {"severity": "high"}},
        ],
    }
]

CAUSAL_SYSTEM_PROMPT = """You are an expert in causal analysis for business and financial news.

Your task is to extract causal relationships in the format:
**Subject → Action → Object**

Where:
- **Subject**: The actor/cause (an entity that initiates change)
- **Action**: The relationship verb (e.g., ACQUIRES, REJECTS, INVESTS_IN, DISRUPTS)
- **Object**: The affected entity (what/who is impacted)

For each relationship, provide:
1. **Sentiment**: -1.0 (very negative) to +1.0 (very positive)
2. **Confidence**: 0.0 (uncertain) to 1.0 (certain)
3. **Reasoning**: Explain your chain-of-thought in 1-2 sentences

CRITICAL RULES:
1. Only extract DIRECT causal relationships stated in the text
2. Use standardized action verbs (uppercase): ACQUIRES, REJECTS, INVESTS_IN, DISRUPTS, PARTNERS_WITH, etc.
3. Sentiment should reflect the impact on the OBJECT entity
4. If the relationship is ambiguous, set confidence < 0.7

Output format: JSON array of relationships
"""

CAUSAL_EXAMPLES = [
    {
        "article": "The Federal Reserve raised interest rates by 0.25%, impacting mortgage lenders and tech companies reliant on cheap debt.",
        "relationships": [
            {"subject": {"name": "Federal Reserve", "type": "organization", "confidence": 0.98},
             "action": "RAISES_RATES_FOR",
             "object": {"name": "Mortgage Lenders", "type": "industry", "confidence": 0.90},
             "sentiment": -0.6, "confidence": 0.92,
             "reasoning": "Higher interest rates directly reduce mortgage demand, negatively impacting lenders' revenue."},
            {"subject": {"name": "Federal Reserve", "type": "organization", "confidence": 0.98},
             "action": "RAISES_RATES_FOR",
             "object": {"name": "Tech Companies", "type": "industry", "confidence": 0.88},
             "sentiment": -0.7, "confidence": 0.89,
             "reasoning": "Tech firms relying on debt for growth face higher borrowing costs, constraining expansion."},
        ],
    },
    {
        "article": "Amazon Web Services announced a $10B partnership with Anthropic to develop enterprise AI solutions, directly challenging Microsoft's OpenAI integration.",
        "relationships": [
            {"subject": {"name": "Amazon Web Services", "type": "company", "confidence": 0.98},
             "action": "PARTNERS_WITH",
             "object": {"name": "Anthropic", "type": "company", "confidence": 0.98},
             "sentiment": 0.8, "confidence": 0.95,
             "reasoning": "Strategic partnership brings significant capital and distribution to Anthropic."},
            {"subject": {"name": "Amazon Web Services", "type": "company", "confidence": 0.98},
             "action": "COMPETES_WITH",
             "object": {"name": "Microsoft", "type": "company", "confidence": 0.95},
             "sentiment": -0.4, "confidence": 0.87,
             "reasoning": "This partnership creates direct competitive pressure on Microsoft's AI strategy."},
        ],
    },
]

IMPACT_SYSTEM_PROMPT = """You are a business analyst creating executive summaries of news impact.

Your task is to generate a 2-sentence summary that answers:
1. **What happened?** (First sentence: The core event)
2. **Who cares?** (Second sentence: The stakeholders/industries affected)

Additionally, provide:
- **Severity**: Integer from 1-10
  - 1-3: Minor operational news
  - 4-6: Significant market movement
  - 7-8: Major industry disruption
  - 9-10: Economy-wide crisis
- **Affected Sectors**: List of industries impacted
- **Key Stakeholders**: Main parties who should care

CRITICAL RULES:
1. Be concise (max 2 sentences total)
2. Focus on BUSINESS IMPACT, not just the event itself
3. Severity should match the actual economic consequence
4. List specific industries, not vague categories

Output format: JSON object
{
  "summary": "string (2 sentences, max 500 chars)",
  "severity": 1-10,
  "affected_sectors": ["Industry1", "Industry2"],
  "key_stakeholders": ["Stakeholder1", "Stakeholder2"]
}
"""

IMPACT_EXAMPLES = [
    {
        "article": "The FDA rejected PharmaCorp's new cancer drug application due to insufficient clinical trial data. The company's stock dropped 15% in after-hours trading.",
        "impact_summary": {
            "summary": "FDA's rejection of PharmaCorp's cancer drug halts a major revenue stream and threatens the company's growth trajectory. This affects pharmaceutical investors, oncology research partners, and potentially delays treatment options for cancer patients.",
            "severity": 7,
            "affected_sectors": ["Pharmaceuticals", "Healthcare", "Biotechnology", "Clinical Research"],
            "key_stakeholders": ["PharmaCorp shareholders", "Pharmaceutical supply chain partners",
                                 "Cancer treatment facilities", "Healthcare investors"],
        },
    },
    {
        "article": "Apple announced a new color option for the iPhone 15. The midnight blue variant will be available next month.",
        "impact_summary": {
            "summary": "Apple introduced a new iPhone color variant as part of its routine product refresh cycle. This is a minor cosmetic update with negligible business impact beyond potential marginal sales increases.",
            "severity": 2,
            "affected_sectors": ["Consumer Electronics", "Retail"],
            "key_stakeholders": ["Apple retail partners", "Consumer electronics analysts"],
        },
    },
]

ARTICLE_PREFIX = "Article: "
ENTITY_TASK = "\n\nExtract all entities as JSON array:"
CAUSAL_ENTITIES = "\n\nKnown Entities: "
CAUSAL_TASK = "\n\nExtract causal relationships between these entities as JSON array:"
IMPACT_ENTITIES = "\n\nEntities: "
IMPACT_RELATIONSHIPS = "\nRelationships: "
IMPACT_TASK = "\n\nGenerate impact summary as JSON:"
RESPONSE_FORMAT = "json_object"

# ----------------------------------------------------------------------------

MESSAGES_DDL = "array<struct<role:string,content:string>>"


def _shots(system: str, examples: list[dict], answer_key: str) -> list[tuple[str, str]]:
    """(role, content) of the messages before an article's own."""
    out = [("system", system)]
    for ex in examples:
        out += [("user", ARTICLE_PREFIX + ex["article"]), ("assistant", json.dumps(ex[answer_key], ensure_ascii=False))]
    return out


STAGE_MESSAGES = {
    "entity": _shots(ENTITY_SYSTEM_PROMPT, ENTITY_EXAMPLES, "entities"),
    "mapping": _shots(CAUSAL_SYSTEM_PROMPT, CAUSAL_EXAMPLES, "relationships"),
    "impact": _shots(IMPACT_SYSTEM_PROMPT, IMPACT_EXAMPLES, "impact_summary"),
}


def template_id(stage: str) -> str:
    """Digest of the messages that every request of a stage begins with."""
    return hashlib.sha256(json.dumps(STAGE_MESSAGES[stage], ensure_ascii=False).encode()).hexdigest()


def templates(spark: SparkSession) -> DataFrame:
    """(template, stage, messages): one row a stage, to be stored beside the requests."""
    rows = [(template_id(s), s, [(r, c) for r, c in m]) for s, m in STAGE_MESSAGES.items()]
    return spark.createDataFrame(rows, f"template string, stage string, messages {MESSAGES_DDL}")


def with_messages(requests: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Requests with their whole chat in column ``messages``: the template's, then the article's own.

    ``table``: the templates (default: those of this version); requests whose
    template it does not have get no messages.
    """
    known = templates(requests.sparkSession) if table is None else table
    own = F.struct(F.lit("user").alias("role"), F.col("user").alias("content"))
    joined = requests.join(F.broadcast(known.select("template", F.col("messages").alias("_first"))), "template", "left")
    return joined.withColumn("messages", F.concat("_first", F.array(own))).drop("_first")


def _request(df: DataFrame, stage: str, user: Column, cfg: Config) -> DataFrame:
    return df.select(
        "article_id", F.lit(stage).alias("stage"), F.lit(template_id(stage)).alias("template"), user.alias("user"),
        F.lit(cfg.model).alias("model"), F.lit(cfg.temperatures[stage]).alias("temperature"),
        F.lit(RESPONSE_FORMAT).alias("response_format"))


def entity_context(entities: DataFrame, mode: str = "mapping") -> DataFrame:
    """Per article: JSON list of {name, type} (mapping) or {name, type, industry} (impact)."""
    fields = [F.col("name"), F.col("type")] + ([F.col("industry")] if mode == "impact" else [])
    item = F.struct(F.col("pos"), F.struct(*fields).alias("v"))
    ctx = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])
    return entities.groupBy("article_id").agg(
        F.to_json(ctx, {"ignoreNullFields": "false"}).alias("entity_context"),
        F.count("*").alias("n_entities"))


def relationship_context(relationships: DataFrame) -> DataFrame:
    """Per article: JSON list of {subject, action, object, sentiment} (names only)."""
    v = F.struct(F.col("subject.name").alias("subject"), F.col("action"),
                 F.col("object.name").alias("object"), F.col("sentiment"))
    ctx = F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), v.alias("v")))),
                      lambda x: x["v"])
    return relationships.groupBy("article_id").agg(
        F.to_json(ctx, {"ignoreNullFields": "false"}).alias("relationship_context"))


def entity_requests(articles: DataFrame, cfg: Config = Config()) -> DataFrame:
    """system + 1 few-shot pair + the article: 4 messages."""
    user = F.concat(F.lit(ARTICLE_PREFIX), F.col("content"), F.lit(ENTITY_TASK))
    return _request(articles, "entity", user, cfg)


def causal_requests(articles: DataFrame, entities: DataFrame, cfg: Config = Config(),
                    min_entities: int = 2) -> DataFrame:
    """system + 2 pairs + article with known entities: 6 messages.

    Only articles with ``min_entities``+ entities get a request (the gate runs
    before the call); the article text joins the small context, not the reverse.
    """
    ctx = entity_context(entities, "mapping").filter(F.col("n_entities") >= min_entities)
    j = articles.select("article_id", "content").join(ctx, "article_id")
    user = F.concat(F.lit(ARTICLE_PREFIX), F.col("content"), F.lit(CAUSAL_ENTITIES),
                    F.col("entity_context"), F.lit(CAUSAL_TASK))
    return _request(j, "mapping", user, cfg)


def impact_requests(articles: DataFrame, entities: DataFrame, relationships: DataFrame,
                    cfg: Config = Config()) -> DataFrame:
    """system + 2 pairs + article with entities and relationships: 6 messages.

    ``articles``: the articles that reach this stage (those that kept an entity);
    ``entities``: their fact-checked entities (possibly none, then ``[]``).
    """
    ectx = entity_context(entities, "impact")
    rctx = relationship_context(relationships)
    j = articles.select("article_id", "content").join(ectx, "article_id", "left") \
        .join(rctx, "article_id", "left")
    user = F.concat(F.lit(ARTICLE_PREFIX), F.col("content"), F.lit(IMPACT_ENTITIES),
                    F.coalesce(F.col("entity_context"), F.lit("[]")), F.lit(IMPACT_RELATIONSHIPS),
                    F.coalesce(F.col("relationship_context"), F.lit("[]")), F.lit(IMPACT_TASK))
    return _request(j, "impact", user, cfg)
