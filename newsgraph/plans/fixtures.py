"""Inputs derived from the driver tables by fixed formulas (FIXTURES.md §2).

The same formulas are written in SQL in ``newsgraph.plans.oracle`` so that the
DuckDB oracle and the Spark plan start from identical rows.  Every derivation
is a DataFrame plan over the given tables, so its size grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgraph.sources.tables import Tables

# Fixed values of the fixture formulas (FIXTURES.md §2).
ACTION_BY_FLAG = {"A": "supplies", "N": "delivers_to", "R": "recalls_from"}
GAZETTEER_LABELS = ["ORG", "PERSON", "GPE", "LOC", "EVENT", "MONEY", "PRODUCT"]
GAZETTEER_PHRASES = [("apache license", "PRODUCT"), ("general public license", "PRODUCT"),
                     ("the&&&", "ORG"), ("mail2.example.com", "ORG"), ("unmapped phrase", "NORP")]
ORDER_PHRASES = [("apache license", "PRODUCT"), ("license terms office", "ORG"), ("office trade relations", "ORG"),
                 ("trade relations", "EVENT"), ("general public license", "PRODUCT"), ("with profit", "EVENT"),
                 ("million pounds sterling", "GPE"), ("unmapped phrase", "NORP"),
                 ("acme inc", "PRODUCT"), ("Acme Inc.", "ORG"), ("at&t", "ORG"), ("3m corp", "ORG"), ("3m", "ORG"), ("coca-cola co.", "ORG"),
                 ("s&p 500", "PRODUCT"), ("beta", "GPE"), ("yahoo!", "ORG"), ("smith", "PERSON"), ("j. doe", "PERSON"), ("u.s. steel", "ORG")]
LEXICON = [("is", "IS", 0.0), ("was", "WAS", 0.0), ("are", "ARE", 0.0),
           ("from", "COMES_FROM", 0.1), ("with", "WORKS_WITH", 0.3), ("by", "AFFECTED_BY", -0.2)]
IMPACT_SUMMARY_FMT = "Order %d changed hands. Its customer is affected."
ENDPOINT_CONFIDENCE = 0.9
STAGES = ("entity", "mapping", "impact")


def pct(expr: Column) -> Column:
    """integer/100 as DOUBLE (same bits as the SQL oracle)."""
    return expr.cast("double") / F.lit(100)


def _article_id(order_key: Column) -> Column:
    return order_key.cast("string")


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")


def ln(lineitem: DataFrame, order: tuple[str, ...] = LINE_ORDER) -> DataFrame:
    """lineitem + article_id, rn, a deterministic line order per order (2.1).

    The window is dealt out by article_id, the key that everything later is grouped
    and joined by; l_orderkey is read back from it, so only one of them is moved.
    ``order``: as many of the ordering columns as tell the rows apart in the columns that are used.
    """
    numbered = lineitem.withColumn("article_id", _article_id(F.col("l_orderkey"))).drop("l_orderkey") \
        .withColumn("rn", F.row_number().over(Window.partitionBy("article_id").orderBy(*order)))
    return numbered.withColumn("l_orderkey", F.col("article_id").cast(lineitem.schema["l_orderkey"].dataType))


def cand_entities(t: Tables) -> DataFrame:
    """(article_id, pos, name, type, confidence, industry, country) (2.2)."""
    own, suppliers, parts = _cand_parts(t)
    return own.unionByName(suppliers).unionByName(parts)


def _cand_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The candidates by origin: customer and nation of the order, suppliers of its lines, parts of its lines."""
    o = t.orders.select("o_orderkey", "o_custkey")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    oc = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey) \
        .join(r, F.col("n_regionkey") == r.r_regionkey)
    k = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    cust = oc.select(_article_id(k).alias("article_id"), F.lit(0).alias("pos"), F.col("c_name").alias("name"),
                     F.lit("company").alias("type"),
                     pct(60 + F.col("o_custkey") % 41).alias("confidence"),
                     F.col("c_mktsegment").alias("industry"), none.alias("country"))
    nat = oc.select(_article_id(k).alias("article_id"), F.lit(1).alias("pos"), F.col("n_name").alias("name"),
                    F.lit("location").alias("type"), pct(60 + k % 41).alias("confidence"),
                    none.alias("industry"), F.col("r_name").alias("country"))
    # lines that tie in these columns are alike in all that is read of them
    li = ln(t.lineitem, LINE_ORDER[:3]).select("article_id", "l_orderkey", "l_partkey", "l_suppkey", "rn")
    s = t.supplier.select("s_suppkey", "s_name")
    p = t.part.select("p_partkey", "p_name")
    lk, rn = F.col("l_orderkey"), F.col("rn")
    sup = li.join(s, li.l_suppkey == s.s_suppkey).select(
        "article_id", (2 * rn).alias("pos"), F.col("s_name").alias("name"),
        F.lit("company").alias("type"),
        pct(50 + (lk * 7 + F.col("l_partkey") * 13) % 51).alias("confidence"),
        none.alias("industry"), none.alias("country"))
    prt = li.join(p, li.l_partkey == p.p_partkey).select(
        "article_id", (2 * rn + 1).alias("pos"), F.col("p_name").alias("name"),
        F.lit("product").alias("type"),
        pct(50 + (F.col("l_partkey") * 11 + rn * 17) % 51).alias("confidence"),
        none.alias("industry"), none.alias("country"))
    own, sup, prt = (x.withColumn("pos", F.col("pos").cast("int")) for x in (cust.unionByName(nat), sup, prt))
    return own, sup, prt


def edges_fixture(t: Tables) -> DataFrame:
    """One supplier -> customer edge per line, pos = rn (2.5)."""
    flag = F.col("l_returnflag")
    action = F.when(flag == "A", ACTION_BY_FLAG["A"]).when(flag == "N", ACTION_BY_FLAG["N"]) \
              .when(flag == "R", ACTION_BY_FLAG["R"])
    # "+ 0.0" turns a negative zero into 0.0 (same text in JSON on both engines)
    sentiment = F.round(F.when(flag == "R", -F.col("l_discount") * 10)
                        .otherwise(F.col("l_tax") * 10), 6) + F.lit(0.0)
    lines = t.lineitem.select("l_orderkey", *LINE_ORDER, action.alias("action"), sentiment.alias("sentiment"))
    li = ln(lines).select("article_id", "l_orderkey", "l_suppkey", "action", "sentiment", "rn")
    o = t.orders.select(_article_id(F.col("o_orderkey")).alias("article_id"), "o_custkey")
    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    s = t.supplier.select("s_suppkey", "s_name")
    # customers meet the orders, not their lines, which stay where their order is
    oc = o.join(c, o.o_custkey == c.c_custkey).select("article_id", "c_name", "c_mktsegment")
    j = li.join(oc, "article_id").join(s, li.l_suppkey == s.s_suppkey)
    lk = F.col("l_orderkey")
    return j.select(
        lk.alias("k"), "article_id", F.col("rn").cast("int").alias("pos"),
        F.col("s_name").alias("subject_name"), F.col("c_name").alias("object_name"),
        F.col("c_mktsegment").alias("object_industry"), "action", "sentiment",
        pct(50 + (lk * 3 + F.col("l_suppkey") * 5) % 51).alias("confidence"),
        F.concat(F.lit("Line "), F.col("rn"), F.lit(" of order "), lk).alias("reasoning"))


# ---------------------------------------------------------------- responses (2.3)

def _elements(df: DataFrame, elem: str = "elem") -> DataFrame:
    """Per article: its element strings with their places."""
    return df.groupBy("article_id").agg(F.collect_list(F.struct("pos", elem)).alias("els"))


def _json_items(els: Column, elem: str = "elem") -> Column:
    """The elements in order of their places, as the inside of a JSON array."""
    return F.array_join(F.transform(F.array_sort(els), lambda x: x[elem]), ",")


def _entity_elem(idx: Column) -> Column:
    meta = (F.when(F.col("pos") == 0, F.create_map(F.lit("industry"), F.col("industry")))
            .when(F.col("pos") == 1, F.create_map(F.lit("country"), F.col("country"))))
    is0 = F.col("pos") == 0
    opts = {"ignoreNullFields": "false"}
    base = lambda **over: F.to_json(F.struct(
        over.get("name", F.col("name")).alias("name"), F.col("type").alias("type"),
        over.get("confidence", F.col("confidence")).alias("confidence"),
        over.get("metadata", meta).alias("metadata")), opts)
    plain_sup = F.to_json(F.struct("name", "type", "confidence"))
    plain_prt = F.to_json(F.struct("name", "type", "confidence",
                                   F.create_map().cast("map<string,string>").alias("metadata")))
    return (F.when(is0 & (idx == 13), base(confidence=F.lit(1.7)))
            .when(is0 & (idx == 14), base(name=F.lit(5)))
            .when(is0 & (idx == 15), base(confidence=F.lit("0.9")))
            .when(is0 & (idx == 16), base(metadata=F.lit(None).cast("map<string,string>")))
            .when(F.col("pos") <= 1, base())
            .when(F.col("type") == "company", plain_sup)
            .otherwise(plain_prt))


def _edge_elem(idx: Column) -> Column:
    first = F.col("pos") == 1
    subj_full = F.struct(F.col("subject_name").alias("name"), F.lit("company").alias("type"),
                         F.lit(ENDPOINT_CONFIDENCE).alias("confidence"))
    subj_noconf = F.struct(F.col("subject_name").alias("name"), F.lit("company").alias("type"))
    obj = F.struct(F.col("object_name").alias("name"), F.lit("company").alias("type"),
                   F.lit(ENDPOINT_CONFIDENCE).alias("confidence"),
                   F.col("object_industry").alias("industry"))

    def rel(subject=subj_full, action=F.col("action"), sentiment=F.col("sentiment")):
        return F.to_json(F.struct(subject.alias("subject"), action.alias("action"),
                                  obj.alias("object"), sentiment.alias("sentiment"),
                                  F.col("confidence").alias("confidence"),
                                  F.col("reasoning").alias("reasoning")))
    return (F.when(first & (idx == 13), rel(sentiment=F.lit(-1.5)))
            .when(first & (idx == 15), rel(subject=subj_noconf))
            .when(first & (idx == 16), rel(action=F.lit(7)))
            .otherwise(rel()))


def responses_fixture(t: Tables) -> DataFrame:
    """(article_id, stage, content, tokens_used, error) for the three stages (2.3)."""
    orders = t.orders.select("o_orderkey", "o_custkey", _article_id(F.col("o_orderkey")).alias("article_id"))
    k = F.col("o_orderkey")

    order_type = orders.schema["o_orderkey"].dataType
    e = orders.where(k % 20 != 19).withColumn("idx", k % 20)
    for n, part in enumerate(_cand_parts(t)):
        # what was brought to other keys is moved back as columns, the JSON text is made at the article
        part = part if n == 1 else part.repartition("article_id")
        part = part.withColumn("idx", F.col("article_id").cast(order_type) % 20).where("idx <> 19")
        els = _elements(part.withColumn("elem", _entity_elem(F.col("idx")))).withColumnRenamed("els", f"els{n}")
        e = e.join(els, "article_id", "left")
    none = F.array().cast("array<struct<pos:int,elem:string>>")
    e = e.withColumn("items", _json_items(F.concat(*[F.coalesce(f"els{n}", none) for n in range(3)])))
    arr = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    e_content = (F.when(F.col("idx") == 0, arr)
                 .when(F.col("idx") == 17, F.lit("not json"))
                 .when(F.col("idx") == 18, F.concat(F.lit('{"results":'), arr, F.lit("}")))
                 .otherwise(F.concat(F.lit('{"entities":'), arr, F.lit("}"))))
    e = e.select(
        "article_id", F.lit("entity").alias("stage"),
        e_content.alias("content"), (200 + k % 97).alias("tokens_used"))

    ed = edges_fixture(t).withColumn("idx", (F.col("k") + 7) % 20).where("idx <> 19")
    ed = ed.withColumn("elem", _edge_elem(F.col("idx")))
    lone = ed.filter((F.col("pos") == 1) & (F.col("idx") == 14)).select(
        "article_id", F.col("elem").alias("lone"))
    ed_items = _elements(ed).select("article_id", _json_items(F.col("els")).alias("items"))
    m = orders.join(ed_items, "article_id", "left") \
        .join(lone, "article_id", "left") \
        .withColumn("idx", (k + 7) % 20).withColumn("items", F.coalesce("items", F.lit("")))
    arr = F.concat(F.lit("["), F.col("items"), F.lit("]"))
    m_content = (F.when(F.col("idx") == 0, arr)
                 .when((F.col("idx") == 14) & F.col("lone").isNotNull(), F.col("lone"))
                 .when(F.col("idx") == 17, F.lit("not json"))
                 .when(F.col("idx") == 18, F.lit('{"relationships":null}'))
                 .otherwise(F.concat(F.lit('{"relationships":'), arr, F.lit("}"))))
    m = m.filter(F.col("idx") != 19).select(
        "article_id", F.lit("mapping").alias("stage"),
        m_content.alias("content"), (300 + k % 89).alias("tokens_used"))

    c = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    im = orders.join(c, orders.o_custkey == c.c_custkey).withColumn("idx", (k + 13) % 20)
    summary = F.format_string(IMPACT_SUMMARY_FMT, k)
    idx = F.col("idx")

    def obj(severity):
        return F.to_json(F.struct(
            F.when(idx == 16, F.rpad(summary, 501, ".")).otherwise(summary).alias("summary"),
            severity.alias("severity"),
            F.when(idx != 18, F.array("c_mktsegment")).alias("affected_sectors"),
            F.when(k % 2 == 1, F.array("c_name")).alias("key_stakeholders")))
    i_content = (F.when(idx == 17, F.lit("not json"))
                 .when(idx == 13, obj(F.lit(11)))
                 .when(idx == 14, obj(F.lit(7.5)))
                 .when(idx == 15, obj(F.lit("7")))
                 .otherwise(obj((1 + k % 10).cast("int"))))
    im = im.filter(idx != 19).select(
        "article_id", F.lit("impact").alias("stage"),
        i_content.alias("content"), (150 + k % 83).alias("tokens_used"))
    out = e.unionByName(m).unionByName(im)
    return out.withColumn("tokens_used", F.col("tokens_used").cast("bigint")) \
              .withColumn("error", F.lit(None).cast("string"))


# ---------------------------------------------------------------- KBs (2.4)

def company_kb(t: Tables) -> DataFrame:
    s = t.supplier.filter(F.col("s_suppkey") % 5 != 0).select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("kb_id"), F.col("s_name").alias("name"),
        (F.col("s_suppkey") % 97).alias("popularity"))
    cu = t.customer.select("c_custkey", "c_name")
    same = cu.filter(F.col("c_custkey") % 3 != 0).select(
        F.concat(F.lit("c"), F.col("c_custkey")).alias("kb_id"), F.col("c_name").alias("name"),
        (F.col("c_custkey") % 97).alias("popularity"))
    hold = cu.filter(F.col("c_custkey") % 6 == 0).select(
        F.concat(F.lit("h"), F.col("c_custkey")).alias("kb_id"),
        F.concat(F.col("c_name"), F.lit(" Holdings")).alias("name"),
        (F.col("c_custkey") % 97).alias("popularity"))
    # one row in another language that must never match (its name is otherwise absent)
    de = cu.filter(F.col("c_custkey") == 3).select(
        F.lit("de3").alias("kb_id"), F.col("c_name").alias("name"), F.lit(0).cast("bigint").alias("popularity"))
    en = s.unionByName(same).unionByName(hold).withColumn("language", F.lit("en"))
    kb = en.unionByName(de.withColumn("language", F.lit("de")))
    return kb.select(
        "kb_id", "name", F.array().cast("array<string>").alias("aliases"),
        F.concat(F.lit("org/"), F.lower(F.regexp_replace("name", "[^A-Za-z0-9]+", "-"))).alias("permalink"),
        F.concat(F.lit("Company record "), F.col("kb_id")).alias("short_description"),
        F.col("popularity").cast("bigint").alias("popularity"), "language")


def wiki_kb(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = n.join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("n_nationkey")
    own = j.filter(key % 4 != 0).select(
        F.concat(F.lit("Q"), key).alias("wikidata_id"), F.col("n_name").alias("label"),
        F.array().cast("array<string>").alias("aliases"))
    generic = j.filter(key % 8 == 4).select(
        F.concat(F.lit("Q"), key).alias("wikidata_id"), F.lit("NATION").alias("label"),
        F.array("n_name").alias("aliases"))
    desc = j.select(F.concat(F.lit("Q"), key).alias("wid"),
                    F.concat(F.lit("nation in region "), F.col("r_name")).alias("description"),
                    (key % 97).cast("bigint").alias("popularity"))
    en = own.unionByName(generic).withColumn("language", F.lit("en"))
    # a foreign-language row carrying an absent nation's name: must never match
    de = j.filter(key == 8).select(F.lit("Qde8").alias("wikidata_id"), F.col("n_name").alias("label"),
                                   F.array().cast("array<string>").alias("aliases"),
                                   F.lit("de").alias("language"))
    kb = en.unionByName(de)
    return kb.join(desc, kb.wikidata_id == desc.wid, "left").select(
        "wikidata_id", "label", "aliases",
        F.coalesce("description", F.lit("Nation")).alias("description"),
        F.coalesce("popularity", F.lit(0).cast("bigint")).alias("popularity"), "language")


def kb_errors(t: Tables) -> DataFrame:
    """Lookups that failed at the source: (name, type, kind in {network, http_status})."""
    s = t.supplier.select("s_suppkey", "s_name")
    net = s.filter(F.col("s_suppkey") % 11 == 0).select(
        F.col("s_name").alias("name"), F.lit("company").alias("type"), F.lit("network").alias("kind"))
    http = s.filter((F.col("s_suppkey") % 13 == 0) & (F.col("s_suppkey") % 11 != 0)).select(
        F.col("s_name").alias("name"), F.lit("company").alias("type"), F.lit("http_status").alias("kind"))
    nat = t.nation.filter(F.col("n_nationkey") % 5 == 1).select(
        F.col("n_name").alias("name"), F.lit("location").alias("type"), F.lit("http_status").alias("kind"))
    return net.unionByName(http).unionByName(nat)


# ---------------------------------------------------------------- articles

def doc_articles(t: Tables) -> DataFrame:
    """Articles from documents (2.7), typed."""
    d = t.documents.select("doc_id", "text", "lang", "source")
    pub = F.timestamp_add("DAY", F.col("doc_id") % 30, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/d/"), F.col("doc_id"))
    return d.select(
        F.col("doc_id"),
        F.sha2(url, 256).alias("article_id"),
        url.alias("url"),
        F.split_part(F.col("text"), F.lit("."), F.lit(1)).alias("title"),
        F.col("text").alias("content"), F.col("source"), pub.alias("published_date"),
        F.timestamp_add("SECOND", F.col("doc_id") % 600, pub).alias("fetch_timestamp"),
        F.lit(None).cast("string").alias("author"), F.array("lang").alias("tags"),
        F.lit(None).cast("string").alias("raw_html"))


def _iso(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def doc_article_messages(t: Tables) -> DataFrame:
    """JSON article messages with faults injected by ``doc_id % 10`` (2.7)."""
    a = doc_articles(t)
    f = F.col("doc_id") % 10
    base = {
        "article_id": F.col("article_id"), "url": F.col("url"), "title": F.col("title"),
        "content": F.col("content"), "source": F.col("source"),
        "published_date": _iso(F.col("published_date")),
        "fetch_timestamp": _iso(F.col("fetch_timestamp")), "tags": F.col("tags"),
    }

    def msg(**over):
        fields = dict(base)
        for key, v in over.items():
            if v is None:
                fields.pop(key)
            else:
                fields[key] = v
        return F.to_json(F.struct(*[v.alias(key) for key, v in fields.items()]))

    value = (F.when(f == 2, msg(title=None))
             .when(f == 3, msg(url=F.regexp_replace("url", "^https", "ftp")))
             .when(f == 4, msg(published_date=F.lit("yesterday")))
             .when(f == 5, msg(tags=F.array(F.lit(1), F.lit(2))))
             .when(f == 6, msg(extra=F.lit("ignored")))
             .when(f == 7, msg(fetch_timestamp=None))
             .when(f == 8, msg(author=F.lit(42)))
             .when(f == 9, F.concat(msg(), F.lit(" trailing")))
             .otherwise(msg()))
    return a.select("doc_id", value.alias("value"))


def order_articles(t: Tables) -> DataFrame:
    """One article per order: the structured path (2.13)."""
    o = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    k = F.col("o_orderkey")
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select(
        k.cast("string").alias("article_id"),
        F.concat(F.lit("https://orders.example.org/"), k).alias("url"),
        F.col("o_orderpriority").alias("title"), F.concat(F.lit("Order "), k).alias("content"),
        F.col("o_orderstatus").alias("source"), ts.alias("published_date"),
        ts.alias("fetch_timestamp"), F.lit(None).cast("string").alias("author"),
        F.array().cast("array<string>").alias("tags"), F.lit(None).cast("string").alias("raw_html"),
        (k % 4).alias("file_no"))


def dup_stream(t: Tables) -> DataFrame:
    """Duplicate article stream (2.9): file_no 1, 2 (+1 day, doc_id%10=0), 3 (+20 days, %50=0)."""
    a = doc_articles(t).select("doc_id", "article_id", "url", "title", "source")
    base = F.timestamp_add("SECOND", F.col("doc_id") % 600,
                           F.lit("2024-01-01 00:00:00").cast("timestamp"))
    f1 = a.withColumn("fetch_timestamp", base).withColumn("file_no", F.lit(1))
    f2 = a.filter(F.col("doc_id") % 10 == 0) \
          .withColumn("fetch_timestamp", F.timestamp_add("DAY", F.lit(1), base)) \
          .withColumn("file_no", F.lit(2))
    f3 = a.filter(F.col("doc_id") % 50 == 0) \
          .withColumn("fetch_timestamp", F.timestamp_add("DAY", F.lit(20), base)) \
          .withColumn("file_no", F.lit(3))
    return f1.unionByName(f2).unionByName(f3)


# ---------------------------------------------------------------- text fixtures

def gazetteer(t: Tables) -> DataFrame:
    """(phrase, label): benchmark words of 6+ letters plus fixed phrases (2.10)."""
    words = t.benchmark.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("phrase"))
    words = words.filter(F.length("phrase") >= 6).distinct()
    labels = F.array(*[F.lit(x) for x in GAZETTEER_LABELS])
    words = words.withColumn("label", F.element_at(labels, (F.length("phrase") % 7 + 1).cast("int")))
    extra = t.spark.createDataFrame(GAZETTEER_PHRASES, "phrase string, label string")
    return words.unionByName(extra)


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "verb string, action string, sentiment double")


def order_texts(t: Tables) -> DataFrame:
    """One text per order: chained overlaps, money amounts, an unmapped label, verbs inside mentions, names with digits and marks (2.14)."""
    o = t.orders.select("o_orderkey", "o_custkey", F.floor("o_totalprice").cast("string").alias("p"))
    c = t.customer.select("c_custkey", "c_mktsegment")
    kind = F.col("o_orderkey") % 6
    text = (F.when(kind == 0, F.concat(F.lit("Apache License Terms Office Trade Relations was paid $"), "p",
                                       F.lit(" million by "), "c_mktsegment",
                                       F.lit(" buyers. An Unmapped Phrase is from General Public License holders!")))
            .when(kind == 1, F.concat(F.lit("Apache License Terms Office deals with profit from General Public License, worth €"),
                                      "p", F.lit(" million pounds sterling.")))
            .when(kind == 2, F.concat("c_mktsegment", F.lit(" demand is with profit. £"), "p",
                                      F.lit(",000 was from Apache\tLicense? Yes, by Trade Relations with profit")))
            .when(kind == 3, F.concat(F.lit("Acme Inc. acquired AT&T from 3M Corp. with $4.2 billion in Beta. S&P 500 was by Coca-Cola Co. "),
                                      "c_mktsegment", F.lit(" is from Beta")))
            .when(kind == 4, F.concat(F.lit("Dr. Smith is with J. Doe from U.S. Steel. ACME  Inc. was by 3Mx and AT&Tx or "), "c_mktsegment",
                                      F.lit(" and 3m? Yahoo! is with AT&T. Beta Inc. Acme inc was with (3M)")))
            .otherwise(F.lit("Unmapped phrase was nothing.")))
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))


def order_gazetteer(t: Tables) -> DataFrame:
    """Customer segments as ORG, and phrases that overlap in chains (2.14)."""
    seg = t.customer.select(F.lower("c_mktsegment").alias("phrase")).distinct().withColumn("label", F.lit("ORG"))
    return seg.unionByName(t.spark.createDataFrame(ORDER_PHRASES, "phrase string, label string"))


def crawled_pages(t: Tables) -> DataFrame:
    """Pages, some with a URL that is missing or none of http(s) (2.8)."""
    kind = F.pmod("page_id", F.lit(23))
    url = F.when(kind == 3, F.lit(None)).when(kind == 7, F.concat(F.lit("ftp://files.example.org/"), F.col("page_id").cast("string"))) \
           .when(kind == 11, F.lit("no address")).when(kind == 13, F.lit("https:///nohost")).otherwise(F.col("url"))
    return t.pages.withColumn("url", url)


# ---------------------------------------------------------------- users

def interactions(t: Tables) -> DataFrame:
    """(user_id, name, event_type, value): every event follows supplier k % count(supplier) (2.6)."""
    s = t.supplier.select("s_suppkey", "s_name")
    n_sup = s.agg(F.count("*")).scalar()  # scalar subquery, planned by Catalyst
    ev = t.events.select("user_id", "event_type", "value",
                         (F.get_json_object("props", "$.k").cast("bigint") % n_sup).alias("sk"))
    return ev.join(s, ev.sk == s.s_suppkey).select("user_id", F.col("s_name").alias("name"), "event_type", "value")
