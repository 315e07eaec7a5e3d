"""Not-modified revisit records resolved to the responses that they confirm."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fields that a 304 response may update (RFC 9110, section 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
# Seconds of one time bucket, within which rows of a URL are ordered together.
BUCKET = 86_400
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def canonical_url(url: str) -> Column:
    """Key under which captures of one resource meet.

    Host in lower case without user, leading ``www.`` and default port; path
    without trailing slashes; query parameters sorted, without ``utm_*``; no
    scheme and no fragment.  Text that is no URL is its own key, trimmed.
    """
    c = F.trim(url)
    scheme = F.lower(F.regexp_extract(c, _URL, 1))
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(c, _URL, 2)), "^.*@", ""), r"^www\.", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.regexp_replace(F.regexp_extract(c, _URL, 3), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(c, _URL, 4), r"^\?", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.when(scheme == "", c).otherwise(F.concat(host, F.when(path == "", "/").otherwise(path), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def _opaque(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def lower_names(headers: str) -> Column:
    """The map with field names in lower case, without null values; a null map is empty.

    Of names that differ in case only, the one that sorts first counts (``ETag``
    before ``etag``).
    """
    entries = F.array_sort(F.map_entries(F.map_filter(headers, lambda _, v: v.isNotNull())))
    names = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(names, F.lower(e["key"])) == i + 1)
    lowered = F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    return F.coalesce(lowered, F.create_map().cast("map<string,string>"))


def resolve(records: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Every revisit with the latest earlier full response of its URL.

    ``records``: ``record_id`` (unique), ``url``, ``ts`` (seconds), ``kind``
    ('response' or 'revisit'), ``status``, ``etag``, ``last_modified``,
    ``headers`` (map) and ``payload_digest``; further columns are ignored.  A full
    response is a 'response' of status 200; earlier means by (ts, record_id).
    The outcome is 'resolved' if the validators agree: equal ETags but for the
    weak mark where the revisit has one, else equal Last-Modified where it has
    one, else neither has any; 'mismatch' if not; 'no-earlier' if there is no
    response (or the revisit has no url or time).  A resolved revisit carries
    the response's headers, with the permitted fields of the revisit in their
    place (names in lower case, see ``lower_names``), and its digest; others their own headers.
    Records of any other kind, or without an id, give no row.

    The as-of join orders rows within (URL, time bucket) and hands the last
    response of each bucket on to later ones, so a hot URL is spread over its
    buckets; only ids travel, validators and headers are joined afterwards.
    """
    lower = lower_names("headers")
    rows = records.where(F.col("record_id").isNotNull()).select(
        "record_id", canonical_url("url").alias("url_key"), F.col("ts").cast("long").alias("ts"), "kind", "status", "etag",
        "last_modified", lower.alias("headers"), "payload_digest")
    full = F.coalesce((F.col("kind") == "response") & (F.col("status") == 200), F.lit(False))
    asked = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    line = rows.where("url_key is not null and ts is not null").where(full | asked).select(
        "url_key", F.floor(F.col("ts") / bucket).alias("_b"), "ts", "record_id", full.alias("_full"))
    here = Window.partitionBy("url_key", "_b").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = line.withColumn("_near", F.last(F.when(F.col("_full"), F.col("record_id")), ignorenulls=True).over(here)).where("not _full")
    ends = line.groupBy("url_key", "_b").agg(F.max(F.when(F.col("_full"), F.struct("ts", "record_id")))["record_id"].alias("_end"))
    past = Window.partitionBy("url_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_far", F.last("_end", ignorenulls=True).over(past)).select("url_key", "_b", "_far")
    found = near.join(carried, ["url_key", "_b"]).select("record_id", F.coalesce("_near", "_far").alias("refers_to"))
    stored = rows.where(full).select(F.col("record_id").alias("refers_to"), *(
        F.col(c).alias(f"_{c}") for c in ("etag", "last_modified", "headers", "payload_digest")))
    out = rows.where(asked).join(found, "record_id", "left").join(stored, "refers_to", "left")
    agree = F.when(F.col("etag").isNotNull(), _opaque(F.col("etag")).eqNullSafe(_opaque(F.col("_etag")))).when(
        F.col("last_modified").isNotNull(), F.col("last_modified").eqNullSafe(F.col("_last_modified"))).otherwise(
        F.col("_etag").isNull() & F.col("_last_modified").isNull())
    outcome = F.when(F.col("refers_to").isNull(), "no-earlier").when(agree, "resolved").otherwise("mismatch")
    fresh = F.map_filter("headers", lambda k, _: k.isin(*PERMITTED))
    merged = F.map_concat(F.map_filter("_headers", lambda k, _: ~F.array_contains(F.map_keys(fresh), k)), fresh)
    done = out.withColumn("outcome", outcome)
    ok = F.col("outcome") == "resolved"
    return done.select("record_id", "url_key", "ts", "refers_to", "outcome", F.when(ok, merged).otherwise(F.col("headers")).alias("headers"),
                       F.when(ok, F.col("_payload_digest")).alias("payload_digest"))


def with_payloads(resolved: DataFrame, responses: DataFrame) -> DataFrame:
    """Resolved revisits with the payload column of the responses (``record_id``, ``payload``)."""
    return resolved.where("outcome = 'resolved'").join(
        responses.select(F.col("record_id").alias("refers_to"), "payload"), "refers_to")


def capture_records(pages: DataFrame) -> DataFrame:
    """Archive records of a crawl that fetched every page and came back to it later.

    A response of each page, and a revisit of its URL in another spelling; the
    page number decides the time of the revisit and which validators it has.
    """
    p = pages.where("page_id is not null")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 16), F.lit('"'))
    n = lambda k: F.pmod("page_id", F.lit(k))
    etag = F.when(n(10) != 9, tag)
    modified = F.when(n(3) == 0, F.concat(F.lit("day "), F.col("page_id").cast("string")))
    digest = F.md5(F.coalesce("html", F.lit("")))
    response = p.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 600).alias("ts"), F.lit("response").alias("kind"),
        F.when(n(13) == 12, 404).otherwise(200).alias("status"), etag.alias("etag"), modified.alias("last_modified"),
        F.map_from_arrays(F.array(*map(F.lit, ("Content-Type", "Content-Length", "Date", "Cache-Control", "ETag"))), F.array(
            F.lit("text/html"), F.coalesce(F.length("html"), F.lit(0)).cast("string"), (F.col("page_id") * 600).cast("string"), F.lit("max-age=60"), etag)).alias("headers"),
        digest.alias("payload_digest"))
    scheme, host, rest = (F.regexp_extract("url", r"^([a-z]+)://([^/?#]*)(.*)$", k) for k in (1, 2, 3))
    port = F.when(scheme == "http", ":80").otherwise(":443")
    again = F.when(scheme.isin("http", "https"), F.concat(F.upper(scheme), F.lit("://"), F.upper(host), port, F.regexp_replace(rest, "#.*$", ""), F.lit("#again"))).otherwise(F.col("url"))
    seen = F.when(n(10) == 0, F.concat(F.lit("W/"), tag)).when(n(10) == 1, F.lit('"other"')).when(~n(10).isin(2, 9), tag)
    at = F.col("page_id") * 600 + F.when(n(11) == 0, -900).otherwise(n(7) * 43_200 + 30)
    revisit = p.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), again.alias("url"), at.alias("ts"), F.lit("revisit").alias("kind"),
        F.lit(304).alias("status"), seen.alias("etag"), modified.alias("last_modified"),
        F.map_from_arrays(F.array(*map(F.lit, ("Content-Length", "DATE", "Expires", "Cache-Control", "ETag"))), F.array(
            F.lit("0"), at.cast("string"), (at + 3600).cast("string"), F.concat(F.lit("max-age="), n(100).cast("string")), seen)).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"))
    return response.unionByName(revisit)
