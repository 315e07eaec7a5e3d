from newsgraph.llm import warc
from newsgraph.llm.oracle import SQL
from newsgraph.llm.queries import QUERIES
from oracle_check import compare, duck

SCHEMA = ("record_id long, url string, ts long, kind string, status int, etag string, last_modified string, headers map<string,string>, "
          "payload_digest string, _b string, _near string, outcome string")


def rec(i, url, ts, kind, etag=None, mod=None, headers=None, digest=None, status=None):
    return (i, url, ts, kind, status or (200 if kind == "response" else 304), etag, mod, headers, digest, "x", "y", "z")


def test_query(spark):
    d = "/root/testdata/sf0.01"
    assert compare(spark, d, "op9_warc", QUERIES["op9_warc"], SQL["op9_warc"], duck(d), verbose=False)


def test_canonical_url(spark):
    same = ["http://www.A.com:80/x/", "https://a.com:443/x", "HTTPS://user@a.com/x#top", " http://a.com/x?utm_source=f "]
    other = ["http://a.com:8080/x", "http://a.com/X", "http://a.com/x?b=1&a=2", "http://a.com/x?a=2&&b=1&utm_x=3", "not a url", "", None, "http://a.com"]
    df = spark.createDataFrame([(u,) for u in same + other], "u string").select(warc.canonical_url("u")).collect()
    keys = [r[0] for r in df]
    assert set(keys[:4]) == {"a.com/x"}
    assert keys[4:] == ["a.com:8080/x", "a.com/X", "a.com/x?a=2&b=1", "a.com/x?a=2&b=1", "not a url", "", None, "a.com/"]


def test_rules(spark):
    day = warc.BUCKET
    rows = [
        rec(1, "http://a.com/x", 10, "response", '"1"', "m", {"ETag": '"1"', "Content-Type": "t", "Date": "10"}, "d1"),
        rec(2, "http://a.com/x", 20, "response", '"2"', None, {"Content-Type": "t2", "X": None}, "d2"),
        rec(3, "http://a.com/x", 15, "response", '"9"', None, None, "d9", 404),
        rec(10, "https://www.a.com/x/", 16, "revisit", 'W/"1"', None, {"date": "16", "Content-Length": "0", "Set-Cookie": "c"}),
        rec(11, "http://a.com/x", 20, "revisit", '"2"', None, None),
        rec(0, "http://a.com/x", 20, "revisit", '"1"', None, None),  # the same second, a smaller id: before record 2
        rec(12, "http://a.com/x", 5, "revisit", '"1"', None, None),
        rec(13, "http://a.com/x", 5 * day, "revisit", '"2"', None, {"Expires": "e"}),
        rec(14, "http://a.com/x", 5 * day, "revisit", '"1"', None, None),
        rec(15, "http://a.com/x", 17, "revisit", None, "m", None),
        rec(16, "http://a.com/x", 17, "revisit", None, "other", None),
        rec(17, "http://a.com/x", 17, "revisit", None, None, None),
        rec(20, None, 30, "revisit", '"1"'), rec(21, "http://a.com/x", None, "revisit", '"1"'), rec(22, "junk", 40, "revisit"),
        rec(23, "junk", 30, "response", None, None, {}, "dj"), rec(24, "http://a.com/x", 1, "other"), rec(None, "http://a.com/x", 1, "revisit"),
        rec(25, "http://a.com/x", 12, None),
    ]
    out = warc.resolve(spark.createDataFrame(rows, SCHEMA))
    got = {r["record_id"]: r for r in out.collect()}
    assert {i: (r["refers_to"], r["outcome"]) for i, r in got.items()} == {
        10: (1, "resolved"), 11: (2, "resolved"), 0: (1, "resolved"), 12: (None, "no-earlier"), 13: (2, "resolved"), 14: (2, "mismatch"),
        15: (1, "resolved"), 16: (1, "mismatch"), 17: (1, "mismatch"), 20: (None, "no-earlier"), 21: (None, "no-earlier"), 22: (23, "resolved")}
    assert got[10]["headers"] == {"etag": '"1"', "content-type": "t", "date": "16"} and got[10]["payload_digest"] == "d1"
    assert got[13]["headers"] == {"content-type": "t2", "expires": "e"} and got[14]["payload_digest"] is None
    bodies = warc.with_payloads(out, spark.createDataFrame([(1, "body")], "record_id long, payload string"))
    assert {r["record_id"] for r in bodies.collect()} == {10, 0, 15}


def test_names_that_differ_in_case(spark):
    rows = [rec(1, "http://a.com/", 1, "response", '"1"', None, {"ETag": '"1"', "etag": '"x"', "Date": "d", "DATE": "D", "date": None, "a": "b"}),
            rec(2, "http://a.com/", 2, "revisit", '"1"', None, {"expires": "e", "Expires": "E", "EXPIRES": None})]
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [r["headers"] for r in got] == [{"etag": '"1"', "date": "D", "a": "b", "expires": "E"}]


def test_hot_url_and_empty(spark):
    rows = [rec(i, "http://h.com/", i * 7000, "response" if i % 5 == 0 else "revisit", '"t"', None, {}, str(i)) for i in range(600)]
    got = warc.resolve(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["refers_to"] == r["record_id"] // 5 * 5 for r in got) and len(got) == 480
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).collect() == []
    assert warc.capture_records(spark.createDataFrame([(None, None, None), (3, None, None)], "page_id long, url string, html string")).count() == 2
