import gzip
import io

import pytest

from metricloom.llm import urlfilter, warc

URLS = [
    None, "", "no scheme", "http://", "http://A.Net/x", "http://a.net", "https://sub.example.net/en/p?q=1", "https://example.net/fr/x", "http://example.com/de/y#z",
    "http://example.com/den", "http://myexample.com/de/y", "http://b.org/fr/casino", "http://x.org/casino-win", "http://x.org/casinos", "http://ads.example.org/track",
    "http://ads.example.org/ads", "ftp://X.org?free=bonus", "http://ü.org/ädult/adult" + "/a" * 5000, "://casino",
]


def test_rules_and_words(spark):
    pages = spark.createDataFrame([(i, u, "rule") for i, u in enumerate(URLS)] + [(4, URLS[4], None)], "page_id long, url string, rule string")
    got = [(r["page_id"], r["host"], r["path"][:9], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).orderBy("page_id").collect()]
    assert got == [
        (0, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "a.net", "/x", "net/", "block"), (4, "a.net", "/x", "net/", "block"),
        (5, "a.net", "", None, "allow"), (6, "sub.example.net", "/en/p", "example.net/en/", "allow"), (7, "example.net", "/fr/x", "net/", "block"), (8, "example.com", "/de/y", "example.com/de/", "block"),
        (9, "example.com", "/den", None, "allow"), (10, "myexample.com", "/de/y", None, "allow"), (11, "b.org", "/fr/casin", "org/fr/", "allow"), (12, "x.org", "/casino-w", None, "block"),
        (13, "x.org", "/casinos", None, "allow"), (14, "ads.example.org", "/track", None, "block"), (15, "ads.example.org", "/ads", None, "allow"), (16, "x.org", "", None, "block"),
        (17, "ü.org", "/ädult/ad", None, "block"), (18, "casino", "", None, "block"),
    ]
    assert urlfilter.judge(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    long, longer = "é" * 500, "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 90000
    rows = [(1, "http://a/\r\nEvil: 1", long), (5, "http://b", long), (3, None, long), (2, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", longer), (8, "u", longer), (8, "u", longer), (None, "u", longer)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)


def test_round_trip(spark, pages):
    path = warc.archive(pages)
    back = warc.read(spark, path)
    assert back.filter("digest_ok = false").count() == 0
    got = {(r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digest(back).collect()}
    n = len(pages.filter("page_id = 7").first()["html"])
    assert got == {(1, 1000, "revisit", 5), (5, 1000, "response", None), (3, 1000, "revisit", 5), (2, 5, "response", None), (4, 5, "response", None), (6, 0, "response", None), (7, n, "revisit", 8), (8, n, "response", None), (None, n, "revisit", 8)}
    texts = {r["record_id"]: r["payload"].decode() for r in back.filter("record_type = 'response'").collect()}
    assert texts["urn:page:5"] == "é" * 500 and texts["urn:page:6"] == ""
    assert warc.read(spark, warc.archive(pages.limit(0))).count() == 0


def test_predicates_reach_the_headers(spark, pages):
    path = warc.archive(pages)
    found = warc.read(spark, path, payload=False).filter("record_type = 'revisit' and target_uri like 'http%'")
    assert "PushedFilters" in found._jdf.queryExecution().toString() or found.count() == 1
    assert [r["record_id"] for r in found.collect()] == ["urn:page:1"]
    seen = []

    class Spy(io.BytesIO):
        def read(self, n=-1):
            data = super().read(n)
            seen.append(len(data))
            return data

    noise = "".join(map(chr, range(0x100, 0x8000)))
    rows = [{"record_id": f"urn:{i}", "record_type": t, "target_uri": "u", "date": "d", "payload_digest": "x", "payload_length": 1, "refers_to": None, "payload": noise.encode() * 3} for i, t in enumerate(("response", "other", "response"))]
    packed = b"".join(warc.member(warc.record(r)) for r in rows)
    file = Spy(packed)
    assert [r["record_id"] for r in warc.records(file, len(packed), lambda h: h["warc-type"] == "other", True)] == ["urn:1"]
    assert sum(seen) < 0.6 * len(packed)


def test_foreign_archives():
    rows = [{"record_id": f"urn:{i}", "record_type": "response", "target_uri": "u", "date": "d", "payload_digest": "x", "payload_length": 3, "refers_to": None, "payload": b"abc" * i} for i in range(4)]
    for form in (b"".join(map(warc.record, rows)), b"".join(gzip.compress(warc.record(r)) for r in rows)):
        got = list(warc.records(io.BytesIO(form), len(form), lambda h: True, True))
        assert [r["payload"] for r in got] == [b"abc" * i for i in range(4)]
        assert len(list(warc.records(io.BytesIO(form), len(form), lambda h: True, False))) == 4
