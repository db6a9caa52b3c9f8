import base64
import hashlib

from lexspark.llm import url_filter, warc

PAGES = "page_id long, url string, html string, digest string, off long"


def expect(rows):
    best = {}
    for k, _, h, *_ in rows:
        best[h or ""] = max(best.get(h or "", -(2**62)), -(2**62) if k is None else k)
    out = []
    for k, _, h, *_ in rows:
        b, first = (h or "").encode(), best[h or ""]
        fresh = (-(2**62) if k is None else k) == first
        out.append((k, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if fresh else "revisit", None if fresh else first))
    return sorted(out, key=str)


def test_round_trip_with_magic_inside_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 5\r\n\r\nHTTP!\r\n\r\n"
    rows = [(1, "u", "x" + fake * 3 + "é", "", 0), (2, None, None, None, None), (3, "a\r\nb: c", "", "", 0), (4, "u", "WARC/1.0\r\n", "", 0), (5, "u", fake, "", 0), (6, "u", fake, "", 0), (6, "u", fake, "", 0), (None, "u", "n", "", 0), (None, "u", "long " * 400_000, "", 0), (8, "u", "WARC/1.0\r\nContent-Length: 999999\r\n\r\n", "", 0)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        got = warc.round_trip(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(map(tuple, got), key=str) == expect(rows)


def test_payloads_come_back(spark, tmp_path):
    rows = [(1, "u", "a WARC/1.0\r\n b\r\n\r\nc", "", 0), (2, "u", "ß" * 10, "", 0)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), str(tmp_path / "w"))
    got = {r.id: bytes(r.payload).decode() for r in warc.read(spark, str(tmp_path / "w"), with_payload=True).collect()}
    assert got == {"<urn:x-page:1>": rows[0][2], "<urn:x-page:2>": rows[1][2]}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("b.net", "/p", "block")]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(x) for x in "/?#" if x in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.index(x) for x in "?#" if x in rest], default=len(rest))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


def test_url_rules_against_brute_force(spark):
    urls = [None, "", "x", "http://", "http://A.com", "http://a.COM/", "https://www.example.com/en/1?x#y", "https://x.example.com/en/1", "https://example.com/en", "ftp://notexample.com/en/", "h://a.net/es/q", "h://a.net/fr/q", "h://c.b.net/pq", "h://com/", "h://x://b.com/", "h://" + "a." * 3000 + "com/" + "p/" * 3000, "h://É.com/é\n#", "h://a..com/"]
    rows = [(i, u, 1, "z", "v") for i, u in enumerate(urls)] + [(0, None, 1, "z", "v"), (None, "h://a.com/", 1, "z", "v"), (6, urls[6], 1, "z", "v")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, host int, rule string, verdict string"), spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((k, *judged(u)) for k, u, *_ in rows), key=str)


def test_url_rules_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    page = spark.createDataFrame([(1, "h://a.com/")], "page_id long, url string")
    assert [tuple(r) for r in url_filter.judge(page, none).collect()] == [(1, "a.com", "/", None, "allow")]
    assert url_filter.judge(page.limit(0), spark.createDataFrame(RULES, none.schema)).collect() == []
