import base64
import gzip
import hashlib
from pathlib import Path

from quernel.llm import warc

SCHEMA = "page_id long, url string, html string, file string, offset long, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "f", 1, "d") for r in rows], SCHEMA).repartition(3)


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows):
    out = []
    for i, _, html in rows:
        equal = [j for j, _, other in rows if (other or "") == (html or "") and j is not None]
        top = max(equal, default=None)
        revisit = top is not None and i != top
        out.append((i, len((html or "").encode()), digest(html), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"https://www.site{i % 7}.example/a/{i}?q={i % 5}", f"<p>page {i % 40}</p>é" * (1 + i % 9)) for i in range(300)]
ODD = [
    (500, None, "no url"), (501, "", ""), (502, "http://[bad", "broken host"), (503, "http://x.example/ a b\n", "blanks"), (504, "https://x.example:8443/p", None), (505, "http://x.example/", None),
    (506, "http://x.example/", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (507, "http://x.example/", "long " * 100_000), (None, "http://n.example/", "null id"), (None, "http://n.example/", "page of 508"), (508, "http://n.example/", "page of 508"),
    (509, "http://r.example/", "twice"), (509, "http://r.example/", "twice"),
]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    folder = f"file://{tmp_path}/archives"
    got = warc.archived(pages(spark, ROWS + ODD), folder, payload=True).collect()
    found = sorted(((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got), key=str)
    assert found == brute(ROWS + ODD)
    html = {i: t for i, _, t in ROWS + ODD if i is not None}
    assert all(bytes(x.payload) == (html[x.page_id] or "").encode() for x in got if x.record_type == "response" and x.page_id is not None)
    # every file is a row of gzip members that begin with a record's head
    files = sorted(Path(tmp_path, "archives").glob("archive-*.warc.gz"))
    assert len(files) > 3 and not list(Path(tmp_path, "archives").glob("*.gz.*"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC-Record-ID: ") for f in files) == len(ROWS + ODD)


def test_small_payloads_are_all_responses(spark, tmp_path):
    rows = [(1, "http://a.example/", "ab"), (2, "http://a.example/", "ab"), (3, "http://a.example/", "abcd"), (4, "http://a.example/", "abcd")]
    folder = f"file://{tmp_path}/archives"
    captures = warc.write_archives(pages(spark, rows), folder, min_bytes=3)
    kinds = {x.page_id: x.record_type for x in warc.read_records(captures, folder).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_lookup_of_what_is_not_there(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    captures = warc.write_archives(pages(spark, ROWS[:50]), folder)
    parts = warc.build_index(captures, folder)
    wanted = spark.createDataFrame([(warc.url_key(ROWS[3][1]), 3), (warc.url_key(ROWS[3][1]), 4), ("", 1), ("zzz", 9), (warc.url_key(ROWS[3][1]), 3)], "url_key string, page_id long")
    assert [(x.url_key, x.page_id) for x in warc.lookup(wanted, folder, parts).collect()] == [(warc.url_key(ROWS[3][1]), 3)]


def test_url_keys():
    assert warc.url_key("https://www.a.example/x/y?z=1#part") == "example,a,www)/x/y?z=1"
    assert warc.url_key("http://A.example:80") == "example,a)/" and warc.url_key("http://a.example:8080/") == "example,a:8080)/"


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], SCHEMA)).count() == 0
