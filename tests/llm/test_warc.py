import base64
import gzip
import hashlib

from sparkloom.llm import warc
from sparkloom.staging import fresh_path

PAGES = [
    (5, "http://a.org/x?y#z", "<p>one</p>"), (3, "http://b.org", "<p>one</p>"), (7, None, "<p>one</p>"), (1, "http://c.org/ü \r\nX: y", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (2, "http://d.org", None), (4, "", ""), (None, "http://e.org", "<p>one</p>"), (9, "http://f.org", "alone"), (9, "http://f.org", "alone"), (8, "http://g.org", "x" * 200000),
]
SCHEMA = "page_id long, url string, html string, digest string"


def brute(rows, least=0):
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == h and j is not None]
        first = min(same, default=None) if len(h) >= least else i
        kind = "response" if i == first else "revisit"
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), kind, None if kind == "response" else first))
    return sorted(out, key=str)


def test_digests_against_brute_force(spark):
    df = spark.createDataFrame([(*p, "d") for p in PAGES], SCHEMA)
    for least in (0, 5, 1000):
        assert sorted((tuple(r) for r in warc.archive_digests(df, least).collect()), key=str) == brute(PAGES, least)
    assert warc.archive_digests(df.limit(0)).collect() == []


def test_transactions_are_whole(spark):
    df = spark.createDataFrame([(*p, "d") for p in PAGES[:6]], SCHEMA)
    path = fresh_path(spark, "warc-test")
    warc.write_archives(df, path)
    rows = {int(r.metadata.page_id): r for r in warc.assemble(warc.read_records(spark, path, with_payload=True)).collect()}
    assert sorted(rows) == [1, 2, 3, 4, 5, 7]
    assert rows[1].capture.payload == PAGES[3][2] and rows[1].capture.uri == "http://c.org/ü%20%0D%0AX:%20y"
    assert rows[3].capture.type == "response" and rows[5].capture.type == "revisit" and rows[5].capture.refers_to == rows[3].capture_id
    assert all(r.request.concurrent_to == r.metadata.concurrent_to == r.capture.record_id == r.capture_id and r.copies == 1 for r in rows.values())


def test_archives_of_other_writers():
    one = warc.capture("1", "http://a.org", "<p>", None).encode() + b"\r\n\r\n"
    want = list(warc.parse_archive(one))
    assert [f["warc-type"] for f, _ in want] == ["request", "response", "metadata"]
    members = gzip.compress(one) + gzip.compress(one)
    assert list(warc.parse_archive(members)) == want * 2 and list(warc.parse_archive(b"")) == []
