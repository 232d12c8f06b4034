"""Archive files, plain and compressed, read and resolved."""

import gzip

from arborlight.llm import warc


def record(kind, uri, date, http, body=b"", rid="1"):
    payload = http.encode() + b"\r\n\r\n" + body
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\nContent-Length: {len(payload)}"
    return head.encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


FIRST = record("response", "http://a.org/x", "2024-01-01T00:00:00Z", 'HTTP/1.1 200 OK\r\nETag: "t"\r\nServer: s', b"hello WARC/ is not a record", "1")
AGAIN = record("revisit", "http://www.a.org/x", "2024-01-02T00:00:00Z", 'HTTP/1.1 304 Not Modified\r\nETag: W/"t"\r\nDate: d2', b"", "2")
INFO = record("warcinfo", "", "2024-01-01T00:00:00Z", "software: x")
BAD = record("revisit", "http://b.org/", "no date", "HTTP/1.1 304 Not Modified", b"", "3")


def test_files_are_read_and_resolved(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(INFO + FIRST + b"junk\r\n" + BAD)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/b.warc.gz").write_bytes(gzip.compress(INFO) + gzip.compress(AGAIN))
    (tmp_path / "other.txt").write_bytes(FIRST)
    records = warc.read_warc(spark, str(tmp_path))
    assert {(r.kind, r.url, r.body_length) for r in records.collect()} == {("response", "http://a.org/x", 27), ("revisit", "http://www.a.org/x", 0), ("revisit", "http://b.org/", 0)}
    got = {r.url_key: (r.status, r.headers) for r in warc.resolve_revisits(records).collect()}
    assert got["a.org/x"] == ("resolved", {"server": "s", "etag": 'W/"t"', "date": "d2"}) and got["b.org"][0] == "missing"


def test_cut_files_end_at_the_cut():
    assert [r[3] for r in warc.parse_warc(FIRST + AGAIN[:-30])] == ["response"]
    assert list(warc.parse_warc(b"")) == list(warc.parse_warc(b"\x1f\x8bxx")) == list(warc.parse_warc(b"WARC/1.0\r\nno end")) == []
