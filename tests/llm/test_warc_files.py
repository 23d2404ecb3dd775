"""WARC derivatives of real records, written and read back, and pages that are hard to read."""

import gzip
import time
import zlib

import pytest

from tradeframe.llm.shared import scratch
from tradeframe.llm.warc import Page, derivative_records, payload_text, read_warc, responses, unchunked, warc_responses, write_warc


@pytest.mark.parametrize("part", ["<head ", "<title>", "<script ", "<a ", "<a \"", "<a '>", "<!-- ", "<p <p", "</p", "<", "<title", "<html lang", "</script ", "<a href=", "<head><title", "'\"<a>", "&amp", "<!-", "<noscript></"])
def test_long_pages_take_time_in_proportion(part):
    page = part * (1_000_000 // len(part))
    began = time.process_time()
    Page(page)
    assert time.process_time() - began < 6


def test_page():
    page = Page("<HTML LANG=fr><head><title>T &lt; 1</title><meta x='>'></head><p title='a>b'>x<br>y <i>z</i><style>q</style></p>1 < 2<a HREF=u>l</a><a name=k>m</a><script>never")
    assert (page.shown, page.title, page.language, page.links) == ("x\ny z\n1 < 2lm", "T < 1", "fr", ["u"])
    assert Page("").shown == "" and Page("a <head b").shown == "a <head b" and Page("<!-- x").shown == ""


def test_bodies_are_read_as_their_headers_say():
    text = "<p>Größe 1</p>" * 20
    raw = text.encode()
    chunks = b"".join(b"%x;a=b\r\n" % len(raw[i : i + 7]) + raw[i : i + 7] + b"\r\n" for i in range(0, len(raw), 7)) + b"0\r\n\r\n"
    head = lambda *lines: "\r\n".join(["HTTP/1.1 200 OK", *lines])
    assert payload_text(head("transfer-encoding: chunked"), chunks) == text
    assert payload_text(head("Content-Encoding: gzip"), gzip.compress(raw)) == text
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    for body in (zlib.compress(raw), packer.compress(raw) + packer.flush()):
        assert payload_text(head("Content-Encoding: deflate"), body) == text
    packed = gzip.compress(raw)
    assert payload_text(head("Transfer-Encoding: chunked", "Content-Encoding: gzip", "Content-Type: text/html; charset=utf-8"), b"%X\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n") == text
    assert payload_text(head("Content-Type: text/html; charset=ISO-8859-1"), text.encode("latin-1")) == text
    assert payload_text(head('Content-Type: text/html; charset="no-such"'), raw) == text
    assert payload_text(head("Content-Encoding: gzip"), raw) == text and payload_text(head("Content-Encoding: br"), b"ab") == "ab"
    assert payload_text(head("Content-Encoding: gzip"), packed[:-8]) == text  # cut short
    assert unchunked(b"3\r\nabc\r\nrest") == b"abcrest" and unchunked(b"") == b"" and payload_text("", b"") == ""


def test_round_trip(spark):
    body = "<title>t</title><p>Grün</p><a href='/x'>y</a>"
    http = f"HTTP/1.1 200 OK\r\nX-A: 1\r\n\r\n{body}".encode()
    record = lambda kind, name, block: (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 2024-02-03T04:05:06Z\r\nWARC-Target-URI: http://h/\r\nWARC-Payload-Digest: sha1:{name}\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    files = [(gzip.compress(record("warcinfo", "i", b"software: s\r\n")) + gzip.compress(record("response", "r1", http)),), (record("request", "q", b"GET /") + record("response", "r2", b"plain"),)]
    where = scratch(spark, "crawl")
    import os

    os.makedirs(where)
    for i, (content,) in enumerate(files):
        with open(f"{where}/{i}.warc", "wb") as out:
            out.write(content)
    records = derivative_records(warc_responses(spark, where))
    rows = {(r.refers_to, r.record_type): r for r in records.collect()}
    assert set(rows) == {(f"<urn:uuid:{x}>", k) for x in ("r1", "r2") for k in ("metadata", "conversion")}
    one = rows["<urn:uuid:r1>", "conversion"]
    assert one.block == "t\nGrün\ny"  # a title outside a head is shown
    for kind in ("conversion", "metadata"):
        one = rows["<urn:uuid:r1>", kind]
        assert one.payload_digest == "sha1:r1"
        assert one.refers_to_date == one.date == "2024-02-03T04:05:06Z"
        assert one.target_uri == one.refers_to_target_uri == "http://h/"
        assert one.source_headers == "HTTP/1.1 200 OK\r\nX-A: 1"
    plain = rows["<urn:uuid:r2>", "conversion"]
    assert (plain.block, plain.source_headers, plain.payload_digest) == ("plain", "", "sha1:r2")
    path = scratch(spark, "derived")
    assert write_warc(records, path, most=200) == 4
    names = sorted(os.listdir(path))
    back = [x for n in names if n.endswith(".gz") for x in read_warc(open(f"{path}/{n}", "rb").read())]
    kept = {(h["WARC-Refers-To"][0], h["WARC-Type"][0]): h for h, _ in back}
    for (source, kind), h in kept.items():
        row = rows[source, kind]
        assert h["WARC-Record-ID"] == [row.record_id] and h["WARC-Block-Digest"] == [row.block_digest] and h["WARC-Source-Payload-Digest"] == [row.payload_digest]
        assert h.get("X-Source-Header", []) == [x for x in row.source_headers.split("\r\n") if x]
    assert len(names) > 1 and sorted((h["WARC-Refers-To"][0], h["WARC-Type"][0], b.decode()) for h, b in back) == sorted((r.refers_to, r.record_type, r.block) for r in rows.values())
    pages = spark.createDataFrame([(1, "u", "<p>a", "z"), (1, "u", "<p>a", "z"), (None, None, None, None)], "page_id bigint, url string, html string, date string")
    assert derivative_records(responses(pages)).count() == 6
