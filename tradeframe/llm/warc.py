"""WARC derivatives: of each response record a metadata record and a plain-text conversion record, linked to it."""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeframe.llm.shared import small_batches
from tradeframe.llm.token_files import put

#: The space of the record ids, which name content: the same input has the same ids.
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-derivatives")

#: Elements whose content isn't shown; of an unclosed one all that follows is hidden, but for a head.
HIDDEN = "script style template noscript head".split()

#: Elements that begin and end lines.
BREAKS = frozenset(
    "p div br hr li ul ol dl dt dd tr table thead tbody h1 h2 h3 h4 h5 h6 article section nav header footer main aside form blockquote pre body title".split()
)

OPEN = re.compile(r"<(!--|/?[A-Za-z][A-Za-z0-9-]*|[!?])")
CLOSES = {name: re.compile(rf"</{name}\s*>", re.I) for name in [*HIDDEN, "title"]} | {"!--": re.compile("-->")}
STOP = re.compile("[>\"']")
HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
LANGUAGE = re.compile(r"""\blang\s*=\s*["']?([A-Za-z-]+)""", re.I)
SPACES, LINES = re.compile(r"[^\S\n]+"), re.compile(r"\s*\n\s*")


COLUMNS = {
    "record_type": "string", "record_id": "string", "refers_to": "string", "refers_to_target_uri": "string", "refers_to_date": "string",
    "target_uri": "string", "date": "string", "content_type": "string", "content_length": "bigint", "block_digest": "string",
    "payload_digest": "string", "source_headers": "string", "block": "string",
}


class Page:
    """What a page says, found in one pass from left to right: shown (its text, blocks on lines of their own, white space
    drawn together, no scripts, styles, comments or tags), title, language, links.

    No place is looked at more than a few times, whatever the page: what isn't there after a place isn't looked for again."""

    def __init__(self, page: str):
        self.page, self.links, self.title, self.language = page, [], None, None
        #: of a pattern, the last match that was found, or None if there is none any more
        self._next: dict[str, re.Match | None] = {}
        parts, at = [], 0
        while (m := OPEN.search(page, at)) is not None:
            name = m[1].lower()
            parts.append(page[at : m.start()])
            if name in CLOSES and name != "title":
                if name == "head":
                    self._head(m.end())
                close = self._after(name, CLOSES[name], m.end())
                if close is not None or name != "head":
                    parts.append(" ")
                    at = close.end() if close is not None else len(page)
                    continue
            end = self._tag_end(m.end())
            if end is None:
                # no tag is closed from here on: all is text
                at = m.start()
                break
            if name == "a" and (href := HREF.search(page, m.end(), end)):
                self.links.append(html.unescape(href[1] or href[2] or href[3] or ""))
            elif name == "html" and self.language is None and (lang := LANGUAGE.search(page, m.end(), end)):
                self.language = lang[1]
            elif name == "title":
                self._title(end)
            if name.lstrip("/") in BREAKS:
                parts.append("\n")
            at = end
        parts.append(page[at:])
        self.shown = LINES.sub("\n", SPACES.sub(" ", html.unescape("".join(parts)))).strip()

    def _after(self, name: str, pattern: re.Pattern, at: int) -> re.Match | None:
        """The first match at or after a place; places rise."""
        if name not in self._next or (m := self._next[name]) is not None and m.start() < at:
            self._next[name] = pattern.search(self.page, at)
        return self._next[name]

    def _tag_end(self, at: int) -> int | None:
        """Behind the > that ends a tag; those in quotes don't."""
        while (m := STOP.search(self.page, at)) is not None:
            if m[0] == ">":
                return m.end()
            close = self._after(m[0], re.compile(m[0]), m.end())
            at = m.end() if close is None else close.end()
        return None

    def _head(self, at: int) -> None:
        """A head isn't shown, but its title is read."""
        close = self._after("head", CLOSES["head"], at)
        m = re.compile("<title\\b", re.I).search(self.page, at, close.start() if close is not None else at)
        if m is not None and (end := self._tag_end(m.end())) is not None:
            self._title(end)

    def _title(self, at: int) -> None:
        if self.title is None and (close := self._after("title", CLOSES["title"], at)) is not None:
            self.title = SPACES.sub(" ", html.unescape(self.page[at : close.start()]).replace("\n", " ")).strip()


def plain_text(page: str) -> str:
    return Page(page).shown


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(31).join(parts))}>"


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (page, target_uri, date, source_headers, payload) of a table of pages, which has no headers, ids or
    digests of its own. A null page has a null payload."""
    length = F.length(F.encode(F.col(html_col), "UTF-8"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.coalesce(length, F.lit(0)).cast("string"))
    return pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).alias("payload"), F.col(url_col).alias("target_uri"), F.lit(date).alias("date"), headers.alias("source_headers"))


#: Columns of responses; those of SOURCE_OWN may be missing.
SOURCE = ["page", "payload", "target_uri", "date", "source_headers"]
SOURCE_OWN = ["source_id", "source_payload_digest"]


def derivatives(page: int | None, payload: str | None, uri: str | None, date: str | None, headers: str | None, source_id: str | None, payload_digest: str | None) -> list[tuple]:
    """The two records of one response."""
    body = (payload or "").encode()
    if source_id is None:
        source_id = record_id("response", uri or "", date or "", digest((headers or "").encode() + b"\r\n\r\n" + body))
    of_payload = payload_digest or digest(body)
    read = Page(payload or "")
    fields = [("title", read.title), ("language", read.language), ("textLength", str(len(read.shown))), *(("outlink", x) for x in read.links)]
    meta = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    out = []
    for kind, content, text in (("metadata", "application/warc-fields", meta), ("conversion", "text/plain", read.shown)):
        raw = text.encode()
        out.append((page, kind, record_id(kind, source_id), source_id, uri, date, uri, date, content, len(raw), digest(raw), of_payload, headers, text))
    return out


def derivative_records(source: DataFrame) -> DataFrame:
    """Two rows for each response (page, payload, target_uri, date, source_headers and, where known, source_id and
    source_payload_digest): a metadata record with title, language and outlinks, and a conversion record with the text;
    both refer to the response by its record id, target and date, and keep its headers and its payload's digest. A
    response without an id gets one made of its content, one without a digest that of its payload.

    A null or empty payload gives an empty text and no outlinks; other nulls stay null and count as empty in ids;
    repeated rows give equal records; columns of other names aren't read; an empty table gives no rows."""
    rows = source.select(*SOURCE, *(F.col(c) if c in source.columns else F.lit(None).cast("string").alias(c) for c in SOURCE_OWN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in derivatives(*row)]
            kinds = [pa.int64(), *(pa.int64() if k == "bigint" else pa.string() for k in COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["page", *COLUMNS])

    return rows.mapInArrow(run, "page bigint, " + ", ".join(f"{k} {t}" for k, t in COLUMNS.items()))


def record_bytes(row: dict) -> bytes:
    """A record as WARC/1.1 has it."""
    named = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "date"), ("WARC-Target-URI", "target_uri"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "refers_to_target_uri"), ("WARC-Refers-To-Date", "refers_to_date"), ("WARC-Block-Digest", "block_digest"), ("WARC-Source-Payload-Digest", "payload_digest"), ("Content-Type", "content_type")]
    head = "".join(f"{name}: {row[key]}\r\n" for name, key in named if row[key] is not None)
    kept = "".join(f"X-Source-Header: {line}\r\n" for line in (row["source_headers"] or "").split("\r\n") if line)
    raw = (row["block"] or "").encode()
    return f"WARC/1.1\r\n{head}{kept}Content-Length: {len(raw)}\r\n\r\n".encode() + raw + b"\r\n\r\n"


def write_warc(records: DataFrame, path: str, most: int = 64 << 20) -> int:
    """Write records to `path`, a folder that all machines see: a gzip member for each record, files of about `most` bytes.
    Returns the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, size, files = [], 0, 0, 0

        def roll() -> None:
            nonlocal parts, size, files
            put(f"{path}/part-{TaskContext.get().partitionId():06d}-{files:04d}.warc.gz", b"".join(parts))
            parts, size, files = [], 0, files + 1

        for batch in small_batches(batches, block_at):
            for row in batch.to_pylist():
                parts.append(gzip.compress(record_bytes(row), mtime=0))
                n, size = n + 1, size + len(parts[-1])
                if size >= most:
                    roll()
        if parts:
            roll()
        yield pa.RecordBatch.from_pydict({"n": [n]})

    block_at = records.columns.index("block")
    return records.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_warc(content: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Records of one file, plain or gzip by member, one after the other: headers, each with its values, and the block."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()) and line.strip():
            name, _, value = line.decode("utf-8", "replace").rstrip("\r\n").partition(":")
            headers.setdefault(name, []).append(value.strip())
        yield headers, stream.read(int(headers.get("Content-Length", ["0"])[0]))


def http_header(head: str, name: str) -> str | None:
    """A header's value, by its name in any case; of several the last."""
    found = re.findall(rf"(?im)^{re.escape(name)}[ \t]*:[ \t]*(.*?)[ \t]*\r?$", head)
    return found[-1] if found else None


def unchunked(body: bytes) -> bytes:
    """A body sent in chunks, put together; one that isn't made of chunks up to its end stays as it is from there on."""
    parts, at = [], 0
    while m := CHUNK.match(body, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(parts)
        parts.append(body[m.end() : m.end() + size])
        at = m.end() + size
        at += 2 if body[at : at + 2] == b"\r\n" else 0
    return b"".join([*parts, body[at:]])


#: The line before a chunk.
CHUNK = re.compile(rb"([0-9A-Fa-f]{1,8})[ \t]*(?:;[^\r\n]*)?\r\n")


def unpacked(body: bytes, coding: str) -> bytes:
    """A body in gzip or deflate, unpacked as far as it goes; other codings, and bodies that aren't in theirs, stay as they are."""
    for name in reversed([c.strip().lower() for c in coding.split(",")]):
        if name not in ("gzip", "x-gzip", "deflate"):
            continue
        for bits in (31,) if name != "deflate" else (15, -15):
            worker = zlib.decompressobj(bits)
            try:
                body = worker.decompress(body)
                break
            except zlib.error:
                continue
    return body


def payload_text(head: str, body: bytes) -> str:
    """The text of an HTTP response's body: chunks put together, unpacked, and read in the charset that its header names, UTF-8
    where there is none or none that is known; bytes that aren't of it are replaced."""
    if (http_header(head, "Transfer-Encoding") or "").lower().endswith("chunked"):
        body = unchunked(body)
    body = unpacked(body, http_header(head, "Content-Encoding") or "")
    m = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", http_header(head, "Content-Type") or "", re.I)
    try:
        return body.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def warc_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files under `path`, as derivative_records takes them, with the ids and digests that they
    have; page is null. A file is read by one task: files of up to 2 GB, of which many make a crawl. A block without an
    HTTP header is all payload; a body is put together, unpacked and read as its header says (payload_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for headers, block in read_warc(content.as_py()):
                    one = lambda name: headers.get(name, [None])[0]  # noqa: B023, E731
                    if one("WARC-Type") != "response":
                        continue
                    head, mark, body = block.partition(b"\r\n\r\n")
                    if not mark or not head.startswith(b"HTTP/"):
                        head, body = b"", block
                    lines = head.decode("utf-8", "replace")
                    row = [None, payload_text(lines, body), one("WARC-Target-URI"), one("WARC-Date"), lines, one("WARC-Record-ID"), one("WARC-Payload-Digest")]
                    kinds = [pa.int64(), *[pa.string()] * 6]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], [*SOURCE, *SOURCE_OWN])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page bigint, " + ", ".join(f"{c} string" for c in [*SOURCE[1:], *SOURCE_OWN]))
