"""WARC derivatives: responses to linked metadata and plain-text conversion records.

``records`` cuts WARC files (plain, or with a gzip member a record) into records. ``responses`` writes crawled pages
as response records. ``derivatives`` parses response records and makes, of each, a metadata record and a conversion
record. Both carry WARC-Refers-To with the response's WARC-Record-ID, its WARC-Target-URI and WARC-Date, and their
own block digest. The metadata record's block (application/warc-fields) keeps the source's WARC and HTTP headers and
digests under a prefix, names the conversion record, and lists whether the source's digests hold. The conversion
record's block is the page's visible text in UTF-8.

Text: comments, scripts, styles and the head are dropped, block-level tags break lines, other tags vanish,
character references are resolved, white space is collapsed, empty lines go. A head without an end tag ends at the
first text or element that can't be in a head; a comment, script or style without one goes on to the page's end. Time is
linear in the page, whatever is left open.

Record ids are made from the source's id and the kind, so a task that runs again makes the same records. A record
is row-local: no shuffle, memory follows the longest page. A null html is an empty page, a null url becomes
urn:page:<page_id>, a null page_id is left out of ids (which then hang on url and html). Repeated pages give equal
records. Records of other types than response give no derivatives. A record that can't be parsed gives one row of
kind 'error' with the reason. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import html as entities
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import small_batches, table

DATE = "2024-01-01T00:00:00Z"
HIDDEN = re.compile(r"<!--|<(script|style|noscript|template|head)\b", re.I)
END = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "head")}
BODY = re.compile(r"<body\b", re.I)
#: A head as far as only what can be in one follows.
HEAD = re.compile(
    r"<head\b[^>]*>(?:\s+|<!--.*?-->|<(title|script|style|noscript|noframes|template)\b[^>]*>.*?</\1\s*>|<(?:base|basefont|bgsound|link|meta)\b[^>]*>)*",
    re.S | re.I,
)
#: The rest of a tag: quoted values may hold '>'. Where quotes don't pair up before the next '<', the first '>' ends it.
REST = r"""(?:(?:"[^"<]*"|'[^'<]*'|[^>"'<])*+>|[^>]*>)"""
#: Elements that break lines.
BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b" + REST, re.I)
TAG = re.compile(r"<[/!?a-zA-Z]" + REST)


def shown(page: str) -> str:
    """The page with a blank for each comment, script, style, noscript and template element, and for the first head. One pass:
    an element whose end is missing is looked for once."""
    out, at, pos, plain = [], 0, 0, set()
    while (m := HIDDEN.search(page, pos)) is not None:
        name, end = (m[1] or "").lower(), -1
        if not name:
            end = page.find("-->", m.end()) + 3
            end = end if end > 2 else len(page)
        elif name not in plain and (start := page.find(">", m.end()) + 1):
            close = END[name].search(page, start)
            if name == "head":
                plain.add(name)
                body = BODY.search(page, start, close.start()) if close else None
                end = close.end() if close and not body else HEAD.match(page, m.start()).end()
            elif close:
                end = close.end()
            elif name in ("script", "style"):
                end = len(page)
            else:
                plain.add(name)
        if end < 0:  # a tag as others
            pos = m.end()
            continue
        out += [page[at : m.start()], " "]
        at = pos = end
    return "".join([*out, page[at:]])


def text_of(page: str) -> str:
    s = shown(page)
    end = s.rfind(">") + 1  # no tag ends behind it, so none is looked for there
    s = TAG.sub("", BREAK.sub("\n", s[:end])) + s[end:]
    lines = (" ".join(x.split()) for x in entities.unescape(s).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(parts).encode()).digest(), version=5)}>"


def write_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    clean = lambda v: v.replace("\r", " ").replace("\n", " ")  # noqa: E731  a header is one line
    lines = ["WARC/1.0", *(f"{k}: {clean(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(raw: bytes) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and out:  # a folded line goes on
            out[-1] = (out[-1][0], out[-1][1] + " " + line.strip())
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip(), v.strip()))
    return out


def parse_record(data: bytes) -> tuple[list[tuple[str, str]], bytes, int]:
    """Headers, block and length of the record that data begins with."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        raise ValueError("not a WARC record")
    headers = _fields(data[data.index(b"\r\n") + 2 : end])
    try:
        n = int(dict((k.lower(), v) for k, v in headers)["content-length"])
    except (KeyError, ValueError):
        raise ValueError("no Content-Length") from None
    block = data[end + 4 : end + 4 + n]
    if n < 0 or len(block) != n:
        raise ValueError("the record is cut short")
    after = end + 4 + n
    return headers, block, after + 4 if data[after : after + 4] == b"\r\n\r\n" else after


def split_records(data: bytes):
    """The records of a WARC file, plain or gzipped by member."""
    while data:
        if data[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
            plain = z.decompress(data) + z.flush()
            data = z.unused_data
            yield from split_records(plain)
        else:
            data = data.lstrip(b"\r\n")
            if data:
                n = parse_record(data)[2]
                yield data[:n]
                data = data[n:]


def records(files: DataFrame) -> DataFrame:
    """files: (path, content) as Spark's binaryFile source gives them. Rows: path, number, record."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, r in enumerate(split_records(content or b"")):
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([i], pa.int64()), pa.array([r], pa.binary())], ["path", "number", "record"])

    return files.select("path", "content").mapInArrow(run, "path string, number long, record binary")


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): each page as a WARC response record."""
    small_batches(pages.sparkSession)

    def one(page_id, url, html):
        key, uri = "" if page_id is None else str(page_id), url if url is not None else f"urn:page:{'' if page_id is None else page_id}"
        body = (html or "").encode()
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body
        own = record_id("response", key, uri, hashlib.sha256(body).hexdigest())
        return write_record([("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Target-URI", uri), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(block))], block)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([one(*r) for r in zip(*(c.to_pylist() for c in part.columns))], pa.binary())], ["page_id", "record"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, record binary")


NAMES = ["kind", "record_id", "refers_to", "target_uri", "source_headers", "source_payload_digest", "payload_digest_holds", "block_digest", "content_length", "text", "record"]
KINDS = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.binary()]
SCHEMA = "kind string, record_id string, refers_to string, target_uri string, source_headers map<string,string>, source_payload_digest string, payload_digest_holds boolean, block_digest string, content_length long, text string, record binary"


def derive(data: bytes) -> list[tuple]:
    """The metadata and conversion rows of one record."""
    try:
        headers, block, _ = parse_record(data)
    except ValueError as e:
        return [("error", None, None, None, [], None, None, None, None, str(e), None)]
    w = {k.lower(): v for k, v in headers}
    if w.get("warc-type") != "response":
        return []
    source, uri, date = w.get("warc-record-id", ""), w.get("warc-target-uri", ""), w.get("warc-date", DATE)
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = head.partition(b"\r\n")
    http = _fields(rest)
    charset = re.search(r"charset=[\"']?([\w.-]+)", dict((k.lower(), v) for k, v in http).get("content-type", ""))
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    holds = digest(body) == w["warc-payload-digest"] if "warc-payload-digest" in w else None
    text = text_of(page)
    plain = text.encode("utf-8", "replace")
    conv, meta = record_id("conversion", source), record_id("metadata", source)
    link = [("WARC-Refers-To", source), ("WARC-Target-URI", uri), ("WARC-Date", date)]
    kept = [("source." + k, v) for k, v in headers] + [("source.http.status", status.decode("utf-8", "replace"))] + [("source.http." + k, v) for k, v in http]
    lines = [*kept, ("conversion", conv), ("conversion.block-digest", digest(plain)), ("payload-digest-holds", {True: "yes", False: "no", None: "unknown"}[holds])]
    about = "".join(f"{k}: {v}\r\n" for k, v in lines).encode()
    out = []
    for kind, own, content, b, t in (("metadata", meta, "application/warc-fields", about, None), ("conversion", conv, "text/plain; charset=utf-8", plain, text)):
        record = write_record([("WARC-Type", kind), ("WARC-Record-ID", own), *link, ("Content-Type", content), ("WARC-Block-Digest", digest(b))], b)
        out.append((kind, own, source, uri, list(dict(kept).items()), w.get("warc-payload-digest"), holds, digest(b), len(b), t, record))
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """Rows of NAMES for each response in column record; page_id is carried along."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                rows = [(p, *r) for p, data in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if data is not None for r in derive(data)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *KINDS])], ["page_id", *NAMES])

    return records.select("page_id", "record").mapInArrow(run, f"page_id long, {SCHEMA}")


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return made.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_payload_digest", "payload_digest_holds", "block_digest", "content_length", "text", F.sha2("record", 256).alias("record_sha256"))
