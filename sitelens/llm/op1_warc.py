"""Operator 1: derivatives of WARC responses.

Each response record gives a metadata record (application/warc-fields: status, every source header, digests, title and links)
and a conversion record (text/plain: the visible text). Both refer to the response by WARC-Refers-To with its target and date,
name each other by WARC-Concurrent-To, and carry the digests of the source's block and payload. Ids are version 5 UUIDs of the
source's id and the kind of record, so a task that runs again gives the same records.

Only a payload that is HTML or plain text is converted; from other types the conversion record is left out. For the conversion,
title and links, chunked transfer and gzip, deflate or zstd encodings are undone, where the body really has them; digests are of the
source's bytes. A body in another encoding, or one that unpacks to over UNPACKED bytes, isn't converted either, and the metadata
say so. Bytes are decoded by the charset of the header, else of a meta element, else UTF-8, with U+FFFD for what can't be. A tag
that the end of the page cuts off isn't text. Dates are in UTC, whatever the session's zone.

Null payloads are empty; fields that are null in the source are left out of the headers. Repeated rows give repeated records, an
empty table none; other columns, of any name, aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.llm.common import map_arrow, materialise, read_table, store

VERSION = "WARC/1.1"
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
FILE_BYTES = 64_000_000
UNPACKED = 1 << 28

_ATTRIBUTES = r"(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^>\"']++)*+(?:>|\Z)"
#: A head ends at its end tag, or where that is left out at <body> or the first other tag that can't stand in a head.
_HEAD = rf"<head(?=[\s/>]){_ATTRIBUTES}(?:[^<]++|<!--.*?(?:--!?>|\Z)|<(?P<inner>script|style|template|noscript|noframes|title)\b{_ATTRIBUTES}.*?(?:</(?P=inner)\s*>|\Z)|<(?:meta|link|base|basefont|bgsound|head)(?=[\s/>]){_ATTRIBUTES}|</(?!(?:head|body|html|br)\b)[^>]*+>|<[!?][^>]*+>|<(?![a-z/!?]))*+(?:</head\s*>)?"
#: A comment, a head, an element whose content isn't text, a declaration, or a tag.
TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|{_HEAD}|<(?P<skipped>script|style|template|noscript|iframe|svg)\b{_ATTRIBUTES}.*?(?:</(?P=skipped)\s*>|\Z)|<[!?][^>]*+(?:>|\Z)|</?(?P<name>[a-z][^\s/>]*+){_ATTRIBUTES}",
    re.I | re.S,
)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.I | re.S)
LINK = re.compile(r"<a\b[^>]*?\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
BLOCKS = frozenset("address article aside blockquote br caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def plain_text(page: str) -> str:
    """Visible text: block elements end lines, white space runs are one blank, empty lines go."""

    def gap(m: re.Match) -> str:
        name = m["name"]
        return "\n" if name and name.lower() in BLOCKS else "" if name else " "

    lines = (" ".join(line.split()) for line in html.unescape(TOKEN.sub(gap, page)).split("\n"))
    return "\n".join(line for line in lines if line)


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order with folded lines joined, and body of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        head, found, body = block.partition(b"\n\n")
    if not head.startswith(b"HTTP/"):
        return "", [], block
    lines = re.sub(r"\r?\n[ \t]+", " ", head.decode("latin-1")).splitlines()
    headers = [(name.strip(), value.strip()) for name, colon, value in (line.partition(":") for line in lines[1:]) if colon]
    return lines[0] if lines else "", headers, body


def unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer, or the bytes as they are if they aren't one."""
    out, at = [], 0
    while True:
        end = body.find(b"\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 1 : end + 1 + n])
        if len(out[-1]) < n:  # cut off
            return b"".join(out)
        at = end + 1 + n
        at += 2 if body[at : at + 2] == b"\r\n" else 1
        if at >= len(body):
            return b"".join(out)


class NotUnpacked(Exception):
    """Why a body can't be converted."""


def _gunzip(body: bytes, window: int, most: int) -> bytes:
    out, held = [], 0
    while body:  # a body may have several members
        d = zlib.decompressobj(window)
        out.append(d.decompress(body, most + 1 - held))
        held += len(out[-1])
        if held > most:
            raise NotUnpacked(f"unpacks to over {most} bytes")
        if not d.eof or window != 31 or not d.unused_data.startswith(b"\x1f\x8b"):
            break
        body = d.unused_data
    return b"".join(out)


def _unzstd(body: bytes, most: int) -> bytes:
    with zstandard.ZstdDecompressor().stream_reader(body, read_across_frames=True) as f:
        out = f.read(most + 1)
    if len(out) > most:
        raise NotUnpacked(f"unpacks to over {most} bytes")
    return out


def unpacked(body: bytes, headers: list[tuple[str, str]], most: int = UNPACKED) -> bytes:
    """The body without its transfer and content encodings. Crawlers often keep the headers of encodings they have undone, so a
    body that isn't in the encoding named is taken as it is."""
    coded = lambda header: [x.strip().lower() for k, v in headers if k.lower() == header for x in v.split(",")]
    for name in reversed([*coded("content-encoding"), *coded("transfer-encoding")]):
        try:
            if name == "chunked":
                body = unchunked(body)
            elif name in ("gzip", "x-gzip"):
                body = _gunzip(body, 31, most) if body.startswith(b"\x1f\x8b") else body
            elif name == "deflate":
                try:
                    body = _gunzip(body, 15, most)
                except zlib.error:
                    body = _gunzip(body, -15, most)
            elif name == "zstd":
                body = _unzstd(body, most) if body.startswith(b"\x28\xb5\x2f\xfd") else body
            elif name not in ("", "identity", "none", "utf-8"):
                raise NotUnpacked(f"encoding {name}")
        except (zlib.error, zstandard.ZstdError):
            continue
    return body


def decode(body: bytes, content_type: str) -> str:
    found = CHARSET.search(content_type) or CHARSET.search(body[:1024].decode("latin-1"))
    try:
        return body.decode(found[1] if found else "utf-8", "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def derive_one(record_id: str | None, target: str | None, date: str | None, block: bytes) -> list[dict]:
    """The metadata record and, for text, the conversion record of one response."""
    status, headers, body = split_http(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    source = record_id or f"<urn:uuid:{uuid.uuid5(SPACE, digest(block))}>"
    textual = kind.split(";")[0].strip().lower() in ("", "text/html", "application/xhtml+xml", "text/plain")
    reason = None
    try:
        page = decode(unpacked(body, headers), kind) if textual else ""
    except NotUnpacked as e:
        page, textual, reason = "", False, str(e)
    marked = textual and "text/plain" not in kind.lower()
    links = [html.unescape(a or b or c).strip() for a, b, c in LINK.findall(page)] if marked else []
    title = TITLE.search(page) if marked else None
    name = {k: f"<urn:uuid:{uuid.uuid5(SPACE, f'{source} {k}')}>" for k in ("metadata", "conversion")}
    block_digest, payload_digest = digest(block), digest(body)
    fields = [("source-record-id", source), ("source-status", status), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest), ("source-payload-length", str(len(body)))]
    fields += [(f"source-header-{k}", v) for k, v in headers]
    if reason:
        fields.append(("conversion-left-out", reason))
    if title:
        fields.append(("title", " ".join(html.unescape(title[1]).split())))
    fields += [("outlink", resolved(target, x)) for x in links]
    meta = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields).encode()
    out = [("metadata", "application/warc-fields", meta)]
    if textual:
        out.append(("conversion", "text/plain; charset=utf-8", (plain_text(page) if marked else page).encode()))
    records = []
    for k, content_type, data in out:
        other = name["conversion" if k == "metadata" else "metadata"] if len(out) == 2 else None
        records.append({"record_type": k, "record_id": name[k], "refers_to": source, "concurrent_to": other, "target_uri": target, "warc_date": date, "content_type": content_type, "block": data, "block_digest": digest(data), "source_block_digest": block_digest, "source_payload_digest": payload_digest, "source_headers": json.dumps(headers, ensure_ascii=False), "n_links": len(links)})
    return records


def resolved(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


COLUMNS = "record_type string, record_id string, refers_to string, concurrent_to string, target_uri string, warc_date string, content_type string, block binary, block_digest string, source_block_digest string, source_payload_digest string, source_headers string, n_links int"
_KINDS = [pa.binary() if c.endswith("binary") else pa.int32() if c.endswith(" int") else pa.string() for c in COLUMNS.split(", ")]
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def derive(responses: DataFrame) -> DataFrame:
    """Records of all responses (id, record_id, target_uri, warc_date, block); id passes through. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                ids, rows = [], []
                for own, *fields in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    for r in derive_one(fields[0], fields[1], fields[2], fields[3] or b""):
                        ids.append(own)
                        rows.append(r)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array([r[n] for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True))], names=["id", *_NAMES])

    return map_arrow(responses.select(F.col("id").cast("long").alias("id"), "record_id", "target_uri", "warc_date", "block"), run, f"id long, {COLUMNS}")


def responses(pages: DataFrame) -> DataFrame:
    """Response records of a table of pages (page_id, url, html), as a crawl of one page a second would give them."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    name = F.sha1(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha1(body.cast("binary"))).cast("binary"))
    part = lambda a, n: F.substring(name, a, n)
    record_id = F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))
    second = F.lit(1_700_000_000) + F.col("page_id").cast("long")
    days, rest = F.floor(second / 86_400).cast("int"), F.pmod(second, F.lit(86_400))
    clock = [F.lpad((F.floor(rest / n) % 60 if n < 3600 else F.floor(rest / n)).cast("string"), 2, "0") for n in (3600, 60, 1)]
    date = F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("T"), clock[0], F.lit(":"), clock[1], F.lit(":"), clock[2], F.lit("Z"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col("page_id").cast("long").alias("id"), record_id.alias("record_id"), F.col("url").cast("string").alias("target_uri"), date.alias("warc_date"), F.concat(head, body).cast("binary").alias("block"))


def to_warc(r: dict) -> bytes:
    """A record of derive() in WARC format."""
    fields = [
        ("WARC-Type", r["record_type"]),
        ("WARC-Record-ID", r["record_id"]),
        ("WARC-Date", r["warc_date"]),
        ("WARC-Target-URI", r["target_uri"]),
        ("WARC-Refers-To", r["refers_to"]),
        ("WARC-Refers-To-Target-URI", r["target_uri"]),
        ("WARC-Refers-To-Date", r["warc_date"]),
        ("WARC-Concurrent-To", r["concurrent_to"]),
        ("WARC-Block-Digest", r["block_digest"]),
        ("Content-Type", r["content_type"]),
        ("Content-Length", str(len(r["block"]))),
    ]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n").encode() + r["block"] + b"\r\n\r\n"


def parse_warc(data: bytes | pa.Buffer) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (the last of a name) and block of each record of a WARC file, compressed or not; a compressed one is unpacked as it
    is read."""
    raw = pa.BufferReader(data)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if bytes(data[:2]) == b"\x1f\x8b" else raw, 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        yield headers, stream.read(int(headers["Content-Length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files (a path, a pattern or a folder), as derive() takes them: id (a hash of the record's), record_id,
    target_uri, warc_date, block. A task reads one file at a time, which Spark holds whole (under 2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in parse_warc(content.as_buffer()):
                    if headers.get("WARC-Type") == "response":
                        rows.append((headers.get("WARC-Record-ID"), headers.get("WARC-Target-URI"), headers.get("WARC-Date"), block))
                        size += len(block)
                    if size > 16_000_000 or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, size = [], 0
                yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.string(), pa.binary()), strict=True)], names=["record_id", "target_uri", "warc_date", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_arrow(files, run, "record_id string, target_uri string, warc_date string, block binary").withColumn("id", F.xxhash64("record_id"))


def write_warc(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes records as compressed WARC files, a gzip member each, and returns file, records, bytes. Only the files named there
    count: a task that runs again writes under another name. The folder must be one that all executors reach (see store())."""
    store(folder)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        held: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            name = f"{uuid.uuid4().hex}.warc.gz"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                for x in held:
                    f.write(x)
            row = pa.RecordBatch.from_pydict({"file": [name], "records": [len(held)], "bytes": [size]})
            held, size = [], 0
            return row

        for batch in batches:
            for r in batch.to_pylist():
                held.append(gzip.compress(to_warc(r), 6, mtime=0))
                size += len(held[-1])
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return materialise(map_arrow(records, save, "file string, records long, bytes long"), "warc-files")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derive(responses(read_table(spark, sf_dir, "pages")))
    return made.select(
        F.col("id").alias("page_id"), "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "warc_date", "content_type", F.octet_length("block").cast("long").alias("content_length"), "block_digest",
        F.sha2("block", 256).alias("block_sha256"), "source_block_digest", "source_payload_digest", "source_headers", "n_links",
    )
