"""WARC derivatives: response records to linked metadata and plain-text conversion records.

responses() makes response records of a pages table; derive() gives every response a metadata record (title, language,
charset, outlinks, and the source's own headers and digests as fields) and a conversion record (its text). Both refer to the
response by WARC-Refers-To with its URI and date, and to each other by WARC-Concurrent-To; the source's payload and block
digests stay beside the new block's digest. write_warc() and read_warc() store records as WARC/1.1 files.

Record ids are name-based: equal sources get equal ids in every run, so a rerun of a lost task repeats the same records.

Cases: a null url gives an empty target URI, a null page an empty payload; both still give all records. Repeated rows give
repeated records with equal ids. An empty table gives no records. Extra columns are ignored. Unclosed comments, scripts and
tags end with the page; work grows with a page's length, also that of broken pages.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

DATE = "2024-01-01T00:00:00Z"
RECORD_START = "\r\n\r\nWARC/1."
SPACE = uuid.UUID("8f4a7f5e-53c9-4b87-9d5a-2f3e1c6b7a90")

# Elements whose content shows nothing, elements that begin a line, and attributes that link.
HIDDEN = ("script", "style", "noscript", "template")
BREAKS = frozenset("address article aside blockquote body br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
LINKING = frozenset("a area link img script iframe".split())

_OPEN = re.compile(r"<(!--|[!/?a-zA-Z])")
_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile("[\"'>]")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in (*HIDDEN, "title")}
_LANG = re.compile(r"""(?i)\blang\s*=\s*["']?([\w-]+)""")
_CHARSET = re.compile(r"""(?i)\bcharset\s*=\s*["']?([\w-]+)""")
_LINK = re.compile(r"""(?i)\b(href|src)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

RECORD = "record_type string, record_id string, target_uri string, date string, refers_to string, concurrent_to string, content_type string, block string, block_digest string, payload_digest string, source_payload_digest string, source_block_digest string"


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, chr(0).join(parts))}>"


@dataclass
class Page:
    """What one pass over a page finds."""

    text: str = ""
    title: str = ""
    language: str = ""
    charset: str = ""
    links: list[tuple[str, str]] = field(default_factory=list)


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Behind the first > outside quotes; a quote that nothing closes is a character like others."""
    while stop := _STOP.search(page, at):
        c, at = stop[0], stop.end()
        if c == ">":
            return at
        if last[c] >= at:
            at = page.index(c, at) + 1
    return len(page)


def parse(page: str) -> Page:
    """Text (blocks on lines of their own, entities decoded, runs of space as one), title, language, character set and the links
    in order without repeats. One pass whose work grows with the page's length, however broken the page is."""
    out, parts, found, at, titled = Page(), [], {}, 0, False
    last = {c: page.rfind(c) for c in "\"'"}
    while opening := _OPEN.search(page, at):
        begin = opening.start()
        parts.append(page[at:begin])
        if opening[1] == "!--":
            at = page.find("-->", begin + 4)
            at = len(page) if at < 0 else at + 3
            parts.append(" ")
            continue
        at = _tag_end(page, begin + 1, last)
        named = _NAME.match(page, begin, at)
        name = named[1].lower() if named else ""
        if name in BREAKS:
            parts.append("\n")
        if not name or page[begin + 1] == "/":
            continue
        if name in LINKING and (m := _LINK.search(page, begin, at)):
            address = html.unescape(m[2] or m[3] or m[4] or "").strip()
            if address:
                found[(address, f"{name}/@{m[1].lower()}")] = None
        elif name == "html" and not out.language and (m := _LANG.search(page, begin, at)):
            out.language = m[1]
        elif name == "meta" and not out.charset and (m := _CHARSET.search(page, begin, at)):
            out.charset = m[1]
        elif name == "title" and not titled:
            titled, m = True, _CLOSE["title"].search(page, at)
            out.title = " ".join(html.unescape(page[at : m.start()]).split()) if m else ""
        if name in HIDDEN:
            m = _CLOSE[name].search(page, at)
            at = m.end() if m else len(page)
            parts.append(" ")
    parts.append(page[at:])
    lines = (" ".join(x.split()) for x in html.unescape("".join(parts)).split("\n"))
    out.text, out.links = "\n".join(x for x in lines if x), list(found)
    return out


def plain_text(page: str) -> str:
    return parse(page).text


def http_response(page: str) -> str:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(page.encode())}\r\n\r\n{page}"


def responses(pages: DataFrame, *, date: str = DATE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records (the id and RECORD's columns) of a table of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, url, page in zip(*(c.to_pylist() for c in batch.columns)):
                url, page = url or "", page or ""
                block = http_response(page)
                rows.append((key, "response", record_id("response", str(key), url, digest(page.encode())), url, date, None, None, "application/http; msgtype=response", block, digest(block.encode()), digest(page.encode()), None, None))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], pa.string()) for k in range(1, 13))], names)

    names = [id_col, *(x.split()[0] for x in RECORD.split(", "))]
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {pages.schema[id_col].dataType.simpleString()}, {RECORD}")


def derive(records: DataFrame, *, id_col: str = "page_id") -> DataFrame:
    """The metadata and the conversion record of every response among the records."""
    names = [id_col, *(x.split()[0] for x in RECORD.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                keys, rows = [], []
                for i, r in enumerate(part.to_pylist()):
                    headers, _, page = (r["block"] or "").partition("\r\n\r\n")
                    seen, source = parse(page), r["record_id"] or ""
                    text = seen.text
                    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
                    fields = [("title", seen.title), ("languages-html", seen.language), ("charset-html", seen.charset), ("source-record-id", source), ("source-payload-digest", r["payload_digest"] or ""), ("source-block-digest", r["block_digest"] or "")]
                    fields += [("source-http-" + k.strip().lower(), v.strip()) for k, _, v in (h.partition(":") for h in headers.split("\r\n")[1:]) if k]
                    fields += [("outlink", f"{a} L {where}") for a, where in seen.links]
                    meta = "".join(f"{k}: {v}\r\n" for k, v in fields if v)
                    for kind, own, other, content, block in (("metadata", meta_id, text_id, "application/warc-fields", meta), ("conversion", text_id, meta_id, "text/plain; charset=utf-8", text)):
                        keys.append(i)
                        rows.append((kind, own, r["target_uri"], r["date"], source, other, content, block, digest(block.encode()), digest(block.encode()), r["payload_digest"], r["block_digest"]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keys, pa.int64())), *(pa.array([x[k] for x in rows], pa.string()) for k in range(12))], names)

    sources = records.where(F.col("record_type") == "response").select(*names)
    return sources.mapInArrow(run, f"`{id_col}` {records.schema[id_col].dataType.simpleString()}, {RECORD}")


def warc_text(records: DataFrame) -> DataFrame:
    """One column `value`: whole records but for the two line ends behind each."""
    c = F.col

    def header(name: str, value) -> F.Column:
        return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise("")

    block = F.coalesce(c("block"), F.lit(""))
    value = F.concat(F.lit("WARC/1.1\r\n"), header("WARC-Type", c("record_type")), header("WARC-Record-ID", c("record_id")), header("WARC-Date", c("date")), header("WARC-Target-URI", c("target_uri")), header("WARC-Refers-To", c("refers_to")), header("WARC-Refers-To-Target-URI", F.when(c("refers_to").isNotNull(), c("target_uri"))), header("WARC-Refers-To-Date", F.when(c("refers_to").isNotNull(), c("date"))), header("WARC-Concurrent-To", c("concurrent_to")), header("WARC-Block-Digest", c("block_digest")), header("WARC-Payload-Digest", c("payload_digest")), header("X-Source-Payload-Digest", c("source_payload_digest")), header("X-Source-Block-Digest", c("source_block_digest")), header("Content-Type", c("content_type")), F.lit("Content-Length: "), F.length(block.cast("binary")).cast("string"), F.lit("\r\n\r\n"), block)
    return records.select(value.alias("value"))


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """WARC/1.1 files, one for each partition, by Spark's own writer and so to any store it knows."""
    warc_text(records).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


HEADERS = pa.map_(pa.string(), pa.string())


def _head(piece: bytes) -> tuple[list[tuple[str, str]], int, int | None]:
    """Headers, where the block begins, and where it ends by its Content-Length (None without one)."""
    at = piece.find(b"\r\n\r\n")
    at = len(piece) if at < 0 else at
    pairs = [(k, v) for k, _, v in (h.partition(": ") for h in piece[:at].decode("utf-8", "replace").split("\r\n")[1:])]
    length = next((v.strip() for k, v in pairs if k.lower() == "content-length"), "")
    return pairs, at + 4, at + 4 + int(length) if length.isascii() and length.isdigit() else None


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads, blocks = [], []
        for piece in batch.column(0).to_pylist():
            pairs, begin, end = _head(piece)
            if end is None or end > len(piece):
                raise ValueError("a record lacks its Content-Length or ends before it")
            heads.append(pairs)
            blocks.append(piece[begin:end])
        yield pa.RecordBatch.from_arrays([pa.array(heads, HEADERS), pa.array(blocks, pa.binary())], ["headers", "block"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each piece's place in its split, its length, and the length that the record asks for if one begins there."""
    split, place = None, 0
    for batch in batches:
        places, lengths, asked = [], [], []
        for piece, *own in zip(*(c.to_pylist() for c in batch.columns)):
            split, place = own, place + 1 if own == split else 0
            places.append(place)
            lengths.append(len(piece))
            asked.append(_head(piece)[2])
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int64()) for x in (places, lengths, asked))], ["piece", "file", "split", "place", "length", "asked"])


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pieces of files in order, those that are only a part of a record, with its number in the file."""
    file, owner, held, need = None, 0, 0, 0
    for batch in batches:
        out: list[tuple] = []
        for own, split, place, length, asked in zip(*(c.to_pylist() for c in batch.columns)):
            if own != file:
                if held < need:
                    raise ValueError("a record ends before its Content-Length")
                file, owner, held, need = own, 0, 0, 0
            if held < need:
                held += len(RECORD_START) + length
            elif asked is None:
                raise ValueError("a record lacks its Content-Length")
            else:
                owner, held, need = owner + 1, length, asked
                if held >= need:
                    continue
            out.append((own, split, place, owner))
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(x, pa.int64()) for x in columns[1:])], ["file", "split", "place", "owner"])
    if held < need:
        raise ValueError("a record ends before its Content-Length")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(headers map, block) of the records in WARC/1.x files, plain or gzip, of any number of splits.

    Spark's text reader cuts the files where a record seems to begin, so a task holds a piece, not a file. If every piece holds
    as much as its Content-Length asks for, no block holds such a place, and the pieces are the records. Otherwise the pieces
    are written with their places, once, so that later steps see the same splits; of each file that has a piece with too
    little, the lengths alone are gone through in order, in one task a file that keeps a few numbers; and only the
    pieces that are parts of a record meet again, a group a record. A record without or with too great a Content-Length is an error.
    """
    text = spark.read.option("lineSep", RECORD_START).text(path)
    pieces = text.select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    numbered = pieces.mapInArrow(_numbered, "piece binary, file string, split bigint, place bigint, length bigint, asked bigint")
    short = F.col("asked").isNull() | (F.col("length") < F.col("asked"))
    result = "headers map<string,string>, block binary"
    if not numbered.select(short.alias("short")).where("short").take(1):
        return pieces.select("piece").mapInArrow(_parsed, result)
    keys = ["file", "split", "place"]
    numbered = cut(numbered)
    broken = numbered.where(short).select("file").distinct()
    index = numbered.select(*keys, "length", "asked").join(broken, "file", "left_semi")
    parts = cut(index.repartition("file").sortWithinPartitions(*keys).mapInArrow(_owners, "file string, split bigint, place bigint, owner bigint"))
    whole = numbered.join(parts, keys, "left_anti").select("piece")
    one = numbered.join(parts, keys).groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("split", "place", "piece"))).alias("parts"))
    between = F.lit(RECORD_START.encode())
    joined = one.select(F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["piece"], lambda all, p: F.concat(all, between, p["piece"])).alias("piece"))
    return whole.union(joined).mapInArrow(_parsed, result)


def op3(pages: DataFrame) -> DataFrame:
    found = derive(responses(pages))
    return found.select("page_id", "record_type", "record_id", "refers_to", "concurrent_to", "target_uri", "content_type", F.length(F.col("block").cast("binary")).cast("bigint").alias("content_length"), "block_digest", "source_payload_digest", "source_block_digest", F.sha2(F.col("block").cast("binary"), 256).alias("block_sha256"), "block")
