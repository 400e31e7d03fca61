"""WARC derivatives: a metadata and a plain-text conversion record for each response.

Both refer to the response by its id, target URI and date, and carry digests: of the
source payload, and of their own block. The source's HTTP headers are fields of the metadata
record, so a reader of the records alone has them. Ids of derived records are
made from the response's id and the kind, so a task that runs again writes the same.

Plan: one pass over the responses, without a shuffle; the work of a row depends on that
row alone.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from email.parser import Parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A tag ends at ">" outside quotes; whatever is left open runs to the end.
_INSIDE = r"""(?:[^>"']++|"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))*+(?:>|\Z)"""
_SKIPPED = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>]){_INSIDE}.*?(?:</\1(?=[\s/>]){_INSIDE}|\Z)", re.S | re.I
)
# Elements whose tags end a line.
_LINE_TAG = re.compile(
    rf"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main"
    rf"|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)(?=[\s/>]){_INSIDE}",
    re.I,
)
_TAG = re.compile(rf"<[/!?]?[a-z]{_INSIDE}|<!{_INSIDE}|<\?{_INSIDE}", re.I)
_TITLE = re.compile(rf"<title(?=[\s/>]){_INSIDE}(.*?)(?:</title|\Z)", re.S | re.I)
_HTML_TAG = re.compile(rf"<html(?=[\s/>]){_INSIDE}", re.I)
_LANG = re.compile(r"""\slang\s*+=\s*+["']?([A-Za-z0-9-]+)""", re.I)
_LINK = re.compile(rf"<a(?=[\s/]){_INSIDE}", re.I)
_HREF = re.compile(r"[\s/\"']href\s*+=", re.I)
_BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")

SCHEMA = (
    "record_id string, record_type string, refers_to string, target_uri string, date string, content_type string,"
    " headers string, content binary, content_length long, block_digest string, source_headers string,"
    " source_digest string, source_digest_holds boolean"
)


def digest(data: bytes) -> str:
    """SHA-1 as WARC writes it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def plain_text(page: str) -> str:
    """The readable text of a page: a line for each block, single blanks, references decoded."""
    # What is cut out leaves a mark, or the text on its two sides could make a tag.
    text = _SKIPPED.sub("\0", page)
    text = _TAG.sub("\0", _LINE_TAG.sub("\n", text.replace("\n", " "))).replace("\0", "")
    lines = (_BLANKS.sub(" ", line).strip() for line in html.unescape(text).split("\n"))
    return "\n".join(line for line in lines if line)


def _one_line(text: str) -> str:
    return " ".join(html.unescape(_TAG.sub("", text)).split())


def _charset(headers: str) -> tuple[str, str]:
    """Media type, lower-cased, and charset of an HTTP header block."""
    fields = headers.split("\n", 1)[1] if headers.startswith("HTTP/") and "\n" in headers else headers
    message = Parser().parsestr(fields, headersonly=True)
    return (message.get_content_type() if message["Content-Type"] else ""), message.get_content_charset() or "utf-8"


def _header_fields(headers: str) -> list[tuple[str, str]]:
    """The source's status line and headers as fields, a folded header on one line."""
    lines = re.sub(r"\r?\n[ \t]+", " ", headers).splitlines()
    status = lines[:1] if headers.startswith("HTTP/") else []
    return [("http-status-line", line.strip()) for line in status] + [("http-header", line.strip()) for line in lines[len(status) :]]


def _decoded(payload: bytes, charset: str) -> str:
    try:
        return payload.decode(charset, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def _record(kind: str, response: dict, content_type: str, content: bytes, made_at: str | None) -> dict:
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{response['record_id']} {kind}')}>"
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id,
        "WARC-Refers-To": response["record_id"],
        "WARC-Refers-To-Target-URI": response["target_uri"],
        "WARC-Refers-To-Date": response["date"],
        "WARC-Target-URI": response["target_uri"],
        "WARC-Date": made_at or response["date"],
        "WARC-Block-Digest": digest(content),
        # Of the payload that the record refers to.
        "WARC-Payload-Digest": response["payload_digest"],
        "Content-Type": content_type,
        "Content-Length": str(len(content)),
    }
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields.items() if v)
    return {
        "record_id": record_id,
        "record_type": kind,
        "refers_to": response["record_id"],
        "target_uri": response["target_uri"],
        "date": made_at or response["date"],
        "content_type": content_type,
        "headers": f"WARC/1.1\r\n{lines}\r\n",
        "content": content,
        "content_length": len(content),
        "block_digest": fields["WARC-Block-Digest"],
        "source_headers": response["http_headers"],
        "source_digest": response["payload_digest"],
        "source_digest_holds": response["holds"],
    }


def _derived(response: dict, made_at: str | None) -> Iterator[dict]:
    payload = response["payload"] or b""
    media, charset = _charset(response["http_headers"] or "")
    own = digest(payload)
    stated = response["payload_digest"]
    response |= {"payload_digest": stated or own, "holds": None if not stated else stated == own}
    fields = {"payload-digest": own, "payload-length": str(len(payload)), "content-type": media, "charset": charset}
    is_text = media.startswith("text/") or media == "application/xhtml+xml"
    if is_text and response["payload"] is not None:
        page = _decoded(payload, charset)
        text = page if media == "text/plain" else plain_text(page)
        if media != "text/plain":
            if title := _TITLE.search(page):
                fields["title"] = _one_line(title[1])
            if (tag := _HTML_TAG.search(page)) and (lang := _LANG.search(tag.group())):
                fields["language"] = lang[1]
            fields["links"] = str(sum(1 for tag in _LINK.finditer(page) if _HREF.search(tag.group())))
    block = "".join(f"{k}: {v}\r\n" for k, v in [*fields.items(), *_header_fields(response["http_headers"] or "")] if v).encode()
    yield _record("metadata", response, "application/warc-fields", block, made_at)
    if is_text and response["payload"] is not None:
        yield _record("conversion", response, "text/plain; charset=utf-8", text.encode("utf-8", "replace"), made_at)


def derive(responses: DataFrame, made_at: str | None = None) -> DataFrame:
    """Metadata and conversion records of ``responses``.

    Read are ``record_id``, ``target_uri``, ``date``, ``http_headers``, ``payload``
    (binary) and ``payload_digest``; other columns are left aside. ``headers`` is the
    WARC header block of a derived record, ``content`` its block; put together with two
    line ends behind, they are the record. ``made_at`` dates the derived records,
    which otherwise have the date of the response. The metadata block has a field
    ``http-header`` for each of the source's headers, in their order, after its status line.

    Every response gives a metadata record. Text and HTML with a payload give a
    conversion record too, which may be empty; a null payload and other media do not.
    A stated digest is kept and compared (null where none is stated). A response
    without an id is left out, as nothing could refer to it. Repeated rows give
    repeated records; an empty table gives none.
    """
    columns = ["record_id", "target_uri", "date", "http_headers", "payload_digest"]
    rows = responses.where("record_id is not null")
    rows = rows.select(*(F.col(c).cast("string").alias(c) for c in columns), F.col("payload").cast("binary").alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [r for response in batch.to_pylist() for r in _derived(response, made_at)]
            yield pa.RecordBatch.from_pylist(found, schema=_ARROW)

    return rows.mapInArrow(run, SCHEMA)


_TYPES = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}
_ARROW = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in SCHEMA.split(","))])


def responses_of(
    pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Response records of stored pages, with ids made from page id and URL."""
    key = F.md5(F.concat_ws("\x00", pages[id_col].cast("string"), pages[url_col].cast("string")).cast("binary"))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    name = F.concat(
        F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-4"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">")
    )
    return pages.select(
        name.alias("record_id"),
        pages[url_col].cast("string").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n").alias("http_headers"),
        F.encode(pages[html_col].cast("string"), "UTF-8").alias("payload"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
