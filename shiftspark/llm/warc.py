"""WARC derivatives: linked metadata and conversion records of responses.

For every response record the builder makes two records that point back to it
with WARC-Refers-To: a ``metadata`` record (application/warc-fields: what was
fetched, its status, content type, payload digest and size) and a ``conversion``
record with the page's plain text.  Both keep the response's target URI and
date, have digests of their blocks, and identifiers that follow from the
response's, so a rerun writes the same records.  A response may carry its own
digest; one that does not fit its block is reported in the metadata
(``payload-digest-status``), and never dropped.

Records are a table (one row a record: type, id, headers, block) or WARC files
in text form: ``write_warc`` ends every record with the blank lines that the
format asks for, ``read_warc`` splits files of either version at what looks like a
record's end, so large files are read by many tasks, and joins what follows until a
record has its Content-Length: blocks may hold record ends.  Only where such a block
is cut by an input split does it raise (``spark.sql.files.maxPartitionBytes`` sets their
size).  Headers beyond those with a column stay, in order, in ``other_headers``; those of
the response, and all its HTTP headers, are written into the metadata record.  Blocks
are UTF-8.

Null html is an empty block, a null url a record without a target URI; rows that
repeat a key give records with the same identifier and differ in their digests
only if their content does.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftspark.llm.common import map_batches, read_table
from shiftspark.llm.dom import visible_text
from shiftspark.session import ship_package

# Fixed values of the WARC format.
VERSION = "WARC/1.1"
EOL = "\r\n"
END = EOL + EOL
#: Date of records made from tables that have none.
NO_DATE = "1970-01-01T00:00:00Z"
#: Name space of derived record identifiers.
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

RECORD = "key long, type string, record_id string, refers_to string, target_uri string, date string, content_type string, block string, block_digest string, payload_digest string, other_headers string"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _one_line(text: str | None) -> str | None:
    """Header values have no line ends; those of a url are written as %0D and %0A."""
    return None if text is None else text.replace("\r", "%0D").replace("\n", "%0A")


def http_response(html: str | None) -> str:
    body = html or ""
    return (f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}"
            f"Content-Length: {len(body.encode('utf-8', 'surrogatepass'))}{EOL}{EOL}{body}")


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Response records of a table of pages."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _batch([response(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)])

    return map_batches(_source(pages, id_col, url_col, html_col), run, RECORD)


def _source(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))


def response(key: int | None, url: str | None, html: str | None) -> tuple:
    """The response record of one page."""
    block, body = http_response(html), (html or "").encode("utf-8", "surrogatepass")
    return (key, "response", record_id("response", str(key), url or ""), None, _one_line(url), NO_DATE,
            "application/http; msgtype=response", block, digest(block.encode("utf-8", "surrogatepass")), digest(body), None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=_NAMES)


def split_http(block: str) -> tuple[str, dict[str, str], str]:
    """Status line, headers (lower-case names) and body of an HTTP response."""
    head, found, body = block.partition(END)
    if not found:
        head, body = "", block
    status, *lines = head.split(EOL)
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return status, headers, body


def derive(record: dict) -> list[tuple]:
    """The metadata and the conversion record of one response."""
    status, headers, body = split_http(record["block"] or "")
    raw = body.encode("utf-8", "surrogatepass")
    payload = digest(raw)
    said = record["payload_digest"]
    source = record["record_id"]
    kind = headers.get("content-type", "")
    is_html = "html" in kind.lower() or not kind
    text = visible_text(body) if is_html else body if kind.lower().startswith("text/") else ""
    conversion = record_id("conversion", source)
    fields = [("source-record-id", source), ("conversion-record-id", conversion), ("http-status", status.partition(" ")[2]),
              ("source-content-type", kind), ("payload-length", str(len(raw))), ("payload-digest", payload),
              ("payload-digest-status", "absent" if said is None else "match" if said == payload else f"differs from {said}"),
              ("text-length", str(len(text.encode("utf-8", "surrogatepass"))))]
    fields += [(f"source-http-{name}", value) for name, value in headers.items()]
    fields += [(f"source-{name.strip().lower()}", value.strip()) for name, colon, value in
               (line.partition(":") for line in (record.get("other_headers") or "").split(EOL)) if colon]
    meta = "".join(f"{k}: {v}{EOL}" for k, v in fields)
    out = []
    for type_, id_, mime, block in (("metadata", record_id("metadata", source), "application/warc-fields", meta),
                                    ("conversion", conversion, "text/plain; charset=utf-8", text)):
        out.append((record["key"], type_, id_, source, record["target_uri"], record["date"], mime, block,
                    digest(block.encode("utf-8", "surrogatepass")), payload if type_ == "metadata" else None, None))
    return out


def derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all response records, in one pass."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, b.num_rows, 512):
            rows = b.slice(start, 512).to_pylist()
            yield _batch([d for r in rows if r["type"] == "response" for d in derive(r)])

    return map_batches(records.select(*_NAMES), run, RECORD)


def page_derivatives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``derivatives(responses(pages))`` in one step: the responses, which hold the
    whole pages, do not travel between two Python stages."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, b.num_rows, 512):
            rows = zip(*(c.to_pylist() for c in b.slice(start, 512).columns), strict=True)
            yield _batch([d for r in rows for d in derive(dict(zip(_NAMES, response(*r), strict=True)))])

    return map_batches(_source(pages, id_col, url_col, html_col), run, RECORD)


# --- files ------------------------------------------------------------------

_HEADERS = [("type", "WARC-Type"), ("record_id", "WARC-Record-ID"), ("refers_to", "WARC-Refers-To"), ("target_uri", "WARC-Target-URI"),
            ("date", "WARC-Date"), ("content_type", "Content-Type"), ("block_digest", "WARC-Block-Digest"),
            ("payload_digest", "WARC-Payload-Digest")]


def serialise(record: dict) -> str:
    """The record without its closing blank lines."""
    head = [f"{h}: {record[c]}" for c, h in _HEADERS if record[c] is not None]
    if record["key"] is not None:
        head.append(f"X-Row-Key: {record['key']}")
    head += [line for line in (record.get("other_headers") or "").split(EOL) if line]
    block = record["block"] or ""
    return EOL.join([VERSION, *head, f"Content-Length: {len(block.encode('utf-8', 'surrogatepass'))}"]) + END + block


#: Where files are split: a record's end and the next one's version, up to its last digit.
_SPLIT = END + "WARC/1."
_KNOWN = {h.lower() for _, h in _HEADERS} | {"x-row-key", "content-length"}


def parse(text: str) -> tuple[tuple | None, int]:
    """A record from its text (after the version, or with it), and the bytes that its block lacks.

    0: the record is whole; more: its block goes on after what was split off; less: it is too long.
    """
    _, _, rest = text.partition(EOL)
    head, found, block = rest.partition(END)
    if not found:
        return None, -1
    h, other = {}, []
    for line in head.split(EOL):
        name, _, value = line.partition(":")
        h[name.strip().lower()] = value.strip()
        if line and name.strip().lower() not in _KNOWN:
            other.append(line)
    lacks = int(h.get("content-length") or -1) - len(block.encode("utf-8", "surrogatepass"))
    if lacks == -len(END) and block.endswith(END):          # the last record of a file has its end
        block, lacks = block.removesuffix(END), 0
    key = h.get("x-row-key")
    got = {c: h.get(n.lower()) for c, n in _HEADERS} | {"key": int(key) if key else None, "block": block, "other_headers": EOL.join(other) or None}
    return tuple(got[c] for c in _NAMES), lacks


def whole_records(pieces: Iterator[str]) -> Iterator[tuple]:
    """Records of consecutive pieces of files; a piece that a block goes on in is joined to it."""
    held, lacks = [], 0
    for t in pieces:
        if not held and not t.strip():
            continue
        held.append(t)
        if lacks > 0:
            lacks -= len((_SPLIT + t).encode("utf-8", "surrogatepass"))
            if lacks > 0:
                continue
        got, lacks = parse(_SPLIT.join(held))
        if lacks < 0:
            raise ValueError("WARC record longer than its Content-Length: " + held[0][:200])
        if lacks == 0:
            yield got
            held = []
    if held:
        raise ValueError("WARC record shorter than its Content-Length, or cut by an input split: " + held[0][:200])


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files under ``path``, one a partition."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([serialise(r) for r in b.to_pylist()])], names=["value"])

    map_batches(records.select(*_NAMES), run, "value string").write.option("lineSep", END).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; raises on a record whose length does not fit."""
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = whole_records(t for b in batches for t in b.column(0).to_pylist())
        while rows := list(islice(records, 512)):
            yield _batch(rows)

    return spark.read.option("lineSep", _SPLIT).text(path).mapInArrow(run, RECORD)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and the columns of the two derived records of every page."""
    made = page_derivatives(read_table(spark, sf_dir, "pages"))
    return made.withColumnRenamed("key", "page_id")
