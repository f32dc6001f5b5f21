r"""WARC archives: writing with segmentation, and reading back with segment reassembly.

Writing: a record a page, its block an HTTP response whose body is framed in chunks. Blocks over ``segment_bytes`` are cut
into segments: the first keeps the record's type, the others are continuation records with WARC-Segment-Number and
WARC-Segment-Origin-ID, the last with WARC-Segment-Total-Length. Of records with equal payloads of at least
``revisit_bytes``, that with the smallest id is the response; the others are revisits without a payload, which name it.
Records are written by Spark's text writer with the record's end as line separator, so files are committed like any
output of Spark and may be in any store that Spark can reach. A task's share of the shuffle makes a file of each kind.

Reading: every file is parsed record by record by Content-Length. Segments are grouped by the identifier of their origin,
ordered by segment number, and must have the numbers from 1 on and the total length that the last one gives. Then the
chunk framing is decoded.

Scale: a file is read whole and is bounded: no more than ``file_records`` segments of ``segment_bytes``. Payloads are
shuffled once, by digest, to meet the digests that several pages share; those are found by digest alone, combined on the
map side, and a large group of equal payloads is left to adaptive skew handling. A group that is reassembled is one record.

A null payload counts as empty, a null URL as an empty one. A null id comes last and has no number in its record's name.
Rows that share an id are told apart by URL and payload; rows that repeat all three are one record each, which all read
back as the same. Segments that are missing, doubled or of a wrong total raise an error unless ``strict`` is off, when
the record comes back with whole false and no payload.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.common import NULL_ID, order_id

CRLF = b"\r\n"
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
CHUNK = 1 << 15

RECORD = "record_id string, type string, uri string, page_id long, refers_to string, digest string, n_payload long, segment int, origin string, total long, block binary"
PAGE = "record_id string, record_type string, uri string, page_id long, refers_to string, payload_digest string, payload_bytes long, payload binary, segments int, whole boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """The body in chunked transfer framing."""
    parts = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        parts += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked transfer; chunk extensions and trailers are passed over."""
    parts, at = [], 0
    while True:
        end = framed.index(CRLF, at)
        size = int(framed[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if len(framed) < at + size + 2 or framed[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        parts.append(framed[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its closing line breaks, which separate it from the next."""
    lines = ["WARC/1.1", *(f"{name}: {value}" for name, value in headers if value), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def http_block(payload: bytes, framed: bool) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    return head + (b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload) if framed else b"Content-Length: %d\r\n\r\n" % len(payload))


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The records of an uncompressed archive: headers by lower-case name, and block."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == CRLF:
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(END, at)
        lines = data[at:end].decode().split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin = end + 4
        at = begin + int(headers["content-length"])
        if at > len(data):
            raise ValueError("an archive ends inside a record")
        yield headers, data[begin:at]


def open_block(block: bytes) -> bytes:
    """The payload of an HTTP response."""
    head, _, body = block.partition(END)
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _line(text: str) -> str:
    """The text without line breaks, which would end a header."""
    return text.replace("\r", " ").replace("\n", " ")


def _name(page_id: int | None, digest: str, uri: str) -> str:
    known = hashlib.sha1(f"{page_id}\n{digest}\n{uri}".encode()).hexdigest()
    return f"<urn:page:{'' if page_id is None else page_id}:{known[:16]}>"


def records_of(page_id: int | None, uri: str, payload: bytes, refers_to: str | None, segment_bytes: int) -> list[tuple[int, bytes]]:
    """The records of one page: segment number (0 if whole), bytes."""
    digest = base32_sha1(payload)
    name = _name(page_id, digest, uri)
    page = "" if page_id is None else str(page_id)
    common = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", page), ("Content-Type", "application/http;msgtype=response")]
    if refers_to:
        return [(0, record([*common, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)], http_block(payload, False)))]
    block = http_block(payload, True)
    if len(block) <= segment_bytes:
        return [(0, record(common, block))]
    parts = [block[at : at + segment_bytes] for at in range(0, len(block), segment_bytes)]
    out = [(1, record([*common, ("WARC-Segment-Number", "1")], parts[0]))]
    for i, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(parts) else []
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{i}>"), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", str(i)), *last]
        out.append((i, record(own, part)))
    return out


def first_of_equal(pages: DataFrame, revisit_bytes: int) -> DataFrame:
    """pages (id, uri, payload) to (digest, first, first_uri) for the payloads that several pages share."""
    digests = pages.where(F.length("payload") >= revisit_bytes).select("id", "uri", F.sha2("payload", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min(F.struct("id", "uri")).alias("first"), F.max("id").alias("last")).where("first.id < last")
    return firsts.select("digest", F.col("first.id").alias("first"), F.col("first.uri").alias("first_uri"))


def write_warc(df: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = 0, segment_bytes: int = 1 << 18, file_records: int = 4096) -> None:
    """Writes a record a row to ``path``, in gzipped archives; segmented records go to a folder of their own."""
    pages = df.select(order_id(f"`{page_id}`").alias("id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("uri"), F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit(b"")).alias("payload"))
    firsts = first_of_equal(pages, revisit_bytes)
    known = pages.withColumn("digest", F.sha2("payload", 256)).join(firsts.hint("shuffle_hash"), "digest", "left").select("id", "uri", "payload", "first", "first_uri")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = [], []
            for doc, uri, payload, first, first_uri in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                # The first of equal payloads has an id, as others come after it.
                refers = _name(first, base32_sha1(payload), _line(first_uri)) if first is not None and first < doc else None
                for i, value in records_of(None if doc == NULL_ID else doc, _line(uri), payload, refers, segment_bytes):
                    kinds.append("segmented" if i else "whole")
                    values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.binary())], names=["kind", "value"])

    rows = known.mapInArrow(run, "kind string, value binary").select("kind", F.col("value").cast("string").alias("value"))
    rows.write.partitionBy("kind").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", file_records).text(path)


def _parsed(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                out = []
                for h, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    if h["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    name, n = h["warc-record-id"], int(h.get("warc-segment-number", 0))
                    page = h.get("x-page-id", "")
                    length = None
                    if h["warc-type"] == "revisit":
                        fields = dict(line.split(": ", 1) for line in block.partition(END)[0].decode().split("\r\n")[1:])
                        length = int(fields["Content-Length"])
                    out.append((name, h["warc-type"], h.get("warc-target-uri", ""), int(page) if page else None, h.get("warc-refers-to"), h.get("warc-payload-digest"), length, n, h.get("warc-segment-origin-id", name), int(h.get("warc-segment-total-length", 0)) or None, block))
                    if len(out) >= 256:
                        yield _batch(out)
                        out = []
                if out:
                    yield _batch(out)

    return files.mapInArrow(run, RECORD)


_RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("digest", pa.string()), ("n_payload", pa.int64()), ("segment", pa.int32()), ("origin", pa.string()), ("total", pa.int64()), ("block", pa.binary())])
_PAGE = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("segments", pa.int32()), ("whole", pa.bool_())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RECORD, strict=True)], schema=_RECORD)


def _page(first: dict, block: bytes, segments: int) -> dict:
    """A page of its first record and its whole block; the digest is checked."""
    out = {"record_id": first["record_id"], "record_type": first["type"], "uri": first["uri"], "page_id": first["page_id"], "refers_to": first["refers_to"], "segments": segments, "whole": True}
    said = (first["digest"] or "").rpartition(":")[2]
    if first["type"] == "revisit":
        return out | {"payload_digest": said, "payload_bytes": first["n_payload"], "payload": None}
    payload = open_block(block)
    digest = base32_sha1(payload)
    if said and said != digest:
        raise ValueError(f"the payload of {first['record_id']} does not have the digest {said}")
    return out | {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload}


def _opened(records: DataFrame) -> DataFrame:
    """Records that are not segmented."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from pa.Table.from_pylist([_page(r, r["block"], 0) for r in batch.to_pylist()], _PAGE).to_batches()

    return records.mapInArrow(run, PAGE)


def reassembled(records: DataFrame, strict: bool = True) -> DataFrame:
    """Segments to pages: grouped by origin, ordered by number, total length verified."""

    def run(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: (r["segment"], r["block"]))
        # A record that is there twice has each of its segments twice.
        parts = [r for i, r in enumerate(parts) if not i or (r["segment"], r["block"]) != (parts[i - 1]["segment"], parts[i - 1]["block"])]
        block = b"".join(r["block"] for r in parts)
        if [r["segment"] for r in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
            if strict:
                raise ValueError(f"segments of {parts[0]['origin']} are missing or do not have the total length that the last one gives")
            lost = {f.name: None for f in _PAGE} | {k: parts[0][k] for k in ("record_id", "uri", "page_id")}
            return pa.Table.from_pylist([lost | {"record_type": parts[0]["type"], "segments": len(parts), "whole": False}], _PAGE)
        times = sum(r["segment"] == 1 for r in table.to_pylist())
        return pa.Table.from_pylist([_page(parts[0], block, len(parts))] * times, _PAGE)

    return records.groupBy("origin").applyInArrow(run, PAGE)


def read_warc(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The pages of the archives under ``path``: see PAGE. refers_to is the identifier as written."""
    def files(kind: str) -> DataFrame:
        return _parsed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(f"{path}/kind={kind}").select("content"))

    kinds = {r["kind"] for r in spark.read.format("binaryFile").load(f"{path}/*").select(F.regexp_extract("path", "/kind=([a-z]+)/", 1).alias("kind")).distinct().collect()}
    whole = _opened(files("whole")) if "whole" in kinds else spark.createDataFrame([], PAGE)
    return whole.unionByName(reassembled(files("segmented"), strict)) if "segmented" in kinds else whole


def page_number(identifier: str) -> F.Column:
    """The page's number in an identifier of this writer."""
    return F.nullif(F.regexp_extract(identifier, r"^<urn:page:(-?\d*)", 1), F.lit("")).cast("long")
