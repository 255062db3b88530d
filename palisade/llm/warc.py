"""WARC archives: written with segmented records and chunked payloads, read back by reassembling the segments.

Each record is a gzip member of its own, so that readers can seek to it. A member's last byte is 0, so Spark's own text
writer lays members down, with that byte as the line separator, through any file system that Spark knows. Segments bound
a record's size and records per file bound a file's size, so readers hold one bounded file at a time. Files of one member
for all records, of several, and plain ones are read alike.
"""

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.words import bound_batches
from palisade.sources import scratch

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = "\r\n\r\n"
PART_BYTES = 8 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID(int=0)


def digest32(payload: bytes) -> str:
    """Base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, url) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {digest} {url}')}>"


def _cuts(text: str, most: int) -> Iterator[tuple[str, int]]:
    """Pieces of at most `most` UTF-8 bytes (at least one code point), with their bytes."""
    at = 0
    while at < len(text):
        piece = text[at:at + most]
        size = len(piece.encode())
        while size > most and len(piece) > 1:
            piece = piece[:max(1, len(piece) * most // size - (size - most < 4))]
            size = len(piece.encode())
        yield piece, size
        at += len(piece)


def chunked(text: str, most: int) -> str:
    """HTTP/1.1 chunked transfer coding."""
    return "".join(f"{size:x}\r\n{piece}\r\n" for piece, size in _cuts(text, most)) + "0\r\n\r\n"


def dechunk(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        if body[end + 2 + size:end + 4 + size] != b"\r\n":
            raise ValueError("chunk framing is broken")
        at = end + 4 + size


def _head(kind: str, ident: str, fields: dict, length: int) -> str:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", ident), *((k, v) for k, v in fields.items() if v is not None), ("Content-Length", length)]
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"


def page_records(page_id, url, html, refers: tuple | None, date: str, segment_bytes: int, chunk_bytes: int) -> Iterator[str]:
    """The records of a page without their closing CRLF CRLF. refers: (page id, url) of the response that holds the payload."""
    digest = digest32(html.encode())
    ident = record_id(page_id, digest, url)
    target = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = {"WARC-Date": date, "WARC-Target-URI": target, "WARC-Payload-Digest": f"sha1:{digest}", "X-Page-ID": page_id, "Content-Type": "application/http; msgtype=response"}
    if refers:
        block = HTTP + "\r\n"
        yield _head("revisit", ident, fields | {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers[0], digest, refers[1])}, len(block.encode())) + block
        return
    block = HTTP + "Transfer-Encoding: chunked\r\n\r\n" + chunked(html, chunk_bytes)
    total = len(block.encode())
    if total <= segment_bytes:
        yield _head("response", ident, fields, total) + block
        return
    at = 0
    for k, (piece, size) in enumerate(_cuts(block, segment_bytes), 1):
        at += size
        own = fields if k == 1 else {"WARC-Date": date, "WARC-Segment-Origin-ID": ident}
        whole = {"WARC-Segment-Total-Length": total} if at == total else {}
        yield _head("response" if k == 1 else "continuation", ident if k == 1 else f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{ident} {k}')}>", own | {"WARC-Segment-Number": k} | whole, size) + piece


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z", segment_bytes: int = 32 << 10, chunk_bytes: int = 8 << 10, records_per_file: int = 4000, least_bytes: int = 0, broadcast_digests: int = 200_000) -> None:
    """Write a record for every row of pages to WARC files below path, each record a gzip member.

    Of rows with equal payloads of at least least_bytes, those with the largest id are responses (all of them, where ids
    repeat) and others revisit it; where several rows share that largest id, revisits name the smallest url's. A null id
    is smaller than any. A null html is empty, a null url has no target. The table of repeated payloads is broadcast up
    to broadcast_digests rows and joined by shuffle beyond. Rows that repeat are each a record; further columns, whatever
    their names, are dropped; an empty table gives files without records.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    first = F.struct(F.bitwise_not(F.coalesce(F.col("page_id"), F.lit(-(2**63)).cast("long"))).alias("i"), F.coalesce("url", F.lit("")).alias("u"), "page_id", "url")
    repeated = (rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("r"))
                .filter("n > 1").select(F.col("sha").alias("_sha"), F.col("r.page_id").alias("ref_id"), F.col("r.url").alias("ref_url"), F.lit(True).alias("_found")))
    repeated = scratch.cut(repeated, "payloads")
    if repeated.count() <= broadcast_digests:
        repeated = F.broadcast(repeated)
    rows = rows.join(repeated, F.col("sha") == F.col("_sha"), "left").select(
        "page_id", "url", "html", "ref_id", "ref_url", (F.col("_found") & ~F.col("page_id").eqNullSafe(F.col("ref_id"))).alias("again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for page_id, url, html, ref_id, ref_url, again in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for record in page_records(page_id, url, html, (ref_id, ref_url) if again else None, date, segment_bytes, chunk_bytes):
                    out.append(packed(record))
                    held += len(record)
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])

    (rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none")
     .option("maxRecordsPerFile", records_per_file).mode("errorifexists").text(path))


def packed(record: str) -> bytes:
    """The record, with its closing CRLF CRLF, as a gzip member (as several ones beyond PART_BYTES) without its last byte.

    That byte is the highest one of the member's length, 0 below 16 MB; the writer's line separator puts it there.
    """
    data = memoryview((record + END).encode())
    parts = [data[a:a + PART_BYTES] for a in range(0, len(data), PART_BYTES)]
    return b"".join(gzip.compress(x, 6, mtime=0) for x in parts)[:-1]


def unpacked(data: bytes) -> bytes:
    """data without gzip: all of its members, one after the other; plain data as it is. A member that is cut off is an error."""
    if data[:2] != b"\x1f\x8b":
        return data
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        if view[at:at + 2] != b"\x1f\x8b":
            raise ValueError(f"no gzip member at byte {at}")
        member = zlib.decompressobj(31)
        while not member.eof:
            step = view[at:at + (64 << 10)]
            if not len(step):
                raise ValueError("a gzip member is cut off")
            out.append(member.decompress(step))
            at += len(step) - len(member.unused_data)
        while at < len(view) and not view[at]:  # writers may pad with zeros
            at += 1
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Fields (names in lower case) and block of every record, by their lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(fields["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        yield fields, data[end + 4:stop]
        at = stop + 4


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunk(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r", b"")) else body


SEGMENTS = "origin string, segment int, total long, kind string, page_id long, url string, digest string, refers string, block binary"
WHOLE = "record_id string, kind string, page_id long, url string, digest string, refers string, payload binary"


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_SEGMENTS = pa.schema([("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("block", pa.binary())])
_WHOLE = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("refers", pa.string()), ("payload", pa.binary())])


def read_segments(spark, path: str) -> DataFrame:
    """Every record below path; segment is 0 for records in one piece."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = unpacked(content.as_buffer().to_pybytes())
                out, held = [], 0
                for f, block in parse_records(data):
                    number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                    out.append((f.get("warc-segment-origin-id") or f["warc-record-id"], number("warc-segment-number") or 0, number("warc-segment-total-length"), f["warc-type"], number("x-page-id"),
                                f.get("warc-target-uri"), f.get("warc-payload-digest", "").removeprefix("sha1:") or None, f.get("warc-refers-to"), block))
                    held += len(block)
                    if held > 4 << 20:
                        yield _rows(_SEGMENTS, out)
                        out, held = [], 0
                if out:
                    yield _rows(_SEGMENTS, out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SEGMENTS)


def reassemble(segments: DataFrame) -> DataFrame:
    """Whole records with decoded payloads (null for revisits).

    Continuations are grouped by the origin's id and ordered by segment number; numbers must run from 1 and the blocks'
    lengths must sum to the last one's total, and a payload must match its digest, else ValueError. Identical records
    (repeated rows of pages) give as many results as their first segment has copies.
    """
    def finish(parts: list[bytes], first: tuple) -> tuple:
        payload = payload_of(b"".join(parts)) if first[3] != "revisit" else None
        if payload is not None and first[6] and digest32(payload) != first[6]:
            raise ValueError(f"{first[0]}: the payload doesn't match its digest")
        return (first[0], first[3], first[4], first[5], first[6], first[7], payload)

    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _rows(_WHOLE, [finish([r[8]], r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, parts, copies, last, total = None, [], 0, 0, None

        def done() -> list[tuple]:
            if first is None:
                return []
            if total is None or sum(map(len, parts)) != total:
                raise ValueError(f"{first[0]}: {sum(map(len, parts))} bytes of {total}")
            return [finish(parts, first)] * copies

        for b in batches:
            out = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if first is None or r[0] != first[0]:
                    out += done()
                    first, parts, copies, last, total = r, [], 0, 0, None
                if r[1] == last:  # a copy
                    copies += last == 1
                    continue
                if r[1] != last + 1:
                    raise ValueError(f"{r[0]}: segment {r[1]} follows {last}")
                parts.append(r[8])
                copies, last, total = copies + (r[1] == 1), r[1], total if r[2] is None else r[2]
            if out:
                yield _rows(_WHOLE, out)
        if out := done():
            yield _rows(_WHOLE, out)

    split = segments.filter("segment > 0").repartition("origin").sortWithinPartitions("origin", "segment")
    return segments.filter("segment = 0").mapInArrow(singles, WHOLE).unionByName(split.mapInArrow(joined, WHOLE))


def read_warc(spark, path: str, broadcast_records: int = 200_000) -> DataFrame:
    """record_id, kind, page_id, url, payload_bytes, payload_digest, refers_to (a page id) of every record below path.

    Bytes and digest are those of the decoded payload; a revisit takes them from the response that it names, which must
    be there. A record without a page id or url has null there; files without records give no rows.
    """
    bound_batches(spark)
    whole = reassemble(read_segments(spark, path)).select(
        "record_id", "kind", "page_id", "url", "refers", "digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
    whole = scratch.cut(whole, "records")  # payloads are read once
    own = whole.filter("kind = 'response'").select("record_id", "kind", "page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"))
    again = whole.filter("kind = 'revisit'").drop("payload_bytes")
    named = (again.select(F.col("refers").alias("record_id")).distinct().join(whole.filter("kind = 'response'"), "record_id")
             .groupBy("record_id").agg(F.min("page_id").alias("refers_to"), F.min("payload_bytes").alias("payload_bytes")).withColumnRenamed("record_id", "refers"))
    named = scratch.cut(named, "revisited")
    if named.count() <= broadcast_records:
        named = F.broadcast(named)
    back = again.join(named, "refers", "left").select("record_id", "kind", "page_id", "url", "payload_bytes", F.col("digest").alias("payload_digest"), "refers_to")
    return own.unionByName(back)
