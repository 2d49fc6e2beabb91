"""WARC archives: writing with revisits, segments and chunked framing; reading with reassembly.

Writing: a page is an HTTP response whose body is in chunked framing. Of pages with equal payloads the one
with the largest page_id is written as response, the others as revisits to it; duplicates are found on
digests alone, so payloads are not grouped. A block longer than ``SEGMENT_BYTES`` is cut into a first
record and continuation records. Each record is a gzip member of its own, as WARC readers expect. Spark's text writer puts the
members into ``.warc.gz`` files: a member's last byte, the highest of its size below 16 MB, is always 0, and is
written as the line separator. So archives go to any file system that Spark can write to; the number of records a file
bounds a file's size, and files get their names when all are written.

Reading: files are read whole, records follow their Content-Length; kinds other than responses, resources, revisits and
continuations are passed over, and records of other writers are pages without a page_id. Continuation records are grouped by
the record they continue, put in order of segment number and checked for gaps and against their total
length; then the chunked framing is decoded and the payload's digest compared with the header's. A group
is one payload.

Defined results: null html is an empty payload, and empty payloads are equal to each other; a null page_id is
kept, never referred to, and a revisit if a page with an id has its payload; rows that share page_id and payload
are all responses if theirs is the largest page_id, with record ids of their own; control characters in a URL are
percent-encoded, a null URL is ``urn:x-none``, one of more than 65,536 characters the URN of its digest; an empty table gives
no records; columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import batch_rows, scratch_path
from corvane.scratch import file_system

SEGMENT_BYTES = 32 << 10
MAX_SEGMENT_BYTES, MAX_URL = 8 << 20, 65_536
CHUNK_BYTES = 8 << 10
RECORDS_A_FILE = 1000
READ_BYTES = 16 << 10
END_OF_RECORD = b"\r\n\r\n"
KINDS = ("response", "resource", "revisit", "continuation")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

PARSED = (
    "page_id bigint, record_type string, refers_to bigint, digest string, payload_bytes bigint, "
    "origin string, segment int, segments_total bigint, block binary"
)
READ = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_ID = re.compile(r"<urn:x-page:(-?\d+|none):([A-Z2-7]+)(?::[^>]*)?>")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    pieces = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        pieces += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*pieces, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    pieces, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(pieces)
        part = body[line + 2 : line + 2 + size]
        if len(part) != size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        pieces.append(part)
        at = line + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block


def _target(url: str | None) -> str:
    if not url:
        return "urn:x-none"
    if len(url) > MAX_URL:
        return f"urn:x-sha1:{digest_of(url.encode('utf-8', 'surrogatepass'))}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def page_records(page_id: int | None, url: str | None, html: str | None, refers_to: int | None, segment_bytes: int = SEGMENT_BYTES, serial: str = "") -> Iterator[bytes]:
    """The records of a page, without the empty lines that end each; ``serial`` tells the ids of rows apart that repeat a page."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    digest = digest_of(payload)
    name = f"urn:x-page:{'none' if page_id is None else page_id}:{digest}{':' if serial else ''}{serial}"
    common: list[tuple[str, object]] = [("WARC-Date", DATE), ("WARC-Target-URI", _target(url))]
    described: list[tuple[str, object]] = [
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", len(payload)),
    ]
    if refers_to is not None:
        back = ("WARC-Refers-To", f"<urn:x-page:{refers_to}:{digest}>")
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{name}>"), *common, *described, ("WARC-Profile", PROFILE), back], _HTTP)
        return
    block = _HTTP + chunked(payload)
    cuts = range(0, len(block), segment_bytes)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment_bytes]
        segment: list[tuple[str, object]] = []
        if len(cuts) > 1:
            segment.append(("WARC-Segment-Number", number))
            if number == len(cuts):
                segment.append(("WARC-Segment-Total-Length", len(block)))
        if number == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", f"<{name}>"), *common, *described, *segment], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name}:s{number}>"), *common, ("WARC-Segment-Origin-ID", f"<{name}>"), *segment], part)


def member(record: bytes) -> bytes:
    """The record and the empty lines that end it as a gzip member, without the member's last byte, which is 0."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = packer.compress(record) + packer.compress(END_OF_RECORD) + packer.flush()
    if packed[-1]:
        raise ValueError("a record of 16 MB or more")
    return packed[:-1]


def _records(segment_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = TaskContext.get().partitionId(), 0
        for part in parts:
            columns = [part.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "copies")]
            held: list[bytes] = []
            for page_id, url, html, refers_to, copies in zip(*columns, strict=True):
                serial = ""
                if copies is not None and copies > 1:
                    serial, seen = f"{task}-{seen}", seen + 1
                held += map(member, page_records(page_id, url, html, refers_to, segment_bytes, serial))
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    return run


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, sha1, refers_to, copies of pages whose payload a page with a larger id has (refers_to) or that rows repeat; digests
    alone are moved."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    known = known.groupBy("page_id", "sha1", "size").agg(F.count(F.lit(1)).alias("copies"))
    last = known.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = known.join(last, ["sha1", "size"], "left")
    back = F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    return found.select("page_id", "sha1", back.alias("refers_to"), "copies").where("refers_to is not null or copies > 1")


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> str:
    if segment_bytes > MAX_SEGMENT_BYTES:
        raise ValueError(f"segments of more than {MAX_SEGMENT_BYTES} bytes")
    spark = pages.sparkSession
    batch_rows(spark)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    back = revisits(pages, min_bytes).select(F.col("page_id").alias("b_id"), F.col("sha1").alias("b_sha1"), "refers_to", "copies")
    rows = rows.join(back, F.col("page_id").eqNullSafe(F.col("b_id")) & (F.sha1(F.col("html").cast("binary")) == F.col("b_sha1")), "left")
    records = rows.select("page_id", "url", "html", "refers_to", "copies").mapInArrow(_records(segment_bytes), "value binary")
    # the text writer writes a string's bytes as they are, and the separator after each
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", str(RECORDS_A_FILE)).text(path)
    files, at = file_system(spark, path)
    for status in files.listStatus(at):  # one name a file, when all are written
        name = status.getPath().getName()
        if name.endswith(".txt"):
            files.rename(status.getPath(), file_system(spark, f"{path}/{name.removesuffix('.txt')}.warc.gz")[1])
    return path


def unpacked(data: bytes | memoryview) -> bytes:
    """The content of all gzip members; each is fed by pieces, as what follows a member is copied when it ends."""
    view, at, out = memoryview(data), 0, []
    while at < len(view):
        one = zlib.decompressobj(31)
        while not one.eof:
            if at >= len(view):
                raise ValueError("a gzip member is cut short")
            piece = view[at : at + READ_BYTES]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
    return b"".join(out)


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record; lengths come from the records themselves."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record starts at {at}")
        fields = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        begin, size = stop + 4, int(fields["Content-Length"])
        block = data[begin : begin + size]
        if len(block) != size or data[begin + size : begin + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        yield fields, block
        at = begin + size + 4


def _page_of(name: str) -> int | None:
    """The page_id in a record's name; null in one of another writer."""
    found = _ID.fullmatch(name)
    return int(found[1]) if found and found[1] != "none" else None


def _parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PARSED.split(", ")]
    for part in parts:
        for content in part.column("content"):
            rows: list[tuple] = []
            for f, block in parse_archive(unpacked(content.as_buffer())):
                kind, name = f["WARC-Type"], f["WARC-Record-ID"]
                if kind not in KINDS:
                    continue
                number, total, digest = f.get("WARC-Segment-Number"), f.get("WARC-Segment-Total-Length"), f.get("WARC-Payload-Digest", "")
                if kind == "resource":  # its block is its payload
                    kind, block = "response", b"\r\n\r\n" + block
                rows.append(
                    (
                        _page_of(name),
                        kind,
                        _page_of(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None,
                        digest.removeprefix("sha1:") if digest.startswith("sha1:") else None,
                        int(f["WARC-Payload-Length"]) if "WARC-Payload-Length" in f else None,
                        f.get("WARC-Segment-Origin-ID", name) if number else None,
                        int(number) if number else None,
                        int(total) if total else None,
                        None if kind == "revisit" else block,
                    )
                )
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP response, its chunked framing decoded; another block as it is."""
    if not block.startswith((b"HTTP/", b"\r\n\r\n")):
        return block
    stop = block.index(b"\r\n\r\n")
    body = block[stop + 4 :]
    return dechunked(body) if b"\r\ntransfer-encoding: chunked" in block[:stop].lower() else body


def join_segments(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The whole block of a record from its (number, total length, part) segments, in any order."""
    by_number = {n: (total, part) for n, total, part in segments}
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise ValueError("a segment is missing")
    block = b"".join(by_number[n][1] for n in sorted(by_number))
    if by_number[len(by_number)][0] != len(block):
        raise ValueError("the segments don't add up to their total length")
    return block


def checked_payload(block: bytes, digest: str | None, page_id: int | None) -> tuple[bytes, str]:
    """(payload, digest), held against the header's digest if there is one."""
    payload = payload_of(block)
    found = digest_of(payload)
    if digest is not None and digest != found:
        raise ValueError(f"page {page_id}: the payload isn't that of its digest")
    return payload, found


def _whole(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Complete responses and revisits."""
    for part in parts:
        rows = []
        columns = [part.column(c).to_pylist() for c in ("page_id", "record_type", "refers_to", "digest", "payload_bytes", "block")]
        for page_id, kind, refers_to, digest, size, block in zip(*columns, strict=True):
            if kind == "response":
                payload, digest = checked_payload(block, digest, page_id)
                size = len(payload)
            rows.append((page_id, size, digest, kind, refers_to))
        yield _read_rows(rows)


def _segmented(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for segments in part.column("segments").to_pylist():
            block = join_segments([(s["segment"], s["segments_total"], s["block"]) for s in segments])
            first = next(s for s in segments if s["segment"] == 1)
            payload, digest = checked_payload(block, first["digest"], first["page_id"])
            rows.append((first["page_id"], len(payload), digest, "response", None))
        yield _read_rows(rows)


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in READ.split(", ")])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    batch_rows(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    parsed = files.mapInArrow(_parse, PARSED)
    whole = parsed.where("segment is null").mapInArrow(_whole, READ)
    parts = F.struct("segment", "segments_total", "page_id", "digest", "block")
    grouped = parsed.where("segment is not null").groupBy("origin").agg(F.collect_list(parts).alias("segments"))
    return whole.unionByName(grouped.select("segments").mapInArrow(_segmented, READ))


def warc_round_trip(pages: DataFrame, path: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write the archives (under ``path`` or the scratch folder) and read them back."""
    spark = pages.sparkSession
    return read_warc(spark, write_warc(pages, path or scratch_path(spark, "warc"), min_bytes))
