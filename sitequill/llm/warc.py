"""WARC archives of pages: records, segments, revisits, and reading them back.

Writing. Of pages with equal payloads the one with the smallest id is a `response`; the others
become `revisit` records without a body, and only narrow rows decide which. A response holds an
HTTP head and the payload in chunked framing. Blocks beyond a segment's size are split into a
first record and `continuation` records that name it as their origin. Files are written by
Spark's text writer: two line ends close a WARC record, so they are the separator of lines.

Reading. Each file is parsed record by record by its Content-Length. Segments are grouped by the
record they continue, ordered by number, checked against the total length, and the HTTP body is
taken out of its chunks. Records of one segment skip the grouping.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a block in one record, bytes of one chunk, records in one file. A file and a record
#: are held in memory while they are read, so a file is at most SEGMENT x FILE_RECORDS bytes.
SEGMENT = 32 * 1024
CHUNK = 8 * 1024
FILE_RECORDS = 1000
#: Records keep no clock, so that a repeated task writes the same bytes.
DATE = "2000-01-01T00:00:00Z"


def payload_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, size: int = CHUNK) -> bytes:
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes | None:
    """The body without its framing; null if the framing is broken."""
    at, parts = 0, []
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            return None
        if size < 0:
            return None
        if size == 0:
            return b"".join(parts)
        part = data[end + 2 : end + 2 + size]
        if len(part) < size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            return None
        parts.append(part)
        at = end + 4 + size


def _record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Date: {DATE}"]
    head += [f"{k}: {v}" for k, v in fields.items() if v is not None]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block


def _uri(url: str | None) -> str | None:
    """The URL with everything escaped that would end a header line."""
    if url is None:
        return None
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record_id(page_id: int | None, digest: str, part: int = 1) -> str:
    own = "none" if page_id is None else page_id
    return f"<urn:page:{own}:{digest}:{part}>"


def response_records(page_id: int | None, url: str | None, payload: bytes) -> list[bytes]:
    """One record, or a first record and its continuations."""
    digest = payload_digest(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + SEGMENT] for i in range(0, len(block), SEGMENT)]
    first = record_id(page_id, digest)
    records = [
        _record(
            "response",
            {
                "WARC-Record-ID": first,
                "WARC-Target-URI": _uri(url),
                "WARC-Payload-Digest": f"sha1:{digest}",
                "WARC-Segment-Number": 1 if len(parts) > 1 else None,
                "Content-Type": "application/http;msgtype=response",
            },
            parts[0],
        )
    ]
    for n, part in enumerate(parts[1:], 2):
        records.append(
            _record(
                "continuation",
                {
                    "WARC-Record-ID": record_id(page_id, digest, n),
                    "WARC-Target-URI": _uri(url),
                    "WARC-Segment-Origin-ID": first,
                    "WARC-Segment-Number": n,
                    "WARC-Segment-Total-Length": len(block) if n == len(parts) else None,
                },
                part,
            )
        )
    return records


def revisit_record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    own = "none" if page_id is None else page_id
    return _record(
        "revisit",
        {
            "WARC-Record-ID": f"<urn:page:{own}:{digest}:revisit>",
            "WARC-Target-URI": _uri(url),
            "WARC-Payload-Digest": f"sha1:{digest}",
            "WARC-Refers-To": record_id(refers_to, digest),
            "WARC-Profile": PROFILE,
            "Content-Type": "application/http;msgtype=response",
        },
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode(),
    )


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batch(records: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])


def _as_responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([r for row in _rows(batch) for r in response_records(*row)])


def _as_revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([revisit_record(*row) for row in _rows(batch)])


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> None:
    """Write one record per row of pages (page_id, url, html) as gzipped WARC files.

    A null html is an empty payload; payloads below `least` bytes are all responses. The smallest
    page_id of equal payloads is the response, and each of its repeated rows; null ids come last.
    A null url gives a record without target. An empty table gives a folder without records.
    """
    payloads = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        "url",
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    )
    payloads = payloads.withColumn("sha", F.sha1("payload"))
    narrow = payloads.select("page_id", "url", "sha", F.octet_length("payload").alias("size"))
    first = cut_lineage(
        narrow.groupBy("sha", "size").agg(F.min("page_id").alias("first_id")).select(
            F.col("sha").alias("sha1"), F.col("size").alias("size1"), "first_id"
        ),
        "first-payloads",
    )
    small = F.col("size") < least
    same_id = F.col("page_id").eqNullSafe(F.col("first_id"))
    bodies = payloads.where(F.octet_length("payload") >= least).join(
        first.hint("shuffle_hash"),
        same_id & (F.col("sha") == F.col("sha1")),
        "left_semi",
    )
    responses = bodies.unionByName(payloads.where(F.octet_length("payload") < least))
    revisits = (
        narrow.where(~small)
        .join(first, (F.col("sha") == F.col("sha1")) & (F.col("size") == F.col("size1")) & ~same_id)
        .select("page_id", "url", _base32("sha").alias("digest"), "size", "first_id")
    )
    records = responses.select("page_id", "url", "payload").mapInArrow(_as_responses, "record binary")
    records = records.unionByName(revisits.mapInArrow(_as_revisits, "record binary"))
    (
        records.select(F.col("record").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", FILE_RECORDS).mode("overwrite").text(folder)
    )


def _base32(sha: str):
    """Base 32 of a SHA-1 in hex: 32 groups of five bits."""
    bits = F.concat(*[F.lpad(F.conv(F.substring(sha, i, 10), 16, 2), 40, "0") for i in range(1, 41, 10)])
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(
        *[F.substring(letters, F.conv(F.substring(bits, i, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(1, 161, 5)]
    )


_PARSED = "kind string, record_id string, url string, digest string, refers_to string, origin string, segment int, total long, block binary"


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of one file."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends too early")
        yield fields, block


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["kind", "record_id", "url", "digest", "refers_to", "origin", "segment", "total", "block"]
    kinds = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]

    def batch(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for files in batches:
        for (data,) in _rows(files):
            stream = io.BytesIO(data)
            rows, held = [], 0
            for fields, block in parse_records(gzip.GzipFile(fileobj=stream) if data[:2] == b"\x1f\x8b" else stream):
                number = fields.get("warc-segment-number")
                total = fields.get("warc-segment-total-length")
                rows.append((
                    fields["warc-type"], fields["warc-record-id"], fields.get("warc-target-uri"),
                    fields.get("warc-payload-digest"), fields.get("warc-refers-to"), fields.get("warc-segment-origin-id"),
                    int(number) if number else None, int(total) if total else None, block,
                ))
                held += len(block)
                if held > 4_000_000:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads of reassembled blocks; a block that misses a part or length has none."""
    for batch in batches:
        complete, payloads, declared = [], [], []
        for *_, segments, total in _rows(batch):
            numbers = [s["segment"] for s in segments]
            block = b"".join(s["block"] for s in segments)
            whole = numbers == list(range(1, len(numbers) + 1)) and (total is None or len(block) == total)
            head, _, body = block.partition(b"\r\n\r\n")
            if whole and b"transfer-encoding: chunked" in head.lower():
                body = unchunked(body)
            length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", head)
            declared.append(int(length[1]) if length else None)
            complete.append(whole and body is not None)
            payloads.append(body if whole else None)
        kept = batch.drop_columns(["segments", "total"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array(complete, pa.bool_()), pa.array(declared, pa.int64()), pa.array(payloads, pa.binary())],
            names=[*kept.schema.names, "complete", "http_length", "payload"],
        )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row per logical record: kind, record_id, url, digest, refers_to, complete, http_length, payload.

    Continuations may lie in other files than their origin. `complete` is false, and the payload
    null, if a segment is missing, the total length differs or the chunks are broken; a
    continuation without its first record gives such a row, too. Records of
    the same id and content, from repeated pages, come out as often as they were written.
    Revisits have an empty payload; http_length is the length that their HTTP head states.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")
    parsed = files.mapInArrow(_parsed, _PARSED)
    facts = ["kind", "record_id", "url", "digest", "refers_to"]
    part = F.struct("segment", "block")
    one = parsed.where("segment is null").select(
        *facts, F.array(F.struct(F.lit(1).alias("segment"), "block")).alias("segments"), F.lit(None).cast("long").alias("total")
    )
    first = F.col("segment") == 1
    many = (
        parsed.where("segment is not null")
        .groupBy(F.coalesce("origin", "record_id").alias("record_id"))
        .agg(
            *[F.max(F.when(first, F.col(c))).alias(c) for c in facts if c != "record_id"],
            F.array_distinct(F.sort_array(F.collect_list(part))).alias("segments"),
            F.coalesce(F.max("total"), F.lit(-1)).alias("total"),
            F.greatest(F.count_if(first), F.lit(1)).alias("times"),
        )
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*facts, "segments", "total")
    )
    schema = "kind string, record_id string, url string, digest string, refers_to string, complete boolean, http_length long, payload binary"
    return one.unionByName(many).select(*facts, "segments", "total").mapInArrow(_joined, schema)


def round_trip(pages: DataFrame, folder: str) -> DataFrame:
    """Write archives of the pages and describe what is read back, one row per page.

    page_id, payload_bytes, payload_digest (of the full payload), record_type, refers_to. The
    digest of a response is computed from the payload that was read. A revisit takes its size
    from the HTTP head that it keeps, its digest from its own header.
    """
    spark = pages.sparkSession
    write_archives(pages, folder)
    return read_archives(spark, folder).mapInArrow(
        _digests, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def _page(name: str | None) -> int | None:
    own = name.split(":")[2] if name else "none"
    return None if own == "none" else int(own)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for kind, name, _, digest, refers, complete, length, payload in _rows(batch):
            if kind == "response" and not complete:
                raise ValueError(f"record {name} can't be put together")
            if kind == "response":
                rows.append((_page(name), len(payload), payload_digest(payload), kind, None))
            else:
                rows.append((_page(name), length, digest.removeprefix("sha1:"), kind, _page(refers)))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )
