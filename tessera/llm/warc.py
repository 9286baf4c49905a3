"""Web archives: records compressed one by one with a Zstandard dictionary that each archive carries.

An archive is a series of Zstandard frames. The first is a skippable frame with the dictionary, built from the archive's
own first records; each record is a frame of its own, so that it can be read alone. After each comes a skippable frame of
9 bytes, the length of the frame before it and an end mark, so that an archive can be walked from its end.

Spark's own committer writes the archives; nothing is opened by path.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import new_path, small, stored, table, until_exit

DICTIONARY, TRAILER = 0x184D2A5D, 0x184D2A50
#: Records of an archive that its dictionary is built from, at most: so many bytes.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 32 << 10
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
END = struct.Struct("<IIQ")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    body = HTTP if revisit else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and its payload (of a revisit: empty)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("record is cut off")
    return fields, body.partition(b"\r\n\r\n")[2]


def trained(samples: list[bytes]) -> bytes:
    """A dictionary, or none where the samples are too few or too short for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def _row(frame: bytes) -> bytes:
    """A frame and its trailer without the last byte: Spark's writer ends each row with a line end, the end mark."""
    return frame + END.pack(TRAILER, 9, len(frame))


def archive_rows(records: Iterator[bytes]) -> Iterator[bytes]:
    first: list[bytes] = []
    held = 0
    for x in records:
        first.append(x)
        held += len(x)
        if held >= SAMPLE_BYTES:
            break
    if not first:
        return
    own = trained(first)
    yield _row(struct.pack("<II", DICTIONARY, len(own)) + own)
    kept = zstandard.ZstdCompressionDict(own) if own else None
    squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=kept, write_checksum=True).compress
    while first:
        yield _row(squeeze(first.pop(0)))
    for x in records:
        yield _row(squeeze(x))


def archive_records(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each record, from the last to the first."""
    if not data:
        return
    if struct.unpack_from("<I", data)[0] != DICTIONARY:
        raise ValueError("archive has no leading dictionary frame")
    n = struct.unpack_from("<I", data, 4)[0]
    kept = zstandard.ZstdCompressionDict(data[8 : 8 + n]) if n else None
    inflate = zstandard.ZstdDecompressor(dict_data=kept).decompress
    end, floor, view = len(data), 8 + n + 17, memoryview(data)
    while end > floor:
        magic, size, length = END.unpack_from(data, end - 17)
        if magic != TRAILER or size != 9 or data[end - 1] != 10 or end - 17 - length < floor:
            raise ValueError(f"trailer that ends at {end} is damaged")
        yield end - 17 - length, length, inflate(view[end - 17 - length : end - 17])
        end -= 17 + length
    if end != floor:
        raise ValueError("archive is damaged")


def resolved(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to, revisit. Of rows with equal payloads of at least min_bytes, those with the
    largest page_id are responses and all others revisit it; null ids count as smallest. Only digests are shuffled, and
    each task sends one row for each digest; the payloads stay where they were read."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    many = keyed.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to", F.lit(True).alias("found"))
    out = keyed.join(small(stored(many, "payloads")), "digest", "left")
    revisit = F.coalesce(F.col("found") & ~F.col("page_id").eqNullSafe(F.col("refers_to")), F.lit(False))
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("refers_to")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write a record for each row of pages (page_id, url, html; other columns are not read): one archive for each
    partition. Null html is an empty payload, a null url or id leaves its header out, repeated rows are records of
    their own, and an empty table writes no record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(*(x.as_py() for x in row)) for b in batches for row in zip(*b.columns, strict=True))
        out, held = [], 0
        for x in archive_rows(records):
            out.append(x)
            held += len(x)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])

    resolved(pages, min_bytes).mapInArrow(write, "row binary").selectExpr("cast(row AS string) AS value").write.text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives; every payload is checked against its digest."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, file = [], name.as_py()
                for at, n, data in archive_records(content.as_py()):
                    h, payload = parse(data)
                    own, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    if kind == "response" and digest(payload) != own:
                        raise ValueError(f"payload of the record at {at} of {file} is damaged")
                    page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                    rows.append((page and int(page), h.get("WARC-Target-URI"), int(h["X-Payload-Length"]), own, kind, refers and int(refers), file, at, n))
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    until_exit(spark, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
