"""Token ids in length-delimited binary records, with a separate offset index for shuffled reads.

A record is

    u64 length of the payload | u32 masked checksum of those 8 bytes | payload | u32 masked checksum of the payload | "\\n"

little-endian; the last byte is the record's end mark. The mask turns a checksum by 15 bits and adds a constant, so that
a checksum over data that holds checksums stays sound. The payload is

    u8 flags (1: has an id, 2: ids take 4 bytes instead of 2) | i64 document id | u32 count | ids

Spark's own committer writes the files, so a lost executor's attempt leaves nothing behind, and any file system that
Spark knows will do: nothing is opened by path.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm._common import new_path, small, until_exit, whole

MASK = 0xA282EAD8
HEAD, PAYLOAD = struct.Struct("<QI"), struct.Struct("<BqI")
#: Bytes of text for each file, so that a file is read at once by one task.
FILE_BYTES = 24 << 20
#: Pieces whose ids a worker keeps, from task to task; the frequent ones come first, and later ones are encoded each time.
CACHE = 600_000
#: Characters of text, and pieces, that are encoded at once.
AT_ONCE, JOINED = 1 << 20, 500

#: Pieces of a text: a word of ASCII letters before a blank or a stop, else all up to the next blank, with the spaces and line
#: ends before it. The pre-tokenizer cuts wherever a piece ends, if no other white space is near; a text with other white
#: space, or with a special token, is encoded at once.
PIECE, OTHER_SPACE = re.compile(r"[ \n]*[A-Za-z]+(?=[ \n.,;:!?]|\Z)|[ \n]*[^ \n]+|[ \n]+"), re.compile(r"[^\S \n]")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """A record without its end mark: Spark's writer ends each row with a line end."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, payload) of each record; raises ValueError on a damaged one."""
    at, view = 0, memoryview(data)
    while at < len(data):
        if len(data) - at < 17:
            raise ValueError(f"record at {at} is cut off")
        n, crc = HEAD.unpack_from(data, at)
        if masked(view[at : at + 8]) != crc or at + n + 17 > len(data):
            raise ValueError(f"length of the record at {at} is damaged")
        payload = bytes(view[at + 12 : at + 12 + n])
        if masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0] or data[at + 16 + n] != 10:
            raise ValueError(f"record at {at} is damaged")
        yield at, n + 17, payload
        at += n + 17


def packed(doc_id: int | None, ids: bytes, wide: bool) -> bytes:
    return PAYLOAD.pack(2 * wide | (doc_id is not None), doc_id or 0, len(ids) // (4 if wide else 2)) + ids


def ids_of(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id, n = PAYLOAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & 2 else "<u2", n, PAYLOAD.size)
    return (doc_id if flags & 1 else None), ids


class Encoder:
    """ids of whole texts, with end_id after each. Pieces repeat, so their ids are kept; they come from the tokenizers library,
    which takes the strings of special tokens for those tokens."""

    def __init__(self, path: str, end_id: int | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        vocab = self.own.get_vocab()
        self.kind = "<u4" if max(*vocab.values(), end_id or 0) >= 65536 else "<u2"
        self.end = b"" if end_id is None else np.array([end_id], self.kind).tobytes()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a token's letters stand for one byte each
        for token, i in vocab.items():
            self.bytes[i] = len(token)
        special = [re.escape(t.content) for t in self.own.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([OTHER_SPACE.pattern, *special]))
        self.cache: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: set[str]) -> dict[str, bytes]:
        """Pieces that begin with a blank before a word are encoded many at a time; a piece's ids end where its bytes do."""
        joined = [p for p in pieces if p[0] in " \n" and not p.isspace()]
        alone = [p for p in pieces if p[0] not in " \n" or p.isspace()]
        found = {p: x.tobytes() for p, x in zip(alone, self._ids(alone), strict=True)}
        for at in range(0, len(joined), JOINED):
            part = joined[at : at + JOINED]
            ids = self._ids(["".join(part)])[0]
            upto = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in part])) + 1
            data, ends = ids.tobytes(), (upto * ids.itemsize).tolist()
            found |= {p: data[s:e] for p, s, e in zip(part, [0, *ends], ends, strict=False)}
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [bool(self.whole.search(t)) for t in texts]
        at_once = iter(self._ids([t for t, x in zip(texts, odd, strict=True) if x]))
        pieces = [None if x else PIECE.findall(t) for t, x in zip(texts, odd, strict=True)]
        new = self._new(set(chain.from_iterable(p for p in pieces if p)).difference(self.cache))
        room = CACHE - len(self.cache)
        self.cache |= new
        of = self.cache.__getitem__
        out = [(next(at_once).tobytes() if p is None else b"".join(map(of, p))) + self.end for p in pieces]
        for p in list(new)[max(room, 0) :]:
            del self.cache[p]
        return out


_KEPT: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None) -> Encoder:
    """The worker's own, kept between tasks."""
    if (path, end_id) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, end_id] = Encoder(path, end_id)
    return _KEPT[path, end_id]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every whole text in ascending order of id_col (null first; rows of equal id by their text's hash).

    Null and empty texts give a record with the end id alone; repeated rows give a record each; an empty table gives no
    record. Other columns are not read. A third of all rows may share an id: the hash deals them out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id)
        wide = encode.kind == "<u4"

        def framed(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
            ids = encode([text for _, text in rows])
            return pa.RecordBatch.from_arrays([pa.array([frame(packed(d, x, wide)) for (d, _), x in zip(rows, ids, strict=True)], pa.binary())], ["record"])

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                rows.append((doc_id.as_py(), text.as_py()))
                held += len(rows[-1][1])
                if held > AT_ONCE:
                    yield framed(rows)
                    rows, held = [], 0
            yield framed(rows)

    order = ["id", F.xxhash64("text")]
    (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(records, "record binary")
        .selectExpr("cast(record AS string) AS value")
        .write.text(path)
    )


def index_tokens(spark: SparkSession, path: str, index_path: str) -> DataFrame:
    """Read the files back, check every record, and write the offset index: a row for each record."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, before = [], 0
                for ordinal, (at, n, payload) in enumerate(frames(content.as_py())):
                    doc_id, ids = ids_of(payload)
                    rows.append((name.as_py(), ordinal, doc_id, at, n, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    before += len(ids)
                names = ["file", "ordinal", "id", "offset", "length", "before", "n_tokens", "ids_crc32"]
                cols = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "file" else pa.int64()) for k, c in zip(names, cols, strict=True)], names)

    (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "part-*")
        .load(path)
        .select("path", "content")
        .mapInArrow(walk, "file string, ordinal long, id long, offset long, length long, before long, n_tokens long, ids_crc32 long")
        .write.parquet(index_path)
    )
    return spark.read.parquet(index_path)


def token_table(index: DataFrame) -> DataFrame:
    """The index with `start`, the count of ids before each record in the order of the files."""
    per_file = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("part", F.regexp_extract("file", r"part-(\d+)", 1).cast("int"))
    base = per_file.select("file", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    return index.join(small(base), "file").withColumn("start", F.col("base") + F.col("before"))


def op7_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    from tessera.llm._common import table

    path = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    rows = token_table(index_tokens(spark, path, f"{path}-index"))
    for x in (path, f"{path}-index"):
        until_exit(spark, x)
    return rows.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32", "file", "offset", "length")
