"""Rows of gzip files, whose members are read side by side."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.plans.common import stored

#: Compressed bytes that a task looks through for the beginnings of members; it reads those that begin there to their ends.
RANGE_BYTES = 64 << 20
#: Bytes that are read or unpacked at a time.
STEP = 1 << 20
MAGIC = b"\x1f\x8b\x08"
PIECE = "_file string, start long, k long, kind string, value binary, stop long, failed boolean"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if path.startswith("file:") or path.startswith("/"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def can_open(path: str) -> bool:
    """Whether tasks can read ranges of bytes there."""
    try:
        opened(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def member(file: pa.NativeFile, at: int) -> Iterator[bytes | int]:
    """The text of the member that begins at a place, in parts, then where it ends; zlib.error if there is none, or a cut one."""
    file.seek(at)
    unpack = zlib.decompressobj(31)
    taken = 0
    while not unpack.eof:
        fresh = b"" if unpack.unconsumed_tail else file.read(STEP)
        taken += len(fresh)
        part = unpack.decompress(unpack.unconsumed_tail or fresh, STEP)
        if not (part or fresh or unpack.unconsumed_tail or unpack.eof):
            raise zlib.error("the file ends within a member")
        yield part
    yield at + taken - len(unpack.unused_data)


def candidates(file: pa.NativeFile, begin: int, end: int) -> Iterator[int]:
    """Where a member may begin in a range of bytes. A place may be sent, before which none is of interest."""
    at = begin
    while at < end:
        file.seek(at)
        data = file.read(min(STEP, end - at) + len(MAGIC))  # the header may cross the end of a step, and of the range
        i = data.find(MAGIC)
        if i < 0 or i >= min(STEP, end - at):
            at += min(STEP, end - at)
            continue
        at += i
        if data[i + 3 : i + 4] >= b"\x20":  # bits that no member has
            at += 1
            continue
        later = yield at
        at = max(at + 1, later or 0)


def pieces(file: pa.NativeFile, begin: int, end: int, separator: bytes) -> Iterator[tuple]:
    """start, k, kind, value, end, failed of what begins in a range. Members that follow each other are one unit, named by where
    the first begins: its complete rows with their number, its head before the first separator and its tail after the last (a head
    alone if it has none), and one row more for where it ends and whether it failed."""
    found = candidates(file, begin, end)
    at = next(found, None)
    while at is not None:
        start, rest, k, failed = at, bytearray(), 0, False
        while True:
            try:
                for part in member(file, at):
                    if isinstance(part, int):
                        at = part
                        break
                    look = max(0, len(rest) - len(separator) + 1)
                    rest += part
                    if rest.find(separator, look) >= 0:
                        *whole, last = bytes(rest).split(separator)
                        for value in whole:
                            yield start, k, "row" if k else "head", value, None, None
                            k += 1
                        rest = bytearray(last)
            except zlib.error:
                failed = True
                break
            file.seek(at)
            if at >= end or file.read(len(MAGIC)) != MAGIC:
                break
        yield start, k, "tail" if k else "head", bytes(rest), None, None
        yield start, k, "end", None, at, failed
        try:
            at = found.send(at if at > start else start + 1)
        except StopIteration:
            at = None


def member_rows(files: DataFrame, separator: str = "\n") -> DataFrame:
    """value, _file, _block, _k of the rows of gzip files (_file, path, length): blocks are in the order of the file, and _k is a row's number in
    its block.

    Each task looks through a range of compressed bytes for members. A place within a member's data that looks like a member is known
    by the members before it, which reach beyond it. A row that crosses the border of ranges is put together from its parts,
    which alone are shuffled. Files of one member are streamed by one task; memory is bounded by a row and a step of bytes.
    ValueError: a member that cannot be unpacked, or bytes that are of none, zeros after the last included. An empty file has no rows.
    """
    sep = separator.encode()
    ranges = files.where("length > 0").select("_file", "path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {RANGE_BYTES}L)")).alias("begin"))
    n = max(1, min(ranges.count(), 10_000))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_file", "start", "k", "kind", "value", "stop", "failed"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.bool_()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for given in batches:
            for name, path, length, begin in zip(*[given.column(c).to_pylist() for c in ("_file", "path", "length", "begin")], strict=True):
                system, own = opened(path)
                with system.open_input_file(own) as file:
                    rows: list[tuple] = []
                    size = 0
                    for piece in pieces(file, begin, min(begin + RANGE_BYTES, length), sep):
                        rows.append((name, *piece))
                        size += len(piece[3] or b"") + 64
                        if size >= STEP:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    parts = stored(ranges.repartition(n).mapInArrow(read, PIECE), "gzip-pieces")

    # a row or two for each range of bytes
    units = parts.where("kind = 'end'").select("_file", "start", "stop", "failed", (F.col("k") > 0).alias("cut"))
    upto = W.partitionBy("_file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    units = units.withColumn("reach", F.coalesce(F.max(F.when(~F.col("failed"), F.col("stop"))).over(upto), F.lit(0)))
    units = units.where("start >= reach").withColumn("group", F.coalesce(F.sum(F.col("cut").cast("long")).over(upto), F.lit(0)))
    units = stored(units, "gzip-units")
    ends = units.groupBy("_file").agg(F.max("stop").alias("stop"), F.max(F.col("failed") | (F.col("start") > F.col("reach"))).alias("failed"))
    wrong = files.where("length > 0").join(ends, "_file", "left").where("failed OR stop IS NULL OR stop < length").select("_file").limit(3).collect()
    if wrong:
        raise ValueError(f"not gzip, cut or damaged: {', '.join(r[0] for r in wrong)}")

    known = parts.where("kind <> 'end'").join(F.broadcast(units.select("_file", "start", "group")), ["_file", "start"])  # a row or two for each range
    inside = known.where("kind = 'row'").select("value", "_file", (2 * F.col("start") + 1).alias("_block"), "k")
    borders = known.where("kind <> 'row'").withColumn("group", F.col("group") + (F.col("kind") == "tail").cast("long"))
    joined = borders.groupBy("_file", "group").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("x"))
    last = joined.groupBy("_file").agg(F.max("group").alias("last"))
    joined = joined.join(F.broadcast(last), "_file")  # a row for each file
    text = F.expr("cast(aggregate(x, X'', (a, p) -> concat(a, p.value)) AS string)")
    block = F.expr("CASE WHEN x[0].kind = 'tail' THEN 2 * x[0].start + 2 ELSE 0L END")
    joined = joined.select("_file", block.alias("_block"), (F.col("group") == F.col("last")).alias("last"), F.split(text, F.lit(f"\\Q{separator}\\E"), -1).alias("v"))
    v = F.expr("CASE WHEN last AND v[size(v) - 1] = '' THEN slice(v, 1, size(v) - 1) ELSE v END")
    crossing = joined.select("_file", "_block", F.posexplode(v).alias("k", "value")).select("value", "_file", "_block", F.col("k").cast("long").alias("_k"))
    return inside.select(F.col("value").cast("string").alias("value"), "_file", "_block", (F.col("k") - 1).alias("_k")).unionByName(crossing)
