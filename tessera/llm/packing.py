"""Packing documents into training sequences: best fit under conflicts.

Bins are ordered by what room is left in them and carry bitmaps of the sources and duplicate clusters that they hold. For
each document, largest first, the search starts at the tightest bin that it fits into and goes on from bin to bin until
one is compatible; only if none is, a new bin is opened.

Rows are dealt by a hash into windows of about WINDOW rows, and each window is a task's; bins do not reach over windows. So
windows are full and the result is the same whatever the partitions, no source or cluster gathers in one task, and memory
is bounded. Only what packing needs is shuffled, not the texts. A document's clusters are by default its least shingles,
one of each of KEYS ranges: exact copies share all of them, and near copies nearly always one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import arrow_rows, n_words, stored, table, whole
from tessera.llm.shingles import shingle_sets

CAPACITY = 4096
WINDOW = 16_384
#: Documents of one source that a bin may hold. Of one duplicate cluster it holds one.
PER_SOURCE = 4
#: Least shingles that stand for a document's clusters.
KEYS = 4
#: Rows that a task in Python gets at once.
ROWS = 500

SCHEMA = "doc_id long, piece int, first long, n long, bin string, place long"


class Bins:
    """Residual-ordered bins of one window."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (room left, bin)
        self.sources: list[list[int]] = []  # for each bin, bitmap j: sources with more than j documents
        self.clusters: list[int] = []

    def put(self, n: int, source: int, clusters: int) -> tuple[int, int]:
        """bin and place of a piece of n; source is a number, clusters a bitmap of numbers."""
        s, c = 1 << source, clusters
        last = self.per_source - 1
        for k in range(bisect_left(self.order, (n, -1)), len(self.order)):
            room, at = self.order[k]
            if not (self.clusters[at] & c or self.sources[at][last] & s):
                del self.order[k]
                break
        else:
            room, at = self.capacity, len(self.clusters)
            self.sources.append([0] * self.per_source)
            self.clusters.append(0)
        self.clusters[at] |= c
        planes = self.sources[at]
        for j in range(self.per_source):
            if not planes[j] & s:
                planes[j] |= s
                break
        insort(self.order, (room - n, at))
        return at, self.capacity - room


def pack_window(rows: list[tuple], capacity: int, per_source: int, label: str) -> list[tuple]:
    """Packed pieces of rows (doc_id, n, source, clusters)."""
    out, rest = [], []
    for i, (doc_id, n, _, _) in enumerate(rows):
        full = n // capacity
        out += [(doc_id, k, k * capacity, capacity, f"{label}-full-{i}-{k}", 0) for k in range(full)]
        if n % capacity:
            rest.append((n % capacity, i, full))
        elif not n:
            out.append((doc_id, 0, 0, 0, None, None))
    seen = Counter(c for _, i, _ in rest for c in set(rows[i][3] or ()))
    numbers = {c: k for k, c in enumerate(c for c, m in seen.items() if m > 1)}  # one that is alone conflicts with none
    sources: dict = {}
    bins = Bins(capacity, per_source)
    for n, i, piece in sorted(rest, key=lambda x: (-x[0], x[1])):
        doc_id, _, source, clusters = rows[i]
        mask = sum(1 << numbers[c] for c in set(clusters or ()) if c in numbers)
        at, place = bins.put(n, sources.setdefault(source, len(sources)), mask)
        out.append((doc_id, piece, piece * capacity, n, f"{label}-{at}", place))
    return out


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, gives way to its clusters."""
    bounds = np.arange(KEYS, dtype=np.uint64) << np.uint64(65 - KEYS.bit_length())
    for batch in batches:
        found = []
        for s in shingle_sets([x.as_py() for x in batch.columns[-1]]):
            at = np.searchsorted(s, bounds)
            found.append(s[at[at < np.append(at[1:], len(s))]].view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "clusters"])


def packed(docs: DataFrame, capacity: int = CAPACITY, per_source: int = PER_SOURCE, window: int = WINDOW, size: Column | None = None, clusters: Column | None = None) -> DataFrame:
    """doc_id, piece, first, n, bin, place for each piece of each row of docs (doc_id, source, text).

    size: a row's length, by default its words; clusters: an array of its duplicate clusters (64-bit integers), by default
    its least shingles. A longer row is cut into full pieces, each a bin of its own, and a rest; first is where a piece begins
    in its row, place where it lies in its bin. Null and empty texts have one piece of 0 in no bin. A null source is a source
    of its own, a null id stays null, repeated rows are rows of one cluster, other columns are not read, and an empty table
    gives an empty table. The same rows give the same bins, however they are partitioned; only where equal rows are more than
    half a window they are dealt by their place in the table.
    """
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(size if size is not None else n_words(), F.lit(0)).cast("long").alias("n"), F.xxhash64("source", F.col("source").isNull()).alias("source"), F.xxhash64("doc_id", "text").alias("h")]
    if clusters is not None:
        rows = stored(docs.select(*own, clusters.cast("array<bigint>").alias("clusters")), "sizes")
    else:
        with arrow_rows(docs.sparkSession, ROWS):
            rows = docs.select(*own, whole().cast("binary").alias("text")).mapInArrow(keyed, "doc_id long, n long, source long, h long, clusters array<long>")
            rows = stored(rows, "sizes")
    windows = max(1, -(-rows.count() // window))
    many = stored(rows.groupBy("h").agg(F.count("*").alias("m")).where(f"m > {window // 2}").select("h", F.lit(True).alias("many")), "equal-rows")
    if not many.isEmpty():
        # h is rows' own, and few values are that frequent: fewer than two for each window
        rows = rows.join(many, "h", "left").withColumn("h", F.when(F.col("many"), F.xxhash64("h", F.monotonically_increasing_id())).otherwise(F.col("h")))
    dealt = rows.withColumn("window", F.pmod(F.xxhash64("h"), F.lit(windows)))

    def pack(part: pa.Table) -> pa.Table:
        label = part.column("window")[0].as_py()
        columns = [part.column(c).to_pylist() for c in ("h", "doc_id", "n", "source", "clusters")]
        rows = [r[1:] for r in sorted(zip(*columns, strict=True), key=lambda r: (r[0], r[2], r[3], r[1] is None, r[1] or 0))]
        found = list(zip(*pack_window(rows, capacity, per_source, str(label)), strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["doc_id", "piece", "first", "n", "bin", "place"])

    return dealt.groupBy("window").applyInArrow(pack, SCHEMA)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and their bins."""
    return packed(table(spark, sf_dir, "documents"))
