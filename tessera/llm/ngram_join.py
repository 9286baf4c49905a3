"""Self-join of documents by the Jaccard similarity of their word shingles, exact.

Equal sets are one node, and one of its documents stands for it. Under a total order of shingles, rare ones first, the
first shingle that two linked sets share lies in a prefix of both, so that few of an inverted index's lists are needed:

 1. Hub links. Sets with a common least hash are a group; each is compared with two hubs of its group, not with each other.
 2. Index. The prefixes' shingles give lists of (position, size). Lists are cut into blocks by size and position; two
    blocks are skipped if even their best pair has too little left after the list's shingle, and so are pairs of one
    component. Bitmaps of the sets, short ones and then longer ones, bound what a pair can share; what passes is compared in
    full.
 3. Long lists make no pairs. Lists with the same first set are one family, whose answers are derived within a task: a
    hub's intersection with each member is counted, and then any two members' from how they differ from the hub. The
    triangle inequality settles most of them at once. A family gives no more links than it has members; one too large for
    a task is dealt into parts, and each two parts are a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import arrow_rows, small, stored, table, unused, whole
from tessera.llm.graph import components
from tessera.llm.shingles import shingle_sets

#: A pair links when PARTS * intersection >= SHARE * union.
SHARE, PARTS = 75, 100
#: Shingles of more sets than COMMON are ordered by how many (the MOST_COMMON most frequent of them: 12 bytes each go to every
#: task); all others come first. The order decides speed, not links.
COMMON, MOST_COMMON = 32, 1 << 20
#: Lists of more sets than this make no pairs.
LONG = 2 * COMMON
#: Least hashes for hubs, and the size of a group from which it gets hubs.
KEYS, GROUP = 8, 8
#: Bytes of text for each bucket of the index, and of sets for each part of a family.
BUCKET_BYTES, FAMILY_BYTES = 16 << 20, 8 << 20
#: Sets in a block of a list, and blocks that are compared at once.
BLOCK, BLOCKS = 8, 1 << 15
#: Rows of lists that a task compares, about.
LIST_ROWS = 200_000
#: Classes of the short bitmaps, and of the longer ones for each shingle, at least.
BITS, MORE_BITS = 512, 4
#: Rows that a task in Python gets at once.
ROWS = 500
#: What a task holds at once: bytes of text, and shingles to be dealt out.
SLICE_BYTES, HELD = 1 << 20, 1 << 18


def least_common(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Least intersection of two linked sets of these sizes."""
    return -(-(SHARE * (n_a + n_b)) // (PARTS + SHARE))


def prefix(n: np.ndarray) -> np.ndarray:
    """Shingles of a set of n among which is the first that it shares with any linked set."""
    return np.where(n > 0, n - (-(-SHARE * n // PARTS)) + 1, 0)


def short_prefix(n: np.ndarray) -> np.ndarray:
    """The same for linked sets that are no smaller."""
    return np.where(n > 0, n - least_common(n, n) + 1, 0)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about SLICE_BYTES of text (their last column, binary) each."""
    for batch in batches:
        size = np.diff(np.frombuffer(batch.columns[-1].buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.columns[-1].offset)) if batch.num_rows else []
        part = np.cumsum(size) // SLICE_BYTES if batch.num_rows else []
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0, 0]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The set of each text of a batch."""
    return list(shingle_sets([x.as_py() for x in batch.columns[-1]]))


def _distinct_sets(batch: pa.RecordBatch) -> dict[bytes, np.ndarray]:
    return {set_id(s): s for s in _sets(batch) if len(s)}


def least_hashes(s: np.ndarray) -> list[int]:
    """The least shingle of each of KEYS equal ranges of hashes, as far as there is one."""
    bounds = np.arange(KEYS, dtype=np.uint64) << np.uint64(64 - KEYS.bit_length() + 1)
    at = np.searchsorted(s, bounds)
    there = np.flatnonzero(at < np.append(at[1:], len(s)))
    return s[at[there]].view(np.int64).tolist()


def parities(s: np.ndarray, classes: int) -> bytes:
    """For each class of shingles, whether the set has an odd number of them. Two sets' bitmaps differ in no more bits than
    the sets have shingles of their own. classes: a power of two; a bitmap's halves by exclusive or are that of half as many."""
    odd = np.bincount((s % np.uint64(classes)).astype(np.int64), minlength=classes).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two bitmaps of 64-bit words differ, the longer folded to the length of the other."""
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, text_hash, sid, n, least hashes and bitmaps of each row."""
    for batch in _slices(batches):
        sets = _sets(batch)
        sid = pa.array([set_id(s) if len(s) else None for s in sets], pa.binary())
        keys = pa.array([least_hashes(s) for s in sets], pa.list_(pa.int64()))
        bits = pa.array([parities(s, BITS) if len(s) else None for s in sets], pa.binary())
        more = pa.array([parities(s, max(64, 1 << (MORE_BITS * len(s) - 1).bit_length())) if len(s) else None for s in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], sid, pa.array([len(s) for s in sets], pa.int64()), keys, bits, more], ["id", "text_hash", "sid", "n", "keys", "bits", "more_bits"])


def _blobs(bucket: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket with the bytes of its part of each column."""
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    cuts = [*first.tolist(), len(bucket)]
    data = [pa.array([c[lo:hi].tobytes() for lo, hi in zip(cuts, cuts[1:], strict=False)], pa.binary()) for c in (c[order] for c in columns)]
    return pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), *data], ["bucket", *(f"c{i}" for i in range(len(columns)))])


def _placed(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Each shingle's bucket, and what tells it from others of its bucket."""
    return (tokens % np.uint64(buckets)).astype(np.int32), (tokens >> np.uint64(32)).astype(np.uint32)


def _key(bucket: np.ndarray, high: np.ndarray) -> np.ndarray:
    return high.astype(np.uint64) << np.uint64(32) | bucket.astype(np.uint64)


def counting(buckets: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def dealt() -> pa.RecordBatch:
            bucket, high = _placed(np.concatenate([*held, np.zeros(0, np.uint64)]), buckets)
            return _blobs(bucket, [high])

        for batch in _slices(batches):
            held += _distinct_sets(batch).values()
            if sum(map(len, held)) >= HELD:
                yield dealt()
                held = []
        yield dealt()

    return count


def frequent(part: pa.Table) -> pa.Table:
    """key and n of a bucket's shingles of more than COMMON sets."""
    v, n = np.unique(np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in part.column("c0")]), return_counts=True)
    key = _key(np.full(len(v), part.column("bucket")[0].as_py()), v)
    return pa.table({"key": key[n > COMMON].view(np.int64), "n": n[n > COMMON].astype(np.int64)})


def indexing(buckets: int, common: Broadcast) -> Callable:
    """Prefixes under the order (class of frequency, hash). common: sorted keys of common shingles and their classes."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, classes = common.value
        held: list[list[np.ndarray]] = []
        for batch in _slices(batches):
            found = _distinct_sets(batch)
            if not found:
                continue
            sets = list(found.values())
            n = np.array([len(s) for s in sets])
            flat, own = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
            bucket, high = _placed(flat, buckets)
            of = np.zeros(len(flat), np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key := _key(bucket, high)), len(keys) - 1)
                of = np.where(keys[at] == key, classes[at], 0)
            order = np.lexsort((of, own))  # stable: by hash within a class
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            kept = place < prefix(n)[own]
            order, place = order[kept], place[kept]
            # common shingles are known to be shared; they are dealt out evenly
            spread = -1 - (np.arange(len(order)) + order[:1].sum()) % buckets
            ids = np.frombuffer(b"".join(found), np.dtype("V16"))
            held.append([np.where(of[order] > 0, spread, bucket[order]).astype(np.int32), flat[order], ids[own[order]], n[own[order]].astype(np.int32), place.astype(np.int32)])
            if sum(len(x[0]) for x in held) >= HELD:
                yield _indexed(held)
                held = []
        if held:
            yield _indexed(held)

    return index


def _indexed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    bucket, *columns = [np.concatenate(c) for c in zip(*held, strict=True)]
    return _blobs(bucket, columns)


def _binary(ids: np.ndarray) -> pa.Array:
    """16-byte values as binary."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(ids), [None, pa.py_buffer(ids.tobytes())]).cast(pa.binary())


def shared(part: pa.Table) -> pa.Table:
    """Rows of a bucket whose shingle is in two sets at least, one of them early enough to be the smaller of a linked pair.
    Of common shingles all rows, to be counted by list."""
    token, sid, n, at = (np.frombuffer(b"".join(part.column(f"c{i}").to_pylist()), k) for i, k in enumerate((np.uint64, np.dtype("V16"), np.int32, np.int32)))
    if part.column("bucket")[0].as_py() < 0:
        return _rows(token, sid, n, at, np.ones(len(token), bool))
    two = sid.view(np.uint64).reshape(-1, 2)
    order = np.lexsort((two[:, 1], two[:, 0], token))
    token, sid, n, at, two = token[order], sid[order], n[order], at[order], two[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (two[1:] != two[:-1]).any(1)
    token, sid, n, at = token[new], sid[new], n[new], at[new]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    size = np.diff(np.append(first, len(token)))
    early = np.maximum.reduceat((at < short_prefix(n)).astype(np.int8), first) if len(first) else np.zeros(0)
    kept, long = np.repeat((size > 1) & (early > 0), size), np.repeat(size > LONG, size)
    return _rows(token[kept], sid[kept], n[kept], at[kept], long[kept])


def _rows(token: np.ndarray, sid: np.ndarray, n: np.ndarray, at: np.ndarray, common: np.ndarray) -> pa.Table:
    return pa.table({"token": token.view(np.int64), "sid": _binary(sid), "n": n, "at": at, "common": common})


def _numbers(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The values of the columns in ascending order, and each column as numbers of them."""
    sizes = np.cumsum([0, *map(len, columns)])
    every = pa.chunked_array([x for c in columns for x in c.chunks], pa.binary()).combine_chunks().dictionary_encode()
    rank = pc.sort_indices(every.dictionary)
    back = np.empty(len(rank), np.int64)
    back[rank.to_numpy()] = np.arange(len(rank))
    codes = back[every.indices.to_numpy()] if len(rank) else np.zeros(0, np.int64)
    return every.dictionary.take(rank), [codes[lo:hi] for lo, hi in zip(sizes, sizes[1:], strict=False)]


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] ... first[i] + size[i] - 1, one after the other, and their i."""
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + first[of], of


def _pairs_of(values: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Table:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    return pa.table({"a": values.take(pa.array(lo)), "b": values.take(pa.array(hi))})


def pairs(part: pa.Table) -> pa.Table:
    """Pairs of sets of different components of which a list's shingle may be the first that they share, and which could
    be similar."""
    values, (sid, root) = _numbers(part.column("sid"), part.column("root"))
    token, n, at = (part.column(c).to_numpy().astype(np.int64) for c in ("token", "n", "at"))
    size_class = np.floor(np.log(np.maximum(n, 1)) / np.log(PARTS / SHARE))
    order = np.lexsort((at, size_class, token))
    token, sid, n, at, root = token[order], sid[order], n[order], at[order], root[order]
    rest = n - at  # what a pair can share if this is its first
    lists = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    size = np.diff(np.append(lists, len(token)))
    # blocks, and each two of a list
    count = -(-size // BLOCK)
    k, of = _ranges(np.zeros(len(count), int), count)
    begin = lists[of] + BLOCK * k
    end = np.minimum(begin + BLOCK, (lists + size)[of])
    if not len(begin):
        return _pairs_of(values, np.zeros(0, int), np.zeros(0, int))
    n_lo, n_hi, r_hi = np.minimum.reduceat(n, begin), np.maximum.reduceat(n, begin), np.maximum.reduceat(rest, begin)
    root_lo, root_hi = np.minimum.reduceat(root, begin), np.maximum.reduceat(root, begin)
    found = [np.zeros(0, np.int64)]
    later = count[of] - k
    for lo in range(0, len(begin), BLOCKS):
        y, x = _ranges(np.arange(lo, min(lo + BLOCKS, len(begin))), later[lo : lo + BLOCKS])
        x += lo
        ok = PARTS * n_hi[x] >= SHARE * n_lo[y]
        ok &= PARTS * n_hi[y] >= SHARE * n_lo[x]
        ok &= np.minimum(r_hi[x], r_hi[y]) >= least_common(n_lo[x], n_lo[y])
        ok &= (root_lo[x] != root_hi[y]) | (root_hi[x] != root_lo[y])
        x, y = x[ok], y[ok]
        wide = (end - begin)[y]
        c, of_pair = _ranges(np.zeros(len(x), int), (end - begin)[x] * wide)
        i, j = begin[x][of_pair] + c // wide[of_pair], begin[y][of_pair] + c % wide[of_pair]
        ok = (i < j) & (root[i] != root[j]) & (np.minimum(rest[i], rest[j]) >= least_common(n[i], n[j]))
        i, j = sid[i[ok]], sid[j[ok]]
        found.append(np.unique(np.minimum(i, j) * len(values) + np.maximum(i, j)))
    code = np.unique(np.concatenate(found))
    return _pairs_of(values, code // len(values), code % len(values))


def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        found = _distinct_sets(batch)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([s.tobytes() for s in found.values()], pa.binary())], ["sid", "data"])


def bounding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sizes, bitmaps) that could link by their bitmaps."""
    for batch in batches:
        n, m = (batch.column(k).to_numpy() for k in (2, 3))
        own = np.array([apart(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column(4), batch.column(5), strict=True)], np.int64)
        ok = 2 * least_common(n, m) + own <= n + m
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def comparing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sets) that link."""
    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.concatenate([s, t])
            both.sort(kind="stable")  # of two sorted runs
            common = np.count_nonzero(both[1:] == both[:-1])
            ok.append(PARTS * common >= SHARE * (len(s) + len(t) - common))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))


def derived(part: pa.Table) -> pa.Table:
    """Links between members (sid, n, root, side, data) of a family that make a forest over their components: none of them
    is within a component, and none is left out between two. With two sides, pairs within a side are another task's."""
    values, (sid, label) = _numbers(part.column("sid"), part.column("root"))
    side = part.column("side").to_numpy()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part.column("data")]
    n = np.array([len(s) for s in sets])
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(n)), n)
    v, code, held = np.unique(flat, return_inverse=True, return_counts=True)
    hub = int(np.argmax(np.bincount(own, held[code]) / n))  # the set with the most usual shingles
    in_hub = np.isin(v, sets[hub])[code]
    near = np.bincount(own[in_hub], minlength=len(n))  # intersection with the hub
    extra = n - near
    # which of the hub's shingles each has, as bits; its other shingles as lists of the members that have them
    width = -(-n[hub] // 64) * 8
    of_hub = np.zeros((len(n), width), np.uint8)
    place = np.searchsorted(sets[hub], flat[in_hub])
    np.bitwise_or.at(of_hub, (own[in_hub], place // 8), (1 << place % 8).astype(np.uint8))
    of_hub = of_hub.view(np.uint64)
    more = ~in_hub & (held[code] > 1)
    by = np.argsort(code[more], kind="stable")
    members, codes = own[more][by], code[more][by]
    begin = np.searchsorted(codes, code[more])
    end = np.searchsorted(codes, code[more], "right")
    own_more = np.searchsorted(own[more], np.arange(len(n) + 1))
    a, b = [], []
    two = side.min() != side.max() if len(side) else False
    for x in range(len(n)):
        y = np.arange(x + 1, len(n))
        y = y[label[y] != label[x]]
        y = y[side[y] != side[x]] if two else y
        need = least_common(n[x], n[y])
        sure = near[x] + near[y] - n[hub] >= need
        open_ = ~sure & (np.minimum(near[x], near[y]) + np.minimum(extra[x], extra[y]) >= need)
        z = y[open_]
        if len(z):
            common = np.bitwise_count(of_hub[z] & of_hub[x]).sum(1, dtype=np.int64)
            lists = slice(own_more[x], own_more[x + 1])
            i, _ = _ranges(begin[lists], (end - begin)[lists])
            common += np.bincount(members[i], minlength=len(n))[z]
            sure[open_] = common >= need[open_]
        linked = y[sure]
        if len(linked):
            labels, first = np.unique(label[linked], return_index=True)
            a += [sid[x]] * len(labels)
            b += sid[linked[first]].tolist()
            label[np.isin(label, labels)] = label[x]
    return _pairs_of(values, np.array(a, np.int64), np.array(b, np.int64))


def fetched(texts: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """sid, data (its shingles) for each sid of `wanted`, from the texts that stand for them alone."""
    of = small(stored(nodes.join(wanted, "sid", "left_semi").select(F.col("id").alias("of_id"), F.col("text_hash").alias("of_hash")), "wanted"))
    some = texts.join(of, F.col("text_hash").eqNullSafe(F.col("of_hash")) & F.col("id").eqNullSafe(F.col("of_id")), "left_semi")
    return stored(some.select("text").mapInArrow(fetch, "sid binary, data binary"), "sets")


def beside(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, and each of the columns of rows (sid) for a and for b."""
    one = rows.select(F.col("sid").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    two = rows.select(F.col("sid").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", *[f"{c}_{x}" for c in columns for x in "ab"])


def verified(pairs: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that link, each compared in full if its bitmaps allow it."""
    for bits in ("bits", "more_bits"):
        pairs = stored(beside(pairs, nodes, ["n", bits]).mapInArrow(bounding, "a binary, b binary"), bits)
    sets = fetched(texts, nodes, pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct())
    return stored(beside(pairs, sets, ["data"]).mapInArrow(comparing, "a binary, b binary"), "compared")


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with the root of their sid, itself where it has no link."""
    return rows.join(small(roots.select(F.col("node").alias("sid"), "root")), "sid", "left").withColumn("root", F.coalesce("root", "sid"))


def hub_pairs(nodes: DataFrame) -> DataFrame:
    """Each set with a common least hash, and two hubs of its group: the one whose least hashes are those of most sets, and
    any one."""
    keyed = nodes.select("sid", "n", F.explode("keys").alias("key"))
    groups = small(stored(keyed.groupBy("key").agg(F.count("*").alias("m")).where(f"m >= {GROUP}"), "groups"))
    keyed = stored(keyed.join(groups, "key"), "keyed")
    usual = keyed.groupBy("sid").agg(F.sum("m").alias("usual"))
    order = F.xxhash64("key", "sid").alias("h")
    hub = [F.max(F.struct("usual", order, "sid", "n")).alias("x"), F.min(F.struct(order, "sid", "n")).alias("y")]
    hubs = keyed.join(usual, "sid").groupBy("key").agg(*hub)
    hubs = stored(hubs.select("key", F.explode(F.array(F.struct("x.sid", "x.n"), F.struct("y.sid", "y.n"))).alias("hub")), "hubs")
    near = keyed.join(small(hubs), "key").where(f"hub.sid <> sid AND {PARTS} * least(n, hub.n) >= {SHARE} * greatest(n, hub.n)")
    return stored(near.select(F.least("sid", "hub.sid").alias("a"), F.greatest("sid", "hub.sid").alias("b")).distinct(), "near")


def common_shingles(texts: DataFrame, buckets: int) -> Broadcast:
    """Sorted keys of common shingles and the classes of their frequency, MOST_COMMON of them at most."""
    counts = texts.mapInArrow(counting(buckets), "bucket int, c0 binary").groupBy("bucket").applyInArrow(frequent, "key long, n long")
    found = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toPandas()
    keys, classes = found["key"].to_numpy(np.int64).view(np.uint64), np.floor(2 * np.log2(found["n"].to_numpy(np.float64))).astype(np.uint8)
    order = np.argsort(keys)
    return texts.sparkSession.sparkContext.broadcast((keys[order], classes[order]))


def lists_of(texts: DataFrame, buckets: int, common: Broadcast) -> tuple[DataFrame, DataFrame]:
    """Lists of LONG sets at most (token, sid, n, at), and the members of families of longer ones (family, sid, n)."""
    index = texts.mapInArrow(indexing(buckets, common), "bucket int, c0 binary, c1 binary, c2 binary, c3 binary")
    rows = stored(index.groupBy("bucket").applyInArrow(shared, "token long, sid binary, n int, at int, common boolean"), "index")
    held = stored(rows.where("common").groupBy("token").agg(F.count("*").alias("m"), F.min("sid").alias("family")).where("m > 1"), "long-lists")
    by_list = rows.where("common").join(small(held), "token")
    short = rows.where("NOT common").unionByName(by_list.where(f"m <= {LONG}").select(*rows.columns)).drop("common")
    return short, by_list.where(f"m > {LONG}").select("family", "sid", "n").distinct()


def family_links(members: DataFrame, roots: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links of families (family, sid, n). One of more than FAMILY_BYTES is dealt into parts, and each two parts are a task."""
    members = stored(rooted(members, roots), "members")
    size = members.groupBy("family").agg(F.ceil(8 * F.sum("n") / FAMILY_BYTES).cast("int").alias("parts"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    size = small(stored(size.where("lo <> hi").select("family", "parts"), "families"))
    dealt = members.join(size, "family").withColumn("side", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "sid", "root")
    dealt = stored(dealt, "dealt")
    full = dealt.join(sets(dealt.select("sid").distinct()), "sid").select("family", "i", "j", "sid", "root", "side", "data")
    return full.groupBy("family", "i", "j").applyInArrow(derived, "a binary, b binary")


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text_hash, sid, n (size of its set), root, component (least id that links reach, itself included) for each row
    of docs. Rows with equal root, a node, are of one component.

    Null texts and texts without a word have an empty set, n = 0, and link with nothing. Rows with fewer words than a
    shingle have one shingle. Repeated rows link like any copies. A null id is no candidate for `component`, which is
    null where no row of the component has an id. Other columns are not read. An empty table gives an empty table.
    """
    with arrow_rows(docs.sparkSession, ROWS):
        return _linked(docs, id_col, text_col)


def _linked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), whole(text_col).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    about = stored(rows.mapInArrow(described, "id long, text_hash long, sid binary, n long, keys array<long>, bits binary, more_bits binary"), "about")
    off = not_standing(about)
    texts, nodes = standing(rows, off), standing(about.where("sid IS NOT NULL"), off)

    links = verified(hub_pairs(nodes), texts, nodes)
    roots = stored(components(links), "roots")

    short, members = lists_of(texts, buckets, common_shingles(texts, buckets))
    lists = rooted(short, roots)
    parts = max(12, -(-short.count() // LIST_ROWS))
    found = lists.groupBy(F.pmod(F.xxhash64("token"), F.lit(parts)).alias("bucket")).applyInArrow(pairs, "a binary, b binary")
    links = links.unionByName(verified(stored(found.distinct(), "candidates"), texts, nodes))
    links = links.unionByName(stored(family_links(members, roots, lambda wanted: fetched(texts, nodes, wanted)), "family-links"))

    roots = stored(components(links), "roots")
    named = stored(rooted(about.where("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("least"), F.count("*").alias("m")), roots), "rooted")
    least = stored(named.groupBy("root").agg(F.min("least").alias("component"), F.sum("m").alias("m")).where("m > 1").drop("m"), "least")
    named = stored(named.join(small(least), "root", "left").select("sid", "root", F.coalesce("component", "least").alias("component")), "named")
    out = about.select("id", "text_hash", "sid", "n").join(named, "sid", "left")
    return out.select("id", "text_hash", "sid", "n", "root", F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def not_standing(about: DataFrame) -> DataFrame:
    """off_id, off_hash of rows that do not stand for their set; `again`: one of several equal rows does."""
    each = about.groupBy("sid", "id", "text_hash").agg(F.count("*").alias("m"))
    rep = each.where("sid IS NOT NULL").groupBy("sid").agg(F.min(F.struct("text_hash", "id")).alias("rep"))
    each = each.join(rep, "sid", "left")
    is_rep = F.coalesce(F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("text_hash") == F.col("rep.text_hash")), F.lit(False))
    off = each.select(F.col("id").alias("off_id"), F.col("text_hash").alias("off_hash"), (is_rep & (F.col("m") > 1)).alias("again"), is_rep.alias("is_rep"))
    return stored(off.where("NOT is_rep OR again").drop("is_rep"), "off")


def standing(rows: DataFrame, off: DataFrame) -> DataFrame:
    """The rows (id, text_hash, others) that stand for a set, one for each."""
    same = F.col("text_hash").eqNullSafe(F.col("off_hash")) & F.col("id").eqNullSafe(F.col("off_id"))
    once = rows.join(small(off.select("off_id", "off_hash")), same, "left_anti")
    again = off.where("again")
    return once if again.isEmpty() else once.unionByName(rows.join(small(again), same, "left_semi").dropDuplicates(["id", "text_hash"]))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near duplicates: of each component the row of least id stays (null last, then by its text's hash),
    once if it is repeated. Rows without a word all stay. Other columns stay as they are, whatever their names."""
    rows = stored(linked(docs, id_col, text_col).where("root IS NOT NULL").select("id", "text_hash", "root"), "linked")
    first = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("text_hash"))
    best = rows.groupBy("root").agg(F.min(first).alias("best"), F.count("*").alias("m")).where("m > 1").drop("m")
    held = rows.join(small(stored(best, "best")), "root")
    is_best = F.col("id").eqNullSafe(F.col("best.id")) & F.col("text_hash").eqNullSafe(F.col("best.text_hash"))
    its_id, its_hash, stays, m = unused(docs.columns, "id", "hash", "stays", "m")
    held = held.groupBy(F.col("id").alias(its_id), F.col("text_hash").alias(its_hash)).agg(F.first(is_best).alias(stays), F.count("*").alias(m))
    held = stored(held.where(f"NOT `{stays}` OR `{m}` > 1"), "held")
    out = docs.join(small(held), F.col(id_col).cast("long").eqNullSafe(F.col(its_id)) & F.xxhash64(text_col).eqNullSafe(F.col(its_hash)), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    many = out.where(F.col(stays)).dropDuplicates([its_id, its_hash]).select(*columns)
    return out.where(F.col(stays).isNull()).select(*columns).unionByName(many)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    out = linked(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
