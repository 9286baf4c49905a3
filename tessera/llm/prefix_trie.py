"""A prefix trie over conversations, built as burst tries.

A sequence is what a conversation's turns spell: 16 digest bytes for each turn, side by side, and the code points of each text.
Equal sequences are one row with a count. Sequences hang in suffix containers, each under a trie head, at first all under the
root. A container with more than ROOM turns bursts: the head keeps what it knows of its container (counts, least member, whether
a sequence ends there) and each next turn id becomes a head with a container of its own. A head that all its container's
sequences pass on from together moves down to where they part, so that rounds follow branches and not turns. The containers
that remain are sorted and swept into nodes, within tasks, by a stack of the nodes that are open. Burst heads get what their
children add up to round by round from below.

No task holds more than a container: of ROOM turns, or one sequence. A frequent first turn is a head that bursts, copies
of a conversation are counted before they are moved, and lists of members are hashed in order from pieces joined before.

A row without a conv_id belongs to no conversation. Null role or text is empty; turns sort by number, null first, and then by
their digests; repeated rows are repeated turns; other columns are not read. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import small, stored, table, whole

#: Turns that a container holds before it bursts.
ROOM = 200_000
#: Digest bytes of a turn.
WIDTH = 16
#: Characters of a piece of a list of members.
PIECE = 1 << 16
NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, parent binary"
NONE = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, id, n) in order, id the digest of role and text, n the text's code points. rows: conv_id, turn, role, text.
    Texts give way to their digests before anything is shuffled."""
    role, text = whole("role"), whole("text")
    each = rows.where("conv_id IS NOT NULL").select("conv_id", F.struct("turn", F.md5(F.concat(F.length(role), F.lit(":"), role, text).cast("binary")).alias("id"), F.length(text).alias("n")).alias("t"))
    return each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def sequences(own: DataFrame, members: str) -> tuple[DataFrame, DataFrame]:
    """own (conv_id, turns) as sequences: conv_id, key, path, lens of each, stored under the name `members`; and each distinct
    one once with first (its least conv_id), m (how many have it)."""
    path = F.unhex(F.array_join(F.col("turns")["id"], ""))
    rows = own.select("conv_id", path.alias("path"), F.col("turns")["n"].alias("lens")).withColumn("key", F.unhex(F.md5("path")))
    rows = stored(rows, members)
    one = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("m"))
    return rows, rows.join(one.withColumnRenamed("conv_id", "first").drop("key"), F.col("conv_id") == F.col("first")).select("key", "first", "m", "path", "lens")


def member_hashes(rows: DataFrame) -> DataFrame:
    """key, ends: the SHA-256 of the conv_ids with each key, ascending, joined by commas. Runs of ids of one key are joined to
    pieces of bounded size where they lie, over ranges of key and id, so that the one who hashes a frequent key reads few rows."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def piece(key: bytes, ids: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "lo": pa.array([int(ids[0])]), "part": [",".join(ids)]})

        key, ids, size = None, [], 0
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or size > PIECE):
                    yield piece(key, ids)
                    ids, size = [], 0
                key = k
                ids.append(str(c))
                size += len(ids[-1])
        if ids:
            yield piece(key, ids)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: bytes, own) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": [own.hexdigest()]})

        key, own = None, None
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own is None or k != key:
                    if own is not None:
                        yield row(key, own)
                    key, own = k, hashlib.sha256(part.encode())
                else:
                    own.update(f",{part}".encode())
        if own is not None:
            yield row(key, own)

    pieces = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(joined, "key binary, lo long, part string")
    return pieces.repartition("key").sortWithinPartitions("key", "lo").select("key", "part").mapInArrow(hashed, "key binary, ends string")


class Open:
    """A node whose members are still being read."""

    __slots__ = ("depth", "first", "n", "chars", "children", "leaves", "saved", "ends", "done")

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars = depth, chars
        self.first, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, NONE
        self.done: list[tuple] = []  # its children's rows, which wait for its least member


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the containers of a task. Rows, by head and then by path: head, parent (the head above, null at the root), depth
    (of the head), first, m, path, lens, ends."""
    names = [f.split()[0] for f in NODE.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.binary()]
    out: list[tuple] = []
    stack: list[Open] = []
    head, above, before = None, None, b""

    def close() -> None:
        node = stack.pop()
        if not node.children:
            node.leaves = 1
        node.saved += (node.n - 1) * node.chars
        out.extend((c[0], c[1], node.first, *c[3:]) for c in node.done)
        row = (node.first, node.depth, None, node.n, node.children, node.leaves, node.saved, node.ends, None)
        if not stack:
            out.append((*row[:-1], above))
            return
        top = stack[-1]
        top.children += 1
        top.leaves += node.leaves
        top.saved += node.saved
        top.n += node.n
        top.first = node.first if top.first is None else min(top.first, node.first)
        top.done.append(row)

    def flush() -> pa.RecordBatch:
        cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * len(names), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(cols, names)

    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in ("head", "parent", "depth", "first", "m", "path", "lens", "ends")], strict=True):
            own, parent, depth, first, m, path, lens, ends = row
            if own != head or not stack:
                while stack:
                    close()
                head, above, before = own, parent, path
                stack.append(Open(depth, lens[depth - 1] if depth else 0))
                shared = depth
            else:
                shared, most = depth, min(len(before), len(path)) // WIDTH
                while shared < most and before[shared * WIDTH : (shared + 1) * WIDTH] == path[shared * WIDTH : (shared + 1) * WIDTH]:
                    shared += 1
                before = path
            while stack[-1].depth > shared:
                close()
            for d in range(shared, len(lens)):
                stack.append(Open(d + 1, lens[d]))
            node = stack[-1]
            node.n += m
            node.first = first if node.first is None else min(node.first, first)
            node.ends = ends
            if len(out) > 10_000:
                yield flush()
    while stack:
        close()
    yield flush()


def trie(distinct: DataFrame, room: int = ROOM) -> DataFrame:
    """A row for each node (columns of NODE but the last). distinct: first, m, path, lens, ends of each distinct sequence."""
    root = F.lit(b"")
    rows = distinct.select(root.alias("head"), F.lit(None).cast("binary").alias("parent"), F.lit(0).alias("depth"), "first", "m", "path", "lens", "ends")
    rows = stored(rows, "containers")
    settled, bursts = [], []
    while True:
        rest = F.size("lens") - F.col("depth")
        sizes = rows.groupBy("head").agg(
            F.sum(rest).alias("turns"), F.count("*").alias("n"), F.sum("m").alias("n_convs"), F.min("first").alias("conv_id"),
            F.min("path").alias("lo"), F.max("path").alias("hi"), F.min_by("lens", "first").alias("lens"), F.first("parent").alias("parent"), F.first("depth").alias("top"),
        )
        big = stored(sizes.where((F.col("turns") > room) & (F.col("n") > 1)), "burst-heads")
        if big.isEmpty():
            settled.append(rows)
            break
        # all sequences of a container pass through what its first and its last have in common
        common = F.expr(f"""aggregate(sequence(top, cast(least(length(lo), length(hi)) / {WIDTH} AS int)), top,
            (a, d) -> CASE WHEN a = d - 1 AND substring(lo, a * {WIDTH} + 1, {WIDTH}) = substring(hi, a * {WIDTH} + 1, {WIDTH}) THEN d ELSE a END)""")
        big = stored(big.withColumn("at", common).select("head", "parent", "top", "at", "conv_id", "n_convs", F.slice("lens", 1, F.col("at")).alias("lens")), "burst-heads")
        settled.append(rows.join(small(big.select("head")), "head", "left_anti"))
        going = stored(rows.select("head", "first", "m", "path", "lens", "ends").join(small(big.select("head", "at")), "head"), "bursting")
        ended = going.where(F.size("lens") == F.col("at")).select("head", "ends")
        bursts.append(stored(big.join(ended, "head", "left").withColumn("ends", F.coalesce("ends", F.lit(NONE))), "burst"))
        turn = F.expr(f"substring(path, at * {WIDTH} + 1, {WIDTH})")
        rows = stored(
            going.where(F.size("lens") > F.col("at")).select(F.unhex(F.md5(F.concat("head", F.lit(b"/"), F.expr(f"substring(path, 1, at * {WIDTH})"), turn))).alias("head"), F.col("head").alias("parent"), (F.col("at") + 1).alias("depth"), "first", "m", "path", "lens", "ends"),
            "containers",
        )
    order = ["head", "path"]
    containers = reduce(DataFrame.unionByName, settled)
    nodes = stored(containers.repartition("head").sortWithinPartitions(*order).mapInArrow(sweep, NODE), "nodes")
    out = [nodes.where("parent IS NULL")]
    tops = nodes.where("parent IS NOT NULL")
    for own in reversed(bursts):
        below = stored(tops.groupBy(F.col("parent").alias("head")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")), "below")
        heads = stored(own.join(below, "head"), "heads")
        # the turns of a head that moved down are nodes one below the other, with the same members
        saved = F.expr("below + (n_convs - 1) * aggregate(slice(lens, greatest(d, 1), size(lens) - greatest(d, 1) + 1), 0L, (a, x) -> a + x)")
        chain = heads.select("*", F.explode(F.sequence("top", "at")).alias("d"))
        chain = stored(
            chain.select(
                "conv_id", F.col("d").alias("depth"), F.when(F.col("d") > F.col("top"), F.col("conv_id")).alias("parent_conv_id"), "n_convs",
                F.when(F.col("d") < F.col("at"), F.lit(1).cast("long")).otherwise(F.col("n_children")).alias("n_children"), "n_leaves", saved.alias("saved_tokens"),
                F.when(F.col("d") < F.col("at"), F.lit(NONE)).otherwise(F.col("ends")).alias("ends_sha256"), F.when(F.col("d") == F.col("top"), F.col("parent")).alias("parent"),
            ),
            "chains",
        )
        # tops under this round's heads are done; those under earlier rounds' wait for them
        mine = own.select(F.col("head").alias("parent"), F.col("conv_id").alias("above"))
        done = tops.join(small(stored(mine, "parents")), "parent").withColumn("parent_conv_id", F.col("above")).drop("above")
        out += [done, chain.where("parent IS NULL")]
        tops = tops.join(small(stored(mine.select("parent"), "parents")), "parent", "left_anti").unionByName(chain.where("parent IS NOT NULL"))
        tops = stored(tops, "tops")
    return reduce(DataFrame.unionByName, out).drop("parent")


def rebuilt(own: DataFrame, first: Column, group: Column) -> DataFrame:
    """conv_id, turns: the `first` turns at the head of conversation `group`, then its own after as many. own: conv_id, turns."""
    base = own.select(F.col("conv_id").alias("base"), F.col("turns").alias("theirs"))
    rows = own.withColumn("base", group).withColumn("h", first)
    heads = rows.select("base").distinct().join(base, "base")  # only conversations that others begin with
    both = rows.join(heads, "base", "left")
    none = F.array().cast(dict(own.dtypes)["turns"])
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("theirs", 1, F.col("h")), none), tail).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str, room: int = ROOM) -> DataFrame:
    """A row for each distinct sequence of first turns of the rebuilt conversations. Rows without a conv_id are left out, nulls
    in role and text are empty, turns of equal number sort by their digests, an empty table gives no row."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = stored(turns(rows), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    members, distinct = sequences(rebuilt(own, h, F.col("conv_id") - F.col("conv_id") % 100), "members")
    nodes = trie(distinct.join(member_hashes(members), "key").drop("key"), room)
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), *[c for c in ("parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")])
