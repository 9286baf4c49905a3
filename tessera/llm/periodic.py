"""Periodic runs in texts: stretches of words that repeat with a period, found online by sparse diagonals, and their removal.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that holds at least
max(LEAST, TIMES * q) words and that no neighbouring word extends keeping the period.

Words are read once from left to right. An earlier occurrence of a word at distance q puts it on diagonal q, whose match length
grows by one with each further word that agrees; a diagonal that ends with sufficient length is a run. Most diagonals of frequent
words end at once, so only those are opened that can still suffice. A run with period q matches over at least 3 q words, so
that a lag between `lo` and 1.5 `lo` is opened only where the next 3 `lo` words agree as well, which are at least two periods:
of such a block's earlier occurrences only the nearest one can belong to a run with this period, for a nearer one would give
the run a smaller period. Each word so has one active lag for each of the O(log n) widths at most, whatever its frequency, and all
runs come out whole: work is O(n log^2 n) for any text, and a text stops at the first width at which nothing repeats.

Null and empty texts have no word and no run. Texts are taken whole; repeated rows give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import WORD, appended, table, unused, whole

#: Words of a run at least, and periods.
LEAST, TIMES = 6, 4


def widths(n: int) -> Iterator[tuple[int, int, int]]:
    """(lo, hi, block): classes of lags up to n / TIMES, and how many words must agree ahead to open a lag of the class: at least
    twice hi, and no more than a run with lag lo matches over."""
    lo = 1
    while TIMES * lo <= n:
        hi = lo * 3 // 2
        yield lo, hi, max(LEAST - 1, 3 * lo)
        lo = hi + 1


def classes(places: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys get equal ids, dense from 0; and for each place the nearest earlier one with its key, or -1. Places ascend."""
    order = np.argsort(keys, kind="stable")
    same = np.empty(len(keys), bool)
    same[:1] = False
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    ids, before = np.empty(len(keys), np.int64), np.full(len(keys), -1, np.int64)
    ids[order] = np.cumsum(~same) - 1
    before[order[1:][same[1:]]] = places[order[:-1][same[1:]]]
    return ids, before


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text, by start and period."""
    n = len(words)
    if n < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    places, have = np.arange(n), 1  # where blocks of `have` words may repeat; -1 in ids elsewhere
    found = []
    for lo, hi, block in widths(n):
        while have < block:
            step = min(have, block - have)
            places = places[places + step + have <= n]
            places = places[(ids[places] >= 0) & (ids[places + step] >= 0)]
            own, before = classes(places, ids[places] * (n + 1) + ids[places + step])
            again = np.bincount(own)[own] > 1 if len(own) else np.zeros(0, bool)
            ids = np.full(n, -1, np.int64)
            places, before = places[again], before[again]
            ids[places] = own[again]
            have += step
        if not len(places):
            break
        lag = np.where(before >= 0, places - before, 0)
        active = (lag >= lo) & (lag <= hi)
        at, lag = places[active], lag[active]
        if not len(at):
            continue
        # a diagonal goes on while the next word has the same lag, and ends else
        ends = np.append(np.flatnonzero((np.diff(at) != 1) | (np.diff(lag) != 0)), len(at) - 1)
        for i, j in zip([0, *(ends[:-1] + 1)], ends, strict=True):
            q, matched = int(lag[i]), int(at[j] - at[i]) + block
            if matched + q >= max(LEAST, TIMES * q):
                found.append((int(at[i]) - q, matched + q, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def searched(texts: pa.Array) -> list[pa.Array]:
    """The runs of each text, and its words that stay, joined by one space."""
    all_runs, collapsed = [], []
    for text in texts:
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # splits at the ASCII white space alone
        own = runs(words)
        all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
        collapsed.append(b" ".join(words if not own else [words[i] for i in np.flatnonzero(kept(len(words), own))]).decode())
    item = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
    return [pa.array(all_runs, pa.list_(item)), pa.array(collapsed, pa.string())]


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `runs` (by start, then period) and `collapsed` (under names that no other column has, underscores added)."""
    found, collapsed = unused(docs.columns, "runs", "collapsed")
    return appended(docs, whole(F.col(f"`{text}`")), f"`{found}` array<struct<start:long,length:long,period:long>>, `{collapsed}` string", searched)


def made_periodic(doc_id: Column, text: Column) -> Column:
    """The text of the contract: for one document in ten by the checksum of its id, its words from word a on repeat with
    period p; else the text as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    some = F.coalesce((h % 10 == 0) & text.rlike(WORD), F.lit(False))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    fields = F.struct(words.alias("w"), (g % F.size(words)).cast("int").alias("a"), g.alias("g"))
    periods = F.transform(F.array(fields), lambda x: F.struct(x["w"].alias("w"), x["a"].alias("a"), (1 + F.floor((F.size(x["w"]) - x["a"]) / (3 + x["g"] % 8))).cast("int").alias("p")))
    made = F.transform(periods, lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))
    return F.when(some, F.get(made, F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each document's text as digests, and the run with the greatest length by period. Null text has no run and no
    word that stays; a null doc_id takes the text as it is; repeated rows stay; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", made_periodic(F.col("doc_id"), whole()).alias("text"))
    rows = with_runs(docs)
    # lengths by periods are compared as products, exactly; among equal ones the first stays, and runs come by start, then period
    top = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
