"""Media columns: audio fingerprints from chroma, and the alignment of recordings by them.

A recording's frames become energies of the 12 pitch classes. Filters compare areas of that picture through its integral
image; 16 of them give 2 bits each, packed into an integer for each frame. Recordings that hold the same passage share
integers at a constant offset: a histogram of offsets proposes alignments, and the stretch of the overlap in which bit errors
are few confirms them: the one with the greatest sum of what each frame's errors stay below BIT_ERRORS. What two
recordings hold besides a shared passage does not count against it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import small, stored, table

RATE, FRAME, HOP = 2000, 256, 128
CLASSES = 12
#: Frames that the widest filter covers.
WIDEST = 8
#: Filters (kind, first class, classes, frames) by a rule: kinds and areas of all shapes.
FILTERS = [(k % 4, 5 * k % 9, 2 + k % 3, 2 + 2 * (k * 7 % 4)) for k in range(16)]
CUTS = (-0.25, 0.0, 0.25)
#: An alignment needs so many equal integers at its offset, so many frames of overlap, and at most such a share of wrong bits.
VOTES, OVERLAP, BIT_ERRORS = 4, 8, 0.15
#: Recordings that a task holds at once.
ROWS = 256
#: Query integers that are broadcast, at most (24 bytes each).
PROBES = 1_000_000


def wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    data = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def samples_of(data: bytes | None) -> np.ndarray:
    """Samples of 16-bit mono PCM in a WAV file; nothing for null, empty or other data."""
    if not data or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return np.zeros(0)
    at = 12
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"data":
            n = min(n, len(data) - at - 8)
            return np.frombuffer(data, "<i2", n // 2, at + 8).astype(np.float64)
        at += 8 + n + n % 2
    return np.zeros(0)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    ok = (hertz >= 100) & (hertz <= 950)
    nearest = np.zeros(len(hertz), int)
    nearest[ok] = np.round(CLASSES * np.log2(hertz[ok] / 220)).astype(int) % CLASSES
    m = np.zeros((len(hertz), CLASSES))
    m[np.flatnonzero(ok), nearest[ok]] = 1
    return np.hanning(FRAME), m


def chroma(samples: np.ndarray) -> np.ndarray:
    """frames x 12, each frame of unit length; silence stays 0."""
    if len(samples) < FRAME:
        return np.zeros((0, CLASSES))
    window, m = _tables()
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.concatenate([np.abs(np.fft.rfft(frames[i : i + 4096] * window)) ** 2 @ m for i in range(0, len(frames), 4096)])
    norm = np.sqrt((out**2).sum(1, keepdims=True))
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """32-bit integers, one for each frame at which the widest filter begins; none for a shorter recording."""
    c = chroma(samples)
    n = len(c) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.int32)
    image = np.zeros((len(c) + 1, CLASSES + 1))
    image[1:, 1:] = c.cumsum(0).cumsum(1)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return image[t1 : t1 + n, y1] - image[t0 : t0 + n, y1] - image[t1 : t1 + n, y0] + image[t0 : t0 + n, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        y1, ym, wm = min(y + h, CLASSES), min(y + h, CLASSES) - h // 2, w // 2
        whole = area(0, w, y, y1)
        if kind == 0:  # an area against all classes
            a, b = whole, area(0, w, 0, CLASSES) * (y1 - y) / CLASSES
        elif kind == 1:  # upper against lower classes
            a, b = area(0, w, ym, y1), area(0, w, y, ym)
        elif kind == 2:  # later against earlier frames
            a, b = area(wm, w, y, y1), area(0, wm, y, y1)
        else:  # one diagonal against the other
            a = area(0, wm, y, ym) + area(wm, w, ym, y1)
            b = whole - a
        level = np.digitize(np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0)), CUTS).astype(np.uint32)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1))
    return out.view(np.int32)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ROWS rows at a time: audio is large."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), ROWS):
            yield batch.slice(at, ROWS)


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, audio, gives way to n_frames and fp."""
    for batch in parts(batches):
        frames, items = [], []
        for x in batch.column(batch.num_columns - 1):
            s = samples_of(x.as_py())
            frames.append(max(0, (len(s) - FRAME) // HOP + 1) if len(s) >= FRAME else 0)
            items.append(fingerprint(s))
        ends = np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int32)
        fp = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(items) if items else np.zeros(0, np.int32)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(frames, pa.int64()), fp], [*batch.schema.names[:-1], "n_frames", "fp"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """recordings (conv_id, turn, audio) with n_frames, fp and `class`, equal for equal fingerprints. Null, empty, short and
    damaged audio has no frame and an empty fingerprint."""
    out = recordings.select("conv_id", "turn", "audio").mapInArrow(fingerprinted, "conv_id long, turn long, n_frames long, fp array<int>")
    return out.withColumn("class", F.when(F.size("fp") > 0, F.struct(F.xxhash64("fp").alias("h"), F.hash("fp").alias("g"), F.size("fp").alias("n"))))


def alignments(prints: DataFrame, query: str) -> DataFrame:
    """q, r (classes), offset, start, overlap, errors, votes: the best alignment of each class with a row of `query` to each
    other class, if it is good enough: start is where its stretch begins in q, overlap how many frames it has. prints:
    class, fp, and the columns of query, from a stored table. Rows without a class, equal recordings of one class and an empty
    table give no pair of their own.

    Equal fingerprints are one class, so that copies are aligned once. Only the queries' integers are broadcast, behind a
    count; beyond it the join shuffles.
    """
    one = stored(prints.where("class IS NOT NULL").groupBy("class").agg(F.first("fp").alias("fp"), F.max(F.expr(query)).alias("asks")), "classes")
    items = one.select("class", "asks", F.posexplode("fp").alias("pos", "value"))
    probes = stored(items.where("asks").select(F.col("class").alias("q"), F.col("pos").alias("q_pos"), "value"), "probes")
    hits = items.join(small(probes, PROBES), "value").where("class <> q")
    votes = hits.groupBy("q", F.col("class").alias("r"), (F.col("pos") - F.col("q_pos")).alias("offset")).agg(F.count("*").alias("votes")).where(f"votes >= {VOTES}")
    votes = stored(votes, "votes")
    queries = one.where("asks").select(F.col("class").alias("q"), F.col("fp").alias("q_fp"))
    found = votes.join(one.select(F.col("class").alias("r"), F.col("fp").alias("r_fp")), "r").join(queries, "q")
    lo, hi = "greatest(0, -offset)", "least(size(q_fp), size(r_fp) - offset)"
    left = f"({32 * BIT_ERRORS}D - x)"
    grown = f"greatest(0D, a.sum + {left})"
    better = f"a.sum + {left} > a.best"
    fold = f"""aggregate(transform(CASE WHEN {lo} < {hi} THEN sequence({lo}, {hi} - 1) ELSE cast(array() AS array<int>) END, i -> bit_count(q_fp[i] ^ r_fp[i + offset])),
        named_struct('k', {lo}, 'sum', 0D, 'from', {lo}, 'errors', 0L, 'best', 0D, 'start', {lo}, 'end', {lo}, 'own', 0L),
        (a, x) -> named_struct('k', a.k + 1, 'sum', {grown}, 'from', CASE WHEN {grown} > 0 THEN a.from ELSE a.k + 1 END,
            'errors', CASE WHEN {grown} > 0 THEN a.errors + x ELSE 0L END, 'best', greatest(a.best, {grown}),
            'start', CASE WHEN {better} THEN a.from ELSE a.start END, 'end', CASE WHEN {better} THEN a.k + 1 ELSE a.end END,
            'own', CASE WHEN {better} THEN a.errors + x ELSE a.own END))"""
    found = found.withColumn("s", F.expr(fold)).select("q", "r", "offset", "votes", F.col("s.start").alias("start"), F.expr("s.end - s.start").alias("overlap"), F.col("s.own").alias("errors"))
    found = found.where(f"overlap >= {OVERLAP}")
    best = F.max_by(F.struct("offset", "start", "overlap", "errors", "votes"), F.struct("overlap", (-F.col("errors")).alias("e"), F.col("votes"), (-F.col("offset")).alias("o")))
    return found.groupBy("q", "r").agg(best.alias("b")).select("q", "r", "b.*")


def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audio for the last column, a text: a note of HOP samples for each word, its pitch by the word's hash."""
    t = np.arange(HOP) / RATE
    notes = [(9000 * np.sin(2 * np.pi * 220 * 2 ** (k / CLASSES) * t)).astype("<i2") for k in range(2 * CLASSES)]
    for batch in parts(batches):
        out = []
        for x in batch.column(batch.num_columns - 1):
            own = [notes[hashlib.blake2b(w.encode(), digest_size=1).digest()[0] % len(notes)] for w in (x.as_py() or "").split()]
            out.append(wav(np.concatenate(own)) if own else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "audio"])


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each turn of a conversation is spoken as a melody first. A row for each recording with its
    class's first member; for queries (conv_id divisible by 100), how many other classes align and the best of them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    prints = stored(fingerprints(turns.mapInArrow(spoken, "conv_id long, turn long, audio binary")), "prints")
    first = stored(prints.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("conv_id", "turn")).alias("first")), "firsts")
    pairs = stored(alignments(prints, "coalesce(conv_id % 100 = 0, false)"), "pairs")
    named = pairs.join(first.select(F.col("class").alias("r"), F.col("first").alias("other")), "r")
    best = F.max_by(F.struct("other", "offset", "overlap", "errors"), F.struct("overlap", (-F.col("errors")).alias("e"), "other"))
    best = named.groupBy(F.col("q").alias("class")).agg(F.count("*").alias("n_matches"), best.alias("best"))
    about = stored(first.join(best, "class", "left"), "about")
    out = prints.select("conv_id", "turn", "n_frames", F.size("fp").cast("long").alias("n_items"), "class").join(small(about), "class", "left")
    asks = F.coalesce(F.col("conv_id") % 100 == 0, F.lit(False))
    return out.select(
        "conv_id", "turn", "n_frames", "n_items",
        F.col("first.conv_id").alias("class_conv_id"), F.col("first.turn").alias("class_turn"),
        F.when(asks, F.coalesce("n_matches", F.lit(0))).alias("n_matches"),
        *[F.when(asks, F.col(f"best.{c}")).alias(n) for c, n in (("other.conv_id", "best_conv_id"), ("other.turn", "best_turn"), ("offset", "best_offset"), ("overlap", "best_overlap"), ("errors", "best_errors"))],
    )
