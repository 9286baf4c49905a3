"""Which of few strings texts hold, by one pass over the texts: tasks walk a table of the strings' prefixes from every place at once.

Only what is found leaves a task, so that a pass over a collection writes nothing of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings that are collected at most, cells of their table, characters of a chunk of text, and characters that a task walks at once.
STRINGS, CELLS, CHUNK, AT_ONCE = 100_000, 1 << 22, 1024, 1 << 20


@dataclass(frozen=True)
class Prefixes:
    """next[state * width + letter] is the state one character on, 0 if no string goes on so; 0 is the start. letter: the number of a code
    point, 0 if no string has it. string: the number of the string that ends in a state, or -1."""

    strings: list[str]
    next: np.ndarray
    width: int
    letter: np.ndarray
    string: np.ndarray
    longest: int

    def walk(self, texts: list[str], found: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """found(places, states) for each number of characters that agree. A place is one of the texts joined by a character."""
        codes = np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = self.letter[np.minimum(codes, len(self.letter) - 1)]
        letters[np.cumsum([len(t) + 1 for t in texts[:-1]], dtype=np.int64) - 1] = 0
        letters = np.append(letters, letters.dtype.type(0))
        at = np.flatnonzero(letters)
        state = np.zeros(len(at), np.int32)
        for n in range(self.longest):
            state = self.next[state * self.width + letters[at + n]]
            on = np.flatnonzero(state)
            at, state = at[on], state[on]
            if not len(at):
                return
            found(at, state)


def prefixes(strings: list[str], cells: int | None = None) -> Prefixes | None:
    """The table of strings, which are not empty; None if it had more cells than that."""
    letters = {c: i + 1 for i, c in enumerate(sorted(set().union(*strings)))}
    width, cells = len(letters) + 1, CELLS if cells is None else cells
    steps: dict[tuple[int, int], int] = {}
    ends = [0] * len(strings)
    for i, s in enumerate(strings):
        for c in s:
            ends[i] = steps.setdefault((ends[i], letters[c]), len(steps) + 1)
        if (len(steps) + 1) * width > cells:
            return None
    table, string = np.zeros((len(steps) + 1) * width, np.int32), np.full(len(steps) + 1, -1, np.int32)
    for (state, c), to in steps.items():
        table[state * width + c] = to
    string[ends] = np.arange(len(strings))
    numbers = np.zeros(max(map(ord, letters)) + 2, np.int32)  # the last one is that of all code points beyond
    for c, i in letters.items():
        numbers[ord(c)] = i
    return Prefixes(strings, table, width, numbers, string, max(map(len, strings)))


def few(strings: DataFrame, most: int | None = None) -> Prefixes | None:
    """The table of a column of distinct strings, none of them empty, if a count shows that they are few enough to go by the driver."""
    most = STRINGS if most is None else most
    rows = strings.limit(most + 1).collect()
    return prefixes([r[0] for r in rows]) if 0 < len(rows) <= most else None


def _chunks(texts: DataFrame, longest: int) -> DataFrame:
    """doc_id, at, part: texts in chunks that overlap, so that each string of so many characters lies in one; at is where a chunk begins."""
    starts = F.expr(f"CASE WHEN length(text) > 0 THEN sequence(0, length(text) - 1, {CHUNK}) ELSE cast(array() AS array<int>) END")
    cut = F.transform(starts, lambda i: F.struct(i.alias("at"), F.substring(F.col("text"), i + 1, F.lit(CHUNK + longest - 1)).alias("part")))
    return texts.select("doc_id", F.explode(cut).alias("_c")).select("doc_id", "_c.at", "_c.part")


def _slices(parts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Rows some at a time: where they begin, and their texts."""
    texts = parts.to_pylist()
    step = max(1, AT_ONCE // max(map(len, texts), default=1))
    for at in range(0, len(texts), step):
        yield at, texts[at : at + step]


def begun(texts: DataFrame, own: Prefixes) -> DataFrame:
    """lmer: the beginnings of the strings, and strings, that a text (doc_id, text) holds."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(own.string), bool)

        def mark(_: np.ndarray, states: np.ndarray) -> None:
            seen[states] = True

        for batch in batches:
            for _, part in _slices(batch.column(0)):
                own.walk(part, mark)
        words = {""}
        for s in own.strings:
            state = 0
            for n, c in enumerate(s):
                state = own.next[state * own.width + own.letter[ord(c)]]
                if not seen[state]:
                    break
                words.add(s[: n + 1])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(words - {""}), pa.string())], ["lmer"])

    return _chunks(texts, own.longest).select("part").mapInArrow(walk, "lmer string").distinct()


def _found(texts: DataFrame, own: Prefixes, places: bool) -> DataFrame:
    """lmer, doc_id and, with places, q: the strings that each document holds, some of them once for each chunk, or each place of each."""
    chunks = _chunks(texts, own.longest)
    n = len(own.strings)
    names = ["_string", "doc_id", *["q"] * places]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).dictionary_encode(null_encoding="encode")  # chunks of one document lie side by side
            document, begin = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy()
            found = [(np.zeros(0, np.int64),) * 3]
            for first, part in _slices(batch.column(2)):
                ends = np.cumsum([0, *[len(t) + 1 for t in part]])

                def keep(at: np.ndarray, states: np.ndarray, first: int = first, ends: np.ndarray = ends) -> None:
                    string = own.string[states]
                    whole = np.flatnonzero(string >= 0)
                    row = np.searchsorted(ends, at[whole], "right") - 1
                    string, inside = string[whole].astype(np.int64), at[whole] - ends[row]
                    if places:
                        new = inside < CHUNK  # what begins later is the next chunk's
                        found.append((string[new], document[first + row[new]], begin[first + row[new]] + inside[new]))
                    else:
                        both = np.unique(document[first + row] * n + string)
                        found.append((both % n, both // n, both))

                own.walk(part, keep)
            string, row, q = map(np.concatenate, zip(*found, strict=True))
            if not places:
                both = np.unique(q)
                string, row = both % n, both // n
            columns = [pa.array(string, pa.int32()), ids.dictionary.take(pa.array(row, pa.int64())), *[pa.array(q, pa.int32())] * places]
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = [T.StructField("_string", T.IntegerType()), chunks.schema["doc_id"], *[T.StructField("q", T.IntegerType())] * places]
    found = chunks.mapInArrow(walk, T.StructType(kinds))
    found = found if places else found.distinct()
    named = texts.sparkSession.createDataFrame(list(enumerate(own.strings)), "_string int, lmer string")
    return found.join(F.broadcast(named), "_string").select("lmer", *names[1:])  # STRINGS rows at most


def holders(texts: DataFrame, own: Prefixes) -> DataFrame:
    """lmer, doc_id: the strings that each document (doc_id, text; several rows may have one doc_id) holds."""
    return _found(texts, own, False)


def places(texts: DataFrame, own: Prefixes) -> DataFrame:
    """lmer, doc_id, q: each place of a string in a text (doc_id, text)."""
    return _found(texts, own, True)
