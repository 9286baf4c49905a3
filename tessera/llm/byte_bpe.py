"""Byte-level BPE by sentencepiece: encode texts to token ids, decode ids to bytes.

A file of ranks (base64 of the token's bytes, blank, rank) becomes a sentencepiece BPE model, serialised here field by field:
each byte stands as one printable character, a token's piece is the characters of its bytes, its score the negative rank, so
that the merge with the least rank comes first; the normalisation is the identity. Texts are cut by a pattern first, and each
match (pre-token) is encoded alone; one that is itself a token is that token. Decoding maps ids to the bytes of their tokens.

Null text is empty; an empty text has no id and decodes to no byte. Repeated rows give a row each, all other columns stay,
whatever their names, and an empty table gives an empty one. A null array of ids decodes to null.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import appended, table, whole

#: Pre-tokens whose ids a worker keeps, from task to task; the frequent ones come first, and later ones are encoded each time.
CACHE = 250_000
#: Field numbers and enumerations of sentencepiece's public model format.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_TYPE = 1, 2, 3
UNKNOWN = 2
MODEL_TYPE, BPE, VOCAB_SIZE, UNK_ID, BOS_ID, EOS_ID, PAD_ID = 3, 2, 4, 40, 41, 42, 43
NAME, DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS = 1, 3, 4, 5


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def byte_letters() -> dict[int, str]:
    """A printable character for each byte: its own where Latin-1 prints one that is no blank, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def number(field: int, value: int) -> bytes:
    return varint(field << 3) + varint(value)


def block(field: int, data: bytes) -> bytes:
    return varint(field << 3 | 2) + varint(len(data)) + data


def model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: an unknown piece, then the tokens in order of their ranks."""
    letters = byte_letters()
    if set(ranks.values()) != set(range(len(ranks))):
        raise ValueError("ranks must be dense from 0")
    if missing := set(range(256)) - {t[0] for t in ranks if len(t) == 1}:
        raise ValueError(f"no token for the bytes {sorted(missing)}")
    out = [block(PIECES, block(PIECE_TEXT, b"<unk>") + number(PIECE_TYPE, UNKNOWN))]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(letters[b] for b in token).encode()
        out.append(block(PIECES, block(PIECE_TEXT, text) + varint(PIECE_SCORE << 3 | 5) + struct.pack("<f", -rank)))
    out.append(block(TRAINER, number(MODEL_TYPE, BPE) + number(VOCAB_SIZE, len(ranks) + 1) + number(UNK_ID, 0) + b"".join(number(f, -1) for f in (BOS_ID, EOS_ID, PAD_ID))))
    out.append(block(NORMALIZER, block(NAME, b"identity") + b"".join(number(f, 0) for f in (DUMMY_PREFIX, EXTRA_BLANKS, ESCAPE_BLANKS))))
    return b"".join(out)


class Coder:
    """Encodes with one file of ranks and one pattern. Pre-tokens repeat, so their ids are kept."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model(self.ranks))
        self.letters = byte_letters()
        self.cut = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        raw = [p.encode() for p in pieces]
        merged = [p for p, r in zip(pieces, raw, strict=True) if r not in self.ranks]
        texts = [p.encode().decode("latin-1").translate(self.letters) for p in merged]
        found = {p: (np.array(x, "<i4") - 1).tobytes() for p, x in zip(merged, self.own.encode(texts, num_threads=1), strict=True)}
        return found | {p: struct.pack("<i", self.ranks[r]) for p, r in zip(pieces, raw, strict=True) if r in self.ranks}

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self.cut(t or "") for t in texts]
        new = self._new(list(set(chain.from_iterable(pieces)).difference(self.cache)))
        room = CACHE - len(self.cache)
        self.cache |= new
        out = [b"".join(map(self.cache.__getitem__, p)) for p in pieces]
        for p in list(new)[max(room, 0) :]:
            del self.cache[p]
        return out

    def encode(self, texts: pa.Array) -> pa.Array:
        ids = self._encode(texts.to_pylist())
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))


def decoded(ids: pa.Array, tokens: list[bytes]) -> pa.Array:
    """The bytes of each array of ids."""
    out = []
    for own in ids:
        if own.is_valid:
            found = own.values.to_numpy(zero_copy_only=False)
            if len(found) and not 0 <= found.min() <= found.max() < len(tokens):
                raise ValueError(f"ids must lie in 0..{len(tokens) - 1}")
            out.append(b"".join(map(tokens.__getitem__, found.tolist())))
        else:
            out.append(None)
    return pa.array(out, pa.binary())


_KEPT: dict[tuple[str, str], Coder] = {}
_TOKENS: dict[str, list[bytes]] = {}


def tokens_of(path: str) -> list[bytes]:
    """Tokens by id; the worker's own, kept between tasks."""
    if path not in _TOKENS:
        _TOKENS.clear()
        _TOKENS[path] = [t for t, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]
    return _TOKENS[path]


def coder(path: str, pattern: str) -> Coder:
    """The worker's own, kept between tasks."""
    if (path, pattern) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, pattern] = Coder(path, pattern)
    return _KEPT[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """docs with array<int> `into`, the ids of each whole text by the ranks at path, which all workers have. A column of that
    name goes."""
    return appended(docs, whole(F.col(f"`{text}`")), f"`{into}` array<int>", lambda texts: [coder(path, pattern).encode(texts)])


def decode(rows: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with binary `into`, the bytes of each array of ids. A column of that name goes."""
    return appended(rows, F.col(f"`{ids}`"), f"`{into}` binary", lambda values: [decoded(values, tokens_of(path))])


def op11_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """Digests of the ids of each document's text and of the bytes they decode to. Null text is empty (no id), null ids and
    repeated rows stay, an empty table gives no row."""
    import public_tokenizers

    own = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), *own), own[0])
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
