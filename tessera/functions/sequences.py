"""Sequence functions as column expressions: case, complement, k-mer codes, hash order, minimizer digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements of the IUPAC letters, U read as T.
LETTERS, COMPLEMENTS = "ACGTURYKMBDHVSWN", "TGCAAYRMKVHDBSWN"
# Multipliers of the MurmurHash3 64-bit finalizer.
MURMUR = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def upper(seq: Column) -> Column:
    return F.upper(seq)


def complement(seq: Column) -> Column:
    """Complement of each letter, upper case; other characters stay, lower-case ASCII letters become upper case."""
    rest = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c.upper() not in LETTERS)
    return F.translate(seq, LETTERS + LETTERS.lower() + rest, 2 * COMPLEMENTS + rest.upper())


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def kmer_code(kmer: Column, k: int, letters: str = "ACGT") -> Column:
    """Base-4 value of a k-mer over A, C, G, T, the first letter first; null for other letters."""
    code = F.conv(F.translate(kmer, letters, "0123"), 4, 10).cast("decimal(20,0)").cast("long")
    return F.when(kmer.rlike(f"^[{letters}]{{{k}}}$"), code)


def _times(x: Column, m: int) -> Column:
    """Product modulo 2 ** 64 of 64-bit patterns, by 16-bit limbs: a plain product would overflow."""
    a = [F.shiftrightunsigned(x, 16 * i).bitwiseAND(0xFFFF) for i in range(4)]
    b = [F.lit((m >> 16 * i) & 0xFFFF).cast("long") for i in range(4)]
    limbs, carry = [], F.lit(0).cast("long")
    for i in range(4):
        total = carry
        for j in range(i + 1):
            total = total + a[j] * b[i - j]
        limbs.append(total.bitwiseAND(0xFFFF))
        carry = F.shiftrightunsigned(total, 16)
    out = limbs[0]
    for i in range(1, 4):
        out = out.bitwiseOR(F.shiftleft(limbs[i], 16 * i))
    return out


def fmix64(value: Column) -> Column:
    """MurmurHash3's 64-bit finalizer, as a signed pattern."""
    h = value.cast("long")
    for m in MURMUR:
        h = _times(h.bitwiseXOR(F.shiftrightunsigned(h, 33)), m)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 33))


def fmix64_of(value: int) -> int:
    h = value
    for m in MURMUR:
        h = ((h ^ h >> 33) * m) & (1 << 64) - 1
    return h ^ h >> 33


def symbol(code: Column) -> Column:
    """Symbol of a 4-mer in the minimizer alphabet: 0, 1 and 2 are reserved and move up by 3."""
    return F.when(code <= 2, code + 3).otherwise(code)


#: k up to which the order of all k-mers is a literal table.
TABLE_K = 4


def minimizers(seq: Column, k: int = 4, w: int = 11, by_hash: bool = True) -> Column:
    """array<bigint> of the values of the minimizers of a sequence of letters A, C, G and T (any case) and others.

    In each stretch of letters every full window of w - k + 1 k-mers gives its least k-mer, by value or by hash; a value
    equal to the one before it, over stretches, is dropped. Everything is linear in the sequence.
    """
    if not 0 < k <= w or k > 31:
        raise ValueError("0 < k <= w and k <= 31 are needed")
    codes = F.transform(F.filter(F.split(F.translate(F.upper(seq), "ACGT", "0123"), ""), lambda c: c != ""), lambda c: F.when(c.isin("0", "1", "2", "3"), F.ascii(c) - 48))
    return _minimizers(codes, k, w, by_hash)


def _minimizers(codes: Column, k: int, w: int, by_hash: bool) -> Column:
    def value(c: Column, i: Column) -> Column:
        out = F.get(c, i).cast("long")
        for j in range(1, k):
            out = out * 4 + F.get(c, i + j)
        return out

    def let(x: Column, f) -> Column:
        """f of x, with x computed once."""
        return F.element_at(F.transform(F.array(x), f), 1)

    def order(v: Column) -> Column:
        if not by_hash:
            return v
        if k <= TABLE_K:
            return F.get(F.array(*[F.lit(_signed(fmix64_of(i))) for i in range(4**k)]), v.cast("int"))
        return fmix64(v).bitwiseXOR(F.lit(-(1 << 63)))

    n = w - k + 1

    def of(c: Column) -> Column:
        places = F.when(F.size(c) >= w, F.sequence(F.lit(0), F.size(c) - k)).otherwise(F.array().cast("array<int>"))
        ranked = F.transform(places, lambda i: let(value(c, i), lambda v: F.when(v.isNotNull(), F.struct(order(v).alias("h"), v.alias("v")))))

        def least(r: Column) -> Column:
            windows = F.when(F.size(r) >= n, F.sequence(F.lit(1), F.size(r) - n + 1)).otherwise(F.array().cast("array<int>"))
            full = F.filter(F.transform(windows, lambda i: let(F.slice(r, i, n), lambda s: F.when(~F.exists(s, lambda x: x.isNull()), F.array_min(s)["v"]))), lambda v: v.isNotNull())
            return let(full, lambda m: F.filter(m, lambda x, i: (i == 0) | (x != F.get(m, i - 1))))

        return let(ranked, least)

    return let(codes, of)


def _signed(h: int) -> int:
    """So that signed order is the order of the unsigned values."""
    return h - (1 << 63)


def spelled(values: Column, k: int) -> Column:
    """The k-mers of values, one after the other."""
    letter = F.array(*map(F.lit, "ACGT"))

    def word(v: Column) -> Column:
        return F.concat(*[F.get(letter, F.shiftrightunsigned(v, 2 * (k - 1 - j)).bitwiseAND(3).cast("int")) for j in range(k)])

    return F.array_join(F.transform(values, word), "")


def digest(seq: Column, k: int = 4, w: int = 11, by_hash: bool = True) -> Column:
    """Concatenated minimizers; a sequence shorter than w stays as it is."""
    return F.when(F.length(seq) < w, seq).otherwise(spelled(minimizers(seq, k, w, by_hash), k))


def alphabet_digest(seq: Column, k: int = 4, w: int = 11, by_hash: bool = True) -> Column:
    """array<bigint> of the minimizers' symbols; null for a sequence shorter than w, which has none."""
    if k != 4:
        raise ValueError("the minimizer alphabet needs k = 4")
    return F.when(F.length(seq) >= w, F.transform(minimizers(seq, k, w, by_hash), symbol))


#: A character for each 8-bit symbol: none is ASCII, an end mark or a letter with two cases that texts are compared by.
SYMBOLS = "".join(chr(0x4E00 + i) for i in range(256))


def spelled_symbols(values: Column) -> Column:
    """A text with one character for each symbol, so that all that indexes texts indexes symbols."""
    return F.array_join(F.transform(values, lambda v: F.substring(F.lit(SYMBOLS), v.cast("int") + 1, F.lit(1))), "")
