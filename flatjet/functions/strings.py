"""ASCII case, byte limits, rolling hashes and categories of strings."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_upper(c: Column) -> Column:
    """Upper case of a-z only; other letters stay."""
    return F.translate(c, _LOWER, _UPPER)


def ascii_lower(c: Column) -> Column:
    """Lower case of A-Z only; other letters stay."""
    return F.translate(c, _UPPER, _LOWER)


def truncate_bytes(c: Column, size: int) -> Column:
    """The first ``size`` bytes; a character cut in half is what decoding makes of it."""
    return F.when(F.octet_length(c) <= size, c).otherwise(F.substring(c.cast("binary"), 1, size).cast("string"))


def _term(code: int, place: int, multiplier: int, modulus: int, lanes: int) -> int:
    return (place % lanes + 1) * (code - 31) * pow(multiplier, place // lanes, modulus)


def poly_hash_of(text: str, multiplier: int = 31, modulus: int = 1_000_000_009, lanes: int = 32) -> int:
    """The hash of ``poly_hash`` for a constant; the character after a backslash counts as nothing."""
    total, escaped = 0, False
    for i, ch in enumerate(text):
        if not escaped:
            total += _term(ord(ch), i, multiplier, modulus, lanes)
        escaped = ch == "\\" and not escaped
    return total % modulus


def poly_hash(multiplier: int = 31, modulus: int = 1_000_000_009, lanes: int = 32):
    """Sum over places i of (i mod lanes + 1) * (code - 31) * multiplier**(i div lanes), modulo ``modulus``.

    Defined for ASCII text. The character after a backslash counts as nothing but keeps its place,
    as in the constant form above; values of ``Str(raw=True)`` hold escapes as they are written.
    """
    if modulus > 1 << 31:
        raise ValueError("the modulus must fit in 31 bits")

    def hashed(c: Column) -> Column:
        # Pairs from left to right, so a backslash that is escaped itself escapes nothing; code 31 has no term.
        c = F.regexp_replace(c, r"(?s)\\.", "\\\\\x1f")
        # Horner by blocks of `lanes` characters, from the last block to the first.
        blocks = F.ceil(F.length(c) / lanes).cast("int")
        number = F.sequence(F.lit(0), F.greatest(blocks - 1, F.lit(0)))

        def block_sum(b: Column) -> Column:
            part = F.substring(c, b * lanes + 1, F.lit(lanes))
            # ascii of the i-th character; empty past the end gives 0, whose term is left out.
            places = F.sequence(F.lit(1), F.lit(lanes))
            return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc + F.when(i <= F.length(part), i.cast("long") * (F.ascii(F.substring(part, i, F.lit(1))) - 31)).otherwise(F.lit(0)))

        return F.aggregate(F.reverse(number), F.lit(0).cast("long"), lambda acc, b: (acc * multiplier + block_sum(b)) % modulus)

    return hashed


def category(codes: Mapping[str, int], by_hash: bool = False, multiplier: int = 31, modulus: int = 1_000_000_009, lanes: int = 32):
    """The code of a string, 0 if it has none.

    ``by_hash`` compares rolling hashes only, so a string whose hash is that of
    a key gets its code; the keys' hashes must differ.
    """
    if any(v == 0 for v in codes.values()):
        raise ValueError("0 stands for no match")
    keys = {poly_hash_of(k, multiplier, modulus, lanes): v for k, v in codes.items()} if by_hash else dict(codes)
    if len(keys) < len(codes):
        raise ValueError("two keys have one hash")

    def coded(c: Column) -> Column:
        value = poly_hash(multiplier, modulus, lanes)(c) if by_hash else c
        out = None
        for k, v in keys.items():
            out = F.when(value == k, v) if out is None else out.when(value == k, v)
        return F.lit(0) if out is None else out.otherwise(0)

    return coded


def fold(start: object, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] = lambda acc: acc):
    """A function of one's own over the characters of a string, from left to right: ``step(state, character)``, then ``finish(state)``."""
    return lambda c: F.aggregate(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), start if isinstance(start, Column) else F.lit(start), step, finish)


def column_hash(c: Column) -> Column:
    """A 64-bit hash of each value, for columns that are only compared or joined."""
    return F.xxhash64(c)


def char_count(char: str):
    """How often one character occurs."""
    return lambda c: (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))).cast("int")
