"""Scaling, binning and wrapping of numbers."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def min_max(low: float, high: float, kind: str = "double"):
    """(x - low) / (high - low), clamped to [0, 1]."""
    if not low < high:
        raise ValueError("low must be below high")
    return lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (c.cast("double") - F.lit(float(low))) / F.lit(float(high - low)))).cast(kind)


def cut(bins: Sequence[float], labels: Sequence[object] | None = None, right: bool = True, outside: object = None):
    """The label of the interval that holds the value.

    Intervals are (a, b], or [a, b) with ``right`` false. Labels default to the
    upper edges. Values outside get ``outside``, or NaN, which needs number labels.
    """
    bins = list(bins)
    if len(bins) < 2 or any(a >= b for a, b in zip(bins, bins[1:], strict=False)):
        raise ValueError("bins must be two or more, strictly ascending")
    names = list(bins[1:] if labels is None else labels)
    if len(names) != len(bins) - 1:
        raise ValueError("one label for each interval")
    if outside is None and not all(isinstance(x, float) for x in names):
        raise ValueError("NaN outside needs floating labels; give a value for outside")

    def bin_of(c: Column) -> Column:
        # The first upper edge that is not passed, among values above the first edge.
        inside = None
        for edge, label in zip(bins[1:], names, strict=True):
            fits = c <= edge if right else c < edge
            inside = F.when(fits, F.lit(label)) if inside is None else inside.when(fits, F.lit(label))
        above = c > bins[0] if right else c >= bins[0]
        return F.when(above & (c <= bins[-1] if right else c < bins[-1]), inside).otherwise(F.lit(float("nan") if outside is None else outside))

    return bin_of


def wrap(c: Column, bits: int, signed: bool) -> Column:
    """An integer modulo 2**bits, in the signed or unsigned range."""
    wide = c.cast("decimal(38,0)")
    size = F.lit(Decimal(2**bits)).cast("decimal(38,0)")
    if not signed:
        return F.pmod(wide, size)
    half = F.lit(Decimal(2 ** (bits - 1))).cast("decimal(38,0)")
    return F.pmod(wide + half, size) - half


def wrap_long(c: Column, bits: int, signed: bool) -> Column:
    """A long of 18 digits at most modulo 2**bits, in the signed or unsigned range; bit operations only."""
    if bits == 64:
        return c if signed else c.cast("decimal(20,0)")
    mask = F.lit(2**bits - 1).cast("long")
    if not signed:
        return c.bitwiseAND(mask)
    half = F.lit(2 ** (bits - 1)).cast("long")
    return (c + half).bitwiseAND(mask) - half


def wrap_digits(c: Column, bits: int, signed: bool) -> Column:
    """The text of an integer of any length modulo 2**bits, in the signed or unsigned range."""
    size = F.lit(Decimal(2**bits)).cast("decimal(38,0)")
    digits = F.ltrim(F.regexp_replace(c, "^-", ""))
    parts = F.ceil(F.length(digits) / 18).cast("int")
    padded = F.lpad(digits, parts * 18, F.lit("0"))
    # Eighteen digits at a time from the left; the state has twenty at most.
    shift = F.lit(Decimal(10**18)).cast("decimal(19,0)")
    part = lambda i: F.substring(padded, i * 18 + 1, F.lit(18)).cast("decimal(18,0)")
    rest = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(Decimal(0)).cast("decimal(38,0)"), lambda acc, i: F.pmod((acc.cast("decimal(20,0)") * shift + part(i)).cast("decimal(38,0)"), size).cast("decimal(38,0)"))
    return F.when(F.length(digits) > 0, wrap(F.when(c.startswith("-"), -rest).otherwise(rest), bits, signed))
