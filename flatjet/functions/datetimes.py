"""Dates and times by strftime-like formats of fixed width."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of each token.
WIDTHS = {"Y": 4, "m": 2, "d": 2, "H": 2, "M": 2, "S": 2}


def pieces(fmt: str | Sequence[str | tuple[str, int]]) -> list[tuple[str, int]]:
    """(token, width) of each field and ("", bytes) of each literal text of a format.

    A format is a string in which ``%%`` is a percent sign, or a list of literal
    texts and (token, digits), where fields may be of any width. Each field may
    stand once.
    """
    out: list[tuple[str, int]] = []

    def add(token: str, width: int) -> None:
        if token and (token not in WIDTHS or width < 1):
            raise ValueError(f"unknown token %{token}")
        if token and token in [t for t, _ in out]:
            raise ValueError(f"%{token} stands twice")
        out.append((token, width))

    if not isinstance(fmt, str):
        for x in fmt:
            add(*(("", len(x.encode())) if isinstance(x, str) else x))
        return out
    i = 0
    while i < len(fmt):
        if fmt[i] != "%":
            add("", len(fmt[i].encode()))
            i += 1
            continue
        if i + 1 == len(fmt):
            raise ValueError("a format cannot end in %")
        kind = fmt[i + 1]
        add(*(("", 1) if kind == "%" else (kind, WIDTHS.get(kind, 0))))
        i += 2
    return out


def tokens(fmt: str | Sequence[str | tuple[str, int]]) -> list[tuple[str, int, int]]:
    """(token, place, width) of each field."""
    out, place = [], 0
    for token, width in pieces(fmt):
        if token:
            out.append((token, place, width))
        place += width
    return out


def epoch(fmt: str | Sequence[str | tuple[str, int]], resolution: str = "s"):
    """Epoch seconds or milliseconds in UTC; literal text is passed over by length, absent fields are those of 1970-01-01."""
    if resolution not in ("s", "ms"):
        raise ValueError("resolution is 's' or 'ms'")
    place = {t: (p, w) for t, p, w in tokens(fmt)}

    def parsed(c: Column) -> Column:
        def part(token: str, default: int) -> Column:
            if token not in place:
                return F.lit(default).cast("long")
            p, w = place[token]
            return F.substring(c, p + 1, w).try_cast("long")

        # Months and days count on from the first of January, so parts out of range carry over.
        first = F.datediff(F.add_months(F.make_date(part("Y", 1970).cast("int"), F.lit(1), F.lit(1)), (part("m", 1) - 1).cast("int")), F.lit("1970-01-01").cast("date"))
        days = first.cast("long") + part("d", 1) - 1
        seconds = ((days * 24 + part("H", 0)) * 60 + part("M", 0)) * 60 + part("S", 0)
        return seconds * 1000 if resolution == "ms" else seconds

    return parsed
