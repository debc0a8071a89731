"""The extraction schema: a tree of objects, arrays and typed leaves.

Each leaf names one output column; unnamed parts of a line are skipped. The same
tree compiles to DataFrame expressions (``plans.compiler``) and drives the
row-level parser (``plans.strict``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

#: JSON kinds that a skipped value may have.
KINDS = ("object", "array", "number", "string", "boolean", "null")


class _Missing:
    def __repr__(self) -> str:
        return "NO_DEFAULT"

    def __reduce__(self) -> str:
        return "NO_DEFAULT"  # one object, on executors too


#: A leaf without a null default: JSON null is then a row error.
NO_DEFAULT = _Missing()


@dataclass(frozen=True)
class Leaf:
    """A value that becomes the column ``name``. ``transform`` maps the parsed column; ``null`` replaces JSON null."""

    name: str
    transform: Callable[[Column], Column] | None = field(default=None, kw_only=True)
    null: object = field(default=NO_DEFAULT, kw_only=True)

    def raw_type(self) -> T.DataType:
        return T.StringType()

    def zero(self) -> object:
        """What a missing value leaves in the column."""
        return ""


@dataclass(frozen=True)
class Int(Leaf):
    """An integer of 8 to 64 bits; values out of range wrap modulo 2**bits. Unsigned unless ``signed``."""

    bits: int = 32
    signed: bool = False

    def __post_init__(self):
        if self.bits not in (8, 16, 32, 64):
            raise ValueError("integers have 8, 16, 32 or 64 bits")

    def raw_type(self) -> T.DataType:
        if self.signed:
            return {8: T.ByteType(), 16: T.ShortType(), 32: T.IntegerType(), 64: T.LongType()}[self.bits]
        return {8: T.ShortType(), 16: T.IntegerType(), 32: T.LongType(), 64: T.DecimalType(20, 0)}[self.bits]

    def zero(self) -> object:
        return 0


@dataclass(frozen=True)
class Real(Leaf):
    """A float or double. ``nine_digits`` keeps only the first nine digits of a fraction."""

    bits: int = 64
    signed: bool = True
    exponent: bool = True
    nine_digits: bool = False

    def raw_type(self) -> T.DataType:
        return T.FloatType() if self.bits == 32 else T.DoubleType()

    def zero(self) -> object:
        return 0.0


@dataclass(frozen=True)
class Bool(Leaf):
    def raw_type(self) -> T.DataType:
        return T.BooleanType()

    def zero(self) -> object:
        return False


@dataclass(frozen=True)
class Str(Leaf):
    """A string, cut to ``max_bytes``. ``raw`` keeps escapes as they stand in the line."""

    max_bytes: int | None = None
    raw: bool = False


@dataclass(frozen=True)
class Datetime(Leaf):
    """Epoch seconds ("s") or milliseconds ("ms") of a quoted date and time in UTC, by a strftime-like format or a tuple of literal texts and (token, digits)."""

    fmt: str | tuple[str | tuple[str, int], ...] = "%Y-%m-%d %H:%M:%S"
    resolution: str = "s"

    def zero(self) -> object:
        return 0


@dataclass(frozen=True)
class Check(Leaf):
    """A string that must be well formed; it gives no column."""

    name: str = ""


@dataclass(frozen=True)
class Skip:
    """A value that is checked and left out, at most ``depth`` levels deep and of the given kinds."""

    depth: int = 8
    kinds: tuple[str, ...] = KINDS


@dataclass(frozen=True)
class Dict:
    """Fields of an object by exact key.

    ``order`` is "random" or "const" (exactly these keys, in this order).
    ``skip`` says what other keys do: a ``Skip`` passes over them, None makes
    them a row error.
    """

    fields: dict[str, object]
    order: str = "random"
    skip: Skip | None = Skip()

    def __post_init__(self):
        if self.order not in ("random", "const"):
            raise ValueError("order is 'random' or 'const'")


@dataclass(frozen=True)
class Array:
    """Items of an array by position; without ``skip`` a longer array is a row error."""

    items: dict[int, object]
    skip: Skip | None = Skip()

    def __post_init__(self):
        if self.skip is None and sorted(self.items) != list(range(len(self.items))):
            raise ValueError("without skipping, positions must be 0, 1, ... without gaps")


def leaves(node: object) -> Iterator[Leaf]:
    """Leaves that give a column, depth first."""
    if isinstance(node, Dict):
        for child in node.fields.values():
            yield from leaves(child)
    elif isinstance(node, Array):
        for k in sorted(node.items):
            yield from leaves(node.items[k])
    elif isinstance(node, Leaf) and not isinstance(node, Check):
        yield node


def validate(node: object) -> None:
    names = [leaf.name for leaf in leaves(node)]
    twice = {n for n in names if names.count(n) > 1}
    if twice:
        raise ValueError(f"column names must be unique: {sorted(twice)}")
