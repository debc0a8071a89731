"""Compile a schema into pruned ``from_json`` calls, a pattern that guards them, and column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import epoch, truncate_bytes, wrap_digits
from ..functions.datetimes import pieces
from ..functions.numeric import wrap_long
from ..schema import NO_DEFAULT, Array, Bool, Check, Datetime, Dict, Int, Leaf, Real, Skip, Str, leaves, validate
from .grammar import NO_BRACKETS, START_DEPTH, STRINGS, Grammar

OK, FAILED = 0, 255
#: Longest pattern that generated code holds as a constant.
MOST_CONSTANT = 60_000


def _has_columns(node: object) -> bool:
    return next(leaves(node), None) is not None


def _json_type(node: object, exact: bool) -> T.DataType:
    """The type that ``from_json`` reads: only what gives columns.

    With ``exact``, integers of any length and arrays of any kinds can be read:
    they come as text.
    """
    if isinstance(node, Dict):
        return T.StructType([T.StructField(k, _json_type(v, exact)) for k, v in node.fields.items() if _has_columns(v)])
    if isinstance(node, Array):
        kinds = {repr(t): t for t in (_json_type(v, exact) for v in node.items.values() if _has_columns(v))}
        # Items of one type are read directly; others as text that is read again by item.
        return T.ArrayType(next(iter(kinds.values())) if len(kinds) == 1 and not exact else T.StringType())
    if isinstance(node, Int):
        return T.StringType() if exact else T.LongType()
    if isinstance(node, Real):
        return T.StringType() if node.nine_digits else T.DoubleType()
    return T.BooleanType() if isinstance(node, Bool) else T.StringType()


def _typed(node: Array) -> bool:
    return _json_type(node, False).elementType != T.StringType()


def _reread(text: Column, node: object, exact: bool) -> Column:
    """An array item of mixed arrays from its text."""
    kind = _json_type(node, exact)
    if isinstance(node, (Dict, Array)):
        return F.from_json(text, kind.simpleString() if isinstance(node, Dict) else kind, {"mode": "PERMISSIVE"})
    return text if kind == T.StringType() else text.try_cast(kind.simpleString())


def value_of(leaf: Leaf, c: Column, exact: bool = True) -> Column:
    """The leaf's value in its output type from what was read; null stays null."""
    kind = leaf.raw_type().simpleString()
    if isinstance(leaf, Int):
        return (wrap_digits if exact else wrap_long)(c, leaf.bits, leaf.signed).cast(kind)
    if isinstance(leaf, Real):
        text = F.regexp_replace(c.cast("string"), r"(\.\d{9})\d+", "$1") if leaf.nine_digits else c
        return text.try_cast(kind)
    if isinstance(leaf, Str) and leaf.max_bytes is not None:
        return truncate_bytes(c, leaf.max_bytes)
    if isinstance(leaf, Datetime):
        return epoch(leaf.fmt, leaf.resolution)(c)
    return c


def transformed(leaf: Leaf, value: Column) -> Column:
    return leaf.transform(value) if leaf.transform else value


def zero_of(kind: T.DataType) -> Column:
    """What a missing value leaves in a column of the type."""
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.BooleanType, T.StringType)):
        return F.lit(False if isinstance(kind, T.BooleanType) else "")
    return F.lit(None).cast(kind)


def finished(leaf: Leaf, value: Column, explicit_null: Column, kind: T.DataType) -> Column:
    """The transformed value in its type, or the null default or zero, which are not transformed."""
    rest = zero_of(kind)
    if leaf.null is not NO_DEFAULT:
        rest = F.when(explicit_null, F.lit(leaf.null).cast(kind)).otherwise(rest)
    if leaf.transform is None:
        return F.coalesce(value, rest)
    return F.when(value.isNotNull(), transformed(leaf, value)).otherwise(rest)


class FastPlan:
    """Expressions for a schema whose root is a ``Dict`` over a column of JSON text.

    A pattern made of the schema tells lines that fit it; it takes the common
    ones at once, and a fuller one the others. Lines that do not fit keep what
    stands before the error: their complete pairs. ``needs_strict`` says why a
    schema cannot be compiled.
    """

    def __init__(self, root: object):
        validate(root)
        self.root = root
        self.columns = list(leaves(root))

    def needs_strict(self) -> str | None:
        if not isinstance(self.root, Dict):
            return "the root is not an object"

        def look(node: object) -> str | None:
            if isinstance(node, Str) and node.raw:
                return f"{node.name} keeps escapes"
            if isinstance(node, Datetime) and not all(x.isascii() for x in ([node.fmt] if isinstance(node.fmt, str) else [t for t in node.fmt if isinstance(t, str)])):
                return f"{node.name} has literal text that is not ASCII"
            children = node.fields.values() if isinstance(node, Dict) else node.items.values() if isinstance(node, Array) else ()
            return next((why for c in children if (why := look(c))), None)

        return look(self.root)

    def guards(self, text: Column) -> tuple[Column, Column, Column]:
        """Whether the quick pattern takes a line, whether the full one does, and what is whole of a line that does not fit, its brackets closed."""
        quick, middle, full = Grammar(self.root, True, _typed), Grammar(self.root, depth=START_DEPTH), Grammar(self.root)

        def fits(grammar: Grammar) -> Column:
            # Patterns that generated code can hold are compiled once for all rows.
            pattern = grammar.whole()
            return F.coalesce(text.rlike(pattern) if len(pattern) < MOST_CONSTANT else F.regexp_extract(text, pattern, 0) != "", F.lit(False))

        # Only lines with many brackets can be nested deeper than the middle pattern takes.
        brackets = F.length(text) - F.length(F.translate(text, "[{", ""))
        begun = F.regexp_extract(text, middle.start(), 0)
        left = F.regexp_replace(F.regexp_replace(begun, STRINGS, ""), NO_BRACKETS, "")
        for _ in range(middle.levels()):
            left = F.regexp_replace(left, r"\{\}|\[\]", "")
        return fits(quick), fits(middle) | ((brackets > START_DEPTH) & fits(full)), F.concat(begun, F.translate(F.reverse(left), "{[", "}]"))

    def parsed(self, text: Column, exact: bool) -> Column:
        kind = _json_type(self.root, exact)
        return F.from_json(text, kind if kind.fields else T.StructType([T.StructField("none", T.StringType())]), {"mode": "PERMISSIVE"})

    def _walk(self, node: object, at: Column, raw: Column, absent: Column | None, exact: bool):
        """(leaf, value read, whether JSON null stands there) of each leaf; ``raw`` is the text of ``node``, which is looked at only where nothing was read."""
        if isinstance(node, Dict):
            keys = F.json_object_keys(raw)
            for k, child in node.fields.items():
                if _has_columns(child):
                    path = "$['" + k.replace("'", "\\'") + "']"
                    yield from self._walk(child, at.getField(k), F.get_json_object(raw, path), F.coalesce(F.array_contains(keys, k), F.lit(False)), exact)
        elif isinstance(node, Array):
            text = _json_type(node, exact).elementType == T.StringType()
            for i, child in sorted(node.items.items()):
                if _has_columns(child):
                    item = F.get(at, F.lit(i))
                    item = _reread(item, child, exact) if text else item
                    yield from self._walk(child, item, F.get_json_object(raw, f"$[{i}]"), F.coalesce(F.size(at) > i, F.lit(False)), exact)
        elif isinstance(node, Leaf):
            yield node, at, at.isNull() & (absent if absent is not None else F.lit(True))

    def values(self, text: Column, taken: Column, quick: Column, rest: Column | None, rest_text: Column | None) -> list[tuple[Leaf, Column, Column]]:
        """(leaf, value, whether JSON null stands there) of each output column, of what was read of lines that the quick pattern took and of others."""
        one = [(leaf, value_of(leaf, at, False), null) for leaf, at, null in self._walk(self.root, quick, text, None, False)]
        if rest is None:
            return one
        two = [(value_of(leaf, at, True), null) for leaf, at, null in self._walk(self.root, rest, rest_text, None, True)]
        return [(leaf, F.when(taken, a).otherwise(b), F.when(taken, na).otherwise(nb)) for (leaf, a, na), (b, nb) in zip(one, two, strict=True)]


def ddl_of(root: object) -> str:
    """The DDL of a schema for the built-in JSON reader: its fields with the types in which they stand in a line."""
    validate(root)
    if not isinstance(root, Dict):
        raise ValueError("the built-in reader reads objects")
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _json_type(root, False).fields)
