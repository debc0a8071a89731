"""Row-level parser: the exact grammar, partial rows and an error code for each line."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa

from ..functions.datetimes import tokens
from ..schema import NO_DEFAULT, Array, Bool, Check, Datetime, Dict, Int, Leaf, Real, Skip, Str, leaves

_BLANK = b" \t\n\r"
_END = re.compile(rb"[ \t\n\r\],}]|$")
_INT = re.compile(rb"0|[1-9][0-9]*")
_REAL = re.compile(rb"(-?)(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
_STRING = re.compile(rb'"((?:[^"\\\x00-\x1f]|\\["\\/bfnrt])*)"')
_ESCAPE = re.compile(rb'\\(["\\/bfnrt])')
#: What the escapes stand for.
_MEANS = {b'"': b'"', b"\\": b"\\", b"/": b"/", b"b": b"\b", b"f": b"\f", b"n": b"\n", b"r": b"\r", b"t": b"\t"}
MISSING, VALUE, NULL = 0, 1, 2


class Bad(Exception):
    """The line does not fit the grammar or the schema."""


class RowParser:
    """Parses one line; ``found`` holds what each leaf has got so far."""

    def __init__(self, root: object):
        self.root = root

    def parse(self, line: bytes) -> tuple[dict[str, tuple[int, object]], bool]:
        """(state, value) of each leaf met, and whether the line is good. Bytes after the value are ignored."""
        self.s, self.found = line, {}
        try:
            self._value(self.root, 0)
            return self.found, True
        except Bad:
            return self.found, False

    def _blank(self, i: int) -> int:
        while i < len(self.s) and self.s[i] in _BLANK:
            i += 1
        return i

    def _at(self, i: int) -> int:
        if i >= len(self.s):
            raise Bad
        return self.s[i]

    def _ended(self, i: int) -> int:
        if not _END.match(self.s, i):
            raise Bad
        return i

    def _string(self, i: int) -> tuple[bytes, int]:
        m = _STRING.match(self.s, i)
        if not m:
            raise Bad
        return m[1], m.end()

    def _value(self, node: object, i: int) -> int:
        if isinstance(node, Dict):
            return self._dict(node, i)
        if isinstance(node, Array):
            return self._array(node, i)
        if isinstance(node, Skip):
            return self._skip(node, i, 0)
        return self._leaf(node, i)

    def _dict(self, node: Dict, i: int) -> int:
        if self._at(i) != 0x7B:
            raise Bad
        i = self._blank(i + 1)
        names = list(node.fields)
        raw = {k.encode(): k for k in names}
        seen = 0
        if self._at(i) == 0x7D:
            if node.order == "const" and names:
                raise Bad
            return i + 1
        while True:
            key, i = self._string(i)
            i = self._blank(i)
            if self._at(i) != 0x3A:
                raise Bad
            i = self._blank(i + 1)
            name = raw.get(key)
            if node.order == "const" and (seen >= len(names) or name != names[seen]):
                raise Bad
            seen += 1
            if name is not None:
                i = self._value(node.fields[name], i)
            elif node.skip is None:
                raise Bad
            else:
                i = self._skip(node.skip, i, 0)
            i = self._blank(i)
            c = self._at(i)
            if c == 0x7D:
                if node.order == "const" and seen < len(names):
                    raise Bad
                return i + 1
            if c != 0x2C:
                raise Bad
            i = self._blank(i + 1)

    def _array(self, node: Array, i: int) -> int:
        if self._at(i) != 0x5B:
            raise Bad
        i = self._blank(i + 1)
        if self._at(i) == 0x5D:
            return i + 1
        k = 0
        while True:
            if k in node.items:
                i = self._value(node.items[k], i)
            elif node.skip is None:
                raise Bad
            else:
                i = self._skip(node.skip, i, 0)
            k += 1
            i = self._blank(i)
            c = self._at(i)
            if c == 0x5D:
                return i + 1
            if c != 0x2C:
                raise Bad
            i = self._blank(i + 1)

    def _skip(self, limit: Skip, i: int, level: int) -> int:
        c = self._at(i)
        if c in b"{[":
            kind = "object" if c == 0x7B else "array"
            if kind not in limit.kinds or level >= limit.depth:
                raise Bad
            close = 0x7D if c == 0x7B else 0x5D
            i = self._blank(i + 1)
            if self._at(i) == close:
                return i + 1
            while True:
                if c == 0x7B:
                    _, i = self._string(i)
                    i = self._blank(i)
                    if self._at(i) != 0x3A:
                        raise Bad
                    i = self._blank(i + 1)
                i = self._blank(self._skip(limit, i, level + 1))
                d = self._at(i)
                if d == close:
                    return i + 1
                if d != 0x2C:
                    raise Bad
                i = self._blank(i + 1)
        if c == 0x22:
            if "string" not in limit.kinds:
                raise Bad
            return self._string(i)[1]
        for word, kind in ((b"null", "null"), (b"true", "boolean"), (b"false", "boolean")):
            if self.s.startswith(word, i):
                if kind not in limit.kinds:
                    raise Bad
                return self._ended(i + len(word))
        m = _REAL.match(self.s, i)
        if not m or "number" not in limit.kinds:
            raise Bad
        return self._ended(m.end())

    def _leaf(self, leaf: Leaf, i: int) -> int:
        if leaf.null is not NO_DEFAULT and self.s.startswith(b"null", i) and _END.match(self.s, i + 4):
            self.found[leaf.name] = (NULL, None)
            return i + 4
        if isinstance(leaf, Int):
            minus = leaf.signed and self._at(i) == 0x2D
            m = _INT.match(self.s, i + minus)
            if not m:
                raise Bad
            self._ended(m.end())
            n = (-int(m[0]) if minus else int(m[0])) % (1 << leaf.bits)
            value = n - (1 << leaf.bits) if leaf.signed and n >> (leaf.bits - 1) else n
            end = m.end()
        elif isinstance(leaf, Real):
            m = _REAL.match(self.s, i)
            if not m or (m[1] and not leaf.signed) or (m[4] and not leaf.exponent):
                raise Bad
            end = self._ended(m.end())
            fraction = (m[3] or b"")[: 10 if leaf.nine_digits else None]
            value = float(m[1] + m[2] + fraction + (m[4] or b""))
            if leaf.bits == 32 and abs(value) > 3.4028235677973366e38:
                value = math.copysign(math.inf, value)
        elif isinstance(leaf, Bool):
            value = self.s.startswith(b"true", i)
            if not value and not self.s.startswith(b"false", i):
                raise Bad
            end = self._ended(i + (4 if value else 5))
        else:
            text, end = self._string(i)
            if isinstance(leaf, Check):
                return end
            if isinstance(leaf, Datetime):
                fields = tokens(leaf.fmt)
                if any(not text[p : p + w].isdigit() or len(text) < p + w for _, p, w in fields):
                    raise Bad
                value = text.decode("utf-8", "replace")
            else:
                if not (isinstance(leaf, Str) and leaf.raw):
                    text = _ESCAPE.sub(lambda m: _MEANS[m[1]], text)
                value = text.decode("utf-8", "replace")
        self.found[leaf.name] = (VALUE, value)
        return end


def arrow_type(leaf: Leaf) -> pa.DataType:
    if isinstance(leaf, Int):
        return pa.decimal128(20, 0) if leaf.bits == 64 and not leaf.signed else pa.int64()
    if isinstance(leaf, Real):
        return pa.float64()
    return pa.bool_() if isinstance(leaf, Bool) else pa.string()


def spark_type(leaf: Leaf) -> str:
    return {pa.int64(): "long", pa.float64(): "double", pa.bool_(): "boolean", pa.string(): "string"}.get(arrow_type(leaf), "decimal(20,0)")


def parsed_schema(root: object) -> str:
    """What ``parse_batches`` adds: for each leaf its value and state, and the error code."""
    return ", ".join([*[f"v{i} {spark_type(leaf)}, s{i} tinyint" for i, leaf in enumerate(leaves(root))], "err smallint"])


def parse_batches(root: object, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parse the first column of each batch and pass the second on."""
    parser, fields = RowParser(root), list(leaves(root))
    for batch in batches:
        values: list[list] = [[] for _ in fields]
        states: list[list[int]] = [[] for _ in fields]
        errors = []
        for line in batch.column(0).to_pylist():
            found, good = parser.parse((line or "").encode())
            errors.append(0 if good else 255)
            for k, leaf in enumerate(fields):
                state, value = found.get(leaf.name, (MISSING, None))
                values[k].append(value)
                states[k].append(state)
        out, names = [batch.column(1)], ["row"]
        for k, leaf in enumerate(fields):
            kind = arrow_type(leaf)
            column = [None if v is None else Decimal(v) for v in values[k]] if pa.types.is_decimal(kind) else values[k]
            out += [pa.array(column, kind), pa.array(states[k], pa.int8())]
            names += [f"v{k}", f"s{k}"]
        yield pa.RecordBatch.from_arrays([*out, pa.array(errors, pa.int16())], [*names, "err"])
