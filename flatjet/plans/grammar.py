"""A schema as a regular expression: which lines fit it, and how far a line that does not fit goes well.

Nesting is bounded by the schema and by the depth of skipped values, so the
dialect is regular. All loops are possessive: matching goes forward only, and
the JVM runs them without recursion, whatever the length of a line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions.datetimes import pieces
from ..schema import NO_DEFAULT, Array, Bool, Datetime, Dict, Int, Leaf, Real, Skip

_B = r"[ \t\n\r]*+"
_END = r"(?=[ \t\n\r\],}]|\z)"
_INSIDE = r'[^"\\\x00-\x1f]*+(?:\\["\\/bfnrt][^"\\\x00-\x1f]*+)*+"'
_STRING = '"' + _INSIDE
_NUMBER = r"(?:0|[1-9][0-9]*+)"
_TAIL = r"(?:\.[0-9]++)?+"
_EXPONENT = r"(?:[eE][+-]?+[0-9]++)?+"
#: Levels of skipped values that the quick pattern and the pattern of starts take, and digits of the quick one's integers, which fit in 64 bits.
QUICK_DEPTH, START_DEPTH, QUICK_DIGITS = 3, 5, 18
#: Where the next pair of an object may begin: after the brace or after a comma.
_NEXT = rf"(?:(?<=\{{){_B}|(?<!\{{){_B},{_B})"


def _key(name: str) -> str:
    return '"' + re.sub(r"([^0-9A-Za-z_\u0080-\U0010ffff])", r"\\\1", name) + '"'


def _loop(item: str, close: str) -> str:
    """Items with commas between them, up to ``close``: what follows an item is a comma before another one, or the end."""
    return f"(?:{item}{_B}(?:,{_B}(?!{close})|(?={close})))*+"


def skipped(limit: Skip, deepest: int, level: int = 0) -> str:
    """A value that is passed over."""
    words = "|".join(w for kind, w in (("boolean", "true|false"), ("null", "null")) if kind in limit.kinds)
    parts = [f"(?:-?+{_NUMBER}{_TAIL}{_EXPONENT}){_END}"] if "number" in limit.kinds else []
    parts += [f"(?:{words}){_END}"] if words else []
    parts += [_STRING] if "string" in limit.kinds else []
    if level < min(limit.depth, deepest) and {"object", "array"} & set(limit.kinds):
        inner = skipped(limit, deepest, level + 1)
        parts += [rf"\[{_B}{_loop(inner, r'\]')}\]"] if "array" in limit.kinds else []
        parts += [rf"\{{{_B}{_loop(f'{_STRING}{_B}:{_B}{inner}', r'\}')}\}}"] if "object" in limit.kinds else []
    return f"(?:{'|'.join(parts)})" if parts else "(?!)"


def _leaf(leaf: Leaf, quick: bool) -> str:
    if isinstance(leaf, Int):
        digits = rf"(?:0|[1-9][0-9]{{0,{QUICK_DIGITS - 1}}}+)" if quick else _NUMBER
        own = ("-?+" if leaf.signed else "") + digits + _END
    elif isinstance(leaf, Real):
        own = ("-?+" if leaf.signed else "") + _NUMBER + _TAIL + (_EXPONENT if leaf.exponent else "") + _END
    elif isinstance(leaf, Bool):
        own = "(?:true|false)" + _END
    elif isinstance(leaf, Datetime):
        parts = [f"[0-9]{{{width}}}" if token else rf"[\x20\x21\x23-\x5b\x5d-\x7e]{{{width}}}" for token, width in pieces(leaf.fmt)]
        while parts and not parts[-1].startswith("[0-9]"):
            parts.pop()  # text after the last field may be missing
        own = '"' + "".join(parts) + _INSIDE
    else:
        own = _STRING
    return own if leaf.null is NO_DEFAULT else f"(?:{own}|null{_END})"


class Grammar:
    """Patterns of a schema.

    ``quick`` leaves out deeply nested skipped values, long integers, and arrays
    read as ``typed`` ones that hold other kinds; ``depth`` limits skipped
    values further than the schema does.
    """

    def __init__(self, root: object, quick: bool = False, typed: Callable[[Array], bool] = lambda node: False, depth: int | None = None):
        self.root, self.quick, self.typed = root, quick, typed
        self.depth = QUICK_DEPTH if quick else depth

    def whole(self) -> str:
        """Matches a line that fits, up to its value's end."""
        return r"\A" + self._node(self.root)

    def start(self) -> str:
        """Matches the longest start of a line that closing brackets make whole."""
        return r"\A" + self._open(self.root)

    def levels(self, node: object = None) -> int:
        """How deep values of a matched start are nested at most."""
        node = node or self.root
        children = node.fields.values() if isinstance(node, Dict) else node.items.values() if isinstance(node, Array) else ()
        return 1 + max([START_DEPTH + 1, *map(self.levels, children)])

    def _open(self, node: object) -> str | None:
        """A container without its end: complete items, then perhaps one that is open itself."""
        if isinstance(node, Dict):
            half = [f"{_key(k)}{_B}:{_B}{x}" if (x := self._open(child)) else None for k, child in node.fields.items()]
            pairs = self._pairs(node)
            if node.order == "const":
                return rf"\{{{self._chain(pairs, half, '')}"
            last = "|".join(x for x in half if x)
            return rf"\{{(?:{_NEXT}(?:{'|'.join(pairs) or '(?!)'}))*+" + (f"(?:{_NEXT}(?:{last}))?+" if last else "")
        if isinstance(node, Array):
            other = self._skip(node.skip) if node.skip is not None else None
            items = [node.items.get(i) for i in range(max(node.items, default=-1) + 1)]
            whole = [self._node(x) if x is not None else other for x in items]
            return rf"\[{self._chain(whole, [x and self._open(x) for x in items], f'(?:{_B},{_B}{other})*+' if other else '')}"
        return None

    @staticmethod
    def _chain(whole: list[str], half: list[str | None], rest: str) -> str:
        """Items in their order, as many as there are; the last one may be open."""
        for i in range(len(whole) - 1, -1, -1):
            both = f"(?:{whole[i]}{rest}|{half[i]})" if half[i] else f"{whole[i]}{rest}"
            rest = f"(?:{_B if i == 0 else f'{_B},{_B}'}{both})?+"
        return rest

    def _skip(self, limit: Skip) -> str:
        return skipped(limit, limit.depth if self.depth is None else self.depth)

    def _pairs(self, node: Dict) -> list[str]:
        pairs = [f"{_key(k)}{_B}:{_B}{self._node(child)}" for k, child in node.fields.items()]
        if node.order == "random" and node.skip is not None:
            other = f"(?!(?:{'|'.join(map(_key, node.fields))}))" if node.fields else ""
            pairs.append(f"{other}{_STRING}{_B}:{_B}{self._skip(node.skip)}")
        return pairs

    def _node(self, node: object) -> str:
        if isinstance(node, Skip):
            return self._skip(node)
        if isinstance(node, Dict):
            pairs = self._pairs(node)
            if node.order == "const":
                return rf"\{{{_B}{f'{_B},{_B}'.join(pairs)}{_B}\}}"
            return rf"\{{{_B}{_loop('(?:' + '|'.join(pairs) + ')', r'\}') if pairs else ''}\}}"
        if isinstance(node, Array):
            return self._array(node)
        return _leaf(node, self.quick)

    def _array(self, node: Array) -> str:
        other = None
        if node.skip is not None:
            # Items of one type are read as such, so those between and after them must be alike as well.
            alike = self.quick and node.items and self.typed(node)
            other = f"(?:{self._node(next(iter(node.items.values())))}|null{_END})" if alike else self._skip(node.skip)
        if not node.items:
            return rf"\[{_B}{_loop(other, r'\]') if other else ''}\]"
        rest = f"(?:{_B},{_B}{other})*+" if other else ""
        for i in range(max(node.items), -1, -1):
            item = self._node(node.items[i]) if i in node.items else other
            rest = f"(?:{item}{rest})?+" if i == 0 else f"(?:{_B},{_B}{item}{rest})?+"
        return rf"\[{_B}{rest}{_B}\]"


#: Strings, and all but brackets: what is left out to see which brackets are open.
STRINGS, NO_BRACKETS = _STRING, r"[^\[\]{}]"
