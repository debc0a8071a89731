"""Column functions that run during extraction."""

from .datetimes import epoch, tokens
from .numeric import cut, min_max, wrap, wrap_digits
from .strings import ascii_lower, ascii_upper, category, char_count, column_hash, fold, poly_hash, poly_hash_of, truncate_bytes

__all__ = ["ascii_lower", "ascii_upper", "category", "char_count", "column_hash", "cut", "epoch", "fold", "min_max", "poly_hash", "poly_hash_of", "tokens", "truncate_bytes", "wrap", "wrap_digits"]
