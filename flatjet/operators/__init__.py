"""DataFrame operators over JSON text."""

from .extract import all_good, check_errors, error_count, extract, number_columns

__all__ = ["all_good", "check_errors", "error_count", "extract", "number_columns"]
