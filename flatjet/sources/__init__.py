"""Reading lines, writing CSV, made-up data."""

from .csv_sink import csv_lines, write_csv, write_plain_csv
from .jsonl import frame_of, generate, read_builtin, read_lines, with_expected_count

__all__ = ["csv_lines", "frame_of", "generate", "read_builtin", "read_lines", "with_expected_count", "write_csv", "write_plain_csv"]
