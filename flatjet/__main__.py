"""Command line: python -m flatjet LINES SCHEMA.py [COUNT] [-o CSV] ...

SCHEMA.py defines ``SCHEMA``; it may use ``WS``, the lanes of its hashes.
"""

from __future__ import annotations

import argparse
import runpy
from dataclasses import replace

from pyspark.sql import SparkSession

from .operators import all_good, extract
from .schema import Array, Dict, Skip, Str
from .sources import read_builtin, read_lines, write_csv, write_plain_csv

#: Assumptions about all objects of a schema: order and skipping.
ASSUME = {
    "none": ("random", Skip()),
    "const": ("const", None),
    "no_skip": ("random", None),
    "skip_0": ("random", Skip(0)),
    "skip_1": ("random", Skip(1)),
    "skip": ("random", Skip()),
}


def assumed(node: object, order: str, skip: Skip | None, max_bytes: int | None = None) -> object:
    """The schema with one order and one way of skipping in all objects, and byte limits for strings without one."""
    if isinstance(node, Dict):
        return Dict({k: assumed(v, order, skip, max_bytes) for k, v in node.fields.items()}, order, skip)
    if isinstance(node, Array):
        return replace(node, items={k: assumed(v, order, skip, max_bytes) for k, v in node.items.items()})
    return replace(node, max_bytes=max_bytes) if isinstance(node, Str) and node.max_bytes is None and max_bytes else node


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="flatjet", description=__doc__)
    p.add_argument("lines")
    p.add_argument("schema")
    p.add_argument("count", nargs="?", type=int, help="declared number of lines")
    p.add_argument("-o", "--output", help="folder for CSV")
    p.add_argument("--quoted", action="store_true", help="quote CSV cells where needed")
    p.add_argument("--engine", choices=["auto", "fast", "strict", "builtin"], default="auto")
    p.add_argument("--types", help="DDL for the built-in reader")
    p.add_argument("--structure", action="store_true", help="print the columns and their types")
    p.add_argument("-b", "--check", action="store_true", help="say whether any line failed")
    p.add_argument("--assumptions", choices=list(ASSUME))
    p.add_argument("--const-order", action="store_true")
    p.add_argument("-s", "--max-string-size", type=int)
    p.add_argument("--ws", type=int, default=32, help="lanes of rolling hashes, as WS in SCHEMA.py")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("flatjet").getOrCreate()
    if a.engine == "builtin":
        df = read_builtin(spark, a.lines, a.types)
    else:
        schema = runpy.run_path(a.schema, {"WS": a.ws})["SCHEMA"]
        if a.assumptions or a.const_order or a.max_string_size:
            schema = assumed(schema, *ASSUME["const" if a.const_order else a.assumptions or "none"], a.max_string_size)
        lines = read_lines(spark, a.lines, expected_count=a.count)
        df = extract(lines, schema, engine=a.engine, errors="_err" if a.check else None)
        if a.check:
            print("no errors" if all_good(df, "_err") else "Parsing errors!")
            df = df.drop("_err")
    if a.structure:
        df.printSchema()
    if a.output:
        (write_csv if a.quoted else write_plain_csv)(df, a.output)
    elif not a.structure:
        df.show()


if __name__ == "__main__":
    main()
