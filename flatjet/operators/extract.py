"""Extraction: a column of JSON text to flat typed columns."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.compiler import FAILED, OK, FastPlan, finished, transformed, value_of
from ..plans.strict import NULL, VALUE, parse_batches, parsed_schema
from ..schema import Int, Real, leaves, validate


def extract(df: DataFrame, schema: object, column: str = "value", engine: str = "auto", errors: str | None = None, keep: list[str] | None = None, trusted: bool = False) -> DataFrame:
    """Columns of ``schema`` from the JSON text in ``column``, one row for each row of ``df``.

    engine "fast" compiles to pruned ``from_json`` calls behind a pattern that
    tells whether a line fits the schema, all in the JVM; "strict" runs the
    row-level parser; "auto" takes the fast one wherever the schema allows it.
    Both give the same values and codes, and a line that does not fit keeps what
    stands before the error.
    ``trusted`` lines are read without the pattern: they must be well formed and
    fit the schema, and integers must have 18 digits at most.
    ``errors`` names a column for the error code (0, or 255 for a line that does
    not fit); ``keep`` lists input columns to carry along. Missing keys leave 0,
    false or an empty string. Null lines are errors.
    """
    validate(schema)
    plan = FastPlan(schema)
    why = plan.needs_strict()
    if engine not in ("auto", "fast", "strict"):
        raise ValueError("engine is 'auto', 'fast' or 'strict'")
    if engine == "fast" and why:
        raise ValueError(f"the row-level engine is needed: {why}")
    if trusted and errors:
        raise ValueError("trusted lines have no errors")
    kept = [F.col(f"`{c}`") for c in keep or []]
    if engine == "strict" or why:
        return _strict(df, schema, column, errors, keep or [])
    # A struct of what is kept, and names of its own, so that no column clashes with the working ones.
    text, taken, fits, rest, p, w = (F.col(f"__{c}") for c in ("text", "taken", "fits", "rest", "p", "w"))
    base = df.select(F.col(f"`{column}`").cast("string").alias("__text"), F.struct(*kept, F.lit(0).alias("_")).alias("__row"))
    out = [F.col(f"__row.`{c}`").alias(c) for c in keep or []]
    if trusted:
        base = base.withColumn("__p", plan.parsed(text, False))
        return base.select(*out, *_finish(base, plan.values(text, F.lit(True), p, None, None)))
    quick, full, begun = plan.guards(text)
    base = base.withColumn("__taken", quick).withColumn("__fits", taken | full)
    base = base.withColumn("__rest", F.when(taken, F.lit(None)).when(fits, text).otherwise(begun))
    base = base.withColumns({"__p": plan.parsed(F.when(taken, text), False), "__w": plan.parsed(rest, True)})
    out += _finish(base, plan.values(text, taken, p, w, rest))
    if errors:
        out.append(F.when(fits, F.lit(OK)).otherwise(F.lit(FAILED)).cast("short").alias(errors))
    return base.select(*out)


def _finish(base: DataFrame, values: list[tuple]) -> list[Column]:
    """Output columns; the types of transformed ones are asked of the analyser, without running anything."""
    kinds = base.select(*[transformed(leaf, value).alias(f"c{i}") for i, (leaf, value, _) in enumerate(values)]).schema
    return [finished(leaf, value, null, field.dataType).alias(leaf.name) for (leaf, value, null), field in zip(values, kinds, strict=True)]


def _strict(df: DataFrame, schema: object, column: str, errors: str | None, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return parse_batches(schema, batches)

    base = df.select(F.col(f"`{column}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in keep], F.lit(0).alias("_")).alias("row"))
    found = base.mapInArrow(run, f"row {base.schema['row'].dataType.simpleString()}, {parsed_schema(schema)}")
    out = [F.col(f"row.`{c}`").alias(c) for c in keep]
    values = []
    for k, leaf in enumerate(leaves(schema)):
        value = F.when(F.col(f"s{k}") == VALUE, F.col(f"v{k}"))
        # Ranges, signs and fractions are settled by the parser; types and byte limits here.
        value = value.cast(leaf.raw_type().simpleString()) if isinstance(leaf, (Int, Real)) else value_of(leaf, value)
        values.append((leaf, value, F.col(f"s{k}") == NULL))
    out += _finish(found, values)
    if errors:
        out.append(F.col("err").alias(errors))
    return found.select(*out)


def error_count(df: DataFrame, errors: str) -> DataFrame:
    """Number of rows and of failed rows."""
    return df.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col(errors) == FAILED, 1)).alias("n_errors"))


def all_good(df: DataFrame, errors: str) -> bool:
    """Whether no line failed; stops at the first one that did."""
    return df.where(F.col(errors) != 0).isEmpty()


def check_errors(df: DataFrame, errors: str) -> DataFrame:
    """The frame itself; raises if any line failed."""
    if not all_good(df, errors):
        raise ValueError("some lines could not be parsed")
    return df


def number_columns(df: DataFrame) -> DataFrame:
    """Columns renamed to "Column 1", "Column 2", ..."""
    return df.toDF(*[f"Column {i + 1}" for i in range(len(df.columns))])
