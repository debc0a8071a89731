"""Sources of JSON lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str | list[str], line_sep: str | None = None, expected_count: int | None = None) -> DataFrame:
    """Lines of files as ``value``; LF and CRLF end lines unless ``line_sep`` is given. Files split at any line.

    A CR that no LF follows is an error, as it may have been meant as the end of a line.
    """
    df = spark.read.option("lineSep", line_sep or "\n").text(path)
    if not line_sep:
        value = F.col("value")
        line = F.when(value.endswith("\r"), F.substring(value, F.lit(1), F.length(value) - 1)).otherwise(value)
        alone = F.raise_error(F.lit("a line holds a carriage return without a line feed")).cast("string")
        # Most lines hold none, which one search tells.
        df = df.select(F.when(~F.contains(value, F.lit("\r")), value).when(F.contains(line, F.lit("\r")), alone).otherwise(line).alias("value"))
    return df if expected_count is None else with_expected_count(df, expected_count)


def with_expected_count(df: DataFrame, expected: int) -> DataFrame:
    """The frame itself; raises if it has another number of rows."""
    found = df.count()
    if found != expected:
        raise ValueError(f"{found} lines where {expected} were declared")
    return df


def frame_of(spark: SparkSession, lines: Iterable[str]) -> DataFrame:
    """Lines in memory as ``value``."""
    return spark.createDataFrame([(x,) for x in lines], "value string")


def read_builtin(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """The built-in JSON reader, for comparison: types inferred, or given as DDL and pruned in the scan."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def generate(spark: SparkSession, kind: str, rows: int, seed: int = 0) -> DataFrame:
    """Made-up lines {"a": ...} of one kind, the same for the same seed.

    Kinds: datetime, datetime_as_string, bool, string, nullable_string, integer,
    fixed, float.
    """
    r = F.rand(seed)
    moment = F.timestamp_seconds(F.floor(r * 4102444800).cast("long"))
    word = F.substring(F.sha2(F.concat(F.lit(str(seed)), F.col("id").cast("string")), 256), 1, 4 + (r * 28).cast("int"))
    values = {
        "datetime": F.concat(F.lit('"'), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit('"')),
        "datetime_as_string": F.concat(F.lit('"'), F.date_format(moment, "yyyy-MM-dd HH:mm:ss"), F.lit('"')),
        "bool": (r < 0.5).cast("string"),
        "string": F.concat(F.lit('"'), word, F.lit('"')),
        "nullable_string": F.when(F.rand(seed + 1) < 0.1, F.lit("null")).otherwise(F.concat(F.lit('"'), word, F.lit('"'))),
        "integer": F.floor(r * (1 << 31)).cast("string"),
        "fixed": F.format_string("%.6f", (r - 0.5) * 2000),
        "float": F.format_string("%.9e", (r - 0.5) * F.exp(F.rand(seed + 1) * 20)),
    }
    if kind not in values:
        raise ValueError(f"kinds are {sorted(values)}")
    return spark.range(rows).select(F.concat(F.lit('{"a": '), values[kind], F.lit("}")).alias("value"))
