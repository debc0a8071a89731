"""CSV without a header: exact (unquoted) and safe (quoted)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv_lines(df: DataFrame) -> DataFrame:
    """One text column ``value``: cells joined by commas, unquoted; floats in six significant digits, booleans as words."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("float", "double"):
            # %g drops no zeros in the JVM, so trailing ones are cut.
            six = F.format_string("%.6g", c.cast("double"))
            text = F.regexp_replace(F.regexp_replace(six, r"(\.\d*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
            c = F.when(c.isNull(), F.lit("")).when(F.isnan(c), F.lit("nan")).when(F.abs(c) == float("inf"), F.when(c > 0, "inf").otherwise("-inf")).otherwise(text)
        cells.append(F.coalesce(c.cast("string"), F.lit("")))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def write_plain_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Unquoted lines of all rows, failed ones included, one file for each partition."""
    csv_lines(df).write.mode(mode).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Quoted where needed, without a header."""
    df.write.mode(mode).csv(path, header=False, sep=",", escape='"')
