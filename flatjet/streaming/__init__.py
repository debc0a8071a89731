"""The same extraction over streams of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import extract


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Lines of files as they arrive in a folder, as ``value``."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def stream_extract(lines: DataFrame, schema: object, **options) -> DataFrame:
    """``extract`` is row by row, so it runs on a stream without state or watermark."""
    return extract(lines, schema, **options)
