"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each table's rows are written as JSON lines first. Timed are reading the files,
extraction with an error code for each line, and a sink that drops the rows;
next to it, the built-in JSON reader with the same fields as declared types.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from flatjet import queries as engine
from flatjet.operators import extract
from flatjet.plans.compiler import ddl_of
from flatjet.sources import read_builtin, read_lines

#: Extraction queries that stand for the engine; the operators on documents are timed by the check tool.
NAMES = ["dict_props", "dict_flat_lineitem", "nested_depth1", "nested_depth5", "array_positional", "book_like", "uint_wrap32", "real_exp", "bool_flag", "static_string_trunc", "datetime_s", "null_default_str", "minmax_price", "cut_right", "ascii_upper", "poly_hash", "category_match", "error_rate", "demo_pipeline", "partial_rows"]


def best_of(frame: DataFrame, times: int = 3) -> float:
    took = []
    for _ in range(times):
        began = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return min(took)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    took, builtin, rate, mb = {}, {}, {}, {}
    try:
        for name in NAMES:
            table, line, schema = engine.SOURCES[name]
            path = f"{folder}/{name}"
            spark.read.parquet(f"{sf_dir}/{table}.parquet").select(line().alias("value")).repartition(int(cpus)).write.text(path)
            lines = read_lines(spark, path)
            rows, size = lines.count(), sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part"))
            # Two rounds of the engine around the built-in reader, so that neither has the warmer machine.
            df = extract(lines, schema, errors="_err")
            one = best_of(df)
            builtin[name] = round(best_of(read_builtin(spark, path, ddl_of(schema))), 4)
            took[name] = round(min(one, best_of(df)), 4)
            rate[name], mb[name] = round(rows / took[name]), round(size / 1e6 / took[name], 1)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    ratio = {k: round(took[k] / builtin[k], 2) for k in NAMES}
    print(json.dumps({"metric": "total_sec", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "rows_per_sec": rate, "mb_per_sec": mb, "builtin_reader": builtin, "times_builtin": ratio, "total_times_builtin": round(sum(took.values()) / sum(builtin.values()), 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
