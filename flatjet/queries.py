"""The registered queries of the extraction engine and their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ascii_lower, ascii_upper, category, char_count, column_hash, cut, fold, min_max, poly_hash
from .operators import error_count, extract, number_columns
from .plans.compiler import ddl_of
from .schema import Array, Bool, Check, Datetime, Dict, Int, Real, Skip, Str
from .sources import csv_lines, frame_of, generate, read_builtin, read_lines, with_expected_count
from .streaming import stream_extract, stream_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Table, line and schema of the queries that read a table's rows as JSON text.
SOURCES: dict[str, tuple[str, Callable[[], Column], object]] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(name: str, sql: str, table: str, line: Callable[[], Column], schema: object, keep: list[str], then: Callable[[DataFrame], DataFrame] = lambda df: df, **options) -> None:
    """A query that writes a table's rows as JSON text and extracts them again."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = _table(spark, sf_dir, table).withColumn("value", line())
        return then(extract(lines, schema, keep=keep, **options))

    run.__doc__ = f"{name}: JSON text of {table}."
    QUERIES[name], SQL[name], SOURCES[name] = run, sql, (table, line, schema)


def _json(*fields: str | Column) -> Callable[[], Column]:
    return lambda: F.to_json(F.struct(*[F.expr(f) if isinstance(f, str) else f for f in fields]))


KEY = ["l_orderkey", "l_linenumber"]
ID = ["event_id"]

_query("dict_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", "events", lambda: F.col("props"), Dict({"k": Int("k", 64, signed=True)}), ID)
_query(
    "dict_flat_lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey AS part, l_quantity AS qty, l_extendedprice AS price, l_returnflag AS flag FROM lineitem",
    "lineitem",
    _json("l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_suppkey"),
    Dict({"l_partkey": Int("part", 64, signed=True), "l_quantity": Real("qty"), "l_extendedprice": Real("price"), "l_returnflag": Str("flag")}),
    KEY,
)
_two = Dict({"a": Int("a", 32, signed=True), "b": Str("b")})
_query("dict_random_order", "SELECT event_id, CAST(user_id AS INTEGER) AS a, event_type AS b FROM events", "events", lambda: F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("b"), F.col("user_id").alias("a")))), _two, ID)
_query(
    "dict_const_order_err",
    "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE 255 END AS SMALLINT) AS err FROM events",
    "events",
    lambda: F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b")))).otherwise(F.to_json(F.struct(F.col("event_type").alias("b"), F.col("user_id").alias("a")))),
    Dict(_two.fields, order="const", skip=None),
    ID,
    lambda df: df.select("event_id", "err"),
    errors="err",
)
_query("skip_unknown", "SELECT event_id, event_type AS b FROM events", "events", _json("event_type AS b", "named_struct('x', array(user_id), 'y', value) AS other", "props"), Dict({"b": Str("b")}), ID)
_query(
    "skip_disabled_err",
    "SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events",
    "events",
    lambda: F.to_json(F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b"), F.when(F.col("event_id") % 3 == 0, F.lit(1)).alias("other"))),
    Dict(_two.fields, skip=None),
    ID,
    lambda df: df.select("event_id", "err"),
    errors="err",
)
for _depth in range(1, 6):
    _tree: object = Int("leaf", 64, signed=True)
    _line = "user_id"
    for _level in range(_depth, 0, -1):
        _tree, _line = Dict({f"l{_level}": _tree}), f"named_struct('l{_level}', {_line})"
    _query(f"nested_depth{_depth}", "SELECT event_id, user_id AS leaf FROM events", "events", lambda line=_line: F.to_json(F.expr(line)), _tree, ID)
_query(
    "array_positional",
    "SELECT event_id, user_id AS first, value AS third FROM events",
    "events",
    lambda: F.concat(F.lit('{"v": ['), F.col("user_id").cast("string"), F.lit(', "skipped", '), F.to_json(F.struct("value")).substr(F.lit(10), F.length(F.to_json(F.struct("value"))) - 10), F.lit("]}")),
    Dict({"v": Array({0: Int("first", 64, signed=True), 2: Real("third")})}),
    ID,
)
_query(
    "array_short_default",
    "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE 0 END AS second FROM events",
    "events",
    lambda: F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.array("event_id", "user_id")).otherwise(F.array("event_id")).alias("v"))),
    Dict({"v": Array({1: Int("second", 64, signed=True)})}),
    ID,
)
_query(
    "book_like",
    "SELECT p_partkey, p_name AS title, p_brand AS author, CAST(p_size AS BIGINT) AS pages FROM part",
    "part",
    _json("array(named_struct('title', p_name, 'author', p_brand, 'pages', p_size, 'extra', p_type)) AS books"),
    Dict({"books": Array({0: Dict({"title": Str("title", 128), "author": Str("author", 64), "pages": Int("pages", 32)})})}),
    ["p_partkey"],
)
for _bits, _type in ((8, "SMALLINT"), (16, "INTEGER"), (32, "BIGINT")):
    _query(f"uint_wrap{_bits}", f"SELECT event_id, CAST((user_id * 123457 + 250) % {2**_bits} AS {_type}) AS n FROM events", "events", _json("user_id * 123457 + 250 AS n"), Dict({"n": Int("n", _bits)}), ID)
_query("sint_wrap", "SELECT event_id, CAST(((user_id * 123457) + 128) % 256 - 128 AS TINYINT) AS n FROM events", "events", _json("user_id * 123457 AS n"), Dict({"n": Int("n", 8, signed=True)}), ID)
_query(
    "signed_default_error",
    "SELECT event_id, CAST(CASE WHEN user_id % 7 - 3 < 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events",
    "events",
    _json("user_id % 7 - 3 AS n"),
    Dict({"n": Int("n", 32)}),
    ID,
    lambda df: df.select("event_id", "err"),
    errors="err",
)
_query("real_fixed", "SELECT l_orderkey, l_linenumber, l_tax AS x FROM lineitem", "lineitem", lambda: F.concat(F.lit('{"x": '), F.format_string("%.2f", "l_tax"), F.lit("}")), Dict({"x": Real("x", exponent=False)}), KEY)
_query("real_exp", "SELECT l_orderkey, l_linenumber, l_quantity AS x FROM lineitem", "lineitem", lambda: F.concat(F.lit('{"x": '), F.format_string("%.6e", "l_quantity"), F.lit("}")), Dict({"x": Real("x")}), KEY)
_query(
    "fraction_9_digits",
    "SELECT event_id, 0.123456789 AS x FROM events".replace("0.123456789", "CAST(0.123456789 AS DOUBLE)"),
    "events",
    lambda: F.concat(F.lit('{"x": 0.123456789'), (F.col("event_id") % 1000).cast("string"), F.lit("}")),
    Dict({"x": Real("x", nine_digits=True)}),
    ID,
)
_query("bool_flag", "SELECT event_id, user_id % 2 = 0 AS flag FROM events", "events", _json("user_id % 2 = 0 AS flag"), Dict({"flag": Bool("flag")}), ID)
_query("static_string_trunc", "SELECT p_partkey, substr(p_name, 1, 5) AS s FROM part", "part", _json("p_name AS s"), Dict({"s": Str("s", 5)}), ["p_partkey"])
_query(
    "raw_escape",
    "SELECT event_id, 'a\\n' || event_type AS s FROM events",
    "events",
    lambda: F.concat(F.lit('{"s": "a\\n'), F.col("event_type"), F.lit('"}')),
    Dict({"s": Str("s", raw=True)}),
    ID,
)
_query("datetime_s", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events", "events", lambda: F.concat(F.lit('{"t": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"}')), Dict({"t": Datetime("t")}), ID)
_query("datetime_ms", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) * 1000 AS t FROM events", "events", lambda: F.concat(F.lit('{"t": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"}')), Dict({"t": Datetime("t", resolution="ms")}), ID)
_query(
    "datetime_date_only",
    "SELECT l_orderkey, l_linenumber, CAST(epoch(date_trunc('day', l_shipdate)) AS BIGINT) AS t FROM lineitem",
    "lineitem",
    # Written with dots, read with dashes: literal text is passed over, not compared.
    lambda: F.concat(F.lit('{"t": "'), F.date_format("l_shipdate", "yyyy.MM.dd"), F.lit('"}')),
    Dict({"t": Datetime("t", "%Y-%m-%d")}),
    KEY,
)
_query(
    "null_default_int",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE user_id END AS n FROM events",
    "events",
    lambda: F.concat(F.lit('{"n": '), F.when(F.col("event_id") % 5 == 0, F.lit("null")).otherwise(F.col("user_id").cast("string")), F.lit("}")),
    Dict({"n": Int("n", 64, signed=True, null=-1)}),
    ID,
)
_query(
    "null_default_str",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS s FROM events",
    "events",
    lambda: F.concat(F.lit('{"s": '), F.when(F.col("event_id") % 5 == 0, F.lit("null")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))), F.lit("}")),
    Dict({"s": Str("s", null="")}),
    ID,
)
_query(
    "minmax_price",
    "SELECT l_orderkey, l_linenumber, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), (l_extendedprice - 5000.0::DOUBLE) / 45000.0::DOUBLE)) AS x FROM lineitem",
    "lineitem",
    _json("l_extendedprice AS x"),
    Dict({"x": Real("x", transform=min_max(5000, 50000))}),
    KEY,
)
_bins = list(range(0, 60, 10))
_by = lambda op1, op2: "CASE " + " ".join(f"WHEN l_quantity {op1} {a} AND l_quantity {op2} {b} THEN {b}" for a, b in zip(_bins, _bins[1:], strict=False)) + " ELSE -1 END"
_query("cut_right", f"SELECT l_orderkey, l_linenumber, CAST({_by('>', '<=')} AS INTEGER) AS c FROM lineitem", "lineitem", _json("l_quantity AS x"), Dict({"x": Real("c", transform=cut(_bins, outside=-1))}), KEY)
_query("cut_left", f"SELECT l_orderkey, l_linenumber, CAST({_by('>=', '<')} AS INTEGER) AS c FROM lineitem", "lineitem", _json("l_quantity AS x"), Dict({"x": Real("c", transform=cut(_bins, right=False, outside=-1))}), KEY)
_query(
    "cut_labels",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 0 AND l_quantity <= 10 THEN 'A' WHEN l_quantity > 10 AND l_quantity <= 25 THEN 'B' WHEN l_quantity > 25 AND l_quantity <= 40 THEN 'C' ELSE 'X' END AS c FROM lineitem",
    "lineitem",
    _json("l_quantity AS x"),
    Dict({"x": Real("c", transform=cut([0, 10, 25, 40], ["A", "B", "C"], outside="X"))}),
    KEY,
)
_query(
    "cut_nan",
    "SELECT l_orderkey, l_linenumber, l_quantity > 40 AS outside, CASE WHEN l_quantity <= 20 THEN 20.0::DOUBLE WHEN l_quantity <= 40 THEN 40.0::DOUBLE ELSE -1.0::DOUBLE END AS c FROM lineitem",
    "lineitem",
    _json("l_quantity AS x"),
    Dict({"x": Real("c", transform=cut([0.0, 20.0, 40.0]))}),
    KEY,
    lambda df: df.select(*KEY, F.isnan("c").alias("outside"), F.when(F.isnan("c"), -1.0).otherwise(F.col("c")).alias("c")),
)
_letters = "abcdefghijklmnopqrstuvwxyz"
_query("ascii_upper", f"SELECT doc_id, translate(substr(lang || source || 'é', 1, 20), '{_letters}', '{_letters.upper()}') AS s FROM documents", "documents", _json("concat(lang, source, 'é') AS s"), Dict({"s": Str("s", transform=ascii_upper)}), ["doc_id"])
_query("ascii_lower", f"SELECT p_partkey, translate(p_brand, '{_letters.upper()}', '{_letters}') AS s FROM part", "part", _json("p_brand AS s"), Dict({"s": Str("s", transform=ascii_lower)}), ["p_partkey"])
_query(
    "poly_hash",
    "SELECT p_partkey, CAST(list_sum([(i % 32 + 1) * (ascii(substr(p_name, CAST(i + 1 AS INTEGER), 1)) - 31) * (CASE WHEN i >= 32 THEN 31 ELSE 1 END) FOR i IN range(length(p_name))]) % 1000000009 AS BIGINT) AS h FROM part",
    "part",
    _json("p_name AS s"),
    Dict({"s": Str("h", transform=poly_hash())}),
    ["p_partkey"],
)
_query(
    "category_match",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS c FROM events",
    "events",
    _json("event_type AS s"),
    Dict({"s": Str("c", transform=category({"click": 1, "view": 2, "purchase": 3}))}),
    ID,
)
_query(
    "category_by_hash",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS c FROM events",
    "events",
    _json("event_type AS s"),
    Dict({"s": Str("c", transform=category({"click": 1, "view": 2, "purchase": 3}, by_hash=True))}),
    ID,
)
_query("char_count_udf", "SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'a', '')) AS INTEGER) AS n FROM part", "part", _json("p_name AS s"), Dict({"s": Str("n", transform=char_count("a"))}), ["p_partkey"])
_query("string_check", "SELECT event_id, CAST(0 AS SMALLINT) AS err FROM events", "events", _json("event_type AS s"), Dict({"s": Check()}), ID, engine="strict", errors="err")
_query("skip_depth_err", "SELECT event_id, user_id AS n, CAST(CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.concat(F.lit('{"n": '), F.col("user_id").cast("string"), F.lit(', "x": '), F.when(F.col("event_id") % 2 == 0, "[[1]]").otherwise("[1]"), F.lit("}")), Dict({"n": Int("n", 64, signed=True)}, skip=Skip(1)), ID, errors="err")
_query("skip_types_err", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 2 == 0, '{"x": "text"}').otherwise('{"x": 1}'), Dict({"y": Check()}, skip=Skip(kinds=("number",))), ID, errors="err")
_query("partial_rows", "SELECT event_id, user_id AS a, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS b, CAST(CASE WHEN event_id % 2 = 0 THEN 0 ELSE 255 END AS SMALLINT) AS err FROM events", "events", lambda: F.concat(F.lit('{"a": '), F.col("user_id").cast("string"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "b": "'), F.col("event_type"), F.lit('"}'))).otherwise(F.lit(', "b": 1}'))), Dict({"a": Int("a", 64, signed=True), "b": Str("b")}), ID, engine="strict", errors="err")
_query(
    "error_rate",
    "SELECT count(*) AS n_rows, count(*) FILTER (WHERE event_id % 4 = 0) AS n_errors FROM events",
    "events",
    lambda: F.when(F.col("event_id") % 4 == 0, F.lit('{"k": -1}')).otherwise(F.lit('{"k": 1}')),
    Dict({"k": Int("k")}),
    [],
    lambda df: error_count(df, "err"),
    errors="err",
)
_query(
    "demo_pipeline",
    "SELECT lower(event_type) AS kind, count(*) AS n_rows, CAST(sum(CASE WHEN user_id > 100 THEN 1000 ELSE 100 END) AS BIGINT) AS bins, CAST(sum(user_id) AS BIGINT) AS total FROM events GROUP BY 1",
    "events",
    _json("user_id AS score", "upper(event_type) AS kind", "value AS rest"),
    Dict({"score": Int("score", 64, signed=True), "kind": Str("kind", transform=ascii_lower)}),
    [],
    lambda df: df.withColumn("bin", F.when(F.col("score") > 100, 1000).otherwise(100)).groupBy("kind").agg(F.count("*").alias("n_rows"), F.sum("bin").alias("bins"), F.sum("score").alias("total")),
)


_lower_event = Dict({"n": Int("n", 64, signed=True), "s": Str("s")})
_event = _json("user_id AS n", "event_type AS s")
_query(
    "array_noskip_err",
    "SELECT event_id, user_id AS first, CAST(CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events",
    "events",
    lambda: F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, F.array("user_id", "event_id")).otherwise(F.array("user_id")).alias("v"))),
    Dict({"v": Array({0: Int("first", 64, signed=True)}, skip=None)}),
    ID,
    errors="err",
)
_query("real_unsigned_err", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2.5::DOUBLE END AS x, CAST(CASE WHEN event_id % 3 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 3 == 0, '{"x": -2.5}').otherwise('{"x": 2.5}'), Dict({"x": Real("x", signed=False)}), ID, errors="err")
_query("real_fixed_err", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 25.0::DOUBLE END AS x, CAST(CASE WHEN event_id % 3 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 3 == 0, '{"x": 2.5e1}').otherwise('{"x": 25.0}'), Dict({"x": Real("x", exponent=False)}), ID, errors="err")
_query("int_hook", "SELECT event_id, user_id * 2 + 1 AS n FROM events", "events", _json("user_id AS n"), Dict({"n": Int("n", 64, signed=True, transform=lambda c: c * 2 + 1)}), ID)
_query("datetime_hook", "SELECT event_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day FROM events", "events", lambda: F.concat(F.lit('{"t": "'), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit('"}')), Dict({"t": Datetime("day", transform=lambda c: F.floor(c / 86400))}), ID)
_query(
    "datetime_tokens",
    "SELECT event_id, CAST(floor(epoch(date_trunc('minute', ts))) AS BIGINT) AS t FROM events",
    "events",
    lambda: F.concat(F.lit('{"t": "'), F.date_format("ts", "dd/MM/yyyy HH:mm"), F.lit('"}')),
    Dict({"t": Datetime("t", (("d", 2), "/", ("m", 2), "/", ("Y", 4), " ", ("H", 2), ":", ("M", 2)))}),
    ID,
)
_query("datetime_digits_err", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 2 == 0, '{"t": "2020-01- 1"}').otherwise('{"t": "2020-01-01"}'), Dict({"t": Datetime("t", "%Y-%m-%d")}), ID, lambda df: df.select("event_id", "err"), errors="err")
_query("string_check_err", "SELECT event_id, CAST(CASE WHEN event_id % 4 = 1 OR event_id % 4 = 2 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 4 == 1, '{"s": 5}').when(F.col("event_id") % 4 == 2, '{"s": "a\tb"}').otherwise('{"s": "a\\tb"}'), Dict({"s": Check()}), ID, errors="err")
_query("string_kind_err", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' ELSE '' END AS s, CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE 255 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 3 == 1, '{"s": 5}').when(F.col("event_id") % 3 == 2, '{"s": {"z": 1}}').otherwise('{"s": "x"}'), Dict({"s": Str("s")}), ID, errors="err")
_query("null_undecorated_err", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE user_id END AS n, CAST(CASE WHEN event_id % 5 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.concat(F.lit('{"n": '), F.when(F.col("event_id") % 5 == 0, F.lit("null")).otherwise(F.col("user_id").cast("string")), F.lit("}")), Dict({"n": Int("n", 64, signed=True)}), ID, errors="err")
_query("uint_wrap64", "SELECT event_id, CAST((user_id::HUGEINT * 1000000000000000000000::HUGEINT + 7) % 18446744073709551616::HUGEINT AS DECIMAL(20,0)) AS n FROM events", "events", lambda: F.concat(F.lit('{"n": '), F.when(F.col("user_id") > 0, F.concat(F.col("user_id").cast("string"), F.lit("000000000000000000007"))).otherwise(F.lit("7")), F.lit("}")), Dict({"n": Int("n", 64)}), ID)
for _bits, _type in ((16, "SMALLINT"), (32, "INTEGER")):
    _query(f"sint_wrap{_bits}", f"SELECT event_id, CAST((user_id * 1234567 - 250 + {2 ** (_bits - 1)} + {2**_bits}) % {2**_bits} - {2 ** (_bits - 1)} AS {_type}) AS n FROM events", "events", _json("user_id * 1234567 - 250 AS n"), Dict({"n": Int("n", _bits, signed=True)}), ID)
_query("sint_wrap64", "SELECT event_id, CAST((user_id::HUGEINT * 1000000000000000000000::HUGEINT + 7 + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT AS BIGINT) AS n FROM events", "events", lambda: F.concat(F.lit('{"n": '), F.when(F.col("user_id") > 0, F.concat(F.col("user_id").cast("string"), F.lit("000000000000000000007"))).otherwise(F.lit("7")), F.lit("}")), Dict({"n": Int("n", 64, signed=True)}), ID)
_query(
    "poly_hash_escaped",
    # The character after the backslash, at place 2, counts as nothing.
    "SELECT event_id, CAST(list_sum([(i + 1) * (ascii(substr(t, CAST(i + 1 AS INTEGER), 1)) - 31) * (CASE WHEN i = 2 THEN 0 ELSE 1 END) FOR i IN range(length(t))]) % 1000000009 AS BIGINT) AS h FROM (SELECT event_id, 'a\\n' || event_type AS t FROM events)",
    "events",
    lambda: F.concat(F.lit('{"s": "a\\n'), F.col("event_type"), F.lit('"}')),
    Dict({"s": Str("h", raw=True, transform=poly_hash())}),
    ID,
)
_query("category_escaped", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS c FROM events", "events", lambda: F.concat(F.lit('{"s": "a\\n'), F.col("event_type"), F.lit('"}')), Dict({"s": Str("c", raw=True, transform=category({"a\\nclick": 1, "a\\nview": 2}, by_hash=True))}), ID)
_query(
    "fold_custom",
    "SELECT p_partkey, CAST(list_reduce(list_prepend(0, [ascii(substr(p_name, CAST(i AS INTEGER), 1)) FOR i IN range(1, length(p_name) + 1)]), lambda a, x: (a * 3 + x) % 1009) AS INTEGER) AS n FROM part",
    "part",
    _json("p_name AS s"),
    Dict({"s": Str("n", transform=fold(0, lambda acc, ch: (acc * 3 + F.ascii(ch)) % 1009))}),
    ["p_partkey"],
)
_query("dynamic_string", "SELECT p_partkey, p_name || ' \"' || p_type || '\"' AS s FROM part", "part", _json("concat(p_name, ' \"', p_type, '\"') AS s"), Dict({"s": Str("s")}), ["p_partkey"])
_query("skip_root", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 2 == 0, "[1, {").otherwise("[1, {}]"), Skip(), ID, errors="err")
_query("skip_depth_default", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.concat(F.lit('{"x": '), F.when(F.col("event_id") % 2 == 0, "[" * 9 + "]" * 9).otherwise("[" * 8 + "]" * 8), F.lit("}")), Dict({}), ID, errors="err")
_query("void_object", "SELECT event_id, CAST(CASE WHEN event_id % 2 = 0 THEN 255 ELSE 0 END AS SMALLINT) AS err FROM events", "events", lambda: F.when(F.col("event_id") % 2 == 0, '{"x": 1}').otherwise("{}"), Dict({}, skip=None), ID, errors="err")
_query("trusted_lines", "SELECT event_id, user_id AS n, event_type AS s FROM events", "events", _event, _lower_event, ID, trusted=True)
_query("csv_plain", "SELECT CAST(user_id AS VARCHAR) || ',' || event_type AS value FROM events", "events", _event, _lower_event, [], csv_lines)
_query("numbered_columns", "SELECT user_id AS column_1, event_type AS column_2 FROM events", "events", _event, _lower_event, [], lambda df: number_columns(df).select(F.col("`Column 1`").alias("column_1"), F.col("`Column 2`").alias("column_2")))
_query(
    "demo_cut_hash",
    "SELECT CASE WHEN user_id > 0 AND user_id <= 50 THEN 'low' WHEN user_id > 50 AND user_id <= 5000 THEN 'high' ELSE 'none' END AS bin, count(*) AS n_rows, count(DISTINCT event_type) AS n_kinds, CAST(sum(length(event_type)) AS BIGINT) AS letters FROM events GROUP BY 1",
    "events",
    _json("user_id AS score", "event_type AS kind", "upper(event_type) AS body"),
    Dict({"score": Int("bin", 64, signed=True, transform=cut([0, 50, 5000], ["low", "high"], outside="none")), "kind": Str("kind", transform=column_hash), "body": Str("body", transform=ascii_lower)}),
    [],
    lambda df: df.groupBy("bin").agg(F.count("*").alias("n_rows"), F.count_distinct("kind").alias("n_kinds"), F.sum(F.length("body")).alias("letters")),
)


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, or where it is unset (tests) a local one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="flatjet-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named}/{name}-{uuid.uuid4().hex}"


def _file_query(name: str, sql: str, read: Callable[[SparkSession, str, int], DataFrame], crlf: bool = False) -> None:
    """A query over files of JSON lines, which it writes from the events first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _scratch(spark, name)
        events = _table(spark, sf_dir, "events")
        line = F.concat(_event(), F.lit("\r")) if crlf else _event()
        events.select(line.alias("value")).write.text(path)
        return read(spark, path, events.count())

    run.__doc__ = f"{name}: files of JSON lines."
    QUERIES[name], SQL[name] = run, sql


def _streamed(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """All that lies in the folder, as a stream that ends when it is read."""
    out = _scratch(spark, "streamed")
    rows_of = stream_extract(stream_lines(spark, path), _lower_event, errors="err")
    query = rows_of.writeStream.format("parquet").option("checkpointLocation", _scratch(spark, "progress")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(rows_of.schema).parquet(out)


_rows = "SELECT user_id AS n, event_type AS s, CAST(0 AS SMALLINT) AS err FROM events"
_file_query("jsonl_scan", _rows, lambda spark, path, rows: extract(read_lines(spark, path), _lower_event, errors="err"))
_file_query("jsonl_crlf", _rows, lambda spark, path, rows: extract(read_lines(spark, path), _lower_event, errors="err"), crlf=True)
_file_query("jsonl_expected_count", _rows, lambda spark, path, rows: extract(read_lines(spark, path, expected_count=rows), _lower_event, errors="err"))
_file_query("jsonl_builtin", "SELECT user_id AS n, event_type AS s FROM events", lambda spark, path, rows: read_builtin(spark, path, ddl_of(_lower_event)))
_file_query("jsonl_stream", _rows, _streamed)


def _in_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in memory."""
    return extract(frame_of(spark, ['{"n":1,"s":"a"}', '{"n":2', '{"s":"é\\n"}']), _lower_event, errors="err")


def _structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a schema and their types."""
    df = extract(frame_of(spark, []), Dict({"a": Int("a", 16), "b": Dict({"x": Real("x", 32), "t": Datetime("t")}), "c": Bool("c"), "s": Str("s", 9)}))
    return spark.createDataFrame([(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)], "place long, name string, kind string")


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made-up lines of one kind, all of which can be read."""
    return error_count(with_expected_count(extract(generate(spark, "float", 1000, seed=1), Dict({"a": Real("a")}), errors="err"), 1000), "err")


QUERIES |= {"in_memory": _in_memory, "structure": _structure, "generated": _generated}
SQL |= {
    "in_memory": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(0 AS SMALLINT)), (2, '', 255), (0, 'é' || chr(10), 0)) AS t(n, s, err)",
    "structure": "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'a', 'int'), (1, 'x', 'float'), (2, 't', 'bigint'), (3, 'c', 'boolean'), (4, 's', 'string')) AS t(place, name, kind)",
    "generated": "SELECT CAST(1000 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_errors",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
