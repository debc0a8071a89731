"""Column functions, sources, sinks, streams, the command line, and the registered queries."""

import glob
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from flatjet import __main__ as cli
from flatjet import queries as engine
from flatjet.functions import ascii_lower, ascii_upper, category, char_count, cut, fold, poly_hash, poly_hash_of, tokens, truncate_bytes, wrap, wrap_digits
from flatjet.operators import extract
from flatjet.schema import Dict, Int, Real, Skip, Str
from flatjet.sources import csv_lines, frame_of, generate, read_builtin, read_lines, with_expected_count, write_csv, write_plain_csv
from flatjet.streaming import stream_extract, stream_lines


def plain_hash(text, lanes=32, multiplier=31, modulus=1_000_000_009):
    total = [0] * lanes
    for block in reversed(range((len(text) + lanes - 1) // lanes)):
        for lane in range(lanes):
            i = block * lanes + lane
            total[lane] = (total[lane] * multiplier + (ord(text[i]) - 31 if i < len(text) else 0)) % modulus
    return sum((lane + 1) * t for lane, t in enumerate(total)) % modulus


@pytest.mark.parametrize("lanes", [32, 8])
def test_poly_hash(spark, lanes):
    rng = random.Random(1)
    texts = ["", "Quartz", *["".join(chr(rng.randrange(32, 92)) for _ in range(rng.randrange(100))) for _ in range(40)]]
    got = [r[0] for r in frame_of(spark, texts).select(poly_hash(lanes=lanes)(F.col("value"))).collect()]
    assert got == [plain_hash(t, lanes) for t in texts] == [poly_hash_of(t, lanes=lanes) for t in texts]
    assert poly_hash_of("Quartz") == plain_hash("Quartz")


def test_hash_of_escapes(spark):
    rng = random.Random(2)
    texts = ["a\\nb", "\\\\n", "\\", "x\\\\\\\"y", *["".join(rng.choice('ab\\\\"n') for _ in range(rng.randrange(100))) for _ in range(40)]]
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    assert [r[0] for r in df.select(poly_hash()(F.col("value"))).collect()] == [poly_hash_of(t) for t in texts]
    assert [r[0] for r in df.limit(3).select(category({"a\\nb": 1, "\\\\n": 2}, by_hash=True)(F.col("value"))).collect()] == [1, 2, 0]


def test_categories(spark):
    codes = {"Quartz": 1, "QuarX": 2, "12": 3}
    df = frame_of(spark, ["Quartz", "12", "no", ""])
    for by_hash in (False, True):
        assert [r[0] for r in df.select(category(codes, by_hash)(F.col("value"))).collect()] == [1, 3, 0, 0]
    # Anagrams across lanes may collide: the code then follows the hash.
    assert poly_hash_of("b!") == plain_hash("b!")
    with pytest.raises(ValueError):
        category({"a": 0})


def test_strings(spark):
    df = frame_of(spark, ["aÉé Z\\n", "AAa"])
    got = df.select(ascii_upper(F.col("value")), ascii_lower(F.col("value")), char_count("A")(F.col("value")), truncate_bytes(F.col("value"), 2)).collect()
    assert [tuple(r)[:3] for r in got] == [("AÉé Z\\N", "aÉé z\\n", 0), ("AAA", "aaa", 2)] and got[1][3] == "AA"


def test_cut(spark):
    df = spark.createDataFrame([(float(x),) for x in (-5, 0, 3, 5, 7, 10, 11)], "x double")

    def labels(**options):
        return [r[0] for r in df.select(cut(**options)(F.col("x"))).collect()]

    assert labels(bins=[0, 5, 10], outside=-1) == [-1, -1, 5, 5, 10, 10, -1]
    assert labels(bins=[0, 5, 10], right=False, outside=-1) == [-1, 5, 5, 10, 10, -1, -1]
    assert labels(bins=[0, 5, 10], labels=["A", "B"], outside="X") == ["X", "X", "A", "A", "B", "B", "X"]
    assert str(labels(bins=[0.0, 10.0])) == str([float("nan")] * 2 + [10.0] * 4 + [float("nan")])
    for wrong in ({"bins": [1]}, {"bins": [2, 1], "outside": 0}, {"bins": [0, 1], "labels": ["a"]}):
        with pytest.raises(ValueError):
            cut(**wrong)


def test_wrap(spark):
    df = spark.createDataFrame([(x,) for x in (-(2**63), -129, -1, 0, 255, 2**63 - 1)], "x long")
    for bits in (8, 16, 32, 64):
        for signed in (False, True):
            got = [int(r[0]) for r in df.select(wrap(F.col("x"), bits, signed)).collect()]
            want = [(r[0] + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1) if signed else r[0] % (1 << bits) for r in df.collect()]
            assert got == want


def test_formats():
    assert tokens("%Y-%m-%d %H:%M:%S") == [("Y", 0, 4), ("m", 5, 2), ("d", 8, 2), ("H", 11, 2), ("M", 14, 2), ("S", 17, 2)]
    assert tokens("100%% %S") == [("S", 5, 2)]
    assert tokens((("d", 1), "/", ("m", 2))) == [("d", 0, 1), ("m", 2, 2)]
    for wrong in ("%Q", "%", "%Y%Y", (("Y", 0),), (("Q", 2),)):
        with pytest.raises(ValueError):
            tokens(wrong)


def test_sources(spark, tmp_path):
    (tmp_path / "lf.json").write_bytes(b'{"a":1}\n{"a":2}\n')
    (tmp_path / "crlf.json").write_bytes(b'{"a":1}\r\n{"a":2}\r\n')
    for name in ("lf", "crlf"):
        df = read_lines(spark, f"{tmp_path}/{name}.json", expected_count=2)
        assert sorted(r.a for r in extract(df, Dict({"a": Int("a")})).collect()) == [1, 2]
    with pytest.raises(ValueError):
        with_expected_count(df, 3)
    assert read_builtin(spark, f"{tmp_path}/lf.json").dtypes == [("a", "bigint")]
    assert read_builtin(spark, f"{tmp_path}/lf.json", "a int").dtypes == [("a", "int")]


def test_a_lone_cr_is_an_error(spark, tmp_path):
    (tmp_path / "cr.json").write_bytes(b'{"a":1}\r{"a":2}\r\n')
    with pytest.raises(Exception, match="carriage return"):
        read_lines(spark, f"{tmp_path}/cr.json").collect()
    assert read_lines(spark, f"{tmp_path}/cr.json", line_sep="\r").count() == 3


def test_fold_and_wide_integers(spark):
    df = spark.createDataFrame([("hello",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(fold(F.lit(0), lambda acc, ch: acc * 2 + F.when(ch == "l", 1).otherwise(0), lambda acc: acc + 1)(F.col("s"))).collect()]
    assert got == [7, 1, None]
    rng = random.Random(4)
    numbers = [0, 1, -1, 10**18, -(10**18), 2**63, -(2**63), 2**64] + [rng.choice((1, -1)) * rng.randrange(10 ** rng.randrange(1, 90)) for _ in range(60)]
    df = spark.createDataFrame([(str(x),) for x in numbers], "s string")
    for bits in (8, 16, 32, 64):
        for signed in (False, True):
            got = [int(r[0]) for r in df.select(wrap_digits(F.col("s"), bits, signed)).collect()]
            assert got == [(x + (1 << bits - 1)) % (1 << bits) - (1 << bits - 1) if signed else x % (1 << bits) for x in numbers]


def test_ddl(spark):
    from flatjet.plans.compiler import ddl_of
    from flatjet.schema import Array, Bool, Check

    schema = Dict({"a": Int("a"), "o": Dict({"x": Real("x"), "c": Check()}), "v": Array({0: Bool("b")}), "s": Str("s")})
    assert ddl_of(schema) == "`a` bigint, `o` struct<x:double>, `v` array<boolean>, `s` string"
    with pytest.raises(ValueError):
        ddl_of(Int("a"))


@pytest.mark.parametrize("kind", ["datetime", "datetime_as_string", "bool", "string", "nullable_string", "integer", "fixed", "float"])
def test_generator(spark, kind):
    from flatjet.schema import Bool, Datetime

    leaf = {"datetime": Datetime("a"), "bool": Bool("a"), "integer": Int("a"), "fixed": Real("a", exponent=False), "float": Real("a")}.get(kind, Str("a", null=""))
    df = generate(spark, kind, 50, seed=3)
    assert df.collect() == generate(spark, kind, 50, seed=3).collect()
    for mode in ("fast", "strict"):
        out = extract(df, Dict({"a": leaf}), engine=mode, errors="err")
        assert out.where("err <> 0").count() == 0 and out.count() == 50


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a,"b"', 0.1, True, None), (2, "", 1234567.0, False, 1e-7)], "i int, s string, x double, b boolean, y double")
    assert [r.value for r in csv_lines(df).collect()] == ['1,a,"b",0.1,true,', "2,,1.23457e+06,false,1e-07"]
    write_plain_csv(df.coalesce(1), f"{tmp_path}/plain")
    assert open(glob.glob(f"{tmp_path}/plain/part*")[0]).read() == '1,a,"b",0.1,true,\n2,,1.23457e+06,false,1e-07\n'
    write_csv(df, f"{tmp_path}/safe")
    back = spark.read.csv(f"{tmp_path}/safe", schema=df.schema, escape='"')
    assert sorted((r.i, r.s or "") for r in back.collect()) == [(1, 'a,"b"'), (2, "")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.json").write_text('{"a":1}\n{"a":-1}\n')
    rows = stream_extract(stream_lines(spark, f"{tmp_path}/in"), Dict({"a": Int("a")}), errors="err")
    query = rows.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r.err for r in spark.table("streamed").collect()) == [0, 255]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "x.json").write_text('{"a":1,"s":"longtext"}\n{"a":2,"s":"t"}\n')
    (tmp_path / "schema.py").write_text('from flatjet.schema import *\nSCHEMA = Dict({"a": Int("a"), "s": Str("s")})\n')
    cli.main([f"{tmp_path}/x.json", f"{tmp_path}/schema.py", "2", "-b", "-o", f"{tmp_path}/out", "--structure", "-s", "4"])
    said = capsys.readouterr().out
    assert "no errors" in said and "a: long" in said
    assert sorted(x for f in glob.glob(f"{tmp_path}/out/part*") for x in open(f).read().split()) == ["1,long", "2,t"]
    cli.main([f"{tmp_path}/x.json", f"{tmp_path}/schema.py", "--assumptions", "const", "-b"])
    assert "no errors" in capsys.readouterr().out
    assert cli.assumed(Dict({"a": Dict({"b": Int("b")})}), *cli.ASSUME["skip_1"]) == Dict({"a": Dict({"b": Int("b")}, skip=Skip(1))}, skip=Skip(1))


@pytest.mark.parametrize("name", sorted(engine.SQL))
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("events", "lineitem", "part", "documents"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    got = engine.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    clean = lambda rows: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({engine.SQL[name]})").fetchall()
    assert clean(map(tuple, got.select(*columns).collect())) == clean(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
