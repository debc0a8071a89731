"""The extraction engine: dialect, both engines against each other, nulls, limits."""

import json
import math
import random
from decimal import Decimal

import pytest

from flatjet.functions import cut, min_max
from flatjet.operators import all_good, check_errors, error_count, extract, number_columns
from flatjet.plans.strict import RowParser
from flatjet.schema import Array, Bool, Check, Datetime, Dict, Int, Real, Skip, Str
from flatjet.sources import frame_of


def run(spark, lines, schema, engine="auto", **options):
    df = extract(frame_of(spark, lines), schema, engine=engine, errors="err", **options)
    return [tuple(r) for r in df.collect()]


ONE = Dict({"a": Int("a", 32)})

#: (line, schema, values, error) that both engines give.
BOTH = [
    ('{"a":1}', ONE, (1,), 0),
    ("{}", ONE, (0,), 0),
    ('{"b":2}', ONE, (0,), 0),
    ('{"a":null}', ONE, (0,), 255),
    ('{"a":null}', Dict({"a": Int("a", null=7)}), (7,), 0),
    ("{}", Dict({"a": Int("a", null=7)}), (0,), 0),
    ('{"a":4294967297}', ONE, (1,), 0),
    ('{"a":300}', Dict({"a": Int("a", 8)}), (44,), 0),
    ('{"a":-129}', Dict({"a": Int("a", 8, signed=True)}), (127,), 0),
    ('{"a":18446744073709551617}', Dict({"a": Int("a", 64)}), (Decimal(1),), 0),
    ('{"a":-5}', Dict({"a": Int("a", 64, signed=True)}), (-5,), 0),
    ('{"a":01}', ONE, (0,), 255),
    ('{"a":1.5}', ONE, (0,), 255),
    ('{"a":1} trailing', ONE, (1,), 0),
    ('{"a":"x"}', ONE, (0,), 255),
    ("", ONE, (0,), 255),
    ('{"a":1,"a":2}', ONE, (2,), 0),
    ('{"A":1}', ONE, (0,), 0),
    ('{"s":"x\\\\ny"}', Dict({"s": Str("s")}), ("x\\ny",), 0),
    ('{"s":"x\\ny"}', Dict({"s": Str("s")}), ("x\ny",), 0),
    ('{"s":null}', Dict({"s": Str("s", null="none")}), ("none",), 0),
    ('{"s":"abcdef"}', Dict({"s": Str("s", 4)}), ("abcd",), 0),
    ('{"s":"true"}', Dict({"s": Bool("s")}), (False,), 255),
    ('{"s":true}', Dict({"s": Bool("s")}), (True,), 0),
    ('{"x":1e400}', Dict({"x": Real("x")}), (math.inf,), 0),
    ('{"x":1e39}', Dict({"x": Real("x", 32)}), (math.inf,), 0),
    ('{"x":0.1234567899}', Dict({"x": Real("x", nine_digits=True)}), (0.123456789,), 0),
    ('{"t":"1970-01-02 00:00:01"}', Dict({"t": Datetime("t")}), (86401,), 0),
    ('{"t":"2000.02.29"}', Dict({"t": Datetime("t", "%Y-%m-%d", "ms")}), (951782400000,), 0),
    ('{"o":{"p":{"q":3}}}', Dict({"o": Dict({"p": Dict({"q": Int("q")})})}), (3,), 0),
    ('{"o":{"p":null}}', Dict({"o": Dict({"p": Int("p", null=9)})}), (9,), 0),
    ('{"v":[1,"x",{"k":2},[5,6]]}', Dict({"v": Array({0: Int("a"), 2: Dict({"k": Int("k")}), 3: Array({1: Int("d")})})}), (1, 2, 6), 0),
    ('{"v":[]}', Dict({"v": Array({0: Int("a")})}), (0,), 0),
    ('{"v":[1,2,3]}', Dict({"v": Array({0: Int("a"), 1: Int("b")}, skip=None)}), (1, 2), 255),
    ('{"b":1,"a":2}', Dict({"a": Int("a"), "b": Int("b")}, "const", None), (2, 1), 255),
    ('{"a":2,"b":1}', Dict({"a": Int("a"), "b": Int("b")}, "const", None), (2, 1), 0),
    ("{}", Dict({"a": Int("a")}, "const", None), (0,), 255),
    ('{"a":1,"z":0}', Dict({"a": Int("a")}, skip=None), (1,), 255),
]

#: Only the row-level engine keeps these values or sees these errors.
STRICT = [
    (' {"a":1}', ONE, (0,), 255),
    ('{"a":1,}', ONE, (1,), 255),
    ('{"a":-1}', ONE, (0,), 255),
    ('{"a":5,"s":"x', Dict({"a": Int("a"), "s": Str("s")}), (5, ""), 255),
    ('{"s":"\\u0041"}', Dict({"s": Str("s")}), ("",), 255),
    ('{"s":"a\tb"}', Dict({"s": Str("s")}), ("",), 255),
    ('{"s":"x\\ny"}', Dict({"s": Str("s", raw=True)}), ("x\\ny",), 0),
    ('{"s":5}', Dict({"s": Str("s")}), ("",), 255),
    ('{"a":1,"z":' + "[" * 8 + "]" * 8 + "}", ONE, (1,), 0),
    ('{"a":1,"z":' + "[" * 9 + "]" * 9 + "}", ONE, (1,), 255),
    ('{"z":"s","a":1}', Dict({"a": Int("a")}, skip=Skip(kinds=("number",))), (0,), 255),
    ('{"z":nope,"a":1}', ONE, (0,), 255),
    ('{"v":[1', Dict({"v": Array({0: Int("a")})}), (1,), 255),
    ('{"x":1e5}', Dict({"x": Real("x", exponent=False)}), (0.0,), 255),
    ('{"x":-1.0}', Dict({"x": Real("x", signed=False)}), (0.0,), 255),
    ('{"t":"1970-0x-02 00:00:01"}', Dict({"t": Datetime("t")}), (0,), 255),
    ('{"a":' + "9" * 45 + "}", ONE, (int("9" * 45) % 2**32,), 0),
    ("[3,4]", Array({1: Int("a")}), (4,), 0),
    ("7 ", Int("a"), (7,), 0),
    ('{"s":"ok"}', Dict({"s": Check()}), (), 0),
    ('{"s":1}', Dict({"s": Check()}), (), 255),
    ('[1,{"a":[]}]', Skip(), (), 0),
    ('[1,{"a":[}]', Skip(), (), 255),
]


#: Further lines on which the engines must agree.
DEEP = Dict({"o": Dict({"p": Int("p"), "v": Array({0: Int("a"), 1: Dict({"q": Str("q")})})}), "z": Int("z", null=5)})
MORE = [
    (line, DEEP, None, 255)
    for line in (
        '{"z":1,"o":{"p":2,"v":[3,{"q":"x"},nope',
        '{"o":{"p":2,"v":[3,{"q":"x","r":[[1,{"a":"]}"}]],"bad" 1}]}}',
        '{"o":{"p":2,"v":[3,{"q":5}]},"z":1}',
        '{"o":{"w":{"a":[1,"}{",{}]},"p":7,"v":[3 4]}}',
        '{"z":null,"o":{"p":1}',
        '{"z":1 "o":{"p":1}}',
        '{,"z":1}',
        '{"z":1,,"o":{}}',
        '{"z":1,"o":[1]}',
        '{"z":1,"o":{"p":1,}}',
        '{"o":{"v":[1,{"q":"a\\x"}]}}',
        "{",
        "nope",
        '{"o":{"v":{}}}',
    )
] + [
    ('{"o":{"v":[1,{"q":"a\\n\\"b"},{"x":1}],"p":3},"z":null}', DEEP, None, 0),
    ('{ "o" : { "p" : 12345678901234567890123 , "v" : [ 99999999999999999999 ] } , "z" : 3 }', DEEP, None, 0),
    ('{"a":-' + "7" * 60 + "}", Dict({"a": Int("a", 64, signed=True)}), None, 0),
    ('{"a":' + "7" * 60 + "}", Dict({"a": Int("a", 64)}), None, 0),
    ('{"a":-9223372036854775808}', Dict({"a": Int("a", 64, signed=True)}), None, 0),
    ('{"a":9223372036854775808}', Dict({"a": Int("a", 64, signed=True)}), None, 0),
    ('{"a":-0}', Dict({"a": Int("a", 64, signed=True)}), None, 0),
    ('{"v":[1,"x",{},3]}', Dict({"v": Array({0: Int("a"), 3: Int("b")})}), None, 0),
    ('{"v":[1,2,"x"]}', Dict({"v": Array({0: Int("a"), 1: Int("b")})}), None, 0),
    ('{"v":[1,null]}', Dict({"v": Array({0: Int("a"), 1: Int("b")})}), None, 255),
    ('{"v":[null,2]}', Dict({"v": Array({0: Int("a", null=4), 1: Int("b")})}), None, 0),
    ('{"v":[{"k":1},7]}', Dict({"v": Array({0: Dict({"k": Int("k")})})}), None, 0),
    ('{"v":[{"k":1},{"k":2}]}', Dict({"v": Array({0: Dict({"k": Int("k")})})}), None, 0),
    ('{"s":{"z":1}}', Dict({"s": Str("s")}), None, 255),
    ('{"s":"a\u0001b"}', Dict({"s": Str("s")}), None, 255),
    ('{"t":"+020-01-01"}', Dict({"t": Datetime("t", "%Y-%m-%d")}), None, 255),
    ('{"t":"2020-01- 1"}', Dict({"t": Datetime("t", "%Y-%m-%d")}), None, 255),
    ('{"t":"2020-01-01T"}', Dict({"t": Datetime("t", "%Y-%m-%d")}), None, 0),
    ('{"t":"20/1/02"}', Dict({"t": Datetime("t", (("Y", 2), "/", ("m", 1), "/", ("d", 2)))}), None, 0),
    ('{"x":-1.5E+2}', Dict({"x": Real("x")}), None, 0),
    ('{"x":.5}', Dict({"x": Real("x")}), None, 255),
    ('{"x":1.}', Dict({"x": Real("x")}), None, 255),
    ('{"b":truex}', Dict({"b": Bool("b")}), None, 255),
    ('{"o":{"a":1,"b":2}}', Dict({"o": Dict({"a": Int("a")}, skip=None)}), None, 255),
    ('{"o":{"b":2,"a":1}}', Dict({"o": Dict({"a": Int("a"), "b": Int("b")}, "const", None)}), None, 255),
    ('{"o":{"a":1,"b":2}}', Dict({"o": Dict({"a": Int("a"), "b": Int("b")}, "const", None)}), None, 0),
    ('{"s":"ok","z":[1,{"a":true}]}', Dict({"s": Check(), "z": Skip()}), None, 0),
    ('{"s":"ok","z":[1,{"a":tru}]}', Dict({"s": Check(), "z": Skip()}), None, 255),
    ('{"we ird.$[k]":1,"é":2}', Dict({"we ird.$[k]": Int("a"), "é": Int("b")}), None, 0),
    ("{}", Dict({}), None, 0),
    ('{"a":1}', Dict({}, skip=None), None, 255),
]


@pytest.mark.parametrize(("line", "schema", "values", "error"), BOTH + STRICT)
def test_row_level(line, schema, values, error):
    found, good = RowParser(schema).parse(line.encode())
    assert (0 if good else 255) == error


@pytest.mark.parametrize("engine", ["fast", "strict"])
def test_dialect_in_both(spark, engine):
    for line, schema, values, error in BOTH:
        (row,) = run(spark, [line], schema, engine)
        if error == 0:
            assert row == (*values, error), (line, row)
        else:
            assert row[-1] == error, (line, row)


def test_engines_agree_on_the_whole_dialect(spark):
    for line, schema, _, error in BOTH + STRICT + MORE:
        (auto,), (strict,) = (run(spark, [line], schema, engine) for engine in ("auto", "strict"))
        assert auto == strict and auto[-1] == error, (line, auto, strict)


def test_dialect_of_the_row_level_engine(spark):
    for line, schema, values, error in STRICT:
        assert run(spark, [line], schema, "strict") == [(*values, error)], line


def random_line(rng):
    value = {
        "n": rng.choice([rng.randrange(2**33), 0, 255]),
        "m": rng.randrange(-(2**20), 2**20),
        "s": "".join(rng.choice('abcXYZ é"\\/\n\t') for _ in range(rng.randrange(12))),
        "x": round(rng.uniform(-1e6, 1e6), 4),
        "b": rng.random() < 0.5,
        "o": {"in": rng.randrange(100), "skip": [1, {"z": None}]},
        "v": [rng.randrange(10), {"w": "t"}, rng.random()][: rng.randrange(4)],
        "none": None if rng.random() < 0.3 else rng.randrange(5),
        "other": {"deep": [[1], "x", None]},
    }
    keys = list(value)
    rng.shuffle(keys)
    return json.dumps({k: value[k] for k in keys if rng.random() < 0.9}, ensure_ascii=False)


def test_engines_agree_on_good_lines(spark):
    schema = Dict(
        {
            "n": Int("n", 16),
            "m": Int("m", 8, signed=True),
            "s": Str("s", 7),
            "x": Real("x"),
            "b": Bool("b"),
            "o": Dict({"in": Int("in", transform=lambda c: c * 2)}),
            "v": Array({0: Int("v0"), 1: Dict({"w": Str("w")})}),
            "none": Int("none", null=99),
        }
    )
    rng = random.Random(5)
    lines = [random_line(rng) for _ in range(400)]
    fast, strict = (run(spark, lines, schema, e) for e in ("fast", "strict"))
    assert fast == strict and all(r[-1] == 0 for r in fast)


def test_nested_skip_and_raw_strings(spark):
    schema = Dict({"o": Dict({"a": Int("a")}, skip=None)})
    for engine in ("auto", "fast", "strict"):
        assert run(spark, ['{"o":{"a":1,"b":2}}', '{"o":{"a":1}}'], schema, engine) == [(1, 255), (1, 0)]
    with pytest.raises(ValueError, match="row-level"):
        extract(frame_of(spark, ["{}"]), Dict({"s": Str("s", raw=True)}), engine="fast")


def test_engines_agree_on_broken_lines(spark):
    rng = random.Random(6)
    schema = Dict({"n": Int("n", 16), "s": Str("s", 7), "x": Real("x"), "o": Dict({"in": Int("in")}), "v": Array({0: Int("v0"), 1: Dict({"w": Str("w")})}), "none": Int("none", null=99)})
    lines = []
    for _ in range(500):
        line = random_line(rng)
        at = rng.randrange(len(line) + 1)
        lines.append(rng.choice([line[:at], line[:at] + rng.choice('{}[],:"\\ x1\u0007') + line[at:], line[:at] + line[at + 1 :]]))
    fast, strict = (run(spark, lines, schema, e) for e in ("fast", "strict"))
    for line, a, b in zip(lines, fast, strict, strict=True):
        assert a == b, (line, a, b)


def test_very_long_lines(spark):
    long = {"a": 7, "s": "x\n" * 200_000, "z": [[i, {"k": "v" * 9}] for i in range(30_000)]}
    schema = Dict({"a": Int("a"), "s": Str("s", 5)})
    lines = [json.dumps(long), json.dumps(long)[:-1], json.dumps(long).replace("29999", "29999x")]
    assert run(spark, lines, schema, "fast") == run(spark, lines, schema, "strict") == [(7, "x\nx\nx", 0), (7, "x\nx\nx", 255), (7, "x\nx\nx", 255)]


def test_trusted_lines(spark):
    schema = Dict({"a": Int("a", 8), "o": Dict({"s": Str("s", null="n")})})
    df = extract(frame_of(spark, ['{"a":300,"o":{"s":null}}', '{"o":{"s":"t"}}']), schema, trusted=True)
    assert [tuple(r) for r in df.collect()] == [(44, "n"), (0, "t")] and "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        extract(frame_of(spark, ["{}"]), schema, errors="e", trusted=True)


def test_transforms_and_kept_columns(spark):
    df = spark.createDataFrame([('{"x": 5}', 1), ('{"x": 50}', 2), ("{}", 3), (None, 4)], "line string, x int")
    schema = Dict({"x": Real("scaled", transform=min_max(0, 10)), "y": Int("label", null="none", transform=cut([0, 3, 9], ["low", "high"], outside="out"))})
    got = extract(df, schema, "line", keep=["x"], errors="err").collect()
    assert [(r.x, r.scaled, r.label, r.err) for r in got] == [(1, 0.5, "", 0), (2, 1.0, "", 0), (3, 0.0, "", 0), (4, 0.0, "", 255)]


def test_error_helpers(spark):
    df = extract(frame_of(spark, ['{"a":1}', "x"]), ONE, errors="err")
    assert tuple(error_count(df, "err").first()) == (2, 1) and not all_good(df, "err")
    with pytest.raises(ValueError):
        check_errors(df, "err")
    assert number_columns(df).columns == ["Column 1", "Column 2"]


def test_schema_checks():
    from flatjet.schema import validate

    with pytest.raises(ValueError):
        validate(Dict({"a": Int("x"), "b": Int("x")}))
    with pytest.raises(ValueError):
        Int("a", 12)
    with pytest.raises(ValueError):
        Array({0: Int("a"), 2: Int("b")}, skip=None)


def test_only_named_fields_are_parsed(spark):
    df = extract(frame_of(spark, ["{}"]), Dict({"a": Int("a"), "o": Dict({"p": Str("p")})}))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(a,LongType" in plan and "Python" not in plan and plan.count("StructField(") <= 8
    assert plan.count("from_json") <= 2
