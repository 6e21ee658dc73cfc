import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from keelson.functions.convert import convert
from keelson.functions.encode import array_text, field, row_text
from keelson.functions.json_check import valid
from keelson.plans.model import ColumnPlan, Kind

K = Kind


def plan(kind, target, source="x", **more):
    return ColumnPlan("c", "c", source, target, kind, **more)


def run(spark, values, dtype, p):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {dtype}")
    made = convert(F.col("c"), p, dict(rows.dtypes)["c"])
    out = rows.select("i", made.value.alias("v"), made.problem.alias("p"), made.changed.alias("ch")).orderBy("i").collect()
    return [(r.v, r.p, r.ch) for r in out]


CASES = [
    ("bigint edges", K.SIGNED, "bigint", {}, "string", ["-9223372036854775808", "9223372036854775807", "9223372036854775808", "5\n", "+7", "x"], [(-(2**63), None), (2**63 - 1, None), (None, "range"), (None, "format"), (7, None), (None, "format")]),
    ("unsigned by source text", K.SIGNED, "integer", {"source": "int unsigned"}, "bigint", [-1, 5], [(None, "range"), (5, None)]),
    ("unsigned 64", K.UNSIGNED, "numeric(20,0)", {}, "string", ["18446744073709551615"], [(2**64 - 1, None)]),
    ("digits as bytes", K.SIGNED, "integer", {}, "binary", [b"12", b"1x"], [(12, None), (None, "format")]),
    ("year", K.UNSIGNED, "smallint", {"source": "year"}, "int", [0, 1900, 1901, 2155, 2156], [(0, None), (None, "range"), (1901, None), (2155, None), (None, "range")]),
    ("wide decimal", K.DECIMAL, "numeric(65,30)", {}, "string", ["+" + "9" * 35 + "." + "9" * 30, "1." + "0" * 31, "000.10"], [("9" * 35 + "." + "9" * 30, None), (None, "range"), ("0.1", None)]),
    ("decimal grammar", K.DECIMAL, "numeric(5,2)", {}, "string", [".5", "5.", "1e3", "1.230", "-0.10", "1234.5"], [(None, "format"), (None, "format"), (None, "format"), (None, "range"), ("-0.10", None), (None, "range")]),
    ("real", K.FLOAT, "real", {}, "double", [0.5, 0.1, float("nan"), float("inf")], [(0.5, None), (None, "range"), (None, "range"), (None, "range")]),
    ("whole number to double", K.FLOAT, "double precision", {}, "bigint", [2**53, 2**53 + 1], [(float(2**53), None), (None, "range")]),
    ("date", K.DATE, "date", {}, "string", ["2024-02-29", "2023-02-29", "2024-2-3", "0000-00-00", "2024-01-01 00:00:01", "2024-01-01 00:00:00"], [(dt.date(2024, 2, 29), None), (None, "field_overflow"), (None, "datetime"), (None, "field_overflow"), (None, "datetime"), (dt.date(2024, 1, 1), None)]),
    ("fraction", K.DATETIME, "timestamp(3) without time zone", {}, "string", ["2024-01-01 01:02:03.120", "2024-01-01 01:02:03.1234", "2024-01-01 01:02:03.1234567"], [(dt.datetime(2024, 1, 1, 1, 2, 3, 120000), None), (None, "field_overflow"), (None, "datetime")]),
    ("zero to null", K.DATE, "date", {"transform": "zero-dates-to-null"}, "string", ["2024-00-10", "0000-00-00", "2024-01-10"], [(None, None), (None, None), (dt.date(2024, 1, 10), None)]),
    ("zero to null, required", K.DATE, "date", {"transform": "zero-dates-to-null", "nullable": False}, "string", ["0000-00-00"], [(None, "not_null")]),
    ("zero to epoch", K.DATE, "date", {"transform": "zero-dates-to-epoch"}, "string", ["0000-00-00", "2024-00-10"], [(dt.date(1970, 1, 1), None), (None, "field_overflow")]),
    ("interval", K.INTERVAL, "interval(6)", {}, "string", ["-838:59:58.999999", "48:01:02.123456", "839:00:00"], [(-dt.timedelta(hours=838, minutes=59, seconds=58, microseconds=999999), None), (dt.timedelta(hours=48, minutes=1, seconds=2, microseconds=123456), None), (None, "field_overflow")]),
    ("time of day", K.INTERVAL, "time(0)", {}, "string", ["23:59:59", "24:00:00", "-01:00:00"], [(dt.timedelta(hours=23, minutes=59, seconds=59), None), (None, "field_overflow"), (None, "field_overflow")]),
    ("boolean", K.BOOLEAN, "boolean", {}, "int", [0, 1, 2], [(False, None), (True, None), (None, "range")]),
    ("bits", K.BIT, "bit(64)", {"bits": 64}, "binary", [b"\xff" * 8, b"\x01", b"\x00" * 9], [("1" * 64, None), ("0" * 63 + "1", None), (None, "range")]),
    ("latin text", K.TEXT, "varchar(3)", {"charset": "latin1"}, "binary", [b"\x80\x81\xe9", b"abcd"], [("€\x81é", None), (None, "length")]),
    ("utf8", K.TEXT, "text", {}, "binary", [b"\xff", "é".encode(), b"", b"a\0b"], [(None, "charset"), ("é", None), ("", None), (None, "charset")]),
    ("utf8mb3", K.TEXT, "text", {"charset": "utf8mb3"}, "string", ["😀", "é"], [(None, "charset"), ("é", None)]),
    ("right trim", K.TEXT, "text", {"transform": "right-trim"}, "string", ["a  \t", " b"], [("a", None), (" b", None)]),
    ("NUL out", K.TEXT, "text", {"transform": "remove-null-characters"}, "string", ["a\0b"], [("ab", None)]),
    ("hex", K.BINARY, "bytea", {"transform": "hex-to-bytea"}, "string", ["0xAbcd", "\\x00", "", "abc", "zz"], [(b"\xab\xcd", None), (b"\0", None), (b"", None), (None, "format"), (None, "format")]),
    ("enum", K.ENUM, "enum", {"enum_labels": ["", "a,b"]}, "int", [1, 2, 0, 3], [("", None), ("a,b", None), (None, "range"), (None, "range")]),
    ("set of 64", K.SET, "text[]", {"set_labels": [f"l{i}" for i in range(64)]}, "decimal(20,0)", [Decimal(2**63 + 1), Decimal(0)], [(["l0", "l63"], None), ([], None)]),
    ("set beyond", K.SET, "text[]", {"set_labels": ["a", "b"]}, "int", [3, 4], [(["a", "b"], None), (None, "range")]),
    ("ip", K.TEXT, "inet", {"transform": "int-to-ip"}, "bigint", [2**32 - 1, 2**32], [("255.255.255.255", None), (None, "range")]),
    ("json", K.JSON, "jsonb", {}, "string", ['{"a": 1, "a": 2}', "null", "{", "NaN", '"\\u0000"', '"\\ud800"', "1" * 200000], [('{"a": 1, "a": 2}', None), ("null", None), (None, "format"), (None, "format"), (None, "format"), (None, "format"), (None, "format")]),
    ("geometry", K.GEOMETRY, "geometry", {}, "string", ["SRID=0;POINT(1 2)", "POINT(1 2)"], [("SRID=0;POINT(1 2)", None), (None, "format")]),
]


@pytest.mark.parametrize("case", CASES, ids=lambda c: c[0])
def test_values(spark, case):
    _, kind, target, more, dtype, values, expected = case
    p = plan(kind, target, **more)
    got = [(v if not hasattr(v, "as_tuple") else (str(v) if kind == K.DECIMAL else int(v)), x) for v, x, _ in run(spark, values, dtype, p)]
    assert [(bytes(v) if isinstance(v, bytearray) else v, x) for v, x in got] == expected


def test_null_is_kept_or_a_problem(spark):
    assert run(spark, [None], "string", plan(K.TEXT, "text")) == [(None, None, False)]
    assert run(spark, [None], "string", plan(K.TEXT, "text", nullable=False)) == [(None, "not_null", False)]


def test_changed_counters(spark):
    flags = lambda values, dtype, p: [c for _, _, c in run(spark, values, dtype, p)]
    assert flags([0, 1, 2], "int", plan(K.BOOLEAN, "boolean", transform="tinyint-to-boolean")) == [False, False, True]
    assert flags(["", "a", None], "string", plan(K.TEXT, "text", transform="empty-string-to-null")) == [True, False, False]
    assert flags(["0000-00-00", "2024-00-01"], "string", plan(K.DATE, "date", transform="zero-dates-to-epoch")) == [True, False]
    with pytest.raises(ValueError):
        run(spark, [1], "int", plan(K.SIGNED, "integer", transform="other"))


def test_copy_text_against_an_independent_encoder(spark):
    import random

    r = random.Random(7)
    rows = [(i, None if r.random() < 0.25 else "".join(r.choice("ab\\\t\n\r\b\f\v é") for _ in range(r.randint(0, 12)))) for i in range(300)]
    names = {"\\": "\\\\", "\t": "\\t", "\n": "\\n", "\r": "\\r", "\b": "\\b", "\f": "\\f", "\v": "\\v"}
    shown = lambda s: "\\N" if s is None else "".join(names.get(c, c) for c in s)
    df = spark.createDataFrame(rows, "i int, s string").select("i", row_text([F.col("i").cast("string"), F.col("s")]).alias("line"))
    assert {r.i: r.line for r in df.collect()} == {i: f"{i}\t{shown(s)}\n" for i, s in rows}


def test_field_forms(spark):
    row = spark.range(1).select(
        field(F.lit(bytearray(b"\x01\xff")), K.BINARY).alias("b"), array_text(F.array(F.lit('a"b'), F.lit("c\\d"))).alias("a"), field(F.lit(True), K.BOOLEAN).alias("t"),
        field(F.lit(dt.timedelta(hours=-100, seconds=-1)), K.INTERVAL).alias("i"),
    ).first()
    assert tuple(row) == ("\\x01ff", '{"a\\"b","c\\\\d"}', "t", "-100:00:01.000000")


@pytest.mark.parametrize("text,ok", [("1e131071", True), ("1e131072", False), ("1e-16383", True), ("1e-16384", False), ("0e999999999999", True), ("[" * 127 + "]" * 127, True), ("[" * 128 + "]" * 128, False), ("01", False), ("1 2", False), (" [] ", True), ("﻿1", False), ('{"a":{"a":1,"a":"\\u0000"}}', False), ("Infinity", False)])
def test_json(text, ok):
    assert valid(text) is ok
