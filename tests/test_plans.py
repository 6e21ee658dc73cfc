import random

import pytest

from keelson.operators.ranges import Bound, RangeError, integer_ranges, jdbc_predicates
from keelson.plans import default_values, defaults, types
from keelson.plans.model import ColumnPlan, Kind, RunReport, SourceColumn, Status, TableReport, VerificationReport, Verified, from_dict, to_json
from keelson.plans.names import literal, mapped_name, stable_name
from keelson.plans.safe_expression import is_safe, to_spark


def ranges(low, high, span, **kw):
    return list(integer_ranges(Bound(low, **kw), Bound(high, **kw), span))


def test_ranges_cover_without_gaps():
    for low in range(-4, 5):
        for high in range(low, 6):
            for span in range(1, 12):
                got = ranges(low, high, span)
                assert [x for a, b in got for x in range(a, b + 1)] == list(range(low, high + 1))
                assert all(b - a < span for a, b in got)


def test_range_edges():
    assert ranges(2**64 - 3, 2**64 - 1, 2, unsigned=True) == [(2**64 - 3, 2**64 - 2), (2**64 - 1, 2**64 - 1)]
    assert ranges(-(2**63), 2**63 - 1, 2**64) == [(-(2**63), 2**63 - 1)]
    assert list(integer_ranges(None, None, 5)) == []
    for args, code in [((Bound(1), Bound(2), 0), "zero_span"), ((Bound(1), None, 1), "incomplete_bounds"), ((Bound(1), Bound(2, True), 1), "mixed_signedness"), ((Bound(3), Bound(2), 1), "reversed_bounds")]:
        with pytest.raises(RangeError) as e:
            integer_ranges(*args)
        assert e.value.code == code
    assert jdbc_predicates("a`b", iter([(1, 2)])) == ["`a``b` >= 1 AND `a``b` <= 2"]


@pytest.mark.parametrize("a,b", [("int4", "integer"), ("numeric(20)", "numeric(20,0)"), ("character varying(5)", "varchar(5)"), ("timestamp(3) with time zone", "timestamptz(3)"), ("timestamp without time zone", "timestamp"), ("int8[]", "bigint[]"), ('"s"."T"', '"s"."T"'), ("BOOL", "boolean"), ("bpchar(2)", "char(2)")])
def test_same_types(a, b):
    assert types.same_type(a, b)


@pytest.mark.parametrize("name", ["", "int(3)", "numeric(0)", "varchar(0)", "timestamp(7)", "foo", "timestamptz with time zone", "numeric(2,3)", "text(3", 'a"b'])
def test_unknown_types(name):
    assert types.normalise(name) is None and not types.same_type(name, name)


def test_default_mapping():
    col = lambda kind, full=None, **more: types.default_type(SourceColumn("c", 1, kind, full or kind, **more))
    assert col("bigint", "bigint unsigned")[:2] == ("numeric(20,0)", Kind.UNSIGNED)
    assert col("int", "int unsigned")[0] == "bigint"
    assert col("decimal", numeric_precision=65, numeric_scale=30)[0] == "numeric(65,30)"
    assert col("decimal", numeric_precision=66, numeric_scale=0) is None
    assert col("bit", "bit(12)") == ("bit(12)", Kind.BIT, 12)
    assert col("bit", "bit(65)") is None and col("varchar") is None and col("odd") is None
    assert col("timestamp", datetime_precision=3)[0] == "timestamptz(3)"
    assert types.chosen_kind("timestamp(3) with time zone") == (Kind.TIMESTAMP, None)
    assert types.chosen_kind("uuid") is None and types.chosen_kind("bit(3)") == (Kind.BIT, 3)


def test_labels():
    assert types.parse_labels(r"enum('', 'a,b','quote''s','back\\s','tab\t')") == ["", "a,b", "quote's", "back\\s", "tab\t"]
    for bad in ("enum", "enum(a)", "enum('a'", "enum('a','a')", "enum('a' 'b')", r"enum('\0')", "enum()"):
        with pytest.raises(ValueError):
            types.parse_labels(bad)


def test_names():
    assert [mapped_name(x, "snake_case", x) for x in ("CamelCase", "HTTPServer", "a1B", "ABC")] == ["camel_case", "http_server", "a1_b", "abc"]
    long = "é" * 40
    made = stable_name(long, "id")
    assert len(made.encode()) <= 63 and made.startswith("é" * 27 + "_") and stable_name("x" * 63, "id") == "x" * 63
    assert literal("a'b\\c") == "'a''b\\\\c'"


def plan(kind, target, **more):
    return ColumnPlan("c", "c", more.pop("source", "x"), target, kind, **more)


@pytest.mark.parametrize("value,p,kind,sql", [
    ("7", plan(Kind.SIGNED, "integer"), "int", "7"), ("2.50", plan(Kind.DECIMAL, "numeric(5,2)"), "decimal", "2.50"), ("it's", plan(Kind.TEXT, "text"), "text", "E'it''s'"),
    ("b'101'", plan(Kind.BIT, "bit(4)", bits=4), "bit", "B'0101'"), ("2024-01-02 03:04:05", plan(Kind.DATETIME, "timestamp(0) without time zone"), "datetime", "E'2024-01-02 03:04:05.000000'"),
    ("current_timestamp(3)", plan(Kind.DATETIME, "timestamp(3)"), "datetime", "CURRENT_TIMESTAMP(3)"), ("a,c", plan(Kind.SET, "text[]", set_labels=["a", "b", "c"]), "set", "E'{\"a\",\"c\"}'"),
    ("0x0102", plan(Kind.BINARY, "bytea"), "varbinary", "E'\\\\x0102'"), ("1", plan(Kind.BOOLEAN, "boolean"), "tinyint", "true"),
])
def test_defaults(value, p, kind, sql):
    assert defaults.default_sql(SourceColumn("c", 1, kind, kind, default=value), p) == sql


@pytest.mark.parametrize("value,p,kind", [("0000-00-00", plan(Kind.DATE, "date"), "date"), ("-1", plan(Kind.UNSIGNED, "integer"), "int"), ("2.505", plan(Kind.DECIMAL, "numeric(5,2)"), "decimal"), ("uuid()", plan(Kind.TEXT, "text"), "text"), ("x", plan(Kind.SET, "text[]", set_labels=["a"]), "set"), ("{", plan(Kind.JSON, "jsonb"), "json")])
def test_refused_defaults(value, p, kind):
    with pytest.raises(defaults.DefaultError):
        defaults.default_sql(SourceColumn("c", 1, kind, kind, default=value, default_is_expression="(" in value), p)


@pytest.mark.parametrize("a,b,p,verdict", [
    ("E'{\"a\":1.0,\"b\":[2]}'", "'{\"b\": [2.00], \"a\": 10e-1}'::jsonb", plan(Kind.JSON, "jsonb"), "equal"), ("1.50", "1.5", plan(Kind.DECIMAL, "numeric(5,2)"), "equal"), ("E'a'", "'a'::text", plan(Kind.TEXT, "text"), "equal"),
    ("E'a'", "'b'::text", plan(Kind.TEXT, "text"), "different"), (None, "1", plan(Kind.SIGNED, "integer"), "different"), (None, None, plan(Kind.TEXT, "text"), "equal"), ("7", "nextval('s')", plan(Kind.SIGNED, "integer"), "unsupported"), ("0.0", "-0.0", plan(Kind.FLOAT, "double precision"), "different"),
])
def test_same_default(a, b, p, verdict):
    assert default_values.same_default(a, b, p) == verdict


@pytest.mark.parametrize("a,b,p,verdict", [
    ("B'0101'", "'0101'::\"bit\"", plan(Kind.BIT, "bit(4)", bits=4), "equal"), ("B'0101'", "X'5'", plan(Kind.BIT, "bit(4)", bits=4), "equal"), ("E'\\\\x0102'", "'\\x0102'::bytea", plan(Kind.BINARY, "bytea"), "equal"),
    ("E'\\\\x4142'", "'AB'::bytea", plan(Kind.BINARY, "bytea"), "equal"), ("E'\\\\x00ff'", "'\\000\\377'::bytea", plan(Kind.BINARY, "bytea"), "equal"), ("E'\\\\x00'", "'\\400'::bytea", plan(Kind.BINARY, "bytea"), "unsupported"),
    ("E'{\"a\",\"c\"}'", "'{a,c}'::text[]", plan(Kind.SET, "text[]", set_labels=["a", "c"]), "equal"), ("E'{\"a\",\"c\"}'", "ARRAY['a'::text, 'c'::text]", plan(Kind.SET, "text[]", set_labels=["a", "c"]), "equal"),
    ("E'{\"a\"}'", "'{c}'::text[]", plan(Kind.SET, "text[]", set_labels=["a", "c"]), "different"), ("E'{\"a\"}'", "'{x}'::text[]", plan(Kind.SET, "text[]", set_labels=["a"]), "unsupported"), ("E'{\"a\"}'", "'{a,}'::text[]", plan(Kind.SET, "text[]", set_labels=["a"]), "unsupported"),
    ("E'01:30:00.000000'", "'@ 1 hour 30 mins'::interval", plan(Kind.INTERVAL, "interval(6)"), "equal"), ("E'-01:30:00.000000'", "'@ 1 hour 30 mins ago'::interval", plan(Kind.INTERVAL, "interval(6)"), "equal"),
    ("E'01:30:00.500000'", "'PT1H30M0.5S'::interval", plan(Kind.INTERVAL, "interval(6)"), "equal"), ("E'01:30:00.000000'", "'PT30M1H'::interval", plan(Kind.INTERVAL, "interval(6)"), "unsupported"), ("E'01:00:00.000000'", "'1 day'::interval", plan(Kind.INTERVAL, "interval(6)"), "unsupported"),
    ("E'2024-01-02 03:04:05.000000+00'", "'2024-01-02 05:04:05+02'::timestamp with time zone", plan(Kind.TIMESTAMP, "timestamptz(0)"), "equal"), ("E'2024-01-02'", "'2024-01-03'::date", plan(Kind.DATE, "date"), "different"),
    ("CURRENT_TIMESTAMP(3)", "CURRENT_TIMESTAMP(3)", plan(Kind.DATETIME, "timestamp(3) without time zone"), "equal"), ("CURRENT_TIMESTAMP", "now()", plan(Kind.TIMESTAMP, "timestamptz"), "equal"), ("CURRENT_TIMESTAMP(0)", "now()", plan(Kind.TIMESTAMP, "timestamptz"), "different"),
    ("E'10.0.0.1'", "'10.0.0.1/32'::inet", plan(Kind.TEXT, "inet"), "equal"), ("E'10.0.0.1'", "'10.0.0.1/8'::inet", plan(Kind.TEXT, "inet"), "different"), ("7", "('7'::text)::integer", plan(Kind.SIGNED, "integer"), "equal"), ("7", "7 + 0", plan(Kind.SIGNED, "integer"), "unsupported"),
    ("true", "'t'::boolean", plan(Kind.BOOLEAN, "boolean"), "equal"), ("E'a'", "'a'::\"app\".\"e\"", plan(Kind.ENUM, '"app"."e"', enum_labels=["a"]), "equal"), ("E'a'", "'a'::\"app\".\"f\"", plan(Kind.ENUM, '"app"."e"', enum_labels=["a"]), "unsupported"),
    ("E'it''s'", "'it''s'::character varying", plan(Kind.TEXT, "varchar(9)"), "equal"), ("E'a\\\\b'", "'a\\b'::text", plan(Kind.TEXT, "text"), "equal"), ("1.5", "1.50::double precision", plan(Kind.FLOAT, "double precision"), "equal"), ("1.5", "'Infinity'::double precision", plan(Kind.FLOAT, "double precision"), "unsupported"),
    ("E'a'", "('a'::text) || 'b'", plan(Kind.TEXT, "text"), "unsupported"), ("E'x'", "NULL::text", plan(Kind.TEXT, "text"), "different"),
])
def test_same_value_however_it_is_written(a, b, p, verdict):
    assert default_values.same_default(a, b, p) == verdict


def report(**more):
    t = TableReport("t", "s", "a", "b", Status.COMPLETE, rows_read=2, committed_rows=2)
    r = RunReport("r", "frozen", "full", VerificationReport("content", Verified.COMPLETE, 1), Status.COMPLETE, tables=[t])
    for k, v in more.items():
        setattr(t if hasattr(t, k) and k != "status" else r, k, v)
    return r


def test_exit_codes():
    assert report().exit_code() == 0
    assert report(rejected_rows=1, committed_rows=1).exit_code() == 3
    assert report(verification=VerificationReport("content", Verified.DIFFERENT, 1)).exit_code() == 4
    assert report(status=Status.CANCELLED, verification=VerificationReport("content", Verified.DIFFERENT, 1)).exit_code() == 130
    assert report(status=Status.CANCELLED, failed_steps=["x"]).exit_code() == 1
    assert report(committed_rows=1).exit_code() == 1
    assert report(indeterminate_rows=1, committed_rows=1).exit_code() == 1
    assert report(verification=VerificationReport("none")).exit_code() == 0


def test_report_round_trip():
    import json

    r = report()
    assert from_dict(RunReport, json.loads(to_json(r))) == r
    with pytest.raises(ValueError):
        from_dict(RunReport, json.loads(to_json(r)) | {"extra": 1})


def test_safe_expressions():
    for good in ("a > 0", "(a >= 0 AND b IS NOT NULL) OR NOT c", "\"A b\" = 'it''s'", "x::integer <> -1.5", "a IS TRUE", "t.a < t.b"):
        assert is_safe(good), good
    for bad in ("f(a)", "a > 0; b", "a >", "SELECT 1", "a = 'x", "a::regclass = 1", "", "(" * 200 + "a" + ")" * 200, "a b"):
        assert not is_safe(bad), bad
    assert to_spark('"A`b"::integer > 0') == "`A``b`::int > 0"


def test_random_ranges_match_bounds():
    r = random.Random(1)
    for _ in range(200):
        low = r.randint(-(2**63), 2**63 - 1)
        high = min(2**63 - 1, low + r.randint(0, 10**6))
        got = ranges(low, high, r.randint(10**4, 10**7))
        assert got[0][0] == low and got[-1][1] == high and all(b + 1 == c for (_, b), (c, _) in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("check,found", [
    ("\"flags\" <@ ARRAY[E'a', E'b']::text[]", ("flags", frozenset("ab"))), ("CHECK ((flags <@ ARRAY['b'::text, 'a'::text]))", ("flags", frozenset("ab"))), ("((\"F g\")::text[] <@ '{a,\"c,d\"}'::text[])", ("F g", frozenset(["a", "c,d"]))),
    ("flags <@ ARRAY[x]", None), ("flags @> ARRAY['a']", None), ("f(flags) <@ ARRAY['a']", None), ("flags <@ ARRAY['a'] AND true", None), ("a > 0", None),
])
def test_membership_checks(check, found):
    assert default_values.membership(check) == found
    if found:
        from keelson.plans.model import CheckExpectation

        want = CheckExpectation("c", "other words", found[0], sorted(found[1], reverse=True))
        assert default_values.same_check(want, check) and not default_values.same_check(CheckExpectation("c", check, found[0], ["z"]), check)
