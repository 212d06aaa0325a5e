import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.functions.canonical import CanonicalError, canonical_json, canonical_object, canonical_text, content_hash, integer, number_text, parse, quoted

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**53) + 1, 2**53 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), x, max_size=4), max_leaves=12)


@pytest.mark.parametrize(("x", "text"), [(1.0, "1"), (-0.0, "0"), (1e-7, "1e-7"), (1.2345678901234568e20, "123456789012345680000"), (1e21, "1e+21"), (0.000001, "0.000001"), (1.5, "1.5"), (123456.789, "123456.789"), (-2.5e-9, "-2.5e-9"), (5e-324, "5e-324"), (100, "100")])
def test_numbers(x, text):
    assert number_text(x) == text


def test_order_and_form():
    assert canonical_json({"b": [{"d": 2, "c": 1}], "a": -0.0}) == '{"a":0,"b":[{"c":1,"d":2}]}'
    assert canonical_json({"é": "\u0001\n", "\U00010000": 1, "\uffff": 2}) == '{"é":"\\u0001\\n","\U00010000":1,"\uffff":2}'


@pytest.mark.parametrize("bad", [math.nan, math.inf, 2**53, object(), {1: 2}, {"a": {1, 2}}, b"x"])
def test_rejected(bad):
    with pytest.raises(CanonicalError):
        canonical_json(bad)


def test_cycle():
    x = []
    x.append(x)
    with pytest.raises(CanonicalError):
        canonical_json(x)


@given(VALUES)
def test_round_trip(v):
    text = canonical_json(v)
    assert canonical_json(parse(text)) == text


def test_columns(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": "x"}', 3, 'q"\\'), ("nope", 4, "é"), (None, 5, "")], "j string, n int, s string")
    rows = df.select(canonical_text("j").alias("c"), canonical_object(n=integer(df.n), a=quoted(df.s)).alias("o")).collect()
    assert [r.c for r in rows] == ['{"a":"x","b":1}', None, None]
    assert [r.o for r in rows] == [canonical_json({"n": n, "a": s}) for n, s in ((3, 'q"\\'), (4, "é"), (5, ""))]
    assert len(content_hash({"a": 1})) == 64
