"""Column expressions against Python's own text."""

import pytest
from pyspark.sql import functions as F

from runloom.functions.pytext import formatted, plain, quoted

DOUBLES = [0.0, 1.0, -1.5, 12345678.5, 1e-5, 1e-4, 1.25e-4, 0.001, 1e7, 1e15, 1.5e15, 1e16, 1.5e16,
           1e22, 1e100, 2.5e-7, 1e-10, 123456789012345.6, 9007199254740993.0, 0.1, 1 / 3, -2.5e-100,
           99999999.99, float("inf"), float("-inf")]
INTS = [0, 7, -7, 255, 1234567, -1234567]
TEXTS = ["", "abc", "it's", 'say "x"', "a\nb", "back\\slash", "both ' and \""]


def test_doubles_as_text(spark):
    df = spark.createDataFrame([(v,) for v in DOUBLES], "v double")
    assert [r[0] for r in df.select(plain(F.col("v"))).collect()] == [str(v) for v in DOUBLES]


def test_other_values_as_text(spark):
    df = spark.createDataFrame([(True, 5, "x")], "b boolean, i int, s string")
    assert list(df.select(*[plain(F.col(c)) for c in df.columns]).first()) == ["True", "5", "x"]


@pytest.mark.parametrize("spec", ["d", "5d", "05d", "+d", " d", ",", ",d", "x", "#x", "X", "o", "b",
                                  "8", "<8d", "^9d", "*>8d", "=+8d", ".2f", "10.1f", "+.0f"])
def test_integers(spark, spec):
    df = spark.createDataFrame([(v,) for v in INTS], "v int")
    got = [r[0] for r in df.select(formatted(F.col("v"), spec)).collect()]
    assert got == [format(v, spec) for v in INTS]


@pytest.mark.parametrize("spec", [".2f", "f", "08.3f", "+.1f", ",.2f", "e", ".3e", "E", "12", "<12",
                                  ".1%", "-^12.2f"])
def test_floats(spark, spec):
    values = [0.0, 1.5, -1.5, 2.675, 0.125, 12345.678, -0.0625, 1e-5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(formatted(F.col("v"), spec)).collect()]
    assert got == [format(v, spec) for v in values]


@pytest.mark.parametrize("spec", ["", "s", "8", "<8", ">8", "^8", "*^9s", ".2", "6.1s"])
def test_strings(spark, spec):
    df = spark.createDataFrame([(v,) for v in TEXTS], "v string")
    assert [r[0] for r in df.select(formatted(F.col("v"), spec)).collect()] == [
        format(v, spec) for v in TEXTS]


def test_quoted(spark):
    df = spark.createDataFrame([(v,) for v in TEXTS], "v string")
    assert [r[0] for r in df.select(quoted(F.col("v"))).collect()] == [repr(v) for v in TEXTS]


def test_unknown_specs_are_refused(spark):
    for spec in ("q", "5.5.5", "c"):
        with pytest.raises(NotImplementedError):
            formatted(F.lit(1), spec)
