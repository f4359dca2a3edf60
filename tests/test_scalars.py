import math

import pytest
from pyspark.sql import functions as F

from riskfold.functions import scalars


def values(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_normalize_id(spark):
    raw = [("007",), (" 12 ",), ("000",), ("A01",), ("\t0123456789012345678901\n",), (None,), ("",)]
    got = values(spark, raw, "x string", scalars.normalize_id(F.col("x")))
    assert got == ["7", "12", "0", "A01", "123456789012345678901", None, ""]


def test_format_subject_id_drops_third_character_and_never_truncates(spark):
    raw = [("12345",), ("1",), ("A1",), ("123456789",)]
    got = values(spark, raw, "x string", scalars.format_subject_id(F.col("x")))
    assert got == ["00-2345", "00-0001", "00-00A1", "12-456789"]


def test_at_least_treats_nan_and_null_as_no(spark):
    nan = float("nan")
    raw = [(0.5, 0.5), (0.4, 0.5), (nan, 0.5), (None, 0.5), (0.5, nan), (0.5, None), (float("inf"), 0.5)]
    got = values(spark, raw, "p double, t double", scalars.at_least(F.col("p"), F.col("t")))
    assert got == [True, False, False, False, False, False, True]


def test_finite(spark):
    raw = [(1.0,), (float("nan"),), (float("-inf"),), (None,)]
    assert values(spark, raw, "x double", scalars.is_finite(F.col("x"))) == [True, False, False, False]


def test_clip_keeps_missing_values(spark):
    raw = [(0.0,), (1.0,), (0.3,), (None,), (float("nan"),)]
    got = values(spark, raw, "x double", scalars.clip_probability(F.col("x"), 0.1))
    assert got[:4] == [0.1, 0.9, 0.3, None] and math.isnan(got[4])
    assert values(spark, raw, "x double", scalars.clip_probability(F.col("x"), 0))[:2] == [0.0, 1.0]


@pytest.mark.parametrize(
    "kind, rows, want",
    [
        ("double", [0.0, 1.0, 2.0, 0.5, -0.5, None, float("nan"), float("inf")],
         [False, False, True, False, False, True, True, True]),
        ("string", ["0", "1", "2", "0.5", "1.0", " 1 ", "+1", "x", None],
         [False, False, True, True, True, False, False, True, True]),
        ("int", [0, 1, 7, None], [False, False, True, True]),
    ],
)
def test_unlabelled_by_label_type(spark, kind, rows, want):
    df = spark.createDataFrame([(r,) for r in rows], f"y {kind}")
    assert [r[0] for r in df.select(scalars.is_unlabelled(df, "y")).collect()] == want
    assert df.select(scalars.is_unlabelled(df, "absent")).distinct().collect()[0][0]


def test_feature_names(spark):
    raw = [("num__ANCA EU",), ("cat__num__x",), ("num__cat__y  EU",), ("EU",)]
    assert values(spark, raw, "x string", scalars.strip_feature_name(F.col("x"))) == [
        "ANCA", "num__x", "y ", "EU",
    ]
    assert values(spark, raw, "x string", scalars.clean_feature_name(F.col("x"))) == [
        "ANCA", "cat__num__x", "cat__y", "EU",
    ]
    assert values(spark, [("p_lab",)], "x string", scalars.meta_feature_name(F.col("x"))) == ["Lab"]


def test_coerce_numeric(spark):
    raw = [(" 1.5 ",), ("x",), (None,), ("",), ("1e3",)]
    assert values(spark, raw, "x string", scalars.coerce_numeric(F.col("x"))) == [1.5, None, None, None, 1000.0]
