import pytest
from pyspark.sql import functions as F

from cladeflow.functions.numbers import round_to, scale_factor
from cladeflow.functions.text import cigar_lengths, demultiplex, feature_count, strip_suffix


def column(spark, values, kind, *made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", *[m.alias(f"m{k}") for k, m in enumerate(made)])
    out = [tuple(r)[1:] for r in rows.orderBy("i").collect()]
    return [r[0] for r in out] if len(made) == 1 else out


def test_tolerant_rounding(spark):
    values = [1.49999999999, 1.5, 0.5, 2.5, 2.50000000001, 2.50001, 1.4999, -0.5, 3.0]
    assert column(spark, values, "double", round_to(F.col("x"))) == [2, 2, 0, 2, 2, 3, 1, 0, 3]


def test_rounding_to_digits(spark):
    assert column(spark, [1.05, 1.049, 1.0, 1.149999999999], "double", round_to(F.col("x"), 1)) == [1.1, 1.0, 1.0, round(1.149999999999, 1)]
    assert column(spark, [4.235, 1.74499999, 2.675, 0.225, None], "double", round_to(F.col("x"), 2)) == [4.24, 1.74, 2.67, 0.23, None]


@pytest.mark.parametrize(("text", "want"), [("1", 1), ("100", 100), ("1k", 1000), ("2K", 2000), ("1M", 10**6), ("1.5k", 1500.0), ("0.1", 0.1), ("k", 1000)])
def test_scale_factor(text, want):
    assert scale_factor(text) == want


def test_bad_scale_factor():
    with pytest.raises(ValueError):
        scale_factor("xyz")


def test_demultiplex(spark):
    ids = ["S1_R1", "S1_R_2", "S1", "S1_", "_R1", "", "S1-R1"]
    assert column(spark, ids, "string", *demultiplex(F.col("x"))) == [("S1", "R1"), ("S1", "R_2"), ("", "S1"), ("", "S1"), ("", "R1"), ("", ""), ("", "S1-R1")]


def test_strip_suffix(spark):
    assert column(spark, ["NC_123456.1_300", "x", "a_b_", "G1_9"], "string", strip_suffix(F.col("x"))) == ["NC_123456.1", "x", "a_b", "G1"]
    assert column(spark, ["a||b||c", "a|b"], "string", strip_suffix(F.col("x"), "||")) == ["a||b", "a|b"]


def test_cigar(spark):
    assert column(spark, ["50M5I20M5D20M", "150M", "*", "10S5=3X2N4M", "5H"], "string", *cigar_lengths(F.col("x"))) == [(90, 95), (150, 150), (0, 0), (12, 14), (0, 0)]


def test_feature_count(spark):
    assert column(spark, ["x:3", "x", "a:b:12", "x:0", "x:y", "x:"], "string", *feature_count(F.col("x"))) == [("x", 3), ("x", 1), ("a:b", 12), ("x:0", 1), ("x:y", 1), ("x:", 1)]
