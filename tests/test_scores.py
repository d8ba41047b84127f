import math

import pytest
from conftest import rows
from pyspark.sql import functions as F
from scipy_free import binomial_tail

from riskweave.functions import scores
from riskweave.functions.text import binary_label, duration_seconds, memory_mebibytes, metric_name


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_wilson_interval(spark):
    lo, hi = one(spark, *scores.wilson_bounds(F.lit(63), F.lit(75)))
    assert round(lo, 4) == 0.7408 and round(hi, 4) == 0.9060
    lo, hi = one(spark, *scores.wilson_bounds(F.lit(10), F.lit(10)))
    assert hi == pytest.approx(1.0) and hi <= 1.0 and lo < 1
    assert tuple(one(spark, *scores.wilson_bounds(F.lit(0), F.lit(0)))) == (None, None)


def test_fisher_four_of_six_against_none(spark):
    p = one(spark, scores.fisher_one_sided(F.lit(4), F.lit(6), F.lit(0), F.lit(6)))[0]
    assert math.isclose(p, 15 / 495, rel_tol=1e-9)


@pytest.mark.parametrize("a,na,b,nb", [(0, 5, 0, 5), (3, 3, 9, 40), (20, 60, 10, 80), (0, 3, 4, 4)])
def test_fisher_against_exact_counts(spark, a, na, b, nb):
    p = one(spark, scores.fisher_one_sided(F.lit(a), F.lit(na), F.lit(b), F.lit(nb)))[0]
    assert math.isclose(p, binomial_tail(a, na, b, nb), rel_tol=1e-9)


@pytest.mark.parametrize("n", [0, 1, 5, 32, 33, 1000, 10**7])
def test_log_factorial(spark, n):
    got = one(spark, scores.log_factorial(F.lit(n)))[0]
    assert math.isclose(got, math.lgamma(n + 1), rel_tol=1e-12, abs_tol=1e-12)


def test_decisions_and_lanes(spark):
    df = spark.createDataFrame([(x,) for x in (0.1, 0.4, 0.5, 0.6, 0.9)], "p double")
    got = rows(df.select("p", scores.decide(F.col("p"), 0.7).alias("d")))
    assert [d for _, d in got] == ["legit", "review", "review", "review", "fraud"]
    got = rows(df.select("p", scores.decide(F.col("p"), 0.0).alias("d")))
    assert [d for _, d in got] == ["legit", "legit", "fraud", "fraud", "fraud"]
    got = rows(df.select("p", scores.decide_split(F.col("p"), 0.6, 0.1).alias("d")))
    assert [d for _, d in got] == ["legit", "review", "review", "fraud", "fraud"]


def test_logit_is_finite_at_the_ends(spark):
    lo, hi, mid = one(
        spark, scores.logit(F.lit(0.0)), scores.logit(F.lit(1.0)), scores.logit(F.lit(0.5))
    )
    assert -28 < lo < -27 and 27 < hi < 28 and mid == 0


@pytest.mark.parametrize(
    "x,text",
    [(0.5, "50.0%"), (0.0, "0.0%"), (1.0, "100.0%"), (0.0004, "0.04%"), (0.99999, "99.999%")],
)
def test_percent_text_hides_no_remainder(spark, x, text):
    assert one(spark, scores.percent_text(F.lit(x)))[0] == text


def test_display_name_drops_one_prefix(spark):
    got = one(spark, *[scores.display_name(F.lit(n)) for n in ("num__a__b", "cat__x", "plain")])
    assert tuple(got) == ("a__b", "x", "plain")


def test_units(spark):
    got = one(spark, *[duration_seconds(F.lit(t)) for t in ("2m30s", "45s", "3m", "", "1h", "5")])
    assert tuple(got) == (150, 45, 180, None, None, None)
    got = one(spark, *[memory_mebibytes(F.lit(t)) for t in ("512Mi", "2Gi", "2048Ki", "9", "1M")])
    assert tuple(got) == (512.0, 2048.0, 2.0, None, None)


def test_labels(spark):
    texts = [" Fraud ", "TRUE", "yes", "1", "0", "legit", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows(df.select("i", binary_label(F.col("t"), "string").alias("y")))
    assert [y for _, y in got] == [1, 1, 1, 1, 0, 0, 0]
    assert one(spark, binary_label(F.lit(2.0), "double"), binary_label(F.lit(0), "int"))[:] == (1, 0)


def test_metric_names(spark):
    assert one(spark, metric_name(F.lit("a b/c.d-e_f:g|h")))[0] == "a b/c.d-e_f_g_h"
