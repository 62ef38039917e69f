import math

import pytest
from pyspark.sql import functions as F

from genoweave.functions import stats as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("x", "g", "d", "n"), [(0, 3, 4, 10), (2, 3, 4, 10), (4, 3, 4, 10), (30, 80, 120, 400), (1, 0, 4, 10), (5, 8, 8, 10)])
def test_tail_is_exact(spark, x, g, d, n):
    true = sum(math.comb(g, i) * math.comb(n - g, d - i) for i in range(max(x, 0, d - n + g), min(g, d) + 1)) / math.comb(n, d)
    args = [F.lit(v).cast("long") for v in (x, g, d, n)]
    assert one(spark, S.hypergeometric_tail(*args)) == pytest.approx(true, rel=1e-10, abs=1e-15)


def test_score_gates(spark):
    p = [F.lit(v) for v in (0.001, 0.5, 0.4, 0.3)]
    assert one(spark, S.interaction_score(*p)) == pytest.approx(-math.log10(0.001 / 0.3), rel=1e-6)
    assert one(spark, S.interaction_score(F.lit(0.06), *p[1:])) == 0
    assert one(spark, S.interaction_score(p[0], F.lit(0.01), *p[2:])) == 0


def test_chi2_short_circuits(spark):
    c = lambda *v: one(spark, S.chi2_stat(*[F.lit(float(x)) for x in v]))
    assert c(10, 20, 30, 40) == pytest.approx(100 * (400 - 600) ** 2 / (30 * 70 * 40 * 60))
    assert c(0, 20, 30, 40) is None
    assert c(5, -1, 3, 4) is None
    assert c(5, 0, 3, 0) is None


def test_infinite_score_and_normal_tail(spark):
    assert one(spark, S.minus_log10(F.lit(0.0))) == math.inf
    rows = spark.createDataFrame([(0.0,), (8.0,), (None,)], "z double").select(S.normal_tail("z").alias("p")).collect()
    assert [r["p"] for r in rows] == [0.5, pytest.approx(6.22e-16, rel=1e-2), 1.0]
