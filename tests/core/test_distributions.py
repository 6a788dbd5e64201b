"""Special functions against published values and against sums and integrals in plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from panelweave.functions import distributions as ds


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def simpson(f, a, b, n=20000):
    h = (b - a) / n
    return h / 3 * math.fsum((1 if i in (0, n) else 4 if i % 2 else 2) * f(a + i * h) for i in range(n + 1))


def t_cdf(t, nu):
    c = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(math.pi)
    return 0.5 + math.copysign(c * simpson(lambda u: math.cos(u) ** (nu - 1), 0, math.atan(abs(t) / math.sqrt(nu))), t)


def test_log_gamma(spark):
    xs = [0.01, 0.5, 1.0, 1.5, 2.0, 7.3, 100.0, 1234.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", ds.log_gamma(F.col("x")).alias("v")).collect()
    assert all(abs(r.v - math.lgamma(r.x)) <= 1e-12 * max(1, abs(math.lgamma(r.x))) for r in got)
    assert one(spark, ds.log_gamma(F.lit(-1.0))) is None


def test_chi_square_tail(spark):
    # Published upper 5 % and 1 % points, to the digits that are printed.
    points = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (16.918977604620448, 9, 0.05), (21.665994333461924, 9, 0.01), (18.307038053275146, 10, 0.05), (124.34211340400407, 100, 0.05)]
    exact = [(x, 2 * k, math.fsum(math.exp(j * math.log(x / 2) - x / 2 - math.lgamma(j + 1)) for j in range(k))) for x in (0.1, 3.0, 40.0, 700.0) for k in (1, 2, 5, 30, 300)]
    df = spark.createDataFrame([(float(x), float(k), p) for x, k, p in points + exact], "x double, k double, p double")
    for r in df.withColumn("v", ds.chi2_tail(F.col("x"), F.col("k"))).collect():
        assert abs(r.v - r.p) <= 1e-10 * max(r.p, 1e-3), r
    assert one(spark, ds.chi2_tail(F.lit(0.0), F.lit(3))) == 1.0 and one(spark, ds.chi2_tail(F.lit(None).cast("double"), F.lit(3))) is None
    assert one(spark, ds.gamma_lower(F.lit(2.0), F.lit(0.0))) == 0.0 and one(spark, ds.gamma_lower(F.lit(-1.0), F.lit(1.0))) is None


@pytest.mark.parametrize("nu", [2.1, 3.0, 4.5, 10.0, 60.0])
def test_student(spark, nu):
    ts = [-40.0, -3.2, -1.0, -0.01, 0.0, 0.3, 2.0, 7.5]
    df = spark.createDataFrame([(t,) for t in ts], "t double").select("t", ds.student_cdf(F.col("t"), F.lit(nu)).alias("c"), ds.student_log_pdf(F.col("t"), F.lit(nu)).alias("l"))
    for r in df.collect():
        assert abs(r.c - t_cdf(r.t, nu)) < 1e-10
        want = math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - (nu + 1) / 2 * math.log1p(r.t**2 / nu)
        assert abs(r.l - want) < 1e-11
    ps = [1e-6, 0.001, 0.01, 0.05, 0.3, 0.499, 0.5, 0.62, 0.95, 0.9999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").withColumn("q", ds.student_quantile(F.col("p"), F.lit(nu)))
    for r in df.withColumn("back", ds.student_cdf(F.col("q"), F.lit(nu))).collect():
        assert abs(r.back - r.p) < 1e-12 and abs(r.back - r.p) < 1e-10 * min(r.p, 1 - r.p) + 1e-15, r


def test_student_closed_forms_and_printed_points(spark):
    for p in (0.6, 0.9, 0.975, 0.9995):
        a = 4 * p * (1 - p)
        c = math.cos(math.acos(math.sqrt(a)) / 3) / math.sqrt(a)
        for nu, q in ((1, math.tan(math.pi * (p - 0.5))), (2, (2 * p - 1) / math.sqrt(a / 2)), (4, 2 * math.sqrt(c - 1))):
            assert abs(one(spark, ds.student_quantile(F.lit(p), F.lit(nu))) - q) < 1e-10 * q
    # Quantiles of Student's t as tables print them.
    for p, nu, q in [(0.975, 1, 12.706), (0.975, 2, 4.303), (0.95, 5, 2.015), (0.99, 30, 2.457), (0.995, 10, 3.169)]:
        assert abs(one(spark, ds.student_quantile(F.lit(p), F.lit(nu))) - q) < 6e-4
    assert one(spark, ds.student_quantile(F.lit(0.0), F.lit(3))) is None and one(spark, ds.student_cdf(F.lit(None).cast("double"), F.lit(3))) is None


def test_beta_share(spark):
    for a, b, x in [(2, 3, 0.4), (1, 1, 0.7), (5, 2, 0.99), (30, 40, 0.5)]:
        n = a + b - 1
        want = math.fsum(math.comb(n, j) * x**j * (1 - x) ** (n - j) for j in range(a, n + 1))
        assert abs(one(spark, ds.beta_share(F.lit(a), F.lit(b), F.lit(x))) - want) < 1e-12
    assert [one(spark, ds.beta_share(F.lit(2), F.lit(2), F.lit(x))) for x in (0.0, 1.0)] == [0.0, 1.0] and one(spark, ds.beta_share(F.lit(2), F.lit(2), F.lit(1.5))) is None


def test_pareto_and_kolmogorov(spark):
    for x, k, s, want in [(1.0, 0.0, 2.0, 1 - math.exp(-0.5)), (3.0, 0.25, 1.0, 1 - 1.75**-4), (1.0, -0.5, 1.0, 0.75), (5.0, -0.5, 1.0, 1.0), (-1.0, 0.2, 1.0, 0.0)]:
        assert abs(one(spark, ds.pareto_cdf(F.lit(x), F.lit(k), F.lit(s))) - want) < 1e-12
    assert one(spark, ds.pareto_cdf(F.lit(1.0), F.lit(0.1), F.lit(0.0))) is None
    assert abs(one(spark, ds.kolmogorov_tail(F.lit(1.3580986 / 1e4), F.lit(1e8))) - 0.05) < 1e-4
