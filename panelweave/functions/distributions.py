"""Gamma and beta functions and the distributions built on them, as column expressions.

Spark has none of them.  Sums and fractions run to a number of terms that grows with the
root of the shape, so results hold to about 1e-12 for shapes up to some thousands.
Arguments outside the domain, and nulls, give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelweave.functions.normal import probit

# Coefficients of the published approximation of the gamma function by Lanczos (g = 7, nine terms).
LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
HALF_LOG_2PI = 0.9189385332046727
TINY = 1e-300


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with `value` computed once a row."""
    return F.transform(F.array(value), body)[0]


def _double(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(float(x))).cast("double")


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _terms(shape: Column) -> Column:
    return F.sequence(F.lit(1), F.least(F.ceil(F.sqrt(shape) * 10) + 60, F.lit(20_000)).cast("int"))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of a positive number."""
    z = _double(x) - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + F.lit(c) / (z + k)
    t = z + 7.5
    return F.when(_double(x) > 0, HALF_LOG_2PI + (z + 0.5) * F.log(t) - t + F.log(series))


def _gamma_parts(a: Column, x: Column) -> Column:
    """(lower, upper) regularised incomplete gamma function for a > 0, x > 0, each computed on its own side."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    series = F.aggregate(_terms(a), F.array(1 / a, 1 / a), lambda s, k: let(s[0] * x / (a + k), lambda t: F.array(t, s[1] + t)), lambda s: front * s[1])

    def more(s: Column, k: Column) -> Column:
        b, an = s[0] + 2, -k * (k - a)
        return let(1 / _away(an * s[2] + b), lambda d: let(_away(b + an / s[1]), lambda c: F.array(b, c, d, s[3] * c * d)))

    first = x + 1 - a
    fraction = F.aggregate(_terms(a), F.array(first, F.lit(1 / TINY), 1 / _away(first), 1 / _away(first)), more, lambda s: front * s[3])
    return F.when(x < a + 1, let(series, lambda p: F.array(p, 1 - p))).otherwise(let(fraction, lambda q: F.array(1 - q, q)))


def _gamma(a, x, side: int) -> Column:
    a, x = _double(a), _double(x)
    inside = let(F.struct(a.alias("a"), x.alias("x")), lambda v: _gamma_parts(v["a"], v["x"])[side])
    return F.when((a > 0) & (x == 0), F.lit(float(side))).when((a > 0) & (x > 0), F.when(x == F.lit(float("inf")), F.lit(1.0 - side)).otherwise(inside))


def gamma_lower(a, x) -> Column:
    """The share of the gamma integral of shape `a` below `x`."""
    return _gamma(a, x, 0)


def gamma_upper(a, x) -> Column:
    """The share above `x`, without the loss of one less the lower share."""
    return _gamma(a, x, 1)


def chi2_tail(x, k) -> Column:
    """P(chi-squared with `k` degrees of freedom > x)."""
    return F.when(_double(x) <= 0, F.when(_double(k) > 0, F.lit(1.0))).otherwise(gamma_upper(_double(k) / 2, _double(x) / 2))


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def more(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

        def step(c: Column, d: Column, h: Column, by: Column, then: Callable) -> Column:
            return let(1 / _away(1 + by * d), lambda d2: let(_away(1 + by / c), lambda c2: then(c2, d2, h * c2 * d2)))

        return step(s[0], s[1], s[2], even, lambda c, d, h: step(c, d, h, odd, lambda c2, d2, h2: F.array(c2, d2, h2)))

    first = 1 / _away(1 - (a + b) * x / (a + 1))
    return F.aggregate(_terms(F.greatest(a, b)), F.array(F.lit(1.0), first, first), more, lambda s: s[2])


def beta_share(a, b, x, rest=None) -> Column:
    """The share of the beta integral of shapes `a`, `b` below `x`; `rest` is 1 - x where that is known better."""
    a, b, x = _double(a), _double(b), _double(x)
    y = 1 - x if rest is None else _double(rest)

    def inside(v: Column) -> Column:
        a, b, x, y = v["a"], v["b"], v["x"], v["y"]
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(y))
        return F.when(x < (a + 1) / (a + b + 2), front * _beta_fraction(a, b, x) / a).otherwise(1 - front * _beta_fraction(b, a, y) / b)

    got = let(F.struct(a.alias("a"), b.alias("b"), x.alias("x"), y.alias("y")), inside)
    return F.when((a > 0) & (b > 0), F.when(x <= 0, F.when(x == 0, F.lit(0.0))).when(y <= 0, F.when(y == 0, F.lit(1.0))).otherwise(got))


def student_tail(t, nu) -> Column:
    """P(T > t) of Student's t for t >= 0, accurate far out."""
    t, nu = _double(t), _double(nu)
    return F.when(t >= 0, 0.5 * beta_share(nu / 2, F.lit(0.5), nu / (nu + t * t), t * t / (nu + t * t)))


def student_cdf(t, nu) -> Column:
    """The distribution function of Student's t with `nu` degrees of freedom."""
    t, nu = _double(t), _double(nu)
    tail = student_tail(F.abs(t), nu)
    return F.when(t > 0, 1 - tail).otherwise(tail)


def student_log_pdf(t, nu) -> Column:
    t, nu = _double(t), _double(nu)
    return F.when(nu > 0, log_gamma((nu + 1) / 2) - log_gamma(nu / 2) - 0.5 * F.log(nu * F.lit(3.141592653589793)) - (nu + 1) / 2 * F.log1p(t * t / nu))


def student_quantile(p, nu, rounds: int = 40) -> Column:
    """The quantile of Student's t: Newton steps on the logarithm of the tail, kept within a shrinking bracket."""
    p, nu = _double(p), _double(nu)

    def find(v: Column) -> Column:
        q, nu = v["q"], v["nu"]
        start = F.greatest(F.coalesce(F.abs(probit(q)), F.lit(0.0)), F.lit(1e-8))

        def step(s: Column, _: Column) -> Column:
            def move(tail: Column) -> Column:
                low = F.when(tail >= q, s[0]).otherwise(s[1])
                high = F.when(tail >= q, s[2]).otherwise(s[0])
                to = s[0] + tail * F.log(tail / q) / F.exp(student_log_pdf(s[0], nu))
                return let(F.array(low, high), lambda e: F.array(F.when((to > e[0]) & (to < e[1]), to).otherwise(F.when(e[1] < 1e299, (e[0] + e[1]) / 2).otherwise(2 * s[0] + 1)), e[0], e[1]))

            return F.when(s[3] == 1, s).otherwise(let(student_tail(s[0], nu), lambda tail: let(move(tail), lambda m: F.array(m[0], m[1], m[2], F.when(F.abs(m[0] - s[0]) <= 1e-15 * m[0], F.lit(1.0)).otherwise(F.lit(0.0))))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.array(start, F.lit(0.0), F.lit(1e300), F.lit(0.0)), step, lambda s: s[0])

    got = let(F.struct(F.least(p, 1 - p).alias("q"), nu.alias("nu")), find)
    return F.when((p > 0) & (p < 1) & (nu > 0), F.when(p == 0.5, F.lit(0.0)).otherwise(F.when(p < 0.5, -got).otherwise(got)))


def pareto_cdf(x, shape, scale) -> Column:
    """The generalised Pareto distribution function; shape 0 is the exponential one."""
    x, shape, scale = _double(x), _double(shape), _double(scale)
    u = x / scale
    base = 1 + shape * u
    body = F.when(F.abs(shape) < 1e-12, 1 - F.exp(-u)).otherwise(F.when(base > 0, -F.expm1(-F.log(base) / shape)).otherwise(F.lit(1.0)))
    return F.when(scale > 0, F.when(x <= 0, F.lit(0.0)).otherwise(body))


def kolmogorov_tail(d, n) -> Column:
    """P(sup distance >= d) of `n` draws from the right distribution, by the limiting series with Stephens' correction."""
    root = F.sqrt(_double(n))
    s = (root + 0.12 + 0.11 / root) * _double(d)
    tail = 2 * F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * k * k * s * s))
    return F.when(s < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


# The same functions in SQL, by Simpson's rule: another way to the same numbers.
NODES = 2000


def _simpson(upper: str, body: str, nodes: int = NODES) -> str:
    """The integral of `body` (over u) from 0 to `upper`."""
    h = f"(({upper}) / {nodes})"
    return f"({h} / 3 * list_sum(list_transform(range(0, {nodes + 1}), lambda i: (CASE WHEN i = 0 OR i = {nodes} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * (list_transform([{h} * i], lambda u: {body})[1]))))"


def chi2_tail_sql(x: str, k: str) -> str:
    """By u = sqrt(x / 2), for one degree of freedom or more."""
    return f"(CASE WHEN ({x}) <= 0 THEN 1.0 ELSE 1 - {_simpson(f'sqrt(({x}) / 2)', f'2 * exp((({k}) - 1) * ln(greatest(u, 1e-300)) - u * u - lgamma(({k}) / 2.0))')} END)"


def student_half_sql(angle: str, nu: str, nodes: int = NODES) -> str:
    """P(0 < T < tan(angle) sqrt(nu))."""
    return f"({_simpson(angle, f'pow(cos(u), ({nu}) - 1)', nodes)} * exp(lgamma((({nu}) + 1) / 2.0) - lgamma(({nu}) / 2.0)) / 1.7724538509055159)"


def student_cdf_sql(t: str, nu: str) -> str:
    return f"(0.5 + sign({t}) * {student_half_sql(f'atan(abs({t}) / sqrt({nu}))', nu)})"


def student_log_pdf_sql(t: str, nu: str) -> str:
    return f"(lgamma((({nu}) + 1) / 2.0) - lgamma(({nu}) / 2.0) - 0.5 * ln(({nu}) * 3.141592653589793) - (({nu}) + 1) / 2.0 * ln(1 + ({t}) * ({t}) / ({nu})))"


def student_quantile_sql(p: str, nu: str) -> str:
    """By halving the angle's interval fifty times."""
    half = student_half_sql("a + 1.5707963267948966 / pow(2, k)", nu, 200)
    return f"(sign(({p}) - 0.5) * sqrt({nu}) * tan(list_reduce(range(1, 51), lambda a, k: CASE WHEN {half} < abs(({p}) - 0.5) THEN a + 1.5707963267948966 / pow(2, k) ELSE a END, 0.0::DOUBLE)))"


def pareto_cdf_sql(x: str, shape: str, scale: str) -> str:
    return f"(CASE WHEN ({x}) <= 0 THEN 0.0 WHEN abs({shape}) < 1e-12 THEN 1 - exp(-({x}) / ({scale})) WHEN 1 + ({shape}) * ({x}) / ({scale}) > 0 THEN 1 - pow(1 + ({shape}) * ({x}) / ({scale}), -1 / ({shape})) ELSE 1.0 END)"
