"""Normal distribution as column expressions (Spark has no erf)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximations AS241 (PPND16)
# for the quantile and Hart's (double precision, after West) for the distribution.
A = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
B = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
FF = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]
P = [220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688, 0.0352624965998911]
Q = [440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207, 1.75566716318264, 0.0883883476483184]


def _poly(coef, x, lit):
    out = lit(coef[-1])
    for c in reversed(coef[:-1]):
        out = out * x + lit(c)
    return out


def _poly_sql(coef, x: str) -> str:
    out = f"CAST({coef[-1]!r} AS DOUBLE)"
    for c in reversed(coef[:-1]):
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def probit(p: Column) -> Column:
    """The standard normal quantile, about 1e-15; null outside (0, 1)."""
    q = p - 0.5
    r = F.lit(0.180625) - q * q
    mid = q * _poly(A, r, F.lit) / _poly(B, r, F.lit)
    s = F.sqrt(-F.log(F.least(p, 1 - p)))
    near = _poly(C, s - 1.6, F.lit) / _poly(D, s - 1.6, F.lit)
    far = _poly(E, s - 5.0, F.lit) / _poly(FF, s - 5.0, F.lit)
    tail = F.signum(q) * F.when(s <= 5, near).otherwise(far)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, mid).otherwise(tail))


def probit_sql(p: str) -> str:
    """The same expression as SQL text over column `p`."""
    q, s = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1 - {p})))"
    r = f"(0.180625 - {q} * {q})"
    mid = f"{q} * {_poly_sql(A, r)} / {_poly_sql(B, r)}"
    near = f"{_poly_sql(C, f'({s} - 1.6)')} / {_poly_sql(D, f'({s} - 1.6)')}"
    far = f"{_poly_sql(E, f'({s} - 5.0)')} / {_poly_sql(FF, f'({s} - 5.0)')}"
    return f"CASE WHEN {p} > 0 AND {p} < 1 THEN CASE WHEN abs({q}) <= 0.425 THEN {mid} ELSE sign({q}) * CASE WHEN {s} <= 5 THEN {near} ELSE {far} END END END"


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function, about 1e-15."""
    z = F.abs(x)
    low = F.exp(-z * z / 2) * _poly(P, z, F.lit) / _poly(Q, z, F.lit)
    b = z + 0.65
    for k in (4, 3, 2, 1):
        b = z + F.lit(float(k)) / b
    high = F.exp(-z * z / 2) / b / 2.506628274631
    tail = F.when(z > 37, F.lit(0.0)).when(z < 7.07106781186547, low).otherwise(high)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_cdf_sql(x: str) -> str:
    z = f"abs({x})"
    low = f"exp(-{z} * {z} / 2) * {_poly_sql(P, z)} / {_poly_sql(Q, z)}"
    b = f"({z} + 0.65)"
    for k in (4, 3, 2, 1):
        b = f"({z} + {k}.0 / {b})"
    high = f"exp(-{z} * {z} / 2) / {b} / 2.506628274631"
    tail = f"(CASE WHEN {z} > 37 THEN 0.0 WHEN {z} < 7.07106781186547 THEN {low} ELSE {high} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(2.5066282746310002)


def chi2_tail_1(x: Column) -> Column:
    """P(chi-squared with one degree of freedom > x)."""
    return 2 * (1 - normal_cdf(F.sqrt(x)))
