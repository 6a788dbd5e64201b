"""Tests of forecasts: coverage with clustered days, uniform and independent transforms, Student-t scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions import distributions as ds
from panelweave.functions.normal import probit
from panelweave.operators.panelreg import ljung_box
from panelweave.operators.resampling import block_walk
from panelweave.operators.saved import saved
from panelweave.operators.stats import effective_n, kupiec

TAUS = [k / 100 for k in range(1, 100)]


def coverage(df: DataFrame, hit: str, level: float, day: str) -> DataFrame:
    """One row: rows, hits, their rate, the likelihood ratio against `level` and its chance, as counted and with the effective number of rows.

    Hits of a day come together, so rows are worth fewer independent ones (`effective_n`);
    the rate stays and the ratio, which is in proportion to the rows, shrinks alike.
    """
    g = kupiec(df, hit, level, []).join(effective_n(df, day, hit).select("icc", "effective_n"))  # one row each
    lr = F.col("lr") * F.col("effective_n") / F.nullif(F.col("n"), F.lit(0))
    g = g.withColumn("p", ds.chi2_tail(F.col("lr"), F.lit(1))).withColumn("lr_effective", lr)
    return g.withColumn("p_effective", ds.chi2_tail(F.col("lr_effective"), F.lit(1)))


def pit_uniformity(df: DataFrame, day: str, pit: str, bins: int, replicates: int, mean_block: int, seed: int) -> DataFrame:
    """One row: the histogram's chi-square, its textbook chance, and the critical value of dependent days.

    Counts per day and bin less what uniform transforms would give are centred over days, so
    that the hypothesis holds by construction, and days are drawn again in blocks: the
    critical value keeps the dependence within and between days and does not follow the
    departure that it is to judge.
    """
    u = F.col(pit)
    b = F.least(F.floor(u * bins), F.lit(bins - 1)).cast("int")
    rows = df.where(u.isNotNull()).select(day, b.alias("__b"))
    per = rows.groupBy(day).agg(F.count("*").alias("n"), *[F.count(F.when(F.col("__b") == k, 1)).cast("double").alias(f"c{k}") for k in range(bins)])
    rest = [F.col(f"c{k}") - F.col("n") / bins for k in range(bins)]
    per = per.select(day, "n", *[r.alias(f"r{k}") for k, r in enumerate(rest)])
    every = Window.partitionBy(F.lit(1))  # one row a date
    centred = per.select(day, "n", *[(F.col(f"r{k}") - F.avg(f"r{k}").over(every)).alias(f"r{k}") for k in range(bins)])

    def statistic() -> Column:
        squares = sum((F.sum(f"r{k}") * F.sum(f"r{k}") for k in range(1, bins)), F.sum("r0") * F.sum("r0"))
        return squares / F.nullif(F.sum("n") / bins, F.lit(0.0))

    seen = per.agg(F.sum("n").alias("n"), statistic().alias("chi2"))
    null = block_walk(centred, day, replicates, mean_block, seed).groupBy("rep").agg(statistic().alias("s"))
    null = null.agg(F.percentile("s", F.lit(0.5)).alias("null_median"), F.percentile("s", F.lit(0.95)).alias("crit95"))  # `replicates` numbers
    return seen.join(null).select("n", "chi2", ds.chi2_tail(F.col("chi2"), F.lit(bins - 1)).alias("p"), "null_median", "crit95", (F.col("chi2") > F.col("crit95")).alias("reject"))


def uniform_distance(df: DataFrame, key: str, pit: str) -> DataFrame:
    """(key, n, d, p): Kolmogorov-Smirnov distance of each key's values from the uniform distribution."""
    u = F.col(pit)
    w = Window.partitionBy(key)
    rows = df.where(u.isNotNull()).select(key, u.alias("__u"), F.row_number().over(w.orderBy(pit)).alias("__i"), F.count("*").over(w).alias("__n"))
    gap = F.greatest(F.col("__i") / F.col("__n") - F.col("__u"), F.col("__u") - (F.col("__i") - 1) / F.col("__n"))
    g = rows.groupBy(key).agg(F.count("*").alias("n"), F.max(gap).alias("d"))
    return g.withColumn("p", ds.kolmogorov_tail(F.col("d"), F.col("n")))


def pit_independence(df: DataFrame, key: str, ts: str, pit: str, lags: int, least: int = 50) -> DataFrame:
    """(key, n, q, p, q_squares, p_squares, ks_p): are the transforms uniform, and free of their past in level and size?

    Transforms become normal quantiles first; keys with fewer than `least` rows are left out.
    """
    z = ds.let(F.col(pit), lambda u: probit(F.least(F.greatest(u, F.lit(1e-6)), F.lit(1 - 1e-6))))
    rows = saved(df.where(F.col(pit).isNotNull()).select(key, ts, z.alias("__z"), pit)).withColumn("__zz", F.col("__z") * F.col("__z"))
    a = ljung_box(rows, key, ts, "__z", lags).where(F.col("n") >= least).select(key, "n", "q", ds.chi2_tail(F.col("q"), F.lit(lags)).alias("p"))
    b = ljung_box(rows, key, ts, "__zz", lags).select(key, F.col("q").alias("q_squares"), ds.chi2_tail(F.col("q"), F.lit(lags)).alias("p_squares"))
    c = uniform_distance(rows, key, pit).select(key, F.col("p").alias("ks_p"))
    return a.join(b, key).join(c, key)


def student_quantiles(nus: DataFrame, nu: str) -> DataFrame:
    """(nu, q): the 1 to 99 % quantiles of Student's t, one row for each distinct value of `nu`."""
    q = F.transform(F.array(*map(F.lit, TAUS)), lambda tau: ds.student_quantile(tau, F.col(nu)))
    return nus.select(nu).where(F.col(nu) > 0).distinct().select(nu, q.alias("q"))


def student_scores(df: DataFrame, y: str, scale: str, nu: str, tail: float = 0.05) -> DataFrame:
    """`df` with crps, tail_crps, pit and log_score of the forecast scale * t(nu).

    The score is twice the mean pinball loss at the 1 to 99 % quantiles, of which the tail's
    has those up to `tail`.  Quantiles are found once for each distinct nu, of which
    forecasts have few; the rows of another scale take multiples of them.  A scale that is
    not positive, or a null, gives nulls.
    """
    t = F.when(F.col(scale) > 0, F.col(y) / F.nullif(F.col(scale), F.lit(0.0)))
    taus = F.array(*map(F.lit, TAUS))

    def loss(keep: Column | None) -> Column:
        pairs = F.zip_with(taus, "q", lambda tau, q: F.struct(tau.alias("tau"), (F.col("__t") - q).alias("d")))
        pairs = pairs if keep is None else F.filter(pairs, lambda p: p["tau"] <= keep)
        total = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.greatest(p["tau"] * p["d"], (p["tau"] - 1) * p["d"]))
        return 2 * F.col(scale) * total / F.size(pairs)

    r = df.withColumn("__t", t).join(student_quantiles(df, nu), nu, "left")
    known = F.col("__t").isNotNull() & F.col("q").isNotNull()
    r = r.withColumn("crps", F.when(known, loss(None))).withColumn("tail_crps", F.when(known, loss(F.lit(tail))))
    r = r.withColumn("pit", ds.student_cdf(F.col("__t"), F.col(nu))).withColumn("log_score", ds.student_log_pdf(F.col("__t"), F.col(nu)) - F.log(F.when(F.col(scale) > 0, F.col(scale))))
    return r.drop("__t", "q")
