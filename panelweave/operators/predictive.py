"""Densities in force, their recalibration and tails."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.mix import mix
from panelweave.operators.regimes import admits
from panelweave.operators.stats import weighted_quantile


def vintage_windows(df: DataFrame, vintages: DataFrame, key: str, ts: str, days: int, least: int, last: int) -> DataFrame:
    """(vintage, key, rows, used, first, last): what each vintage is fitted on.

    Rows of (asof - days, asof]; keys of at least `least` rows; of each the last `last` rows.
    vintages: (vintage, asof), few; a row meets only the vintages whose window holds it.
    """
    v = vintages.agg(F.collect_list(F.struct("asof", "vintage")).alias("__v"))  # a few hundred vintages
    holds = F.filter("__v", lambda x: (x["asof"] >= F.col(ts)) & (F.datediff(x["asof"], F.col(ts)) < days))
    rows = df.select(key, ts).join(v).select(key, ts, F.explode(holds).alias("w")).select("w.vintage", key, ts)  # one row on the right
    back = F.row_number().over(Window.partitionBy("vintage", key).orderBy(F.desc(ts)))
    n = F.count("*").over(Window.partitionBy("vintage", key))
    g = rows.withColumn("__n", n).withColumn("__b", back).where((F.col("__n") >= least) & (F.col("__b") <= last))
    return g.groupBy("vintage", key).agg(F.max("__n").alias("rows"), F.count("*").alias("used"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def clustered_quantiles(df: DataFrame, key: str, v: str, w: str, q: float, replicates: int, seed: int) -> DataFrame:
    """(rep, quantile): the weighted quantile with whole keys drawn again, as many as there are.

    A key drawn c times has its weights times c; work is replicates x rows that are drawn.
    """
    one = Window.partitionBy(F.lit(1))
    keys = df.select(key).distinct().withColumn("pos", F.row_number().over(one.orderBy(key)) - 1).withColumn("n", F.count("*").over(one))
    draws = keys.select(F.col("pos").alias("slot"), "n").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    times = draws.groupBy("rep", mix(seed, F.col("n"), F.col("rep"), F.col("slot")).alias("pos")).agg(F.count("*").alias("times"))
    rows = df.join(keys.select(key, "pos"), key).join(times, "pos").select("rep", v, (F.col(w) * F.col("times")).alias("w"))
    return weighted_quantile(rows, "rep", v, "w", q)


def recalibration(df: DataFrame, vintages: DataFrame, h: int, clip: float, least: int, clamp: float) -> DataFrame:
    """(vintage, n, k): by how much log volatility moves with the deviation of fast from slow volatility.

    df: (pos, dev, z).  k is half the slope of clipped z^2 on dev over its mean, of outcomes
    known at the vintage (`admits`), within +-clamp; 0 below `least` rows.  Moments are
    summed up by the first vintage that admits a row, then over vintages.
    """
    y = F.least(F.greatest(F.col("z"), F.lit(-clip)), F.lit(clip)) ** 2
    x = F.col("dev")
    v = vintages.agg(F.array_sort(F.collect_list("asof_pos")).alias("__a"))  # a few hundred vintages
    o = df.dropna(subset=["dev", "z"]).join(v)
    o = o.withColumn("asof_pos", F.try_element_at(F.filter("__a", lambda a: admits(F.col("pos"), h, a)), F.lit(1)))
    m = o.groupBy("asof_pos").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    up = Window.partitionBy(F.lit(1)).orderBy("asof_pos").rowsBetween(Window.unboundedPreceding, 0)
    c = vintages.join(m, "asof_pos", "left").select("vintage", "asof_pos", *[F.coalesce(F.sum(k).over(up), F.lit(0)).alias(k) for k in ("n", "sx", "sy", "sxx", "sxy")])
    n, den = F.col("n"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(den > 0, den)
    k = 0.5 * slope / F.when(F.col("sy") > 0, F.col("sy") / n)
    k = F.when(n >= least, F.coalesce(F.least(F.greatest(k, F.lit(-clamp)), F.lit(clamp)), F.lit(0.0))).otherwise(0.0)
    return c.select("vintage", "n", k.alias("k"))


def _masses(d: DataFrame) -> DataFrame:
    """(vintage, bin, w): weight per bin over all classes."""
    w = Window.partitionBy("vintage", "cls").orderBy("bin")
    own = (F.col("cdf") - F.coalesce(F.lag("cdf").over(w), F.lit(0.0))) * F.col("mass")
    return d.withColumn("__w", own).groupBy("vintage", "bin").agg(F.sum("__w").alias("w"))


def t_constant(nu: float) -> float:
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)


def student_nu(d: DataFrame, low: float, step: float, grid: list[float]) -> DataFrame:
    """(vintage, nu): the degrees of freedom of the grid that a unit-variance t fits a vintage's bins best with."""
    mid = low + (F.col("bin") + 0.5) * step
    cells = F.array(*[F.struct(F.lit(float(nu)).alias("nu"), F.lit(math.sqrt(nu / (nu - 2))).alias("sc"), F.lit(t_constant(nu)).alias("c")) for nu in grid])
    g = _masses(d).withColumn("g", F.explode(cells)).select("vintage", "w", mid.alias("z"), "g.*")
    x = F.col("z") * F.col("sc")
    logp = F.col("c") - (F.col("nu") + 1) / 2 * F.log(1 + x * x / F.col("nu")) + F.log("sc")
    nll = g.groupBy("vintage", "nu").agg(F.round(-F.sum(F.col("w") * logp), 6).alias("nll"))
    return nll.groupBy("vintage").agg(F.min_by("nu", F.struct("nll", "nu")).alias("nu"))


def spliced_tail(d: DataFrame, low: float, step: float, share: float) -> DataFrame:
    """(vintage, bin, cdf): the pooled distribution with a generalised Pareto tail below its `share` quantile.

    The threshold is the upper edge of the first bin that reaches the share; shape and scale
    come from the mean and variance of the exceedances (method of moments).
    """
    w = Window.partitionBy("vintage")
    m = _masses(d).withColumn("cdf", F.sum("w").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("w").over(w))
    m = m.withColumn("ub", F.min(F.when(F.col("cdf") >= share, F.col("bin"))).over(w))
    m = m.withColumn("pu", F.max(F.when(F.col("bin") == F.col("ub"), F.col("cdf"))).over(w))
    tail, e = F.col("bin") <= F.col("ub"), (F.col("ub") - F.col("bin") + 0.5) * step
    tw = F.sum(F.when(tail, F.col("w"))).over(w)
    m = m.withColumn("mean", F.sum(F.when(tail, F.col("w") * e)).over(w) / F.nullif(tw, F.lit(0.0)))
    m = m.withColumn("var", F.sum(F.when(tail, F.col("w") * e * e)).over(w) / F.nullif(tw, F.lit(0.0)) - F.col("mean") * F.col("mean"))
    q = F.col("mean") * F.col("mean") / F.when(F.col("var") > 1e-9, F.col("var"))
    m = m.withColumn("xi", 0.5 * (1 - q)).withColumn("sc", 0.5 * F.col("mean") * (q + 1))
    base = 1 + F.col("xi") * (F.col("ub") - F.col("bin")) * step / F.col("sc")
    gpd = F.when(base <= 0, 0.0).when(F.abs("xi") < 1e-9, F.exp(-(F.col("ub") - F.col("bin")) * step / F.col("sc"))).otherwise(F.exp(-F.log(F.when(base > 0, base)) / F.col("xi")))
    spliced = F.when((F.col("bin") < F.col("ub")) & F.col("sc").isNotNull(), F.col("pu") * gpd).otherwise(F.col("cdf"))
    return m.select("vintage", "bin", spliced.alias("cdf"))


def recalibration_table(df: DataFrame, vintages: DataFrame, h: int, clip: float, low: float, width: float, bins: int, prior: float) -> DataFrame:
    """(vintage, bin, n, ratio): mean clipped z^2 per bin of the volatility deviation over the vintage's mean, drawn to 1.

    df: (pos, dev, z); vintages: (vintage, asof_pos).  The ratio of a bin is
    (sum + prior * mean) / ((n + prior) * mean): `prior` rows at the level of all stand in each
    bin.  Sums enter at the first vintage that knows a row and are added up over vintages.
    """
    y = F.least(F.greatest(F.col("z"), F.lit(-clip)), F.lit(clip)) ** 2
    b = F.greatest(F.lit(0), F.least(F.floor((F.col("dev") - low) / width), F.lit(bins - 1))).cast("int")
    v = vintages.agg(F.array_sort(F.collect_list("asof_pos")).alias("__a"))  # a few hundred vintages
    o = df.dropna(subset=["dev", "z"]).join(v)
    o = o.withColumn("asof_pos", F.try_element_at(F.filter("__a", lambda a: admits(F.col("pos"), h, a)), F.lit(1))).where("asof_pos is not null")
    new = o.groupBy("asof_pos", b.alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    grid = vintages.select("vintage", "asof_pos").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))  # vintages x bins
    up = Window.partitionBy("bin").orderBy("asof_pos").rowsBetween(Window.unboundedPreceding, 0)
    c = grid.join(new, ["asof_pos", "bin"], "left").na.fill(0, ["n", "s"]).select("vintage", "bin", F.sum("n").over(up).alias("n"), F.sum("s").over(up).alias("s"))
    whole = Window.partitionBy("vintage")
    mean = F.sum("s").over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0))
    c = c.withColumn("__m", mean)
    return c.select("vintage", "bin", "n", F.coalesce((F.col("s") + prior * F.col("__m")) / F.nullif((F.col("n") + prior) * F.col("__m"), F.lit(0.0)), F.lit(1.0)).alias("ratio"))


def replicate_summary(reps: DataFrame, col: str) -> DataFrame:
    """One row: replicates, mean, sd, 2.5 and 97.5 % quantiles, skewness and excess kurtosis of a bootstrap's estimates."""
    q = F.percentile(col, F.array(F.lit(0.025), F.lit(0.975)))  # a row a replicate
    return reps.agg(F.count(col).alias("replicates"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), q[0].alias("low"), q[1].alias("high"), F.skewness(col).alias("skew"), F.kurtosis(col).alias("kurtosis"))
