"""Many trials: deflated Sharpe ratios, overfitting, nested forecasts, conversion of implied gains."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.normal import normal_cdf, probit
from panelweave.operators.stats import hac_mean


def clark_west(df: DataFrame, ts: str, y: str, small: str, large: str, lag: int) -> DataFrame:
    """Clark-West test of nested forecasts, averaged within the day; a positive t favours the larger model."""
    d = df.dropna(subset=[y, small, large])
    v, a, b = (F.col(c) for c in (y, small, large))
    adj = (v - a) * (v - a) - (v - b) * (v - b) + (a - b) * (a - b)
    return hac_mean(d.groupBy(ts).agg(F.avg(adj).alias("cw")), ts, "cw", lag)


def deflated_sharpe(df: DataFrame, trial: str, ret: str) -> DataFrame:
    """Per trial: observations, Sharpe ratio a period, the best one that no skill would give, and the chance to beat it."""
    r = F.col(ret)
    g = df.where(r.isNotNull()).groupBy(trial).agg(F.count("*").alias("n"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("excess"))
    g = g.withColumn("sharpe", F.col("m") / F.nullif(F.col("sd"), F.lit(0.0))).withColumn("trials", F.count("*").over(Window.partitionBy(F.lit(1))).cast("double"))
    g = g.withColumn("p1", 1 - 1 / F.col("trials")).withColumn("p2", 1 - 1 / (F.col("trials") * math.e))
    top = F.when(F.col("trials") <= 1, 0.0).otherwise((1 - 0.5772156649015329) * probit(F.col("p1")) + 0.5772156649015329 * probit(F.col("p2")))
    g = g.withColumn("expected_max", top / F.sqrt(F.col("n").cast("double")))
    s = F.col("sharpe")
    spread = 1 - F.col("skew") * s + (F.col("excess") + 2) / 4 * s * s
    z = (s - F.col("expected_max")) * F.sqrt(F.col("n") - 1.0) / F.sqrt(F.when(spread > 0, spread))
    return g.withColumn("z", z).select(trial, "n", "sharpe", "expected_max", normal_cdf(F.col("z")).alias("probability"))


def overfitting(df: DataFrame, trial: str, period: Column, ret: str, most: int = 14) -> DataFrame:
    """One row: splits, and the share in which the best trial of one half is below the median in the other.

    Periods (at most `most`) are dealt in all ways into two halves; moments per trial and
    period are summed up over each half, so rows are read once.
    """
    r = F.col(ret)
    g = df.where(r.isNotNull()).groupBy(trial, period.alias("period")).agg(F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("ss"))
    g = g.withColumn("bit", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("period")) - 1)
    periods = g.agg(F.max("bit") + 1).first()[0] or 0
    if periods > most:
        raise ValueError(f"{periods} periods give too many splits")
    masks = [m for m in range(1 << periods) if m.bit_count() == periods // 2 and 0 < m]
    split = g.withColumn("mask", F.explode(F.array(*map(F.lit, masks or [0]))))
    inside = F.expr("(shiftright(mask, bit) & 1) = 1")

    def sharpe(where):
        n, s, ss = (F.sum(F.when(where, F.col(c))) for c in ("n", "s", "ss"))
        return (s / n) / F.sqrt(F.when(ss / n - (s / n) * (s / n) > 0, ss / n - (s / n) * (s / n)))

    halves = split.groupBy("mask", trial).agg(sharpe(inside).alias("a"), sharpe(~inside).alias("b")).dropna()
    best = halves.groupBy("mask").agg(F.max_by("b", F.struct("a", trial)).alias("own"))
    rank = halves.join(best, "mask").groupBy("mask").agg(F.sum((F.col("b") < F.col("own")).cast("int")).alias("below"), F.count("*").alias("n"))
    low = F.col("below") / F.nullif(F.col("n") - 1, F.lit(0)) < 0.5
    return rank.agg(F.count("*").alias("splits"), F.avg(low.cast("double")).alias("overfitting"))


def conversion(df: DataFrame, observed: str, implied: str) -> DataFrame:
    """`df` with the share of the implied gain that was observed, and a verdict on it."""
    ratio = F.col(observed) / F.nullif(F.col(implied), F.lit(0.0))
    r = F.col("ratio")
    verdict = F.when(r < 0, "inverted").when(r < 0.10, "no conversion").when(r < 0.50, "partial conversion").when(r.isNotNull(), "converts")
    return df.withColumn("ratio", ratio).withColumn("verdict", verdict)
