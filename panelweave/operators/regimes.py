"""States, soft classes, past-only densities and forecasts from them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.normal import normal_cdf, normal_pdf
from panelweave.operators.saved import carried
from panelweave.operators.stats import quantiles


def rule_backbone(df: DataFrame, col: str, share_low: float, share_high: float) -> DataFrame:
    """Classes cut so that the lowest and highest shares match a census."""
    out = df.join(F.broadcast(quantiles(df, col, [share_low, 1 - share_high], out="__q")))  # one row
    return out.withColumn("rule", F.when(F.col(col) < F.col("__q")[0], "sell").when(F.col(col) > F.col("__q")[1], "buy").otherwise("neutral")).drop("__q")


def hard_class(state: Column, block: Column, conc: Column, t_block: float, t_conc: float) -> Column:
    """Five classes from a state and two cut points."""
    return (
        F.when(state == "neutral", "quiet").when((state == "sell") & (conc > t_conc), "concentrated_sell").when(state == "sell", "dispersed_sell")
        .when(block > t_block, "block_buy").otherwise("steady_buy")
    )


def soft_bands(p_sell: Column, p_neutral: Column, p_buy: Column, block: Column, conc: Column, t_block: float, t_conc: float, sd: float) -> Column:
    """Weights of the five classes: state probability times the normal chance to lie beyond the cut; they sum to 1."""
    up_c, up_b = normal_cdf((conc - t_conc) / sd), normal_cdf((block - t_block) / sd)
    return F.array(p_neutral, p_sell * up_c, p_sell * (1 - up_c), p_buy * up_b, p_buy * (1 - up_b))


def band_summary(w: Column) -> tuple[Column, Column, Column]:
    """Sum, greatest weight and entropy."""
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    entropy = F.aggregate(w, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return total, F.array_max(w), entropy


def standardised_outcome(df: DataFrame, key: str, ts: str, ret: str, sigma: str, h: int, limit: float) -> DataFrame:
    """z = forward h-row return / (sigma sqrt h); a missing or wild return voids every window over it."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(1, h)
    good = F.when(F.abs(F.col(ret)) <= limit, F.log(1 + F.col(ret)))
    df = df.withColumn("__g", good)
    fwd = F.when(F.count("__g").over(w) == h, F.sum("__g").over(w))
    return df.withColumn("z", F.when(F.col(sigma) > 0, fwd / (F.col(sigma) * F.sqrt(F.lit(float(h)))))).drop("__g")


def admits(pos: Column, h: int, asof_pos: Column) -> Column:
    """The one embargo rule: an outcome that ends at pos + h is known at asof_pos."""
    return pos + h <= asof_pos


def past_densities(obs: DataFrame, vintages: DataFrame, h: int, low: float, step: float, bins: int) -> DataFrame:
    """Past-only weighted histograms per vintage and class: (vintage, cls, bin, cdf, mass, ess).

    obs: (pos, cls, z, w); vintages: (vintage, asof_pos).  Each observation enters at the
    first vintage that admits it; counts per vintage are summed up over vintages, so pairs
    of observations and vintages never are made.
    """
    v = vintages.groupBy().agg(F.array_sort(F.collect_list("asof_pos")).alias("__a"))  # a few hundred vintages
    bin_ = F.greatest(F.lit(0), F.least(F.floor((F.col("z") - low) / step), F.lit(bins - 1))).cast("int")
    o = obs.where("z is not null and w > 0").join(F.broadcast(v))
    first = F.try_element_at(F.filter("__a", lambda a: admits(F.col("pos"), h, a)), F.lit(1))
    o = o.withColumn("asof_pos", first).where("asof_pos is not null")
    new = o.groupBy("asof_pos", "cls", bin_.alias("bin")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("w2"))
    grid = vintages.select("asof_pos").distinct().join(new.select("cls", "bin").distinct())  # vintages x classes x bins, no observations
    up = Window.partitionBy("cls", "bin").orderBy("asof_pos").rowsBetween(Window.unboundedPreceding, 0)
    g = grid.join(new, ["asof_pos", "cls", "bin"], "left").na.fill(0.0, ["w", "w2"])
    g = g.select("asof_pos", "cls", "bin", F.sum("w").over(up).alias("w"), F.sum("w2").over(up).alias("w2"))
    cell = Window.partitionBy("asof_pos", "cls")
    mass = F.sum("w").over(cell)
    g = g.withColumn("mass", mass).withColumn("ess", F.col("mass") * F.col("mass") / F.sum("w2").over(cell))
    g = g.where("mass > 0").withColumn("cdf", F.sum("w").over(cell.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)) / F.col("mass"))
    return g.join(vintages, "asof_pos").select("vintage", "cls", "bin", "cdf", "mass", "ess")


def density_gates(d: DataFrame) -> DataFrame:
    """Per vintage and class: steps down of the distribution, its end, and effective size."""
    step = F.col("cdf") - F.lag("cdf").over(Window.partitionBy("vintage", "cls").orderBy("bin"))
    return d.withColumn("__s", step).groupBy("vintage", "cls").agg(F.count(F.when(F.col("__s") < -1e-12, 1)).alias("steps_down"), F.max("cdf").alias("top"), F.max("ess").alias("ess"))


def normal_crps(x: Column, mean: Column, sd: Column) -> Column:
    """Closed-form continuous ranked probability score of a normal forecast."""
    z = (x - mean) / sd
    return sd * (z * (2 * normal_cdf(z) - 1) + 2 * normal_pdf(z) - 0.5641895835477563)


def pinball(y: Column, q: Column, tau: float) -> Column:
    return F.when(y >= q, (y - q) * tau).otherwise((q - y) * (1 - tau))


def forward_filter(
    df: DataFrame, key: str, ts: str, obs: str, means: list[float], sds: list[float], trans: list[list[float]], start: list[float],
    pos: str | None = None, most_gap: int = 250,
) -> DataFrame:
    """Causal state probabilities per key: carried belief, moved by the transitions, times the likelihood.

    A null observation moves the belief only.  With `pos`, a row's number in the calendar,
    the belief is moved once for each position since the row before; after more than
    `most_gap` positions it starts anew from the stationary distribution.
    """
    k = len(means)

    def move(p):
        return [sum(p[i] * trans[i][j] for i in range(k)) for j in range(k)]

    stationary = [1 / k] * k
    for _ in range(2000):
        stationary = move(stationary)

    def step(s, x, at):
        if s is None:
            p = list(start)
        else:
            p, gap = s[0], int(at - s[1])
            if gap > most_gap:
                p = list(stationary)
            else:
                for _ in range(gap):
                    p = move(p)
        if x is not None:
            p = [m * max(1e-300, math.exp(-(((x - a) / d) ** 2) / 2) / d) for m, a, d in zip(p, means, sds, strict=True)]
        total = sum(p)
        p = [v / total for v in p]
        return (p, at), (p,)

    number = F.col(pos).cast("double") if pos else F.row_number().over(Window.partitionBy(key).orderBy(ts)).cast("double")
    rows = df.select(key, ts, F.col(obs).cast("double").alias("__x"), number.alias("__at"))
    return carried(rows, key, ts, ["__x", "__at"], lambda: None, step, "p array<double>")


def seven_classes(state: Column, block: Column, conc: Column, low: float, high: float, b_low: float, b_high: float) -> Column:
    """Seven classes from a state and two cut points a side: low, middle and high concentration of sellers and of buyers, and quiet."""
    return (
        F.when(state == "neutral", "quiet").when(state == "sell", F.when(conc < low, "hostage").when(conc > high, "concentrated_sell").otherwise("sell_mid"))
        .otherwise(F.when(block < b_low, "dispersed_buy").when(block > b_high, "block_buy").otherwise("buy_mid"))
    )


def frontier(d: DataFrame, vintages: DataFrame, least: float) -> DataFrame:
    """(cls, valid_from, vintages): per class the first vintage from which on every later one has an effective size of `least` or more.

    A class without such a vintage has a null.
    """
    e = d.groupBy("vintage", "cls").agg(F.max("ess").alias("ess")).join(vintages, "vintage")
    w = Window.partitionBy("cls").orderBy(F.desc("asof_pos")).rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("__later", F.min("ess").over(w))
    return e.groupBy("cls").agg(F.min_by("vintage", F.when(F.col("__later") >= least, F.col("asof_pos"))).alias("valid_from"), F.count("*").alias("vintages"))


def embargo_slack(obs: DataFrame, vintages: DataFrame, h: int) -> DataFrame:
    """(vintage, n, slack): outcomes that a vintage is the first to know, and the least number of positions by which they ended before it; below 0 would be a look ahead."""
    v = vintages.agg(F.array_sort(F.collect_list(F.struct("asof_pos", "vintage"))).alias("__a"))  # a few hundred vintages
    o = obs.join(v).withColumn("__f", F.try_element_at(F.filter("__a", lambda a: admits(F.col("pos"), h, a["asof_pos"])), F.lit(1))).where("__f is not null")
    return o.groupBy(F.col("__f.vintage").alias("vintage")).agg(F.count("*").alias("n"), F.min(F.col("__f.asof_pos") - h - F.col("pos")).alias("slack"))
