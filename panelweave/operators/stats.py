"""Estimators and tests whose sufficient statistics are Spark aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.saved import saved
from panelweave.operators.windows import average_rank


def ols_moments(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """Per group the cross-products of (1, *xs, y): array xtx (row-major) and xty, and n."""
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    rows = df.dropna(subset=[y, *xs])
    return rows.groupBy(*by).agg(
        F.array(*[F.sum(a * b) for a in cols for b in cols]).alias("xtx"), F.array(*[F.sum(a * F.col(y)) for a in cols]).alias("xty"), F.count("*").alias("n")
    )


def ols(df: DataFrame, y: str, xs: list[str], by: list[str]) -> DataFrame:
    """Coefficients (const first) per group; groups may be many, each solves its own small system."""
    import numpy as np
    import pandas as pd

    k = len(xs) + 1
    names = ["const", *xs]

    def solve(batches):
        for pdf in batches:
            m = np.array(pdf["xtx"].tolist()).reshape(-1, k, k)
            v = np.array(pdf["xty"].tolist()).reshape(-1, k, 1)
            ok = np.linalg.matrix_rank(m) == k
            b = np.full((len(pdf), k), np.nan)
            if ok.any():
                b[ok] = np.linalg.solve(m[ok], v[ok])[..., 0]
            out = pdf[[*by, "n"]].copy()
            for i, c in enumerate(names):
                out[f"b_{c}"] = pd.Series(b[:, i], index=pdf.index).astype(object).where(ok, None)
            yield out

    m = ols_moments(df, y, xs, by)
    schema = ", ".join([f"`{c}` {t}" for c, t in m.dtypes if c in by] + ["n long"] + [f"`b_{c}` double" for c in names])
    return m.mapInPandas(solve, schema)


def demean(df: DataFrame, col: str, key: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(col) - F.avg(col).over(Window.partitionBy(key)))


def demean_two_way(df: DataFrame, col: str, a: str, b: str, rounds: int, out: str) -> DataFrame:
    """Alternating projections: `rounds` sweeps of the means of a, then of b."""
    df = df.withColumn(out, F.col(col))
    for _ in range(rounds):
        df = demean(demean(df, out, a, out), out, b, out)
    return df


def hac_mean(df: DataFrame, ts: str, col: str, lag: int) -> DataFrame:
    """Mean, Bartlett long-run standard error and t of a short series (one row a date)."""
    w = Window.partitionBy(F.lit(1)).orderBy(ts)
    d = df.withColumn("__e", F.col(col) - F.avg(col).over(Window.partitionBy(F.lit(1))))
    prods = [F.sum(F.col("__e") * F.col(f"__l{k}")).alias(f"g{k}") for k in range(lag + 1)]
    d = d.select(col, "__e", *[F.lag("__e", k).over(w).alias(f"__l{k}") for k in range(lag + 1)])
    g = d.agg(F.avg(col).alias("mean"), F.count(col).alias("n"), *prods)
    s = F.col("g0")
    for k in range(1, lag + 1):
        s = s + 2 * (1 - k / (lag + 1)) * F.col(f"g{k}")
    se = F.sqrt(s) / F.col("n")
    return g.select("mean", se.alias("se"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t"), "n")


def daily_differential(df: DataFrame, ts: str, a: str, b: str, lag: int) -> DataFrame:
    """Is loss a below loss b?  Averaged within the day, long-run error over days."""
    daily = df.groupBy(ts).agg(F.avg(F.col(a) - F.col(b)).alias("diff"))
    return hac_mean(daily, ts, "diff", lag)


def _xlogy(x: Column, y: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log(y))


def kupiec(df: DataFrame, hit: str, level: float, by: list[str]) -> DataFrame:
    """Unconditional coverage: rate, and likelihood ratio against `level`."""
    g = df.where(F.col(hit).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("double")).alias("x"))
    n, x = F.col("n"), F.col("x")
    rate = x / n
    lr = -2 * (_xlogy(n - x, F.lit(1 - level)) + _xlogy(x, F.lit(level)) - _xlogy(n - x, 1 - rate) - _xlogy(x, rate))
    return g.select(*by, "n", "x", rate.alias("rate"), lr.alias("lr"))


def christoffersen(df: DataFrame, key: str, ts: str, hit: str) -> DataFrame:
    """Independence of successive hits per key: transition counts and likelihood ratio."""
    h = F.col(hit).cast("int")
    p = df.where(h.isNotNull()).withColumn("__p", F.lag(h).over(Window.partitionBy(key).orderBy(ts))).where("__p is not null")
    g = p.groupBy(key).agg(*[F.count(F.when((F.col("__p") == i) & (h == j), 1)).cast("double").alias(f"n{i}{j}") for i in (0, 1) for j in (0, 1)])
    n00, n01, n10, n11 = (F.col(c) for c in ("n00", "n01", "n10", "n11"))
    p0, p1, pp = n01 / F.nullif(n00 + n01, F.lit(0.0)), n11 / F.nullif(n10 + n11, F.lit(0.0)), (n01 + n11) / (n00 + n01 + n10 + n11)
    one = _xlogy(n00, 1 - p0) + _xlogy(n01, p0) + _xlogy(n10, 1 - p1) + _xlogy(n11, p1)
    none = _xlogy(n00 + n10, 1 - pp) + _xlogy(n01 + n11, pp)
    return g.select(key, "n00", "n01", "n10", "n11", (2 * (one - none)).alias("lr"))


def effective_n(df: DataFrame, day: str, hit: str) -> DataFrame:
    """Intraclass correlation of a 0/1 indicator within days, and the effective number of rows.

    Without variation (no hit or hits only), with one day, or with one row a day the correlation is 0.
    """
    g = df.where(F.col(hit).isNotNull()).groupBy(day).agg(F.count("*").cast("double").alias("m"), F.sum(F.col(hit).cast("double")).alias("x"))
    a = g.agg(F.sum("m").alias("n"), F.count("*").alias("k"), F.sum("x").alias("sx"), F.sum(F.col("m") * F.col("m")).alias("m2"), F.sum(F.col("x") * F.col("x") / F.col("m")).alias("b"))
    n, k, sx = F.col("n"), F.col("k"), F.col("sx")
    more = F.nullif(k - 1, F.lit(0))
    m0 = (n - F.col("m2") / n) / more
    msb = (F.col("b") - sx * sx / n) / more
    msw = (sx - F.col("b")) / F.nullif(n - k, F.lit(0.0))
    icc = F.greatest(F.lit(0.0), (msb - msw) / F.nullif(msb + (m0 - 1) * msw, F.lit(0.0)))
    return a.select(n.alias("n"), icc.alias("icc"), (n / (1 + (n / k - 1) * icc)).alias("effective_n"))


def holm(df: DataFrame, p: str, name: str) -> DataFrame:
    """Bonferroni and Holm step-down adjusted p-values (a table of tests, one window)."""
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    w = Window.partitionBy(F.lit(1)).orderBy(p, name)
    step = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(w) + 1))
    d = df.withColumn("__s", step).withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * n))
    return d.withColumn("holm", F.max("__s").over(w)).drop("__s")


def daily_ic(df: DataFrame, day: str, signal: str, outcome: str, min_names: int) -> DataFrame:
    """Rank correlation of signal and outcome per day with enough names."""
    rows = df.where(F.col(signal).isNotNull() & F.col(outcome).isNotNull())
    rows = rows.withColumn("__a", average_rank(signal, day)).withColumn("__b", average_rank(outcome, day))
    return rows.groupBy(day).agg(F.corr("__a", "__b").alias("ic"), F.count("*").alias("names")).where(F.col("names") >= min_names)


def cumulated(counts: DataFrame, by: list[str], value: str, n: str, out: str = "below") -> DataFrame:
    """`counts` (one row per `by` and value) with `out`: the sum of `n` over smaller values of the group.

    Values are cut into ranges, as many as the session's shuffle partitions, so that a group
    of any number of values is summed up in many tasks: totals per range first, then running
    sums within the ranges.
    """
    ranged = saved(counts.repartitionByRange(*by, value).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy(*by, "__part").agg(F.sum(n).alias("__t"))
    over = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = totals.withColumn("__before", F.coalesce(F.sum("__t").over(over.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    own = F.coalesce(F.sum(n).over(Window.partitionBy(*by, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    keys = [*by, "__part"]
    before = before.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], "__before")
    ranged = ranged.withColumn("__own", own)
    same = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]
    return ranged.join(before, same).select(*counts.columns, (F.col("__before") + F.col("__own")).alias(out))


def quantiles(df: DataFrame, col: str, qs: list[float], by: list[str] | None = None, out: str = "q") -> DataFrame:
    """Exact linear quantiles: (*by, `out`: an array in the order of `qs`), as `percentile` gives them.

    Values are counted, then summed up over ranges of values (`cumulated`), and the values at
    the ranks around each quantile picked out, so that no task holds the values of a group.
    Nulls do not count; without `by` an empty table gives one row of nulls.
    """
    by = by or []
    c = df.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("__n"))
    c = cumulated(c, by, col, "__n", "__below")
    total = c.groupBy(*by).agg(F.sum("__n").alias("__all"))
    if by:
        total = total.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(by)], "__all")
        c = c.join(total, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(by)])  # a row a group on the right
    else:
        c = c.join(total)  # one row on the right

    def at(rank):
        return F.max(F.when((F.col("__below") <= rank) & (rank < F.col("__below") + F.col("__n")), F.col(col).cast("double")))

    parts = []
    for q in qs:
        place = F.lit(float(q)) * (F.col("__all") - 1)
        low, share = F.floor(place), place - F.floor(place)
        parts += [at(low), at(F.ceil(place)), F.max(share)]
    g = c.groupBy(*by).agg(*[p.alias(f"__{i}") for i, p in enumerate(parts)])
    one = [F.col(f"__{i}") + (F.col(f"__{i + 1}") - F.col(f"__{i}")) * F.col(f"__{i + 2}") for i in range(0, len(parts), 3)]
    return g.select(*by, F.array(*one).alias(out))


def auc_scores(df: DataFrame, y: str, p: str, by: list[str]) -> DataFrame:
    """Tie-corrected rank AUC, log-loss, Brier score and accuracy at one half."""
    v, ones, n = F.col(p), F.col("ones"), F.col("n")
    c = df.groupBy(*by, p).agg(F.count("*").cast("double").alias("n"), F.sum(F.col(y).cast("double")).alias("ones"))
    c = cumulated(c, by, p, "n").withColumn("r", F.col("below") + (n + 1) / 2)
    clipped = F.least(F.greatest(v, F.lit(1e-12)), F.lit(1 - 1e-12))
    total = F.sum("n")
    g = c.groupBy(*by).agg(
        F.sum("ones").alias("k"), total.alias("n"), F.sum(F.col("r") * ones).alias("s"),
        (F.sum(-(ones * F.log(clipped) + (n - ones) * F.log(1 - clipped))) / total).alias("log_loss"),
        (F.sum(ones * (v - 1) * (v - 1) + (n - ones) * v * v) / total).alias("brier"), (F.sum(F.when(v >= 0.5, ones).otherwise(n - ones)) / total).alias("accuracy"),
    )
    k, n = F.col("k"), F.col("n")
    return g.select(*by, ((F.col("s") - k * (k + 1) / 2) / F.nullif(k * (n - k), F.lit(0.0))).alias("auc"), "log_loss", "brier", "accuracy")


def reliability(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """Mean forecast and outcome per bin of equal forecast width, with the Brier parts."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("forecast"), F.avg(F.col(y).cast("double")).alias("observed"))
    w = Window.partitionBy(F.lit(1))
    base = F.sum(F.col("n") * F.col("observed")).over(w) / F.sum("n").over(w)
    return g.select("bin", "n", "forecast", "observed", ((F.col("forecast") - F.col("observed")) ** 2 * F.col("n") / F.sum("n").over(w)).alias("reliability"), ((F.col("observed") - base) ** 2 * F.col("n") / F.sum("n").over(w)).alias("resolution"))


def paired_t(df: DataFrame, day: str, a: str, b: str) -> DataFrame:
    d = df.groupBy(day).agg(F.avg(F.col(a) - F.col(b)).alias("x"))
    return d.agg(F.avg("x").alias("mean"), (F.avg("x") / F.nullif(F.stddev_samp("x"), F.lit(0.0)) * F.sqrt(F.count("x"))).alias("t"), F.count("x").alias("days"))


def hazard_by_age(df: DataFrame, age: str, event: str, cap: int, thin: int) -> DataFrame:
    """Discrete hazard per capped age; ages with fewer than `thin` rows take the pooled rate."""
    g = df.groupBy(F.least(F.col(age), F.lit(cap)).alias("age")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("double")).alias("k"))
    w = Window.partitionBy(F.lit(1))
    h = F.when(F.col("n") >= thin, F.col("k") / F.col("n")).otherwise(F.sum("k").over(w) / F.sum("n").over(w))
    return g.select("age", "n", h.alias("hazard"))


def hazard_within(h: DataFrame, k: int) -> DataFrame:
    """Probability of the event within the next k ages; beyond the last age the last hazard holds."""
    w = Window.partitionBy(F.lit(1)).orderBy("age")
    ahead = F.sum(F.log(1 - F.least("hazard", F.lit(1 - 1e-12)))).over(w.rowsBetween(0, k - 1))
    missing = k - F.count("*").over(w.rowsBetween(0, k - 1))
    last = F.last("hazard").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    total = ahead + missing * F.log(1 - F.least(last, F.lit(1 - 1e-12)))
    return h.select("age", (1 - F.exp(total)).alias("within"))


def weighted_quantile(df: DataFrame, by: str, v: str, w: str, q: float) -> DataFrame:
    """Weighted quantile per group at mid-point plotting positions, linear between them.

    Weights are added up per value and summed up over ranges of values, so a group of any
    size is dealt out; of a group only the two values around the quantile meet.
    """
    rows = df.where(F.col(w) > 0).groupBy(by, v).agg(F.sum(w).alias("__w"))
    rows = cumulated(rows, [by], v, "__w", "__below")
    total = rows.groupBy(F.col(by).alias("__k")).agg(F.sum("__w").alias("__all"))
    rows = rows.join(total, F.col(by).eqNullSafe(F.col("__k")))  # a row a group on the right
    p = (F.col("__below") + F.col("__w") / 2) / F.col("__all")
    here = F.struct(p.alias("p"), F.col(v).cast("double").alias("v"))
    g = rows.groupBy(by).agg(F.max(F.when(p <= q, here)).alias("a"), F.min(F.when(p > q, here)).alias("b"))
    a, b = F.col("a.v"), F.col("b.v")
    between = a + (b - a) * (q - F.col("a.p")) / (F.col("b.p") - F.col("a.p"))
    return g.select(by, F.coalesce(between, a, b).alias("quantile"))


def cohen_d(df: DataFrame, label: str, col: str, a: str, b: str) -> DataFrame:
    """Standardised mean difference, tie-corrected Mann-Whitney and Kolmogorov-Smirnov statistics of two groups."""
    rows = df.where(F.col(label).isin(a, b) & F.col(col).isNotNull())
    ia, ib = F.col(label) == a, F.col(label) == b
    x = F.col(col)
    g = rows.agg(
        *[f(F.when(i, x)).alias(n) for n, f, i in (("ma", F.avg, ia), ("mb", F.avg, ib), ("va", F.var_samp, ia), ("vb", F.var_samp, ib))],
        F.count(F.when(ia, 1)).alias("na"), F.count(F.when(ib, 1)).alias("nb"),
    )
    c = rows.groupBy(col).agg(F.count("*").alias("n"), F.count(F.when(ia, 1)).alias("a"), F.count(F.when(ib, 1)).alias("b"))
    c = cumulated(cumulated(cumulated(c, [], col, "n"), [], col, "a", "below_a"), [], col, "b", "below_b")
    up = F.abs((F.col("below_a") + F.col("a")) / F.nullif(F.col("na"), F.lit(0)) - (F.col("below_b") + F.col("b")) / F.nullif(F.col("nb"), F.lit(0)))
    ranks = c.join(g.select("na", "nb")).agg(F.sum((F.col("below") + (F.col("n") + 1) / 2) * F.col("a")).alias("s"), F.max(up).alias("ks"))  # one row on the right
    na, nb = F.col("na"), F.col("nb")
    pooled = F.sqrt(((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / F.nullif(na + nb - 2, F.lit(0)))
    one = g.join(ranks)  # one row each
    return one.select(((F.col("ma") - F.col("mb")) / F.nullif(pooled, F.lit(0.0))).alias("d"), (F.col("s") - na * (na + 1) / 2).alias("u"), "ks", "na", "nb")


def hac_slope(df: DataFrame, ts: str, y: str, x: str, lag: int) -> DataFrame:
    """One row: intercept, slope of y on x, its Newey-West error and t, and the number of dates (one row a date)."""
    one, w = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy(ts)
    d = df.dropna(subset=[y, x]).select(ts, F.col(y).cast("double").alias("__y"), F.col(x).cast("double").alias("__x"))
    d = d.withColumns({"__my": F.avg("__y").over(one), "__u": F.col("__x") - F.avg("__x").over(one)})
    d = d.withColumn("__b", F.sum(F.col("__u") * F.col("__y")).over(one) / F.nullif(F.sum(F.col("__u") * F.col("__u")).over(one), F.lit(0.0)))
    d = d.withColumn("__s", F.col("__u") * (F.col("__y") - F.col("__my") - F.col("__b") * F.col("__u")))
    d = d.select("__x", "__u", "__my", "__b", "__s", *[F.lag("__s", k).over(w).alias(f"__l{k}") for k in range(1, lag + 1)])
    s = F.sum(F.col("__s") * F.col("__s"))
    for k in range(1, lag + 1):
        s = s + 2 * (1 - k / (lag + 1)) * F.coalesce(F.sum(F.col("__s") * F.col(f"__l{k}")), F.lit(0.0))
    g = d.agg(F.first("__my").alias("my"), F.avg("__x").alias("mx"), F.first("__b").alias("slope"), (F.sqrt(F.greatest(s, F.lit(0.0))) / F.nullif(F.sum(F.col("__u") * F.col("__u")), F.lit(0.0))).alias("se"), F.count("*").alias("n"))
    return g.select((F.col("my") - F.col("slope") * F.col("mx")).alias("const"), "slope", "se", (F.col("slope") / F.nullif(F.col("se"), F.lit(0.0))).alias("t"), "n")


def ic_summary(ic: DataFrame, day: str, every: int) -> DataFrame:
    """One row: days, mean rank correlation and its t, and the t of every `every`-th day alone, which do not overlap."""
    d = ic.where("ic is not null").withColumn("__i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(day)) - 1)  # one row a date
    x = F.when(F.col("__i") % every == 0, F.col("ic"))

    def t(c):
        return F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * F.sqrt(F.count(c))

    return d.agg(F.count("ic").alias("days"), F.avg("ic").alias("ic"), t(F.col("ic")).alias("t"), F.count(x).alias("apart"), t(x).alias("t_apart"))


def calibration_error(df: DataFrame, y: str, p: str, bins: int) -> DataFrame:
    """One row: the expected calibration error of the likelier class: the gap of accuracy and confidence per bin of confidence, weighted by rows."""
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull())
    conf = F.greatest(F.col(p), 1 - F.col(p))
    right = ((F.col(p) >= 0.5) == F.col(y)).cast("double")
    b = F.least(F.floor(conf * bins), F.lit(bins - 1))
    g = d.groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.avg(right).alias("acc"), F.avg(conf).alias("conf"))
    return g.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.nullif(F.sum("n"), F.lit(0))).alias("ece"))


def event_grid(anchors: DataFrame, cum: DataFrame, key: str, ts: str, horizons: list[int], era: Column) -> DataFrame:
    """(anchor, state, era, h, n, excess): mean cumulated return over the h rows after each anchor, less the era's mean over all rows.

    anchors: key, ts, anchor, state; cum: key, ts, cum.  Rows whose horizon passes the end of the data do not count.
    """
    w = Window.partitionBy(key).orderBy(ts)
    led = cum.select(key, ts, era.alias("era"), *[(F.lead("cum", h).over(w) - F.col("cum")).alias(f"__{h}") for h in horizons])
    ahead = F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"__{h}").alias("car")) for h in horizons])
    fw = led.select(key, ts, "era", F.inline(ahead)).where("car is not null and era is not null")
    base = fw.groupBy("era", "h").agg(F.avg("car").alias("base"))
    g = anchors.join(fw, [key, ts]).groupBy("anchor", "state", "era", "h").agg(F.count("*").alias("n"), F.avg("car").alias("m"))
    return g.join(base, ["era", "h"]).select("anchor", "state", "era", "h", "n", (F.col("m") - F.col("base")).alias("excess"))
