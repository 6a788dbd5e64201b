"""Fixed-effects slopes with clustered errors, and screens over eras."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.saved import saved
from panelweave.operators.stats import demean_two_way, hac_mean


def fe_slope(df: DataFrame, y: str, x: str, a: str, b: str, rounds: int = 4) -> DataFrame:
    """One row: slope of y on x after sweeping out the effects of a and b, with four errors.

    Clustered by a, by b, heteroskedastic, and two-way (by a plus by b less heteroskedastic).
    Meats are sums over clusters of squared score sums: one grouping each.
    """
    d = df.dropna(subset=[y, x]).select(a, b, F.col(y).alias("__y0"), F.col(x).alias("__x0"))
    d = demean_two_way(demean_two_way(d, "__y0", a, b, rounds, "__y"), "__x0", a, b, rounds, "__x")
    d = saved(d)  # the sweeps run once for the slope and all errors
    s = d.agg(F.sum(F.col("__x") * F.col("__y")).alias("xy"), F.sum(F.col("__x") * F.col("__x")).alias("xx"), F.count("*").alias("n"))
    s = s.withColumn("slope", F.col("xy") / F.nullif(F.col("xx"), F.lit(0.0)))
    d = d.join(F.broadcast(s.select("slope")))  # one row
    d = d.withColumn("__s", F.col("__x") * (F.col("__y") - F.col("slope") * F.col("__x")))

    def meat(k: str, name: str) -> DataFrame:
        return d.groupBy(k).agg(F.sum("__s").alias("g")).agg(F.sum(F.col("g") * F.col("g")).alias(name))

    white = d.agg(F.sum(F.col("__s") * F.col("__s")).alias("mw"))
    one = s.join(meat(a, "ma")).join(meat(b, "mb")).join(white)  # one row each
    se = {k: F.sqrt(F.greatest(F.lit(0.0), v)) / F.nullif(F.col("xx"), F.lit(0.0)) for k, v in (("se_a", F.col("ma")), ("se_b", F.col("mb")), ("se_white", F.col("mw")), ("se_two_way", F.col("ma") + F.col("mb") - F.col("mw")))}
    return one.select("slope", "n", *[v.alias(k) for k, v in se.items()])


def screen(df: DataFrame, ts: str, col: str, cells: dict[str, str], lag: int, bar: float) -> DataFrame:
    """Mean, error and t per cell (name: SQL condition) of a short series, and whether |t| reaches the bar."""
    parts = [hac_mean(df.where(rule), ts, col, lag).withColumn("cell", F.lit(name)) for name, rule in cells.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("passed", F.abs("t") >= bar)


def ljung_box(df: DataFrame, key: str, ts: str, col: str, lags: int) -> DataFrame:
    """Ljung-Box statistic per key: n (n + 2) sum of r_k^2 / (n - k)."""
    w = Window.partitionBy(key).orderBy(ts)
    d = df.where(F.col(col).isNotNull()).withColumn("__e", F.col(col) - F.avg(col).over(Window.partitionBy(key)))
    d = d.select(key, "__e", *[F.lag("__e", k).over(w).alias(f"__l{k}") for k in range(1, lags + 1)])
    g = d.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("__e") * F.col("__e")).alias("g0"), *[F.sum(F.col("__e") * F.col(f"__l{k}")).alias(f"g{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    q = sum((F.col(f"g{k}") / F.nullif(F.col("g0"), F.lit(0.0))) ** 2 / F.nullif(n - k, F.lit(0)) for k in range(1, lags + 1))
    return g.select(key, "n", (n * (n + 2) * q).alias("q"))


def event_arc(events: DataFrame, series: DataFrame, key: str, pos: str, value: str, before: int, after: int) -> DataFrame:
    """Mean of a keyed series at each offset from the events' positions."""
    e = events.select(key, F.col(pos).alias("__p"), F.explode(F.sequence(F.lit(-before), F.lit(after))).alias("offset"))
    e = e.select(key, (F.col("__p") + F.col("offset")).alias(pos), "offset")
    return e.join(series, [key, pos]).groupBy("offset").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))


def pooled_slope(df: DataFrame, y: str, x: str, cluster: str) -> DataFrame:
    """One row: intercept and slope of y on x over all rows, with an error clustered by `cluster`."""
    d = df.dropna(subset=[y, x]).select(cluster, F.col(y).alias("__y"), F.col(x).alias("__x"))
    m = d.agg(F.avg("__x").alias("mx"), F.avg("__y").alias("my"), F.covar_pop("__x", "__y").alias("cov"), F.var_pop("__x").alias("var"), F.count("*").alias("n"))
    m = m.withColumn("slope", F.col("cov") / F.nullif(F.col("var"), F.lit(0.0)))
    e = d.join(m)  # one row
    u = F.col("__x") - F.col("mx")
    g = e.groupBy(cluster).agg(F.sum(u * (F.col("__y") - F.col("my") - F.col("slope") * u)).alias("g")).agg(F.sum(F.col("g") * F.col("g")).alias("meat"))
    one = m.join(g)  # one row each
    return one.select((F.col("my") - F.col("slope") * F.col("mx")).alias("const"), "slope", (F.sqrt("meat") / F.nullif(F.col("var") * F.col("n"), F.lit(0.0))).alias("se"), "n")


def fe_specs(df: DataFrame, ys: list[str], x: str, control: str, a: str, b: str, rounds: int = 2) -> DataFrame:
    """(y, spec, slope, se, n): slopes of each y on x under fixed effects of a and b, errors clustered by a.

    R0 has x alone, R1 the control beside it: what the control explains is taken out of x
    first, which leaves the slope of the regression on both.
    """
    parts = []
    for y in ys:
        d = df.dropna(subset=[y, x, control]).select(a, b, *[F.col(c).cast("double").alias(f"__{k}0") for k, c in (("y", y), ("x", x), ("c", control))])
        for k in "yxc":
            d = demean_two_way(d, f"__{k}0", a, b, rounds, f"__{k}")
        d = saved(d)
        q = d.agg(F.sum(F.col("__x") * F.col("__c")).alias("xc"), F.sum(F.col("__c") * F.col("__c")).alias("cc"))
        part = F.col("xc") / F.nullif(F.col("cc"), F.lit(0.0))
        both = d.join(q).withColumn("v", F.explode(F.array(F.struct(F.lit("R0").alias("spec"), F.col("__x").alias("u")), F.struct(F.lit("R1").alias("spec"), (F.col("__x") - part * F.col("__c")).alias("u")))))  # one row on the right
        both = both.select(a, "__y", "v.spec", "v.u", F.when(F.col("v.spec") == "R1", F.col("__c")).alias("__c"))
        m = both.groupBy("spec").agg(F.sum(F.col("u") * F.col("__y")).alias("uy"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.count("*").alias("n"), F.sum(F.col("__c") * F.col("__y")).alias("cy"), F.sum(F.col("__c") * F.col("__c")).alias("c2"))
        m = m.withColumn("slope", F.col("uy") / F.nullif(F.col("uu"), F.lit(0.0))).withColumn("gamma", F.coalesce(F.col("cy") / F.nullif(F.col("c2"), F.lit(0.0)), F.lit(0.0)))
        e = both.join(m, "spec").withColumn("s", F.col("u") * (F.col("__y") - F.col("slope") * F.col("u") - F.col("gamma") * F.coalesce("__c", F.lit(0.0))))
        meat = e.groupBy("spec", a).agg(F.sum("s").alias("g")).groupBy("spec").agg(F.sum(F.col("g") * F.col("g")).alias("meat"))
        parts.append(m.join(meat, "spec").select(F.lit(y).alias("y"), "spec", "slope", (F.sqrt("meat") / F.nullif(F.col("uu"), F.lit(0.0))).alias("se"), "n"))
    return reduce(DataFrame.unionByName, parts)


def screen_verdict(cells: DataFrame, bar: float) -> DataFrame:
    """One row of `screen`'s cells: the full-sample leg (|t| at the bar), the era leg (the bar and one sign in both), and both."""
    def of(name, col):
        return F.max(F.when(F.col("cell") == name, F.col(col)))

    g = cells.agg(*[of(c, "t").alias(f"t_{c.lower()}") for c in ("FULL", "TRAIN", "TEST")])
    full = F.coalesce(F.abs("t_full") >= bar, F.lit(False))
    eras = F.coalesce((F.abs("t_train") >= bar) & (F.abs("t_test") >= bar) & (F.signum("t_train") == F.signum("t_test")), F.lit(False))
    return g.select("t_full", "t_train", "t_test", full.alias("full_leg"), eras.alias("era_leg"), F.when(full & eras, "PASS").when(full, "FULL ONLY").otherwise("FAIL").alias("verdict"))
