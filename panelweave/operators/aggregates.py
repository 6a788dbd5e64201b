"""Aggregations of trades and panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.windows import average_rank

KEY = ["inst", "d"]


def stockday_panel(trades: DataFrame) -> DataFrame:
    """Per (inst, d): values and counts by side, quantity, size deviation, entities, coverage, net and gross."""
    buy, sell, value = F.col("side") == 1, F.col("side") == 4, F.col("value")
    known = F.col("entity").isNotNull()
    p = trades.groupBy(*KEY).agg(
        F.sum(F.when(buy, value).otherwise(0.0)).alias("buy_value"), F.sum(F.when(sell, value).otherwise(0.0)).alias("sell_value"),
        F.count(F.when(buy, 1)).alias("n_buys"), F.count(F.when(sell, 1)).alias("n_sells"), F.sum("quantity").alias("total_qty"),
        F.stddev_samp("value").alias("size_sd"), F.countDistinct("entity").alias("n_entities"), F.coalesce(F.sum(F.when(known, value)), F.lit(0.0)).alias("valid_gross"),
    )
    p = p.withColumns({"net": F.col("buy_value") - F.col("sell_value"), "gross": F.col("buy_value") + F.col("sell_value"), "n": F.col("n_buys") + F.col("n_sells")})
    return p.withColumns({"mean_size": F.col("gross") / F.nullif(F.col("n"), F.lit(0)), "coverage": F.col("valid_gross") / F.nullif(F.col("gross"), F.lit(0.0))})


def entity_values(trades: DataFrame, side: int) -> DataFrame:
    return trades.where((F.col("side") == side) & F.col("entity").isNotNull()).groupBy("entity", *KEY).agg(F.sum("value").alias("v"))


def concentration(trades: DataFrame, side: int) -> DataFrame:
    """Herfindahl index of participants within (inst, d) on one side, and the attributed value."""
    c = entity_values(trades, side).groupBy(*KEY).agg(F.sum(F.col("v") * F.col("v")).alias("sq"), F.sum("v").alias("valid_value"))
    return c.select(*KEY, (F.col("sq") / F.nullif(F.col("valid_value") * F.col("valid_value"), F.lit(0.0))).alias("concentration"), "valid_value")


def book_focus(trades: DataFrame, side: int) -> DataFrame:
    """Value-weighted mean of the participants' own concentration across instruments that day."""
    e = entity_values(trades, side)
    own = e.groupBy("entity", "d").agg((F.sum(F.col("v") * F.col("v")) / F.nullif(F.sum("v") * F.sum("v"), F.lit(0.0))).alias("hhi"))
    return e.join(own, ["entity", "d"]).groupBy(*KEY).agg((F.sum(F.col("v") * F.col("hhi")) / F.nullif(F.sum("v"), F.lit(0.0))).alias("focus"))


def gate_coverage(df: DataFrame, covered: str, total: str, cols: list[str], least: float = 0.5) -> DataFrame:
    """Null where less than `least` of the value is attributed."""
    ok = F.col(covered) / F.nullif(F.col(total), F.lit(0.0)) >= least
    return df.withColumns({c: F.when(ok, F.col(c)) for c in cols})


def composition(trades: DataFrame, by: list[str], part: str) -> DataFrame:
    """Participants, largest share, entropy and Herfindahl index of value shares per group."""
    v = trades.groupBy(*by, part).agg(F.sum("value").alias("v"))
    s = v.withColumn("s", F.col("v") / F.nullif(F.sum("v").over(Window.partitionBy(*by)), F.lit(0.0)))
    return s.groupBy(*by).agg(F.count("*").alias("parts"), F.max("s").alias("top_share"), (-F.sum(F.col("s") * F.log("s"))).alias("entropy"), F.sum(F.col("s") * F.col("s")).alias("hhi"))


def market_flow(panel: DataFrame) -> DataFrame:
    """Per day: net, gross, imbalance, and breadth (share of net buyers less share of net sellers)."""
    return panel.groupBy("d").agg(
        F.sum("net").alias("net"), F.sum("gross").alias("gross"), (F.sum("net") / F.nullif(F.sum("gross"), F.lit(0.0))).alias("imbalance"),
        F.avg(F.signum("net")).alias("breadth"),
    )


def census(df: DataFrame, by: str, label: str) -> DataFrame:
    """Rows per (by, label) with their share of `by` and of all."""
    c = df.groupBy(by, label).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by))).withColumn("share_all", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def transition_matrix(df: DataFrame, key: str, order: list, state: str, states: list[str]) -> DataFrame:
    """Row-normalised transitions, one column per next state."""
    nxt = df.withColumn("__next", F.lead(state).over(Window.partitionBy(key).orderBy(*order))).where("__next is not null")
    m = nxt.groupBy(state).pivot("__next", states).agg(F.count(F.lit(1))).na.fill(0)
    total = sum(F.col(s) for s in states)
    return m.select(state, *[(F.col(s) / total).alias(f"to_{s}") for s in states])


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Observed and expected agreement of two labels, and Cohen's kappa, from one crosstab."""
    c = df.groupBy(a, b).agg(F.count("*").alias("n"))
    c = c.withColumn("ra", F.sum("n").over(Window.partitionBy(a))).withColumn("same", F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0))
    total, agree = F.sum("n"), F.sum("same")
    pa = c.groupBy(F.col(a).alias("k")).agg(F.sum("n").alias("na"))
    pb = c.groupBy(F.col(b).alias("k")).agg(F.sum("n").alias("nb"))
    exp = pa.join(pb, "k").agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    row = c.agg(total.alias("t"), agree.alias("g")).join(exp)  # one row each
    po, pe = F.col("g") / F.col("t"), F.col("x") / (F.col("t") * F.col("t"))
    return row.select(po.alias("observed"), pe.alias("expected"), ((po - pe) / F.nullif(1 - pe, F.lit(0.0))).alias("kappa"))


def funnel(df: DataFrame, value: str, steps: list[tuple[str, str]]) -> DataFrame:
    """Rows and value share left after each successive filter (name, SQL condition), in one pass."""
    aggs, cond = [F.sum(value).alias("__total")], F.lit(True)
    for i, (_, rule) in enumerate(steps):
        cond = cond & F.coalesce(F.expr(rule), F.lit(False))
        aggs += [F.count(F.when(cond, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0)).alias(f"v{i}")]
    cells = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(name).alias("name"), F.col(f"n{i}").alias("rows"), (F.col(f"v{i}") / F.nullif(F.col("__total"), F.lit(0.0))).alias("value_share")) for i, (name, _) in enumerate(steps)])
    return df.agg(*aggs).select(F.inline(cells))


def latency_curve(trades: DataFrame, calendar: DataFrame, event: str, report: str, max_lag: int) -> DataFrame:
    """Share of value and of rows reported within 0..max_lag calendar positions.

    Reports off the calendar or later than `max_lag` count as never.
    """
    a = calendar.select(F.col("d").alias(event), F.col("pos").alias("__a"))
    b = calendar.select(F.col("d").alias(report), F.col("pos").alias("__b"))
    j = trades.join(a, event).join(b, report, "left")
    j = j.withColumn("lag", F.col("__b") - F.col("__a"))
    t = j.groupBy("lag").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    t = t.withColumn("tv", F.sum("v").over(Window.partitionBy(F.lit(1)))).withColumn("tn", F.sum("n").over(Window.partitionBy(F.lit(1))))
    w = Window.partitionBy(F.lit(1)).orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)
    t = t.where(F.col("lag").between(0, max_lag))
    return t.select("lag", (F.sum("v").over(w) / F.nullif(F.col("tv"), F.lit(0.0))).alias("value_share"), (F.sum("n").over(w) / F.col("tn")).alias("count_share"))


def persistence(trades: DataFrame, key: str, date_col: str) -> DataFrame:
    """Distinct keys, and the median and mean number of months in which a key appears."""
    m = trades.groupBy(key).agg(F.countDistinct(F.trunc(date_col, "MM")).alias("months"))
    return m.agg(F.count("*").alias("keys"), F.median("months").alias("median_months"), F.avg("months").alias("mean_months"))


def record(df: DataFrame, date_col: str, distinct: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.min(date_col).alias("first"), F.max(date_col).alias("last"), *[F.countDistinct(c).alias(f"distinct_{c}") for c in distinct])


def variance_split(df: DataFrame, key: str, col: str) -> DataFrame:
    """Between- and within-key parts of the population variance."""
    g = df.groupBy(key).agg(F.count(col).alias("n"), F.avg(col).alias("m"), F.var_pop(col).alias("v"))
    w = g.agg(F.sum("n").alias("t"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mu"), F.sum(F.col("n") * F.col("v")).alias("wn"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("sq"))
    between = F.col("sq") / F.col("t") - F.col("mu") * F.col("mu")
    return w.select(between.alias("between_var"), (F.col("wn") / F.col("t")).alias("within_var"), (between / F.nullif(between + F.col("wn") / F.col("t"), F.lit(0.0))).alias("between_share"))


def median_autocorrelation(df: DataFrame, key: str, ts: str, col: str, min_n: int) -> DataFrame:
    lagged = df.withColumn("__l", F.lag(col).over(Window.partitionBy(key).orderBy(ts))).where(F.col("__l").isNotNull() & F.col(col).isNotNull())
    c = lagged.groupBy(key).agg(F.corr(col, "__l").alias("r"), F.count("*").alias("n")).where(F.col("n") >= min_n)
    return c.agg(F.median("r").alias("median_ac1"), F.count("r").alias("keys"))


def null_and_correlation(df: DataFrame, cols: list[str], least: float) -> DataFrame:
    """Pairs of columns with absolute correlation of at least `least`, and their null shares."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)], *[F.avg(F.col(c).isNull().cast("double")).alias(f"n_{c}") for c in cols])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"), F.col(f"n_{a}").alias("null_a"), F.col(f"n_{b}").alias("null_b")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(cells)).where(F.abs("corr") >= least)


def enrichment(df: DataFrame, label: str, hit: str) -> DataFrame:
    """Hit rate per class, its ratio to all other rows, and the two-proportion z."""
    g = df.groupBy(label).agg(F.count("*").alias("n"), F.sum(F.col(hit).cast("long")).alias("k"))
    w = Window.partitionBy(F.lit(1))
    g = g.withColumn("on", F.sum("n").over(w) - F.col("n")).withColumn("ok", F.sum("k").over(w) - F.col("k"))
    others = F.nullif(F.col("on"), F.lit(0))
    p1, p0 = F.col("k") / F.col("n"), F.col("ok") / others
    pool = (F.col("k") + F.col("ok")) / (F.col("n") + F.col("on"))
    z = (p1 - p0) / F.nullif(F.sqrt(pool * (1 - pool) * (1 / F.col("n") + 1 / others)), F.lit(0.0))
    return g.select(label, "n", "k", p1.alias("rate"), (p1 / F.nullif(p0, F.lit(0.0))).alias("ratio"), z.alias("z"))


def roll_spread(df: DataFrame, key: str, ts: str, ret: str) -> DataFrame:
    """2 sqrt(-cov(r, lagged r)) where negative, zero-return share and median absolute return."""
    l = df.withColumn("__l", F.lag(ret).over(Window.partitionBy(key).orderBy(ts)))
    g = l.groupBy(key).agg(F.covar_pop(ret, "__l").alias("c"), F.avg((F.col(ret) == 0).cast("double")).alias("zero_share"), F.median(F.abs(F.col(ret))).alias("median_abs"))
    return g.select(key, F.when(F.col("c") < 0, 2 * F.sqrt(-F.col("c"))).alias("spread"), "zero_share", "median_abs")


def range_proxy(df: DataFrame, key: str, high: str, low: str, close: str) -> DataFrame:
    """Median over keys of the keys' median relative range."""
    per = df.groupBy(key).agg(F.median((F.col(high) - F.col(low)) / F.nullif(F.col(close), F.lit(0.0))).alias("m"))
    return per.agg(F.median("m").alias("median_range"), F.count("*").alias("keys"))


def dissect(df: DataFrame, state: str, col: str) -> DataFrame:
    """Quartiles of a feature per state, and the shares below -0.5, between, and above 0.5."""
    x = F.col(col)
    return df.where(x.isNotNull()).groupBy(state).agg(
        *[F.percentile(col, F.lit(q)).alias(f"q{int(q * 100)}") for q in (0.25, 0.5, 0.75)],
        F.avg((x < -0.5).cast("double")).alias("low"), F.avg(x.between(-0.5, 0.5).cast("double")).alias("mid"), F.avg((x > 0.5).cast("double")).alias("high"),
    )


def yearly_shares(df: DataFrame, key: str, ts: str, value: str, label: str, labels: list[str]) -> DataFrame:
    return df.groupBy(key, F.year(ts).alias("year")).agg(F.log(F.sum(value)).alias("log_value"), *[F.avg((F.col(label) == s).cast("double")).alias(f"share_{s}") for s in labels])


def episode_summary(e: DataFrame, label: str) -> DataFrame:
    return e.groupBy(label).agg(F.count("*").alias("episodes"), F.avg("length").alias("mean"), F.median("length").alias("median"), F.percentile("length", F.lit(0.9)).alias("p90"), F.max("length").alias("longest"))


def truncation_share(df: DataFrame, key: str, ts: str, h: int) -> DataFrame:
    l = df.withColumn("__a", F.lead(ts, h).over(Window.partitionBy(key).orderBy(ts)))
    return l.agg(F.avg(F.col("__a").isNull().cast("double")).alias("truncated"), F.count("*").alias("n"))


def match_attrition(left: DataFrame, right: DataFrame, key: str, ts: str, label: str) -> DataFrame:
    """Why rows of `left` find no partner: key absent altogether, or present on other dates only."""
    keys = right.select(F.col(key).alias("__k")).distinct()
    cells = right.select(F.col(key).alias("__k2"), F.col(ts).alias("__t")).distinct()
    j = left.join(keys, F.col(key) == F.col("__k"), "left").join(cells, (F.col(key) == F.col("__k2")) & (F.col(ts) == F.col("__t")), "left")
    absent, other = F.col("__k").isNull(), F.col("__k").isNotNull() & F.col("__k2").isNull()
    return j.groupBy(label).agg(F.count("*").alias("n"), F.avg(absent.cast("double")).alias("key_absent"), F.avg(other.cast("double")).alias("other_date"), F.avg(F.col("__k2").isNotNull().cast("double")).alias("matched"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys, keys that repeat, and the largest number of rows of a key."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.count(F.when(F.col("n") > 1, 1)).alias("repeated"), F.max("n").alias("most"))


def universe(df: DataFrame, group: str, key: str, ts: str) -> DataFrame:
    return df.groupBy(group, F.year(ts).alias("year")).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"), F.countDistinct(ts).alias("days"))


def era_overlap(df: DataFrame, era: Column, ids: list[str]) -> DataFrame:
    """(id, early, late, both): how many values of each id column TRAIN and TEST rows hold, and how many stand in both."""
    parts = None
    for c in ids:
        per = df.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("k")).agg(F.max((era == "TRAIN").cast("int")).alias("a"), F.max((era == "TEST").cast("int")).alias("b"))
        one = per.agg(F.lit(c).alias("id"), F.sum("a").alias("early"), F.sum("b").alias("late"), F.sum(F.col("a") * F.col("b")).alias("both"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def rank_stability(df: DataFrame, key: str, era: Column, col: str) -> DataFrame:
    """One row: the keys with a mean in both eras, and the rank correlation of the two means."""
    m = df.groupBy(key).agg(F.avg(F.when(era == "TRAIN", F.col(col))).alias("a"), F.avg(F.when(era == "TEST", F.col(col))).alias("b")).dropna()
    m = m.withColumn("ra", average_rank("a")).withColumn("rb", average_rank("b"))  # one row a key
    return m.agg(F.count("*").alias("keys"), F.corr("ra", "rb").alias("rank_correlation"))


def enrichment_by_era(df: DataFrame, label: str, hit: str, era: Column) -> DataFrame:
    """`enrichment` within each of TRAIN and TEST."""
    parts = [enrichment(df.where(era == e), label, hit).withColumn("era", F.lit(e)) for e in ("TRAIN", "TEST")]
    return parts[0].unionByName(parts[1])


def stored_against(df: DataFrame, stored: str, again: Column, tol: float) -> DataFrame:
    """One row: rows, rows where a stored column and its recomputation differ by more than `tol` or one is missing, and the largest difference."""
    gap = F.abs(F.col(stored) - again)
    missing = F.col(stored).isNull() != again.isNull()
    return df.agg(F.count("*").alias("rows"), F.count(F.when((gap > tol) | missing, 1)).alias("mismatches"), F.max(gap).alias("worst"))
