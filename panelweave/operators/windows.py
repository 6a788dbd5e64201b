"""Windows over keyed, dated rows: rolling statistics, runs, ranks, calendars."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.normal import probit
from panelweave.operators.saved import carried


def rolling(agg, col, key: str, ts: str, width: int, min_n: int, lag: int = 0) -> Column:
    """`agg` of `col` over the `width` rows that end `lag` rows back; null below `min_n` values."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(-(width - 1 + lag), -lag)
    return F.when(F.count(col).over(w) >= min_n, agg(col).over(w))


def flow_beta(x: str, y: str, key: str, ts: str, width: int, min_n: int) -> Column:
    """Lagged rolling population covariance over the product of sample deviations."""
    def roll(agg, c):
        return rolling(agg, c, key, ts, width, min_n, 1)
    sx, sy = roll(F.stddev_samp, F.col(x)), roll(F.stddev_samp, F.col(y))
    cov = roll(F.avg, F.col(x) * F.col(y)) - roll(F.avg, F.col(x)) * roll(F.avg, F.col(y))
    return F.when((sx > 0) & (sy > 0), cov / (sx * sy))


def market_beta(x: str, y: str, key: str, ts: str, width: int, min_n: int) -> Column:
    """Lagged rolling slope of x on y (population moments)."""
    def roll(c):
        return rolling(F.avg, c, key, ts, width, min_n, 1)
    var = roll(F.col(y) * F.col(y)) - roll(F.col(y)) * roll(F.col(y))
    return F.when(var > 0, (roll(F.col(x) * F.col(y)) - roll(F.col(x)) * roll(F.col(y))) / var)


def forward_car(cum: str, key: str, ts: str, h: int) -> tuple[Column, Column]:
    """Cumulative return h rows ahead (or at the last row) less today's, and the truncation flag."""
    w = Window.partitionBy(key).orderBy(ts)
    last = F.last(cum).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ahead = F.lead(cum, h).over(w)
    return F.coalesce(ahead, last) - F.col(cum), ahead.isNull()


def with_runs(df: DataFrame, key: str, ts: str, state: str, max_gap: int | None = None) -> DataFrame:
    """`run`: number of the stretch of equal states within a key; a date gap beyond `max_gap` days breaks it."""
    w = Window.partitionBy(key).orderBy(ts)
    new = ~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)
    if max_gap is not None:
        new = new | F.coalesce(F.datediff(ts, F.lag(ts).over(w)) > max_gap, F.lit(False))
    return df.withColumn("__new", new.cast("int")).withColumn("run", F.sum("__new").over(w)).drop("__new")


def episodes(runs: DataFrame, key: str, ts: str, state: str, value: str) -> DataFrame:
    """One row per run: state, first and last date, length, mean value, state of the next run."""
    e = runs.groupBy(key, "run").agg(
        F.first(state).alias(state), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("length"), F.avg(value).alias("mean_value")
    )
    return e.withColumn("next_state", F.lead(state).over(Window.partitionBy(key).orderBy("run")))


def run_ages(runs: DataFrame, key: str, ts: str) -> DataFrame:
    """Age within the run, remaining rows, run end, and whether the run is cut by the end of the data."""
    in_run = Window.partitionBy(key, "run")
    age = F.row_number().over(in_run.orderBy(ts))
    last = F.max("run").over(Window.partitionBy(key))
    return runs.withColumns({"age": age, "remaining": F.count("*").over(in_run) - age, "run_end": F.max(ts).over(in_run), "censored": F.col("run") == last})


def streak(df: DataFrame, key: str, ts: str, sign: str) -> DataFrame:
    """Signed length of the run of equal signs as of the row before."""
    runs = with_runs(df, key, ts, sign)
    now = F.row_number().over(Window.partitionBy(key, "run").orderBy(ts)) * F.col(sign)
    runs = runs.withColumn("__now", now)
    return runs.withColumn("streak", F.lag("__now").over(Window.partitionBy(key).orderBy(ts))).drop("__now", "run")


def average_rank(col: str, *by: str) -> Column:
    """Rank with ties averaged; nulls have none."""
    over = Window.partitionBy(*by, F.col(col).isNull()).orderBy(col)
    ties = F.count("*").over(Window.partitionBy(*by, col))
    return F.when(F.col(col).isNotNull(), F.rank().over(over) + (ties - 1) / 2)


def probit_rank(df: DataFrame, day: str, col: str, out: str, eligible: str, min_names: int = 1) -> DataFrame:
    """Normal score of the within-day rank, rank / (n + 1), over eligible rows with a value."""
    df = df.withColumn("__m", F.when(F.col(eligible), F.col(col)))
    n = F.count("__m").over(Window.partitionBy(day))
    p = F.when(n >= min_names, average_rank("__m", day) / (n + 1))
    return df.withColumn("__p", p).withColumn(out, probit(F.col("__p"))).drop("__m", "__p")


def quintile(df: DataFrame, day: str, col: str) -> DataFrame:
    """ceil(5 * percentile rank) within the day."""
    n = F.count(col).over(Window.partitionBy(day))
    return df.withColumn("quintile", F.ceil(average_rank(col, day) / n * 5).cast("int"))


def trading_calendar(rows: DataFrame, day: str, key: str, min_names: int) -> DataFrame:
    """(d, pos): days on which at least `min_names` keys have rows, numbered.

    One row a day reaches the numbering, so its single ordered window stays small.
    """
    days = rows.groupBy(F.col(day).alias("d")).agg(F.countDistinct(key).alias("n")).where(F.col("n") >= min_names)
    return days.select("d", F.row_number().over(Window.orderBy("d")).alias("pos"))


def thin(df: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """Greedy thinning of a key's distinct dates: one stays if it is at least `days` after the last that stayed."""
    rows = df.select(key, ts).distinct().withColumn("__n", F.datediff(ts, F.lit("1970-01-01")).cast("double"))

    def step(last, n):
        return (n, (n,)) if last is None or n - last >= days else (last, None)

    return carried(rows, key, ts, ["__n"], lambda: None, step, "__n double").drop("__n")


def own_past_quintile(df: DataFrame, key: str, ts: str, col: str) -> DataFrame:
    """1 + floor(5 x the share of a key's values so far, this one too, that are smaller), at most 5."""

    def step(past, v):
        below = bisect_left(past, v)
        past.insert(below, v)
        return past, (float(min(5, 1 + 5 * below // len(past))),)

    return carried(df.where(F.col(col).isNotNull()), key, ts, [col], list, step, "quintile double").withColumn("quintile", F.col("quintile").cast("int"))


def ewma_variance(df: DataFrame, key: str, ts: str, ret: str, decay: float, burn: int, least: int | None = None) -> DataFrame:
    """Exponentially weighted variance per key, led in by the mean square of the first `burn` returns.

    v = decay * v + (1 - decay) * r^2 after each non-null return; missing days keep v.  It is
    given from the `least`-th return on (the `burn`-th, unless told otherwise).
    """
    least = least or burn

    def step(s, r):
        n, v = s
        if r is not None:
            n += 1
            v = v + (r * r - v) / n if n <= burn else decay * v + (1 - decay) * r * r
        return (n, v), (v if n >= least else None,)

    return carried(df, key, ts, [ret], lambda: (0, 0.0), step, "variance double")


def bounce_free_car(cum: str, key: str, ts: str, skip: int, h: int) -> tuple[Column, Column]:
    """Cumulated return of rows skip + 1 to h ahead, which leaves out the first ones and their bounce; and whether the data end before.

    Where they end, the last value stands for what is missing.
    """
    w = Window.partitionBy(key).orderBy(ts)
    last = F.last(cum).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    end, begin = F.lead(cum, h).over(w), F.lead(cum, skip).over(w)
    return F.coalesce(end, last) - F.coalesce(begin, last), end.isNull()


def held_impulse(df: DataFrame, key: str, ts: str, state: str, value, rows: int, mean: bool = False) -> DataFrame:
    """An impulse on the first row after a run of `value`, held for `rows` rows by its maximum or mean."""
    w = Window.partitionBy(key).orderBy(ts)
    i = F.when((F.col("__p") == value) & ~F.col(state).eqNullSafe(F.lit(value)), 1.0).otherwise(0.0)
    d = df.withColumn("__p", F.lag(state).over(w)).withColumn("__i", i)
    return d.withColumn("held", (F.avg if mean else F.max)("__i").over(w.rowsBetween(-(rows - 1), 0))).drop("__p", "__i")


def detection_lag(df: DataFrame, key: str, ts: str, causal: str, smoothed: str) -> DataFrame:
    """(label, runs, found, lag): per smoothed label its runs, those in which the causal label ever says the same, and the mean number of rows until it does."""
    w = Window.partitionBy(key).orderBy(ts)
    new = F.when(F.col(smoothed).eqNullSafe(F.lag(smoothed).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    d = df.withColumn("__r", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("__i", F.row_number().over(Window.partitionBy(key, "__r").orderBy(ts)) - 1)
    per = d.groupBy(key, "__r", F.col(smoothed).alias("label")).agg(F.min(F.when(F.col(causal) == F.col(smoothed), F.col("__i"))).alias("lag"))
    return per.groupBy("label").agg(F.count("*").alias("runs"), F.count("lag").alias("found"), F.avg("lag").alias("lag"))
