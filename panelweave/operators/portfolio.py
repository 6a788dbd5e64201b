"""Cross-sectional books as long tables: weights, lagged holdings, costs, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def weights(alpha: DataFrame, day: str, col: str, max_weight: float, rounds: int = 4) -> DataFrame:
    """Per day: `rounds` times demeaned, scaled to absolute sum 1 and clipped, then scaled again.

    Rows without a value are out of the universe.
    """
    w = Window.partitionBy(day)
    df = alpha.where(F.col(col).isNotNull()).withColumn("w", F.col(col))
    for _ in range(rounds):
        df = df.withColumn("w", F.col("w") - F.avg("w").over(w))
        df = df.withColumn("w", F.col("w") / F.nullif(F.sum(F.abs("w")).over(w), F.lit(0.0)))
        df = df.withColumn("w", F.greatest(F.least("w", F.lit(max_weight)), F.lit(-max_weight)))
    return df.withColumn("w", F.col("w") / F.nullif(F.sum(F.abs("w")).over(w), F.lit(0.0)))


def book(w: DataFrame, returns: DataFrame, calendar: DataFrame, lag: int, cost_bps: float) -> DataFrame:
    """Daily gross and net return and turnover of weights held from 1 + lag calendar days on.

    Turnover is the absolute change of holdings over all names; half of it is given too.
    """
    cal = calendar.select(F.col("d"), "pos")
    held = w.join(cal, "d").select("inst", (F.col("pos") + 1 + lag).alias("pos"), "w")
    held = held.join(calendar.select("pos"), "pos")
    gone = held.select("inst", (F.col("pos") + 1).alias("pos"), (-F.col("w")).alias("w")).join(calendar.select("pos"), "pos")
    turn = held.select("inst", "pos", "w").unionByName(gone).groupBy("inst", "pos").agg(F.sum("w").alias("dw")).groupBy("pos").agg(F.sum(F.abs("dw")).alias("turnover"))
    r = returns.where(F.col("ret").isNotNull()).join(cal, "d").select("inst", "pos", "ret")
    pnl = held.join(r, ["inst", "pos"], "left").groupBy("pos").agg(F.coalesce(F.sum(F.col("w") * F.col("ret")), F.lit(0.0)).alias("gross"))
    out = calendar.join(pnl, "pos", "left").join(turn, "pos", "left").na.fill(0.0, ["gross", "turnover"])
    return out.select("d", "gross", "turnover", (F.col("turnover") / 2).alias("half_turnover"), (F.col("gross") - cost_bps * 1e-4 * F.col("turnover")).alias("net"))


def drawdown(b: DataFrame, ts: str, pnl: str) -> DataFrame:
    """Cumulative sum less its running maximum (a short table, one row a day)."""
    w = Window.partitionBy(F.lit(1)).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    c = b.withColumn("cum", F.sum(pnl).over(w))
    return c.withColumn("drawdown", F.col("cum") - F.max("cum").over(w))


def metrics(b: DataFrame, ts: str, pnl: str, periods: float) -> DataFrame:
    """Annualised return, volatility, Sharpe, Sortino, drawdown, Calmar, hit rate, margin in bps."""
    d = drawdown(b, ts, pnl)
    a = d.agg(F.avg(pnl).alias("m"), F.stddev_samp(pnl).alias("s"), F.sqrt(F.avg(F.least(F.col(pnl), F.lit(0.0)) ** 2)).alias("down"), F.min("drawdown").alias("dd"), F.avg((F.col(pnl) > 0).cast("double")).alias("hit"), (F.sum(pnl) / F.nullif(F.sum("turnover"), F.lit(0.0)) * 1e4).alias("margin_bps"))
    m, root = F.col("m") * periods, F.sqrt(F.lit(periods))
    return a.select(m.alias("ret"), (F.col("s") * root).alias("vol"), (m / F.nullif(F.col("s") * root, F.lit(0.0))).alias("sharpe"), (m / F.nullif(F.col("down") * root, F.lit(0.0))).alias("sortino"), F.col("dd").alias("max_drawdown"), (m / F.nullif(-F.col("dd"), F.lit(0.0))).alias("calmar"), "hit", "margin_bps")


def cost_grid(b: DataFrame, costs: list[float], periods: float) -> DataFrame:
    """Sharpe after each cost per unit of turnover, and the breakeven cost; one pass, one row per cost."""
    c = b.withColumn("cost_bps", F.explode(F.array(*map(F.lit, costs)))).withColumn("__n", F.col("gross") - F.col("cost_bps") * 1e-4 * F.col("turnover"))
    return c.groupBy("cost_bps").agg((F.avg("__n") / F.nullif(F.stddev_samp("__n"), F.lit(0.0)) * F.sqrt(F.lit(periods))).alias("sharpe"), (F.sum("gross") / F.nullif(F.sum("turnover"), F.lit(0.0)) * 1e4).alias("breakeven_bps"))


def reversal(df: DataFrame, key: str, ts: str, ret: str, width: int) -> DataFrame:
    """Minus the trailing sum of returns."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(-(width - 1), 0)
    return df.withColumn("alpha", F.when(F.count(ret).over(w) == width, -F.sum(ret).over(w)))


def fitness(b: DataFrame, pnl: str, periods: float, least_turnover: float = 0.125) -> DataFrame:
    """One row: Sharpe ratio, mean turnover, and their trade-off, Sharpe * sqrt(|annual return| / max(turnover, least_turnover)), over days with a holding or a trade."""
    d = b.where((F.abs("turnover") + F.abs(F.col(pnl))) > 0)
    a = d.agg(F.count("*").alias("days"), (F.avg(pnl) * periods).alias("ret"), (F.avg(pnl) / F.nullif(F.stddev_samp(pnl), F.lit(0.0)) * F.sqrt(F.lit(periods))).alias("sharpe"), F.avg("turnover").alias("turnover"))
    return a.select("days", "sharpe", "turnover", (F.col("sharpe") * F.sqrt(F.abs("ret") / F.greatest("turnover", F.lit(least_turnover)))).alias("fitness"))


def gated(df: DataFrame, alpha: str, gate: Column, out: str) -> DataFrame:
    """The signal where the gate holds, and none (a null) elsewhere: those names are out of the book that day."""
    return df.withColumn(out, F.when(F.coalesce(gate, F.lit(False)), F.col(alpha)))


def switched(df: DataFrame, first: str, second: str, use_first: Column, out: str) -> DataFrame:
    """One of two signals, each within-day centred and scaled before, by a condition known that day."""
    return df.withColumn(out, F.when(use_first, F.col(first)).otherwise(F.col(second)))


def standard_signal(df: DataFrame, day: str, col: str) -> DataFrame:
    """`col` less its mean of the day, over its spread of the day; null where there is none."""
    w = Window.partitionBy(day)
    return df.withColumn(col, (F.col(col) - F.avg(col).over(w)) / F.nullif(F.stddev_pop(col).over(w), F.lit(0.0)))


def alignment_gate(b: DataFrame, future: DataFrame, ts: str) -> DataFrame:
    """One row: days, and the largest difference of a book's gross return when all returns after a day are replaced: it must be 0 up to that day."""
    j = b.select(ts, F.col("gross").alias("__a")).join(future.select(ts, F.col("gross").alias("__b")), ts)
    return j.agg(F.count("*").alias("days"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("worst"))
