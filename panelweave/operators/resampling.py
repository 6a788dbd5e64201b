"""Resampling by integer draws: they depend on (seed, replicate, place) alone, so they repeat anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.mix import PRIME, _seed, mix


def _numbered(daily: DataFrame, ts: str) -> DataFrame:
    """`daily` (one row a date) with `__pos` from 0 and `__n`, the number of dates."""
    w = Window.partitionBy(F.lit(1))
    return daily.withColumn("__pos", F.row_number().over(w.orderBy(ts)) - 1).withColumn("__n", F.count("*").over(w))


def block_walk(daily: DataFrame, ts: str, replicates: int, mean_block: int, seed: int) -> DataFrame:
    """(rep, all columns of `daily`): as many dates as there are, in blocks of random length.

    Each replicate walks the dates in a ring: with probability 1 / mean_block it jumps to a
    drawn date, else it takes the next one.  Work is replicates x dates, not rows.
    """
    d = _numbered(daily, ts)
    walk = d.select(F.col("__pos").alias("pos"), F.col("__n").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    jump = (F.col("pos") == 0) | (mix(seed, mean_block, F.col("rep"), F.col("pos")) == 0)
    walk = walk.withColumn("at", F.when(jump, mix(seed + 1, F.col("n"), F.col("rep"), F.col("pos")))).withColumn("from", F.when(jump, F.col("pos")))
    r = Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    src = F.pmod(F.last("at", ignorenulls=True).over(r) + F.col("pos") - F.last("from", ignorenulls=True).over(r), F.col("n"))
    return walk.select("rep", src.cast("int").alias("__pos")).join(d.drop("__n"), "__pos").drop("__pos")


def block_bootstrap(daily: DataFrame, ts: str, total: str, weight: str, replicates: int, mean_block: int, seed: int) -> DataFrame:
    """Stationary date-block bootstrap of sum(total) / sum(weight) from one row per date."""
    drawn = block_walk(daily.select(ts, total, weight), ts, replicates, mean_block, seed)
    return drawn.groupBy("rep").agg((F.sum(total) / F.nullif(F.sum(weight), F.lit(0.0))).alias("estimate"))


def block_draws(daily: DataFrame, ts: str, block: int, replicates: int, seed: int) -> DataFrame:
    """(rep, all columns of `daily`): as many dates as there are, in moving blocks of `block` that run in a ring."""
    d = _numbered(daily, ts)
    slots = d.select(F.col("__pos").alias("slot"), F.col("__n").alias("n")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    start = mix(seed, F.col("n"), F.col("rep"), F.floor(F.col("slot") / block))
    drawn = slots.select("rep", F.pmod(start + F.col("slot") % block, F.col("n")).cast("int").alias("__pos"))
    return drawn.join(d.drop("__n"), "__pos").drop("__pos")


def sharpe_difference(daily: DataFrame, ts: str, a: str, b: str, block: int, replicates: int, seed: int, periods: float) -> DataFrame:
    """Per replicate the Sharpe ratio of `a` less that of `b` on the same drawn dates."""
    def sharpe(c):
        return F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0)) * periods**0.5
    return block_draws(daily, ts, block, replicates, seed).groupBy("rep").agg((sharpe(a) - sharpe(b)).alias("difference"))


def run_permutation(df: DataFrame, key: str, ts: str, label: str, value: str, replicates: int, seed: int) -> DataFrame:
    """Number of runs of `value` in `label`, observed (rep 0) and with labels shuffled within keys.

    A key's labels are shuffled in one pass, which gives one number a replicate.
    """

    def runs(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = (pdf.sort_values(ts)[label] == value).to_numpy()
        pos = np.arange(len(hit), dtype=np.int64)
        out = []
        for rep in range(replicates + 1):
            x = np.full(len(hit), _seed(seed), np.int64)
            for part in (np.int64(rep), pos):
                x = (x * 48271 + part % PRIME + 1) % PRIME
                x = (x * x + 1013904223) % PRIME
            x = (x * x + 12345) % PRIME
            h = hit[np.lexsort((pos, x))] if rep else hit
            out.append(int(h[0]) + int((h[1:] & ~h[:-1]).sum()))
        return pd.DataFrame({"rep": range(replicates + 1), "runs": out})

    return df.select(key, ts, label).groupBy(key).applyInPandas(runs, "rep int, runs long").groupBy("rep").agg(F.sum("runs").alias("runs"))
