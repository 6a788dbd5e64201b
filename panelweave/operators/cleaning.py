"""Admission, repair and adjustment of trade and price rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.mix import mix
from panelweave.operators.stats import quantiles


def admit(trades: DataFrame, kinds: list[str], id_length: tuple[int, int] = (1, 99)) -> DataFrame:
    """Trades of side 1 (buy) or 4 (sell), positive rate, an admitted kind and an id of right length."""
    ok = F.col("side").isin(1, 4) & (F.col("rate") > 0) & F.col("kind").isin(*kinds) & F.length("inst").between(*id_length)
    return trades.where(ok)


def mask_interval(df: DataFrame, date_col: str, low: str, high: str) -> DataFrame:
    """Rows outside the masked interval; apply before any window."""
    return df.where(~F.col(date_col).between(F.to_date(F.lit(low)), F.to_date(F.lit(high))))


def entity_id(col: Column) -> Column:
    """Missing tokens to null; a six-digit date suffix off ids of 17 to 19 characters."""
    text = F.trim(col)
    text = F.when(~F.lower(text).isin("", "null", "(null)", "nan", "none"), text)
    return F.when(F.length(text).between(17, 19), F.regexp_replace(text, r"\d{6}$", "")).otherwise(text)


def repair_year(date: Column) -> Column:
    """A two-digit year (20 for 2020) moved to this millennium."""
    return F.when(F.year(date) < 100, F.add_months(date, 24000)).otherwise(date)


def backfill(df: DataFrame, key: str, ts: str, col: str) -> DataFrame:
    """Nulls take the key's next value in time; rows that never get one are dropped."""
    w = Window.partitionBy(key).orderBy(ts).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(col, F.first(col, ignorenulls=True).over(w)).where(F.col(col).isNotNull())


def dedup_priority(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in `order` (which must be total)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def repair_shift(df: DataFrame, date_col: str, share: float = 0.05) -> DataFrame:
    """If more than `share` of the rows fall on weekends, all dates move a day forward."""
    weekend = df.agg(F.avg(F.dayofweek(date_col).isin(1, 7).cast("double")).alias("__weekend"))
    moved = F.date_add(date_col, F.when(F.col("__weekend") > share, 1).otherwise(0))
    return df.join(F.broadcast(weekend)).withColumn(date_col, moved).drop("__weekend")  # one row


def parse_split(text: Column) -> Column:
    """Factor old / new of a face-value split, within (1.01, 50]; else null."""
    pattern = r"(?i)from\s*rs\.?\s*([0-9.]+).*?to\s*(?:rs|re)\.?\s*([0-9.]+)"
    old, new = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    f = F.when(new > 0, old / new)
    return F.when((f > 1.01) & (f <= 50), f)


def parse_bonus(text: Column) -> Column:
    """Factor (a + b) / b of a bonus a:b, within (1.01, 20]; else null."""
    a, b = (F.regexp_extract(text, r"(?i)bonus[^0-9]*([0-9]+)\s*:\s*([0-9]+)", k).try_cast("double") for k in (1, 2))
    f = F.when(b > 0, (a + b) / b)
    return F.when((f > 1.01) & (f <= 20), f)


def combine_events(df: DataFrame, keys: list[str], factor: str) -> DataFrame:
    """One factor per key: the product of its events' factors."""
    return df.groupBy(*keys).agg(F.product(factor).alias("factor"), F.count("*").alias("n_events"))


def confirm(factor: Column, observed: Column, band: float = 1.30) -> Column:
    """Whether the observed price ratio lies within the log band of the factor; null if it is not known."""
    return F.when((observed > 0) & (factor > 0), F.abs(F.log(observed) - F.log(factor)) <= F.log(F.lit(band)))


def adjust_returns(df: DataFrame, ret: str, factor: str, confirmed: str) -> DataFrame:
    """ret_adj = (1 + ret) * factor - 1 on event days; null where the factor failed confirmation."""
    event = F.col(factor).isNotNull()
    adj = F.when(event & (F.col(confirmed) == F.lit(False)), None).when(event, (1 + F.col(ret)) * F.col(factor) - 1).otherwise(F.col(ret))
    return df.withColumn("ret_adj", adj)


def future_factor(df: DataFrame, key: str, ts: str, factor: str, close: str) -> DataFrame:
    """adj_close = close / product of the factors of later dates."""
    w = Window.partitionBy(key).orderBy(F.desc(ts)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.exp(F.coalesce(F.sum(F.log(F.coalesce(factor, F.lit(1.0)))).over(w), F.lit(0.0)))
    return df.withColumn("adj_close", F.col(close) / later)


def guard_returns(df: DataFrame, ret: str, limit: float = 0.5) -> DataFrame:
    """Returns beyond the limit become null and are flagged."""
    big = F.coalesce(F.abs(F.col(ret)) > limit, F.lit(False))
    return df.withColumn("flagged", big).withColumn(ret, F.when(~big, F.col(ret)))


def winsorise(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Values clipped to global (linear) quantiles."""
    out = df.join(F.broadcast(quantiles(df, col, [low, high], out="__q")))  # one row
    return out.withColumn(col, F.least(F.greatest(F.col(col), F.col("__q")[0]), F.col("__q")[1])).drop("__q")


def era(date: Column, train_end: str, test_start: str) -> Column:
    return F.when(date <= F.to_date(F.lit(train_end)), "TRAIN").when(date >= F.to_date(F.lit(test_start)), "TEST").otherwise("MASK")


def min_sequence(df: DataFrame, key: str, ts: str, n: int, causal: bool = False) -> DataFrame:
    """Keys with at least `n` rows; causally: rows from a key's n-th on."""
    if causal:
        count = F.row_number().over(Window.partitionBy(key).orderBy(ts))
    else:
        count = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("__n", count).where(F.col("__n") >= n).drop("__n")


def last_rows(df: DataFrame, key: str, ts: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(ts))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def random_block(df: DataFrame, key: str, ts: str, n: int, seed: int) -> DataFrame:
    """`n` consecutive rows of each key (a whole number) from a start drawn from key and seed."""
    rows = df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(ts))).withColumn("__m", F.count("*").over(Window.partitionBy(key)))
    start = mix(seed, F.greatest(F.col("__m") - n, F.lit(0)) + 1, F.col(key))
    return rows.where((F.col("__n") > start) & (F.col("__n") <= start + n)).drop("__n", "__m")


def check_extract(df: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(rule, column, violations): nulls of every column and values out of range, in one pass."""
    rules = [("null", c, F.col(c).isNull()) for c in columns] + [("range", c, ~F.col(c).between(a, b)) for c, (a, b) in ranges.items()]
    row = df.agg(*[F.count(F.when(x, 1)).alias(f"v{i}") for i, (_, _, x) in enumerate(rules)])
    cells = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(f"v{i}").alias("violations")) for i, (r, c, _) in enumerate(rules)])
    return row.select(F.inline(cells))


def null_months(df: DataFrame, date_col: str, col: str) -> DataFrame:
    """Per month: rows, share of nulls, and whether all are null."""
    null = F.col(col).isNull()
    return df.groupBy(F.date_format(date_col, "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.avg(null.cast("double")).alias("null_share"), F.every(null).alias("all_null")
    )


def malformed_ids(df: DataFrame, id_col: str, pattern: str, name_col: str) -> DataFrame:
    """Ids that do not match the pattern: records and different names."""
    return df.where(~F.col(id_col).rlike(pattern)).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("records"), F.countDistinct(name_col).alias("names"))


def on_calendar(df: DataFrame, calendar: DataFrame, date_col: str) -> DataFrame:
    return df.join(calendar.select(F.col("d").alias("__d")), F.col(date_col) == F.col("__d"), "left_semi")
