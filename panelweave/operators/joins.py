"""Point-in-time joins by public operations: no private as-of API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], lts: str, rts: str, values: list[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """`left` with the `values` (and time, as `<rts>_matched`) of the right row in force.

    Backward: the latest right row at or before (strict: before) the left time; forward: the
    earliest at or after (after).  Both sides are stacked and one window per key carries
    the last right row along, so each side is shuffled once and no pairs are made.  Of
    right rows with equal key and time the greatest by values counts.
    """
    forward = direction == "forward"
    r = right.groupBy(*by, rts).agg(F.max(F.struct(*values)).alias("__r")).select(*by, F.col(rts).alias("__t"), F.struct(F.col(rts).alias("t"), "__r.*").alias("__r"), F.lit(None).alias("__l"))
    l = left.select(*by, F.col(lts).alias("__t"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"), F.struct(*left.columns).alias("__l"))
    r = r.withColumn("__l", F.lit(None).cast(l.schema["__l"].dataType))
    # On equal times right rows stand before left ones unless the bound is strict.
    side = F.col("__l").isNotNull().cast("int") * (-1 if strict else 1)
    order = [F.desc("__t") if forward else F.asc("__t"), side]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = l.unionByName(r).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where(F.col("__l").isNotNull())
    return out.select("__l.*", *[F.col("__m")[v].alias(v) for v in values], F.col("__m")["t"].alias(f"{rts}_matched"))


def resolve(left: DataFrame, intervals: DataFrame, key: str, ts: str, start: str, end: str, value: str) -> DataFrame:
    """Point in half-open interval [start, end); an open end is null.

    A key's intervals do not overlap: the last that has begun is the only one that may
    hold the point, so an as-of join and a test of its end decide, and no pairs are made.
    """
    found = asof_join(left, intervals.select(key, start, end, value), [key], ts, start, [end, value])
    inside = F.col(end).isNull() | (F.col(ts) < F.col(end))
    return found.withColumn(value, F.when(inside, F.col(value))).drop(end, f"{start}_matched")


def nearest_event_days(left: DataFrame, events: DataFrame, by: list[str], lts: str, ets: str) -> DataFrame:
    """Days to the nearest event of the key on either side (null without any)."""
    e = events.select(*by, ets).distinct().withColumn("__e", F.col(ets))
    back = asof_join(left, e, by, lts, ets, ["__e"]).withColumnRenamed("__e", "__back").drop(f"{ets}_matched")
    both = asof_join(back, e, by, lts, ets, ["__e"], "forward").drop(f"{ets}_matched")
    return both.withColumn("days", F.least(F.datediff(lts, "__back"), F.datediff("__e", lts))).drop("__back", "__e")


def in_any_window(df: DataFrame, ts: str, windows: list[tuple[str, str, str]]) -> Column:
    """The label of the first listed window [from, to] that holds the time."""
    label = F.lit(None).cast("string")
    for name, a, b in reversed(windows):
        label = F.when(F.col(ts).between(F.to_date(F.lit(a)), F.to_date(F.lit(b))), name).otherwise(label)
    return label


def frame_diff(full: DataFrame, part: DataFrame, keys: list[str], col: str, tolerance: float = 0.0) -> DataFrame:
    """One row: worst difference, cells that differ by more than `tolerance`, and cells present on one side only."""
    j = full.select(*keys, F.col(col).alias("a")).join(part.select(*keys, F.col(col).alias("b")), keys, "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    diff = F.abs(F.col("a") - F.col("b"))
    return j.agg(
        F.max(diff).alias("worst"), F.count(F.when(both & (diff > tolerance), 1)).alias("differing"),
        F.count(F.when(F.col("a").isNotNull() & F.col("b").isNull(), 1)).alias("full_only"),
        F.count(F.when(F.col("a").isNull() & F.col("b").isNotNull(), 1)).alias("part_only"),
    )
