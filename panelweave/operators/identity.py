"""Identifier chains resolved point in time, as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.saved import saved


def admit_edges(edges: DataFrame, tiers: list[str]) -> DataFrame:
    """Dated edges of admitted tiers between different ids; the earliest per source (then least target)."""
    ok = edges.where(F.col("old_id").isNotNull() & F.col("new_id").isNotNull() & F.col("ca_date").isNotNull() & (F.col("old_id") != F.col("new_id")) & F.col("tier").isin(*tiers))
    w = Window.partitionBy("old_id").orderBy("ca_date", "new_id")
    return ok.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def break_reciprocal(edges: DataFrame, permanent: str) -> DataFrame:
    """Of a -> b and b -> a the edge out of the less permanent form stays; of equals neither.

    `permanent` is a SQL condition over `id`.
    """
    def is_permanent(c):
        return F.expr(permanent.replace("id", c))
    back = edges.select(F.col("old_id").alias("__n"), F.col("new_id").alias("__o"))
    pair = edges.join(back, (F.col("old_id") == F.col("__o")) & (F.col("new_id") == F.col("__n")), "left")
    keep = F.col("__o").isNull() | (is_permanent("new_id") & ~is_permanent("old_id"))
    return pair.where(keep).drop("__o", "__n")


def chain_intervals(edges: DataFrame) -> DataFrame:
    """old_id, canonical_id, effective_from (null: ever), effective_to (null: open), depth, confidence.

    edges: at most one per old_id, with a `tier` (the least is the surest).  An id stands for
    itself up to its edge's date (depth 0, confidence SELF); from the date of each further edge
    on the chain goes one deeper.  It stops at an id already met and where the date goes
    backwards (equal dates go on).  `confidence` is the weakest tier of the whole chain.
    Chains grow together, one join over edges a round, until none grows any more; edges and
    rounds are cut by checkpoints, so that what the edges come from is worked out once.
    """
    return _intervals(saved(edges.select("old_id", "new_id", "ca_date", "tier")))


def _intervals(e: DataFrame) -> DataFrame:
    """The chains of saved edges."""
    nxt = e.toDF("__o", "__n", "__d", "__t")
    step = e.select("old_id", F.col("new_id").alias("canonical_id"), F.col("ca_date").alias("effective_from"), F.lit(1).alias("depth"), "tier", F.array("old_id", "new_id").alias("seen"))
    rounds = []
    while True:
        step = saved(step)
        if step.isEmpty():
            break
        rounds.append(step)
        grown = step.join(nxt, F.col("canonical_id") == F.col("__o")).where(~F.array_contains("seen", F.col("__n")) & (F.col("__d") >= F.col("effective_from")))
        step = grown.select("old_id", F.col("__n").alias("canonical_id"), F.col("__d").alias("effective_from"), (F.col("depth") + 1).alias("depth"), F.greatest("tier", "__t").alias("tier"), F.concat("seen", F.array("__n")).alias("seen"))
    self_ = e.select("old_id", F.col("old_id").alias("canonical_id"), F.lit(None).cast("date").alias("effective_from"), F.lit(0).alias("depth"), "tier")
    out = reduce(DataFrame.unionByName, [self_, *[r.drop("seen") for r in rounds]])
    w = Window.partitionBy("old_id")
    weakest = F.when(F.col("depth") == 0, "SELF").otherwise(F.max("tier").over(w))
    return out.withColumn("effective_to", F.lead("effective_from").over(w.orderBy("depth"))).withColumn("confidence", weakest).drop("tier")


def interval_gates(intervals: DataFrame) -> DataFrame:
    """One row: intervals, non-monotone ones, self targets beyond the first, and holes between neighbours."""
    w = Window.partitionBy("old_id").orderBy("depth")
    prev = F.lag("effective_to").over(w)
    d = intervals.withColumn("__hole", (F.col("depth") > 0) & ~prev.eqNullSafe(F.col("effective_from")))
    return d.agg(F.count("*").alias("n"), F.count(F.when(F.col("effective_to") < F.col("effective_from"), 1)).alias("not_monotone"), F.count(F.when((F.col("canonical_id") == F.col("old_id")) & (F.col("depth") > 0), 1)).alias("self"), F.count(F.when(F.col("__hole"), 1)).alias("holes"))


def hindsight_gate(edges: DataFrame, cut: str) -> DataFrame:
    """One row: intervals that begin by `cut` and are not the same when built of edges up to `cut` alone."""
    cols, day = ["old_id", "canonical_id", "effective_from", "depth"], F.to_date(F.lit(cut))
    e = saved(edges.select("old_id", "new_id", "ca_date", "tier"))
    full = _intervals(e).where((F.col("depth") > 0) & (F.col("effective_from") <= day)).select(*cols)
    part = _intervals(e.where(F.col("ca_date") <= day)).where("depth > 0").select(*cols)
    both = full.withColumn("side", F.lit(1)).unionByName(part.withColumn("side", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("side").alias("s")).agg(F.count(F.when(F.col("s") != 0, 1)).alias("hindsight"), F.count("*").alias("intervals"))


def overlaps(df: DataFrame, key: str, start: str, end: str, name: str) -> DataFrame:
    """Intervals that begin before some earlier one of their key has ended, with `prev_end`, the latest end so far.

    Intervals are in order of start, end and `name`; a null end is open, later than all dates,
    and `prev_end` is null where an open interval came before.
    """
    never = F.to_date(F.lit("9999-12-31"))
    until = F.coalesce(end, never)
    w = Window.partitionBy(key).orderBy(F.col(start), until, F.col(name)).rowsBetween(Window.unboundedPreceding, -1)
    d = df.where(F.col(start).isNotNull()).withColumn("prev_end", F.max(until).over(w))
    return d.where(F.col("prev_end") > F.col(start)).withColumn("prev_end", F.nullif("prev_end", never))


def lifetimes(df: DataFrame, group: str, key: str, ts: str) -> DataFrame:
    """Per group: keys, and whether their lifetimes are disjoint (fragments) or overlap (coexist)."""
    life = df.groupBy(group, key).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    life = life.withColumn("__next", F.lead("a").over(Window.partitionBy(group).orderBy("a", "b", key)))
    ok = F.bool_and(F.coalesce(F.col("__next") > F.col("b"), F.lit(True)))
    return life.groupBy(group).agg(F.count("*").alias("keys"), F.when(ok, "fragment").otherwise("coexist").alias("kind"))


def name_similarity(df: DataFrame, a: str, b: str) -> DataFrame:
    """Jaccard similarity of the words of two names."""
    x, y = F.split(F.lower(a), " "), F.split(F.lower(b), " ")
    return df.withColumn("similarity", F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def issuer_groups(rows: DataFrame, key: str, day: str, issuer: Column, most_overlap: int) -> DataFrame:
    """(issuer, key, ids, overlap_days, canonical): the ids of an issuer, and what each is carried under.

    Ids of one issuer that follow one another are carried under the one that is seen last (of
    equal last days the greatest); if they are seen together on more than `most_overlap` days
    they exist side by side and each stays itself.  Ids of different issuers never meet.
    """
    seen = rows.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(issuer.alias("issuer"), F.col(key).alias("key"), F.col(day).alias("day")).distinct()
    both = seen.groupBy("issuer", "day").agg(F.count("*").alias("n")).groupBy("issuer").agg(F.count(F.when(F.col("n") > 1, 1)).alias("overlap_days"))
    ids = seen.groupBy("issuer", "key").agg(F.max("day").alias("last"))
    top = ids.groupBy("issuer").agg(F.count("*").alias("ids"), F.max_by("key", F.struct("last", "key")).alias("terminal"))
    j = ids.join(top, "issuer").join(both, "issuer")
    return j.select("issuer", "key", "ids", "overlap_days", F.when(F.col("overlap_days") <= most_overlap, F.col("terminal")).otherwise(F.col("key")).alias("canonical"))
