"""Filter interaction audit: what every order of several filters removes, by relations of failing ids."""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import materialize

SPACE = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """The four failure conditions that a text alone decides, over a non-null text."""
    words = F.array_remove(F.split(text, SPACE), "")
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failing_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, dict[str, DataFrame]]:
    """(rows, fails): a row of (rid, id, part) for each document, and a table (rid, part) of those that fail each filter.

    Every text is read once.  E, a text that a smaller id has, is an anti join of all rows
    with the smallest id of each text, on the pair of both, so that copies of one text spread
    over the tasks.  Texts are compared by their SHA-256.  `rid` numbers the rows: rows that
    repeat an id are documents of their own (neither id is the smaller, so neither fails E
    for the other), and a null id counts as larger than any other.
    """
    text = F.coalesce(text_col, F.lit(""))
    flags = conditions(F.col("t"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("t"))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "part", F.unhex(F.sha2("t", 256)).alias("h"), *[c.alias(k) for k, c in flags.items()])
    rows = materialize(rows, "audit-rows")
    least = rows.groupBy(F.col("h").alias("h0")).agg(F.min("id").alias("id0"))
    later = rows.join(least, (F.col("h") == F.col("h0")) & F.col("id").eqNullSafe(F.col("id0")), "left_anti")
    fails = {k: materialize(rows.where(k).select("rid", "part"), f"audit-fails-{k}") for k in flags}
    fails["E"] = materialize(later.select("rid", "part"), "audit-fails-E")
    return rows.select("rid", "id", "part"), fails


def prefix_counts(rows: DataFrame, fails: dict[str, DataFrame], marked: dict[str, DataFrame]) -> DataFrame:
    """(part, mask, f, kept, removed, redundant, *marked): what filter `f` does after the set of filters `mask`.

    Orders that begin with the same set of filters have the same survivors, so relations are
    kept for each set, not for each order.  The survivors of all sets of k filters are one
    table (mask, rid, part).  Each goes to every filter that its set lacks and meets that
    filter's id table: a left-semi join gives the removed rows, a left-anti join the survivors
    of the sets of k + 1.  Ids of a filter's table without a survivor are redundant, and
    removed rows in a marked id table (rid) are lost.  `rows` and the tables may be empty.
    """
    names = sorted(fails)
    n = len(names)
    bit = F.expr("shiftleft(1, f)")
    every = reduce(DataFrame.union, [fails[c].select(F.lit(i).alias("f"), "rid", "part") for i, c in enumerate(names)])
    ids = every.select("f", "rid")
    alive = rows.select(F.lit(0).alias("mask"), "rid", "part")
    survivors, removed = [alive], []
    lacks = F.filter(F.array(*map(F.lit, range(n))), lambda i: F.col("mask").bitwiseAND(F.element_at(F.array(*[F.lit(1 << j) for j in range(n)]), i + 1)) == 0)
    for k in range(n):
        tried = alive.select("mask", F.explode(lacks).alias("f"), "rid", "part")
        removed.append(materialize(tried.join(ids, ["f", "rid"], "left_semi"), f"audit-removed-{k}"))
        once = tried.where(F.col("mask") < bit)  # each larger set from one smaller set alone
        alive = materialize(once.join(ids, ["f", "rid"], "left_anti").select(F.col("mask").bitwiseOR(bit).alias("mask"), "rid", "part"), f"audit-alive-{k + 1}")
        survivors.append(alive)
    gone, left = reduce(DataFrame.unionByName, removed), reduce(DataFrame.union, survivors)
    sets = F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: F.element_at(F.array(*[m.bitwiseAND(1 << j) for j in range(n)]), F.col("f") + 1) == 0)
    redundant = every.select(F.explode(sets).alias("mask"), "f", "rid", "part").join(left.select("mask", "rid"), ["mask", "rid"], "left_anti")
    found = {"removed": gone, "redundant": redundant, **{c: gone.join(m.select("rid"), "rid", "left_semi") for c, m in marked.items()}}
    out = [materialize(df.groupBy("part", "mask", "f").agg(F.count("*").alias("n")), f"audit-count-{c}").withColumn("what", F.lit(c)) for c, df in found.items()]
    kept = materialize(left.groupBy("part", "mask").agg(F.count("*").alias("n")), "audit-count-kept")
    kept = kept.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).where(F.col("mask").bitwiseAND(bit) != 0)
    out.append(kept.select("part", (F.col("mask") - bit).alias("mask"), "f", "n", F.lit("kept").alias("what")))
    counts = reduce(DataFrame.unionByName, out).groupBy("part", "mask", "f").agg(*[F.sum(F.when(F.col("what") == c, F.col("n"))).alias(c) for c in ("kept", *found)])
    pairs = rows.select("part").distinct().withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("mask", F.explode(sets))
    return pairs.join(counts, ["part", "mask", "f"], "left").na.fill(0)


def all_orders(counts: DataFrame, names: list[str], marked: list[str]) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, *marked, shapley) from `prefix_counts`.

    A pair of a set and a filter stands in the orders that begin with the set and go on with
    the filter; a row joins with those orders alone.
    """
    n = len(names)
    orders = [(sum(1 << i for i in p[:s]), p[s], "".join(names[i] for i in p), s + 1) for p in permutations(range(n)) for s in range(n)]
    table = counts.sparkSession.createDataFrame(orders, "mask int, f int, filter_order string, step int")  # n * n! rows
    by_filter = Window.partitionBy("part", "f")  # at most 2**(n - 1) rows
    times = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), (F.bit_count("mask") + 1).cast("int"))
    rows = counts.withColumn("shapley", F.sum(F.col("removed") * times).over(by_filter))
    others = F.expr(f"{(1 << n) - 1} - shiftleft(1, f)")
    rows = rows.withColumn("unique_fails", F.sum(F.when(F.col("mask") == others, F.col("removed"))).over(by_filter))
    rows = rows.join(F.broadcast(table), ["mask", "f"])
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *marked, "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each step of every order of the five filters does, one row a part, order and step.

    good_lost and toxic_lost count removed documents with a row of quality 1, or toxic 1, in
    `labels`; documents without one, or with a null id, count in neither, and a label that
    repeats counts once.  A null text is empty, a null part the empty string.  Texts are read
    whole.  An empty table gives no rows; empty labels give no losses.  Only the named columns
    are read, so other columns may have any name.
    """
    rows, fails = failing_tables(docs, id_col, text_col, part_col)
    marked = {}
    for c, flag in (("good_lost", "quality"), ("toxic_lost", "toxic")):
        ids = labels.where(F.col(flag) == 1).select(F.col(id_col).alias("id"))
        marked[c] = materialize(rows.join(ids, "id", "left_semi").select("rid"), f"audit-{c}")
    counts = materialize(prefix_counts(rows, fails, marked), "audit-counts")
    return all_orders(counts, sorted(fails), list(marked))
