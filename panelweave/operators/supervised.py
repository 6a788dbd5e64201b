"""Walk-forward classifiers, decisions on their forecasts, boosted trees over feature blocks, and attribution by permutation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.saved import saved
from panelweave.operators.stats import daily_ic, hazard_by_age, hazard_within


def run_rows(df: DataFrame, key: str, ts: str, state: str, value, max_gap: int) -> DataFrame:
    """Rows of the runs of `value`, with run, age (from 1), left (rows to the run's end), run_end and censored.

    A run ends where the state changes or where more than `max_gap` days lie between two
    rows.  It is censored if it reaches the key's last row of the state, since its true end
    is then unknown.
    """
    w = Window.partitionBy(key).orderBy(ts)
    new = ~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.datediff(ts, F.lag(ts).over(w)) > max_gap) | (F.row_number().over(w) == 1)
    d = df.withColumn("run", F.sum(F.when(new, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col(state) == value)
    whole = Window.partitionBy(key, "run")
    d = d.withColumn("age", F.row_number().over(whole.orderBy(ts))).withColumn("left", F.count("*").over(whole) - F.col("age")).withColumn("run_end", F.max(ts).over(whole))
    return d.withColumn("censored", F.col("run_end") == F.max(ts).over(Window.partitionBy(key)))


def ends_within(k: int) -> Column:
    """1 if the run ends within k rows, 0 if not, null where censoring leaves it open."""
    return F.when(~(F.col("censored") & (F.col("left") < k)), (F.col("left") <= k - 1).cast("int"))


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    """`df` with a vector of its features; a missing value is left to the trees as -1e6, apart from all others."""
    filled = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(-1e6)).alias(f"__f{i}") for i, c in enumerate(features)]
    d = df.select("*", *filled)
    return VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol="__x").transform(d).drop(*[f"__f{i}" for i in range(len(features))])


def walk_forward_hazard(
    rows: DataFrame, ts: str, features: list[str], k: int, years: list[int], embargo_days: int = 10, least: int = 2000, cap: int = 15, thin: int = 50, trees: int = 20, depth: int = 4, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(forecasts, folds) of whether a run ends within k rows, each year by a model refitted on what came before.

    rows: `run_rows`.  A year is forecast by trees that were grown on rows more than
    `embargo_days` before its first day, beside two baselines from the same rows: the
    discrete hazard by age, and the share of ends.  Forecasts carry all columns of `rows`, y,
    p_model, p_age and p_share; folds has per year the rows and the last day of training, and
    the first day of the forecasts.  Years with fewer than `least` training rows, or one class
    alone, are left out; if all are, both tables are empty, with the same columns.
    """
    d = saved(rows.withColumn("y", ends_within(k)).where(F.col("y").isNotNull()))
    out, folds = [], []
    for year in years:
        cut = F.date_sub(F.make_date(F.lit(year), F.lit(1), F.lit(1)), embargo_days)
        train, test = d.where(F.col(ts) < cut), d.where(F.year(ts) == year)
        n = train.agg(F.count("*").alias("n"), F.avg(F.col("y").cast("double")).alias("share"), F.max(ts).alias("last")).first()
        if n["n"] < least or not 0 < n["share"] < 1:
            continue
        model = GBTClassifier(featuresCol="__x", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=20, seed=seed).fit(assembled(train, features).select("__x", F.col("y").cast("double").alias("y")))
        scored = model.transform(assembled(test, features)).withColumn("p_model", vector_to_array("probability")[1])
        h = hazard_within(hazard_by_age(train.withColumn("__end", (F.col("left") == 0).cast("int")), "age", "__end", cap, thin), k).select(F.col("age").alias("__age"), F.col("within").alias("p_age"))
        scored = scored.join(F.broadcast(h), F.least("age", F.lit(cap)) == F.col("__age"), "left")  # one row an age
        eps = F.lit(1e-6)
        ps = {"p_model": F.col("p_model"), "p_age": F.coalesce("p_age", F.lit(n["share"])), "p_share": F.lit(n["share"])}
        out.append(scored.select(*d.columns, *[F.least(F.greatest(p, eps), 1 - eps).alias(c) for c, p in ps.items()]))
        folds.append(test.agg(F.lit(year).alias("year"), F.lit(n["n"]).alias("train_rows"), F.lit(n["last"]).alias("last_train"), F.min(ts).alias("first_test"), F.count("*").alias("test_rows")))
    if not out:
        none = d.limit(0)
        day = dict(d.dtypes)[ts]
        kinds = {"year": "int", "train_rows": "bigint", "last_train": day, "first_test": day, "test_rows": "bigint"}
        return none.withColumns({c: F.lit(None).cast("double") for c in ("p_model", "p_age", "p_share")}), none.select(*[F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    return reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, folds)


def episode_gains(forecasts: DataFrame, price: DataFrame, key: str, ts: str, p: str, grid: list[float]) -> DataFrame:
    """(key, run, theta, at, run_end, gain): per threshold each run's first day with a forecast above it, and what the price does from there to a row beyond the run's end.

    forecasts: key, ts, run, run_end, `p`; price: key, ts, cum (cumulated return).  Runs without a
    trigger, or without prices on either day, have no row; where the price ends with the run
    the gain ends there too.
    """
    some = F.filter(F.array(*map(F.lit, grid)), lambda t: F.col(p) > t)
    first = forecasts.select(key, "run", "run_end", ts, F.explode(some).alias("theta")).groupBy(key, "run", "theta").agg(F.min(ts).alias("at"), F.first("run_end").alias("run_end"))
    ahead = F.lead("cum").over(Window.partitionBy(key).orderBy(ts))
    c = price.select(key, F.col(ts).alias("__d"), "cum", F.coalesce(ahead, F.col("cum")).alias("__next"))
    a = c.select(key, F.col("__d").alias("at"), F.col("cum").alias("__from"))
    b = c.select(key, F.col("__d").alias("run_end"), F.col("__next").alias("__to"))
    g = first.join(a, [key, "at"]).join(b, [key, "run_end"])
    return g.select(key, "run", "theta", "at", "run_end", (F.col("__to") - F.col("__from")).alias("gain")).where("gain is not null")


def chosen_thresholds(gains: DataFrame, least: int) -> DataFrame:
    """(year, theta, prior_runs, prior_gain): for each year the threshold of the best mean gain over runs that ended in years before it.

    A threshold counts from `least` such runs on; of equal means the lower one is taken, and a year for which none counts has no row.
    """
    per = gains.groupBy("theta", F.year("run_end").alias("year")).agg(F.count("*").alias("n"), F.sum("gain").alias("s"))
    years, thetas = per.select("year").distinct(), per.select("theta").distinct()
    full = years.join(thetas).join(per, ["year", "theta"], "left").na.fill(0, ["n", "s"])  # years x thresholds
    w = Window.partitionBy("theta").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    past = full.select("year", "theta", F.sum("n").over(w).alias("n"), F.sum("s").over(w).alias("s")).where(F.col("n") >= least)
    past = past.withColumn("m", F.col("s") / F.nullif(F.col("n"), F.lit(0)))
    best = past.groupBy("year").agg(F.max_by(F.struct("theta", "n", "m"), F.struct(F.round("m", 12), -F.col("theta"))).alias("b"))
    return best.select("year", F.col("b.theta").alias("theta"), F.col("b.n").alias("prior_runs"), F.col("b.m").alias("prior_gain"))


def decisions(gains: DataFrame, least: int) -> DataFrame:
    """The episodes of each year at the threshold that earlier years chose."""
    c = chosen_thresholds(gains, least).select(F.col("year").alias("__y"), F.col("theta").alias("__t"))
    return gains.join(c, (F.year("run_end") == F.col("__y")) & (F.col("theta") == F.col("__t"))).drop("__y", "__t").withColumn("year", F.year("run_end"))


def paired_gains(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(year, n, mean, t): the gain of `a` less that of `b` on runs that both acted on."""
    j = a.select(key, "run", "year", F.col("gain").alias("__a")).join(b.select(key, "run", F.col("gain").alias("__b")), [key, "run"])
    x = F.col("__a") - F.col("__b")
    return j.groupBy("year").agg(F.count("*").alias("n"), F.avg(x).alias("mean"), (F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * F.sqrt(F.count("*"))).alias("t"))


def boosted_ladder(train: DataFrame, test: DataFrame, target: str, blocks: dict[str, list[str]], trees: int = 20, depth: int = 4, seed: int = 7) -> tuple[DataFrame, dict]:
    """(`test` with one column pred_<block> a rung, models): trees on growing sets of features, grown on `train` alone.

    A rung has the features of its block and of all blocks before it.
    """
    out, models, have = test, {}, []
    for name, more in blocks.items():
        have = [*have, *more]
        fit = assembled(train.where(F.col(target).isNotNull()), have).select("__x", F.col(target).cast("double").alias("__y"))
        models[name] = (GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol=f"pred_{name}", maxIter=trees, maxDepth=depth, stepSize=0.1, minInstancesPerNode=20, seed=seed).fit(fit), list(have))
        out = models[name][0].transform(assembled(out, have)).drop("__x")
    return out, models


def class_means(train: DataFrame, test: DataFrame, cls: str, target: str, out: str) -> DataFrame:
    """`test` with the training mean of the target in the row's class."""
    m = train.groupBy(cls).agg(F.avg(target).alias(out))
    return test.join(m, cls, "left")


def ic_difference(df: DataFrame, day: str, a: str, b: str, outcome: str, min_names: int) -> DataFrame:
    """One row: mean rank correlations of two signals with the outcome on the days that have both, their mean difference and its t."""
    x = daily_ic(df, day, a, outcome, min_names).select(day, F.col("ic").alias("__a"))
    y = daily_ic(df, day, b, outcome, min_names).select(day, F.col("ic").alias("__b"))
    j = x.join(y, day).where("__a is not null and __b is not null")
    d = F.col("__a") - F.col("__b")
    return j.agg(F.count("*").alias("days"), F.avg("__a").alias("ic_a"), F.avg("__b").alias("ic_b"), F.avg(d).alias("difference"), (F.avg(d) / F.nullif(F.stddev_samp(d), F.lit(0.0)) * F.sqrt(F.count("*"))).alias("t"))


def permuted(df: DataFrame, day: str, key: str, col: str, seed: int) -> DataFrame:
    """`df` with `col` dealt out anew among the rows of its day, in an order that seed and key give."""
    w = Window.partitionBy(day)
    d = df.withColumn("__to", F.row_number().over(w.orderBy(key))).withColumn("__from", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)))
    values = d.select(F.col(day).alias("__d"), F.col("__from").alias("__i"), F.col(col).alias("__v"))
    return d.join(values, F.col(day).eqNullSafe(F.col("__d")) & (F.col("__to") == F.col("__i"))).withColumn(col, F.col("__v")).drop("__to", "__from", "__d", "__i", "__v")


def attribution(test: DataFrame, model, features: list[str], pred: str, day: str, key: str, outcome: str, min_names: int, seed: int = 11) -> DataFrame:
    """(feature, ic, permuted_ic, drop): how much of a model's mean daily rank correlation goes when a feature is dealt out anew within the day."""
    base = saved(test.drop(pred, "__x"))
    def score(df):
        return daily_ic(model.transform(assembled(df, features)), day, pred, outcome, min_names).agg(F.avg("ic").alias("ic"))
    whole = score(base).withColumnRenamed("ic", "__ic")
    parts = [score(permuted(base, day, key, f, seed + i)).select(F.lit(f).alias("feature"), F.col("ic").alias("permuted_ic")) for i, f in enumerate(features)]
    d = reduce(DataFrame.unionByName, parts).join(whole)  # one row on the right
    return d.select("feature", F.col("__ic").alias("ic"), "permuted_ic", (F.col("__ic") - F.col("permuted_ic")).alias("drop"))
