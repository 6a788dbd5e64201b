"""Queries of sinks, audits, groups, eras, anchors, gates and signals that stand beside those of the other modules."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.normal import normal_cdf_sql
from panelweave.operators import aggregates as agg
from panelweave.operators import hmm, panelreg, predictive
from panelweave.operators import identity as idn
from panelweave.operators import mixtures as mx
from panelweave.operators import portfolio as pf
from panelweave.operators import regimes as rg
from panelweave.operators import stats as st
from panelweave.operators import trials
from panelweave.operators import windows as win
from panelweave.operators.cleaning import era
from panelweave.operators.saved import saved, shared_folder
from panelweave.plans.engine_queries import DEV
from panelweave.plans.fixtures import CALENDAR, PANEL, PRICE, SCORES, STATES, TRADES, Views
from panelweave.plans.mixture_queries import ROLLED, _systems
from panelweave.plans.model_queries import BOOK, DENS, IC, _book, _densities, _outcome, _signal, _weights
from panelweave.plans.panel_queries import CUM, _cum
from panelweave.plans.regime_queries import BELIEF, MOST, PAR, PATHS, SEEN, _seen
from panelweave.plans.registry import ORACLES, query
from panelweave.sources import tables as tb

ERA = "CASE WHEN {0} <= DATE '1997-12-31' THEN 'TRAIN' ELSE 'TEST' END"


def _era(c):
    return era(F.col(c), "1997-12-31", "1998-01-01")


def _same(a, b):
    """How many rows stand in one of two frames alone."""
    return a.exceptAll(b).count() + b.exceptAll(a).count()


@query("A5_lineage", f"WITH {PANEL} SELECT 'panel' AS name, 'lineitem,part' AS inputs, 'week' AS grain, count(*) AS rows, CAST(0 AS BIGINT) AS differing FROM panel")
def a5(v: Views):
    """A table written with its provenance, read back, and compared with what was written."""
    at, p = shared_folder(v.spark), saved(v.panel.select("inst", "d", "net", "gross"))
    tb.write_with_lineage(p, f"{at}/panel", "panel", ["lineitem", "part"], f"{at}/lineage", {"grain": "week"})
    line = v.spark.read.parquet(f"{at}/lineage")
    return line.select("name", F.array_join("inputs", ",").alias("inputs"), F.col("extras")["grain"].alias("grain"), "rows", F.lit(_same(p, v.spark.read.parquet(f"{at}/panel"))).cast("long").alias("differing"))


@query("A6_csv_sink", f"WITH {PANEL} SELECT inst, CAST(d AS VARCHAR) AS d, CAST(n AS VARCHAR) AS n FROM panel")
def a6(v: Views):
    """A report written as CSV and read back as text."""
    at = shared_folder(v.spark)
    tb.write_csv(v.panel.select("inst", "d", "n"), at)
    return v.spark.read.option("header", True).csv(at).select("inst", "d", "n")


@query("A7_density_store", f"WITH {DENS} SELECT CAST(5 AS INTEGER) AS h, 'soft' AS weighting, 'expanding' AS \"window\", vintage, cls, count(*) AS cells, max(cdf) AS top FROM dens GROUP BY vintage, cls", "top")
def a7(v: Views):
    """Densities as arrays in a store partitioned by horizon, weighting and window; one partition is read back."""
    at = shared_folder(v.spark)
    d = _densities(v).groupBy("vintage", "cls").agg(F.array_sort(F.collect_list(F.struct("bin", "cdf"))).alias("cells"))
    kinds = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit("soft").alias("weighting"), F.lit("expanding").alias("window")) for h in (1, 5)]))
    tb.write_densities(d.withColumn("k", kinds).select("k.*", "vintage", "cls", F.col("cells.cdf").alias("cdf")), at)
    return v.spark.read.parquet(at).where("h = 5").select("h", "weighting", "window", "vintage", "cls", F.size("cdf").cast("long").alias("cells"), F.array_max("cdf").alias("top"))


@query("D6_issuer_groups", f"WITH {TRADES}, s AS (SELECT DISTINCT left(inst, 7) AS issuer, inst AS key, d AS day FROM trades), b AS (SELECT issuer, count(*) FILTER (n > 1) AS overlap_days FROM (SELECT issuer, day, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY issuer), i AS (SELECT issuer, key, max(day) AS last FROM s GROUP BY 1, 2), t AS (SELECT issuer, count(*) AS ids, arg_max(key, (last, key)) AS terminal FROM i GROUP BY issuer) SELECT issuer, key, ids, overlap_days, CASE WHEN overlap_days <= 5 THEN terminal ELSE key END AS canonical FROM i JOIN t USING (issuer) JOIN b USING (issuer)")
def d6g(v: Views):
    return idn.issuer_groups(v.trades, "inst", "d", F.substring("inst", 1, 7), 5)


@query("E14_era_overlap", f"WITH {TRADES}, x AS (SELECT 'inst' AS id, inst AS k, {ERA.format('day')} AS e FROM trades UNION ALL SELECT 'entity', CAST(entity AS VARCHAR), {ERA.format('day')} FROM trades), p AS (SELECT id, k, max((e = 'TRAIN')::INT) AS a, max((e = 'TEST')::INT) AS b FROM x GROUP BY 1, 2) SELECT id, CAST(sum(a) AS BIGINT) AS early, CAST(sum(b) AS BIGINT) AS late, CAST(sum(a * b) AS BIGINT) AS both FROM p GROUP BY id")
def e14o(v: Views):
    return agg.era_overlap(v.trades, _era("day"), ["inst", "entity"])


@query("E15_rank_stability", f"WITH {PANEL}, m AS (SELECT inst, avg(n) FILTER ({ERA.format('d')} = 'TRAIN') AS a, avg(n) FILTER ({ERA.format('d')} = 'TEST') AS b FROM panel GROUP BY inst HAVING a IS NOT NULL AND b IS NOT NULL), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM m) SELECT count(*) AS keys, corr(ra, rb) AS rank_correlation FROM r", "rank_correlation")
def e15r(v: Views):
    return agg.rank_stability(v.panel, "inst", _era("d"), "n")


@query("E18_enrichment_by_era", f"WITH {TRADES}, g AS (SELECT {ERA.format('day')} AS era, kind, count(*) AS n, CAST(sum((quantity >= 45)::INT) AS BIGINT) AS k FROM trades GROUP BY 1, 2), o AS (SELECT *, sum(n) OVER (PARTITION BY era) - n AS oth, sum(k) OVER (PARTITION BY era) - k AS ok FROM g) SELECT era, kind, n, k, k / n AS rate, (k / n) / (ok / oth) AS ratio, (k / n - ok / oth) / sqrt(((k + ok) / (n + oth)) * (1 - (k + ok) / (n + oth)) * (1.0 / n + 1.0 / oth)) AS z FROM o", "rate ratio z")
def e18e(v: Views):
    return agg.enrichment_by_era(v.trades.withColumn("hit", F.col("quantity") >= 45), "kind", "hit", _era("day"))


@query("E26_stored_totals", "WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS again FROM lineitem GROUP BY 1), j AS (SELECT o_totalprice AS s, again FROM orders LEFT JOIN l ON o_orderkey = l_orderkey) SELECT count(*) AS rows, count(*) FILTER (abs(s - again) > 0.5 OR (s IS NULL) <> (again IS NULL)) AS mismatches, max(abs(s - again)) AS worst FROM j", "worst", 2)
def e26s(v: Views):
    """The stored total of every order against the sum of its lines."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    again = v.table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(price).alias("again"))
    j = v.table("orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("s")).join(again, "o_orderkey", "left")
    return agg.stored_against(j, "s", F.col("again").cast("double"), 0.5)


@query("F7_bounce_free", f"WITH {CUM}, l AS (SELECT inst, d, lead(cum, 12) OVER w AS e, lead(cum, 2) OVER w AS b, last_value(cum) OVER (PARTITION BY inst ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM c WINDOW w AS (PARTITION BY inst ORDER BY d)) SELECT inst, d, coalesce(e, last) - coalesce(b, last) AS car, e IS NULL AS cut FROM l", "car")
def f7b(v: Views):
    car, cut = win.bounce_free_car("cum", "inst", "d", 2, 12)
    return _cum(v).select("inst", "d", car.alias("car"), cut.alias("cut"))


@query("F15_day_quintile", f"WITH {PRICE}, q AS (SELECT d, quantile_cont(turnover, [0.2, 0.4, 0.6, 0.8]) AS e FROM price GROUP BY d) SELECT inst, d, CAST((turnover > e[1])::INT + (turnover > e[2])::INT + (turnover > e[3])::INT + (turnover > e[4])::INT AS INTEGER) AS bucket FROM price JOIN q USING (d)")
def f15d(v: Views):
    e = st.quantiles(v.price, "turnover", [0.2, 0.4, 0.6, 0.8], ["d"], "e")
    return v.price.join(e, "d").select("inst", "d", F.size(F.filter("e", lambda x: F.col("turnover") > x)).alias("bucket"))


@query("F23_buy_share", f"WITH {PANEL}, r AS (SELECT inst, d, buy_value, gross, CASE WHEN count(*) OVER w >= 10 THEN avg(buy_value) OVER w END AS bn, CASE WHEN count(*) OVER w >= 10 THEN avg(gross) OVER w END AS gn FROM panel WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), x AS (SELECT inst, d, ln(buy_value / bn) - ln(gross / gn) AS s FROM r WHERE buy_value > 0 AND bn > 0 AND gross > 0 AND gn > 0) SELECT inst, d, s - avg(s) OVER (PARTITION BY d) AS share FROM x", "share")
def f23s(v: Views):
    """The buyers' share of the week against its own past, free of the week's mean."""
    p = v.panel.select("inst", "d", "buy_value", "gross", win.rolling(F.avg, "buy_value", "inst", "d", 60, 10, 1).alias("bn"), win.rolling(F.avg, "gross", "inst", "d", 60, 10, 1).alias("gn"))
    x = p.where("buy_value > 0 and bn > 0 and gross > 0 and gn > 0").withColumn("s", F.log("buy_value") - F.log("bn") - F.log("gross") + F.log("gn"))
    return x.select("inst", "d", (F.col("s") - F.avg("s").over(Window.partitionBy("d"))).alias("share"))


@query("F29_mean_impulse", f"WITH {STATES}, s AS (SELECT inst, d, CASE WHEN lag(state) OVER (PARTITION BY inst ORDER BY d) = 'sell' AND state <> 'sell' THEN 1.0 ELSE 0 END AS i FROM states) SELECT inst, d, avg(i) OVER (PARTITION BY inst ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM s", "held")
def f29m(v: Views):
    return win.held_impulse(v.states, "inst", "d", "state", "sell", 5, mean=True).select("inst", "d", "held")


@query("F31_detection_lag", f"WITH RECURSIVE {SEEN}, {PATHS}, {BELIEF}, l AS (SELECT inst, k, p.path AS s, CASE WHEN f.p >= 0.5 THEN 0 ELSE 1 END AS c FROM p JOIN f USING (inst, k)), n AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY inst ORDER BY k) THEN 1 ELSE 0 END AS new FROM l), r AS (SELECT *, sum(new) OVER (PARTITION BY inst ORDER BY k) AS run FROM n), i AS (SELECT *, row_number() OVER (PARTITION BY inst, run ORDER BY k) - 1 AS i FROM r), g AS (SELECT inst, run, any_value(s) AS label, min(i) FILTER (c = s) AS lag FROM i GROUP BY 1, 2) SELECT label, count(*) AS runs, count(lag) AS found, avg(lag) AS lag FROM g GROUP BY label", "lag")
def f31l(v: Views):
    """How many rows the carried belief takes to see what the best path, which knows all, calls a run."""
    d = hmm.decode(_seen(v), "inst", "d", "pos", "imb", PAR, MOST).withColumn("c", F.when(F.col("filtered")[0] >= 0.5, 0).otherwise(1))
    return win.detection_lag(d, "inst", "d", "c", "path")


MARKET = PRICE + ", mk AS (SELECT d, avg(adj) AS y, any_value(mkt) AS x FROM price WHERE adj IS NOT NULL AND mkt IS NOT NULL GROUP BY d)"


@query("J3_hac_slope", f"WITH {MARKET}, u AS (SELECT d, x, y, x - avg(x) OVER () AS u, avg(y) OVER () AS my FROM mk), b AS (SELECT *, sum(u * y) OVER () / sum(u * u) OVER () AS b FROM u), s AS (SELECT *, u * (y - my - b * u) AS s FROM b), l AS (SELECT *, lag(s, 1) OVER (ORDER BY d) AS s1, lag(s, 2) OVER (ORDER BY d) AS s2, lag(s, 3) OVER (ORDER BY d) AS s3 FROM s), g AS (SELECT any_value(my) AS my, avg(x) AS mx, any_value(b) AS slope, sqrt(sum(s * s) + 1.5 * sum(s * s1) + sum(s * s2) + 0.5 * sum(s * s3)) / sum(u * u) AS se, count(*) AS n FROM l) SELECT my - slope * mx AS const, slope, se, slope / se AS t, n FROM g", "const slope se t")
def j3s(v: Views):
    m = v.price.where("adj is not null and mkt is not null").groupBy("d").agg(F.avg("adj").alias("y"), F.first("mkt").alias("x"))
    return st.hac_slope(m, "d", "y", "x", 3)


def _leg(rule: str) -> str:
    return f"(SELECT avg(x) / (sqrt(sum(e * e) + sum(e * e1)) / count(*)) FROM (SELECT *, lag(e) OVER (ORDER BY d) AS e1 FROM (SELECT d, x, x - avg(x) OVER () AS e FROM m WHERE {rule})))"


CUT = "DATE '1997-12-31'"


@query("J10_two_leg_verdict", f"WITH {PRICE}, m AS (SELECT d, avg(ret) AS x FROM price WHERE ret IS NOT NULL GROUP BY d), t AS (SELECT {_leg('TRUE')} AS t_full, {_leg('d <= ' + CUT)} AS t_train, {_leg('d > ' + CUT)} AS t_test), l AS (SELECT *, abs(t_full) >= 2 AS full_leg, abs(t_train) >= 2 AND abs(t_test) >= 2 AND sign(t_train) = sign(t_test) AS era_leg FROM t) SELECT *, CASE WHEN full_leg AND era_leg THEN 'PASS' WHEN full_leg THEN 'FULL ONLY' ELSE 'FAIL' END AS verdict FROM l", "t_full t_train t_test")
def j10v(v: Views):
    m = v.price.where("ret is not null").groupBy("d").agg(F.avg("ret").alias("x"))
    cells = panelreg.screen(m, "d", "x", {"FULL": "true", "TRAIN": "d <= '1997-12-31'", "TEST": "d > '1997-12-31'"}, 1, 2.0)
    return panelreg.screen_verdict(cells, 2.0)


@query("J27_ic_summary", f"WITH {IC}, r AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY sig) + (count(*) OVER (PARTITION BY d, sig) - 1) / 2.0 AS a, rank() OVER (PARTITION BY d ORDER BY nxt) + (count(*) OVER (PARTITION BY d, nxt) - 1) / 2.0 AS b FROM y WHERE sig IS NOT NULL AND nxt IS NOT NULL), i AS (SELECT d, corr(a, b) AS ic FROM r GROUP BY d HAVING count(*) >= 20), n AS (SELECT ic, row_number() OVER (ORDER BY d) - 1 AS k FROM i WHERE ic IS NOT NULL) SELECT count(*) AS days, avg(ic) AS ic, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t, count(*) FILTER (k % 4 = 0) AS apart, avg(ic) FILTER (k % 4 = 0) / (stddev_samp(ic) FILTER (k % 4 = 0)) * sqrt(count(*) FILTER (k % 4 = 0)) AS t_apart FROM n", "ic t t_apart")
def j27s(v: Views):
    return st.ic_summary(st.daily_ic(_signal(v), "d", "sig", "nxt", 20), "d", 4)


@query("J30_calibration_error", f"WITH {SCORES}, c AS (SELECT greatest(p, 1 - p) AS c, ((p >= 0.5) = y)::INT AS ok FROM scores WHERE p IS NOT NULL AND y IS NOT NULL), g AS (SELECT least(floor(c * 10), 9) AS b, count(*) AS n, avg(ok) AS acc, avg(c) AS conf FROM c GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, sum(n * abs(acc - conf)) / sum(n) AS ece FROM g", "ece", 4)
def j30e(v: Views):
    return st.calibration_error(v.scores, "y", "p", 10)


EPISODES = STATES + f", {PRICE[PRICE.index('price0 AS'):]}, e0 AS (SELECT inst, d, state, CASE WHEN state IS DISTINCT FROM lag(state) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM states WINDOW w AS (PARTITION BY inst ORDER BY d)), e1 AS (SELECT *, sum(new) OVER (PARTITION BY inst ORDER BY d) AS run FROM e0), ep AS (SELECT inst, run, any_value(state) AS state, min(d) AS s, max(d) AS e FROM e1 GROUP BY 1, 2), an AS (SELECT inst, s AS d, 'START' AS anchor, state FROM ep UNION ALL SELECT inst, e, 'END', state FROM ep), cm AS (SELECT inst, d, sum(adj) OVER (PARTITION BY inst ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM price WHERE adj IS NOT NULL), fw AS (SELECT inst, d, {ERA.format('d')} AS era, h, CASE h WHEN 2 THEN lead(cum, 2) OVER w WHEN 5 THEN lead(cum, 5) OVER w WHEN 10 THEN lead(cum, 10) OVER w END - cum AS car FROM cm, (SELECT unnest([2, 5, 10]) AS h) WINDOW w AS (PARTITION BY inst, h ORDER BY d)), bs AS (SELECT era, h, avg(car) AS base FROM fw GROUP BY 1, 2)"


@query("J33_event_grid", f"WITH {EPISODES} SELECT anchor, state, era, h, count(car) AS n, avg(car) - any_value(base) AS excess FROM an JOIN fw USING (inst, d) JOIN bs USING (era, h) WHERE car IS NOT NULL GROUP BY 1, 2, 3, 4", "excess")
def j33g(v: Views):
    """Excess returns after the first and the last week of every episode, over three horizons, against each era's own mean."""
    e = saved(win.episodes(win.with_runs(v.states, "inst", "d", "state"), "inst", "d", "state", "imb").select("inst", "state", "start", "end"))
    anchors = e.select("inst", "state", F.inline(F.array(F.struct(F.lit("START").alias("anchor"), F.col("start").alias("d")), F.struct(F.lit("END").alias("anchor"), F.col("end").alias("d")))))
    cum = v.price.where("adj is not null").select("inst", "d", F.sum("adj").over(Window.partitionBy("inst").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    return st.event_grid(anchors, cum, "inst", "d", [2, 5, 10], _era("d"))


@query("J35_sharpe_conversion", f"WITH {BOOK}, {IC[IC.index(', x AS') + 2:]}, r AS (SELECT d, rank() OVER (PARTITION BY d ORDER BY sig) + (count(*) OVER (PARTITION BY d, sig) - 1) / 2.0 AS a, rank() OVER (PARTITION BY d ORDER BY nxt) + (count(*) OVER (PARTITION BY d, nxt) - 1) / 2.0 AS b FROM y WHERE sig IS NOT NULL AND nxt IS NOT NULL), i AS (SELECT d, corr(a, b) AS ic, count(*) AS k FROM r GROUP BY d HAVING count(*) >= 20), sh AS (SELECT avg(net) / stddev_samp(net) * sqrt(52) AS observed FROM book), m AS (SELECT avg(ic) * sqrt(52 * avg(k)) AS implied FROM i) SELECT observed, implied, observed / implied AS ratio, CASE WHEN observed / implied < 0 THEN 'inverted' WHEN observed / implied < 0.1 THEN 'no conversion' WHEN observed / implied < 0.5 THEN 'partial conversion' WHEN observed / implied >= 0.5 THEN 'converts' END AS verdict FROM sh, m", "observed implied ratio", 4)
def j35s(v: Views):
    """The book's Sharpe ratio after costs, against what its rank correlation would give over as many independent bets."""
    ic = st.daily_ic(_signal(v), "d", "sig", "nxt", 20)
    implied = ic.agg((F.avg("ic") * F.sqrt(52 * F.avg("names"))).alias("implied"))
    seen = _book(v).agg((F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * math.sqrt(52)).alias("observed"))
    return trials.conversion(seen.join(implied), "observed", "implied")  # one row each


REPLICATES = ORACLES["K11_clustered_quantiles"].replace("range(1, 21)", "range(1, 101)")


@query("K11_replicates", f"WITH r AS ({REPLICATES}), c AS (SELECT quantile AS q, quantile - avg(quantile) OVER () AS e FROM r) SELECT count(q) AS replicates, avg(q) AS mean, stddev_samp(q) AS sd, quantile_cont(q, CAST(0.025 AS DOUBLE)) AS low, quantile_cont(q, CAST(0.975 AS DOUBLE)) AS high, avg(e * e * e) / pow(avg(e * e), 1.5) AS skew, avg(e * e * e * e) / (avg(e * e) * avg(e * e)) - 3 AS kurtosis FROM c", "mean sd low high skew kurtosis", 4)
def k11s(v: Views):
    """Spread and shape of the clustered bootstrap of a weighted quantile."""
    x = v.states.select("inst", F.round("imb", 9).alias("v"), F.col("n").cast("double").alias("w"))
    reps = predictive.clustered_quantiles(x, "inst", "v", "w", 0.6, 100, 17).withColumn("quantile", F.round("quantile", 6))
    return predictive.replicate_summary(reps, "quantile")


@query("K12_seven_classes", f"WITH {STATES} SELECT inst, d, CASE WHEN state = 'neutral' THEN 'quiet' WHEN state = 'sell' THEN CASE WHEN n < 5 THEN 'hostage' WHEN n > 9 THEN 'concentrated_sell' ELSE 'sell_mid' END WHEN gross < 150000 THEN 'dispersed_buy' WHEN gross > 400000 THEN 'block_buy' ELSE 'buy_mid' END AS cls FROM states")
def k12s(v: Views):
    return v.states.select("inst", "d", rg.seven_classes(F.col("state"), F.col("gross"), F.col("n"), 5, 9, 150000.0, 400000.0).alias("cls"))


@query("K16_frontier", f"WITH {DENS}, e AS (SELECT vintage, cls, max(ess) AS ess, any_value(asof_pos) AS ap FROM dens JOIN vint USING (vintage) GROUP BY 1, 2), l AS (SELECT *, min(ess) OVER (PARTITION BY cls ORDER BY ap DESC ROWS UNBOUNDED PRECEDING) AS later FROM e) SELECT cls, arg_min(vintage, ap) FILTER (later >= 60) AS valid_from, count(*) AS vintages FROM l GROUP BY cls")
def k16f(v: Views):
    vint = v.calendar.groupBy(F.date_format("d", "yyyy").alias("vintage")).agg(F.max("pos").alias("asof_pos"))
    return rg.frontier(_densities(v), vint, 60.0)


@query("K16_embargo_slack", f"WITH {DENS}, f AS (SELECT pos, min(asof_pos) AS ap FROM obs JOIN vint ON pos + 5 <= asof_pos GROUP BY pos), n AS (SELECT pos, count(*) AS n FROM obs GROUP BY pos) SELECT vintage, CAST(sum(n) AS BIGINT) AS n, CAST(min(ap - 5 - pos) AS INTEGER) AS slack FROM f JOIN n USING (pos) JOIN vint ON ap = asof_pos GROUP BY vintage")
def k16e(v: Views):
    vint = v.calendar.groupBy(F.date_format("d", "yyyy").alias("vintage")).agg(F.max("pos").alias("asof_pos"))
    return rg.embargo_slack(_outcome(v).where("z is not null").join(v.calendar, "d").select("pos"), vint, 5)


@query("K17_table", f"WITH {DEV}, o AS (SELECT vintage, CAST(greatest(0, least(floor((x + 0.75) / 0.1), 14)) AS INTEGER) AS bin, count(*) AS n, sum(y) AS s FROM vint JOIN dz ON pos + 5 <= asof_pos GROUP BY 1, 2), g AS (SELECT vintage, CAST(bin AS INTEGER) AS bin, coalesce(n, 0) AS n, coalesce(s, 0) AS s FROM (SELECT vintage, bin FROM vint, (SELECT unnest(range(15)) AS bin)) LEFT JOIN o USING (vintage, bin)), m AS (SELECT *, sum(s) OVER (PARTITION BY vintage) / nullif(sum(n) OVER (PARTITION BY vintage), 0) AS m FROM g) SELECT vintage, bin, n, coalesce((s + 50 * m) / nullif((n + 50) * m, 0), 1) AS ratio FROM m", "ratio")
def k17t(v: Views):
    def sd(width, least):
        return F.log(F.nullif(win.rolling(F.stddev_samp, "ret", "inst", "d", width, least, 1), F.lit(0.0)))
    dev = v.price.select("inst", "d", (sd(20, 10) - sd(60, 20)).alias("dev"))
    df = dev.join(_outcome(v), ["inst", "d"]).join(v.calendar, "d").select("pos", "dev", "z")
    vint = v.calendar.groupBy(F.date_format("d", "yyyy").alias("vintage")).agg(F.max("pos").alias("asof_pos"))
    return predictive.recalibration_table(df, vint, 5, 4.0, -0.75, 0.1, 15, 50.0)


@query("K22_coherence", f"WITH {ROLLED} SELECT system, count(*) FILTER (var_01 IS NOT NULL AND var_05 IS NOT NULL) AS n, count(*) FILTER (var_01 > var_05 + 1e-9) AS crossed, count(*) FILTER (es_01 > var_01 + 1e-9 OR es_05 > var_05 + 1e-9) AS shallow FROM emp GROUP BY system")
def k22c(v: Views):
    p, _ = _systems(v)
    return mx.coherence(p.where("vintage is not null and system in ('soft_roll', 'hard_roll', 'soft_exp', 'clim_roll') and mean is not null"), "01", "05")


@query("K25_head_to_head", f"WITH {ROLLED}, x AS (SELECT e.inst, e.crps - (rv.z * (2 * {normal_cdf_sql('rv.z')} - 1) + 2 * exp(-rv.z * rv.z / 2) / 2.5066282746310002 - 0.5641895835477563) AS d FROM emp e JOIN rv ON e.inst = rv.inst AND e.d = rv.d WHERE e.system = 'soft_roll' AND e.crps IS NOT NULL AND rv.z IS NOT NULL) SELECT inst, count(*) AS n, avg(d) AS mean, avg(d) / stddev_samp(d) * sqrt(count(*)) AS t, count(*) FILTER (d < 0) AS wins FROM x GROUP BY inst", "mean t", 4)
def k25h(v: Views):
    """The mixture's score against the normal's, instrument by instrument."""
    p, _ = _systems(v)
    return mx.head_to_head(p.where("vintage is not null"), ["inst", "d"], "inst", "soft_roll", "normal")


@query("K26_rebuilt_features", f"WITH {TRADES}, early AS (SELECT * FROM trades WHERE d < DATE '1998-06-29'), fa AS ({PRICE[len(TRADES) + 2:].join(['WITH ', ''])} SELECT inst, d, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w END AS sd FROM price WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), fb AS ({PRICE[len(TRADES) + 2:].replace('FROM trades', 'FROM early').join(['WITH ', ''])} SELECT inst, d, CASE WHEN count(ret) OVER w >= 10 THEN stddev_samp(ret) OVER w END AS sd FROM price WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) SELECT year(a.d) AS year, count(*) AS rows, count(a.sd) AS full_n, count(b.sd) AS part_n, sum(a.sd) AS full_sum, sum(b.sd) AS part_sum FROM fa a LEFT JOIN fb b ON a.inst = b.inst AND a.d = b.d WHERE a.d < DATE '1998-06-29' GROUP BY 1", "full_sum part_sum")
def k26r(v: Views):
    """A feature of the whole tape beside the same feature of the tape as it stood at a date: year by year the same, on both engines."""
    cut = F.lit("1998-06-29").cast("date")

    def build(views):
        return views.price.select("inst", "d", win.rolling(F.stddev_samp, "ret", "inst", "d", 20, 10, 1).alias("sd")).where(F.col("d") < cut)

    part = Views(v.spark, v.dir)
    part.__dict__["trades"] = v.trades.where(F.col("d") < cut)
    j = build(v).join(build(part).select("inst", "d", F.col("sd").alias("p")), ["inst", "d"], "left")
    return j.groupBy(F.year("d").alias("year")).agg(F.count("*").alias("rows"), F.count("sd").alias("full_n"), F.count("p").alias("part_n"), F.sum("sd").alias("full_sum"), F.sum("p").alias("part_sum"))


@query("P3_fitness", f"WITH {BOOK}, l AS (SELECT * FROM book WHERE abs(turnover) + abs(net) > 0), a AS (SELECT count(*) AS days, avg(net) * 52 AS ret, avg(net) / stddev_samp(net) * sqrt(52) AS sharpe, avg(turnover) AS turnover FROM l) SELECT days, sharpe, turnover, sharpe * sqrt(abs(ret) / greatest(turnover, 0.125)) AS fitness FROM a", "sharpe turnover fitness", 4)
def p3f(v: Views):
    return pf.fitness(_book(v), "net", 52.0)


SIGNALS = STATES + f", {PRICE[PRICE.index('price0 AS'):]}, s0 AS (SELECT s.inst, s.d, s.state, s.imb AS flow, -p.ret AS rev, sum(s.imb) OVER (PARTITION BY s.inst ORDER BY s.d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS proxy FROM states s JOIN price p USING (inst, d) WHERE p.ret IS NOT NULL), s1 AS (SELECT inst, d, state, (flow - avg(flow) OVER w) / nullif(stddev_pop(flow) OVER w, 0) AS flow, (rev - avg(rev) OVER w) / nullif(stddev_pop(rev) OVER w, 0) AS rev, (proxy - avg(proxy) OVER w) / nullif(stddev_pop(proxy) OVER w, 0) AS proxy, avg((state = 'sell')::INT) OVER w > 0.4 AS stress FROM s0 WINDOW w AS (PARTITION BY d))"


@query("P5_signals", f"WITH {SIGNALS} SELECT inst, d, flow, rev AS reversal, proxy, CASE WHEN state <> 'neutral' THEN flow END AS gated, CASE WHEN stress THEN rev ELSE flow END AS switched FROM s1", "flow reversal proxy gated switched")
def p5s(v: Views):
    """Flow, reversal and the flow's trailing sum as standard signals; flow in directed weeks alone; and reversal in stressed weeks, else flow."""
    w = Window.partitionBy("inst").orderBy("d").rowsBetween(-3, 0)
    x = v.states.join(v.price.where("ret is not null").select("inst", "d", "ret"), ["inst", "d"])
    x = x.select("inst", "d", "state", F.col("imb").alias("flow"), (-F.col("ret")).alias("reversal"), F.sum("imb").over(w).alias("proxy"))
    for c in ("flow", "reversal", "proxy"):
        x = pf.standard_signal(x, "d", c)
    x = pf.gated(x, "flow", F.col("state") != "neutral", "gated")
    stress = F.avg((F.col("state") == "sell").cast("double")).over(Window.partitionBy("d")) > 0.4
    return pf.switched(x, "reversal", "flow", stress, "switched").select("inst", "d", "flow", "reversal", "proxy", "gated", "switched")


@query("P6_alignment", f"WITH {BOOK} SELECT count(*) AS days, 0.0::DOUBLE AS worst FROM calendar WHERE d <= DATE '1996-12-30'", "worst")
def p6a(v: Views):
    """A book whose prices after a date are made up: until that date it must earn what it earned."""
    cut = F.lit("1996-12-30").cast("date")
    r = v.price.select("inst", "d", "ret")
    other = r.withColumn("ret", F.when(F.col("d") > cut, F.lit(0.5)).otherwise(F.col("ret")))
    weights = pf.weights(pf.reversal(other, "inst", "d", "ret", 4), "d", "alpha", 0.08).select("inst", "d", "w")
    a, b = _book(v), pf.book(weights, other, v.calendar, 1, 15.0)
    return pf.alignment_gate(a.where(F.col("d") <= cut), b, "d")
