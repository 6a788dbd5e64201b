"""Queries of panel regressions, resampling, the regime model and audits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.mix import mix_sql
from panelweave.operators import hmm, joins, panelreg, resampling
from panelweave.operators import regimes as rg
from panelweave.operators import windows as win
from panelweave.plans.fixtures import CALENDAR, PRICE, STATES, TRADES, Views
from panelweave.plans.model_queries import HITS, _hits
from panelweave.plans.registry import query


@query("C15_first_admitting_vintage", f"WITH {TRADES}, {CALENDAR}, vint AS (SELECT max(pos) AS asof_pos FROM calendar GROUP BY year(d)) SELECT c.d, min(v.asof_pos) AS asof_pos FROM calendar c LEFT JOIN vint v ON c.pos + 5 <= v.asof_pos GROUP BY c.d")
def c15(v: Views):
    vint = v.calendar.groupBy(F.year("d")).agg(F.max("pos").alias("asof_pos")).agg(F.array_sort(F.collect_list("asof_pos")).alias("a"))
    c = v.calendar.join(F.broadcast(vint))  # one row: a position a year
    return c.select("d", F.try_element_at(F.filter("a", lambda a: rg.admits(F.col("pos"), 5, a)), F.lit(1)).alias("asof_pos"))


def _sweeps(col: str, rounds: int) -> str:
    out, prev = "", "s0"
    for i in range(rounds):
        out += f", {col}a{i} AS (SELECT inst, d, v - avg(v) OVER (PARTITION BY inst) AS v FROM {col}{prev}), {col}b{i} AS (SELECT inst, d, v - avg(v) OVER (PARTITION BY d) AS v FROM {col}a{i})"
        prev = f"b{i}"
    return out


FE = PRICE + ", dd AS (SELECT inst, d, ret AS y, ln(turnover) AS x FROM price WHERE ret IS NOT NULL), ys0 AS (SELECT inst, d, y AS v FROM dd), xs0 AS (SELECT inst, d, x AS v FROM dd)" + _sweeps("y", 2) + _sweeps("x", 2) + ", j AS (SELECT inst, d, yb1.v AS y, xb1.v AS x FROM yb1 JOIN xb1 USING (inst, d)), sl AS (SELECT sum(x * y) / sum(x * x) AS slope, sum(x * x) AS xx, count(*) AS n FROM j), sc AS (SELECT inst, d, x * (y - slope * x) AS s FROM j, sl), ma AS (SELECT sum(g * g) AS m FROM (SELECT sum(s) AS g FROM sc GROUP BY inst)), mb AS (SELECT sum(g * g) AS m FROM (SELECT sum(s) AS g FROM sc GROUP BY d)), mw AS (SELECT sum(s * s) AS m FROM sc)"


@query("J5_J6_fixed_effects", f"WITH {FE} SELECT slope, n, sqrt(ma.m) / xx AS se_a, sqrt(mb.m) / xx AS se_b, sqrt(mw.m) / xx AS se_white, sqrt(greatest(0, ma.m + mb.m - mw.m)) / xx AS se_two_way FROM sl, ma, mb, mw", "slope se_a se_b se_white se_two_way")
def j5(v: Views):
    return panelreg.fe_slope(v.price.select("inst", "d", "ret", F.log("turnover").alias("x")), "ret", "x", "inst", "d", 2)


def _cell(name: str, rule: str) -> str:
    return f"SELECT mean, sqrt(g0 + g1) / n AS se, mean / (sqrt(g0 + g1) / n) AS t, n, '{name}' AS cell, abs(mean / (sqrt(g0 + g1) / n)) >= 2.0 AS passed FROM (SELECT avg(x) AS mean, count(*) AS n, sum(e * e) AS g0, sum(e * e1) AS g1 FROM (SELECT *, lag(e) OVER (ORDER BY d) AS e1 FROM (SELECT d, x, x - avg(x) OVER () AS e FROM m WHERE {rule})))"


@query("J10_screen_cells", f"WITH {PRICE}, m AS (SELECT d, avg(adj) AS x FROM price WHERE adj IS NOT NULL GROUP BY d) {_cell('FULL', 'TRUE')} UNION ALL {_cell('TRAIN', 'd <= DATE ' + repr('1997-12-31'))} UNION ALL {_cell('TEST', 'd > DATE ' + repr('1997-12-31'))}", "mean se t")
def j10(v: Views):
    m = v.price.where("adj is not null").groupBy("d").agg(F.avg("adj").alias("x"))
    return panelreg.screen(m, "d", "x", {"FULL": "true", "TRAIN": "d <= '1997-12-31'", "TEST": "d > '1997-12-31'"}, 1, 2.0)


@query("J17_ljung_box", f"WITH {HITS}, e AS (SELECT inst, d, z - avg(z) OVER (PARTITION BY inst) AS e FROM hits), l AS (SELECT inst, e, lag(e, 1) OVER w AS e1, lag(e, 2) OVER w AS e2 FROM e WINDOW w AS (PARTITION BY inst ORDER BY d)), g AS (SELECT inst, count(*) AS n, sum(e * e) AS g0, sum(e * e1) AS g1, sum(e * e2) AS g2 FROM l GROUP BY inst) SELECT inst, n, n * (n + 2) * ((g1 / g0) * (g1 / g0) / (n - 1) + (g2 / g0) * (g2 / g0) / (n - 2)) AS q FROM g", "q")
def j17(v: Views):
    return panelreg.ljung_box(_hits(v), "inst", "d", "z", 2)


@query("J20_block_bootstrap", f"WITH {HITS}, d AS (SELECT row_number() OVER (ORDER BY d) - 1 AS pos, s, n0, count(*) OVER () AS n FROM (SELECT d, sum(z) AS s, count(*) AS n0 FROM hits GROUP BY d)), w AS (SELECT rep, pos, n, CASE WHEN pos = 0 OR {mix_sql(11, 8, 'rep', 'pos')} = 0 THEN {mix_sql(12, 'n', 'rep', 'pos')} END AS a, CASE WHEN pos = 0 OR {mix_sql(11, 8, 'rep', 'pos')} = 0 THEN pos END AS f FROM d, (SELECT unnest(range(1, 201)) AS rep)), x AS (SELECT rep, (last_value(a IGNORE NULLS) OVER o + pos - last_value(f IGNORE NULLS) OVER o) % n AS pos FROM w WINDOW o AS (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING)) SELECT CAST(rep AS INTEGER) AS rep, sum(s) / sum(n0) AS estimate FROM x JOIN d USING (pos) GROUP BY rep", "estimate")
def j20(v: Views):
    daily = _hits(v).groupBy("d").agg(F.sum("z").alias("s"), F.count("*").alias("n"))
    return resampling.block_bootstrap(daily, "d", "s", "n", 200, 8, 11)


@query("J24_run_permutation", f"WITH {STATES}, p AS (SELECT inst, row_number() OVER (PARTITION BY inst ORDER BY d) - 1 AS pos, state = 'sell' AS h FROM states), r AS (SELECT inst, rep, h, CASE WHEN rep = 0 THEN 0 ELSE {mix_sql(13, 2147483648, 'rep', 'pos')} END AS x, pos FROM p, (SELECT unnest(range(0, 51)) AS rep)), l AS (SELECT rep, h AND NOT coalesce(lag(h) OVER (PARTITION BY inst, rep ORDER BY x, pos), FALSE) AS s FROM r) SELECT CAST(rep AS INTEGER) AS rep, count(*) FILTER (s) AS runs FROM l GROUP BY rep")
def j24(v: Views):
    return resampling.run_permutation(v.states, "inst", "d", "state", "sell", 50, 13)


@query("J34_event_arc", f"WITH {PRICE}, {CALENDAR}, x AS (SELECT inst, c.pos, volume, abs(ret) > 0.3 AS big FROM price JOIN calendar c USING (d)), e AS (SELECT inst, pos AS p, unnest(range(-3, 4)) AS o FROM x WHERE big) SELECT CAST(o AS INTEGER) AS \"offset\", count(volume) AS n, avg(volume) AS mean FROM e JOIN x ON x.inst = e.inst AND x.pos = e.p + e.o GROUP BY o", "mean")
def j34(v: Views):
    x = v.price.join(v.calendar, "d").select("inst", "pos", "volume", "ret")
    return panelreg.event_arc(x.where("abs(ret) > 0.3"), x.select("inst", "pos", "volume"), "inst", "pos", "volume", 3, 3)


@query("K1_K5_regimes")
def k1(v: Views):
    """The fitted model's smoothed state per row; the regime model over all instruments."""
    x = v.states.join(v.calendar, "d").select("inst", "d", "pos", "imb")
    par, _ = hmm.fit(x, "inst", "pos", "imb", states=3, rounds=5)
    out = hmm.decode(x, "inst", "d", "pos", "imb", par)
    return out.select("inst", "d", "state", F.round(F.col("filtered")[2], 6).alias("p_buy"), F.round(F.col("smoothed")[0], 6).alias("s_sell"))


@query("K25_risk_profiles", f"WITH {HITS} SELECT inst, year(d) AS year, count(*) AS n, avg(hit::INT) AS hit_rate, quantile_cont(z, 0.05) AS q05, stddev_samp(z) AS sd FROM hits GROUP BY 1, 2", "hit_rate q05 sd")
def k25(v: Views):
    h = _hits(v)
    return h.groupBy("inst", F.year("d").alias("year")).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.percentile("z", F.lit(0.05)).alias("q05"), F.stddev_samp("z").alias("sd"))


@query("K26_lookahead_audit", "SELECT CAST(0 AS BIGINT) AS differing, CAST(0 AS BIGINT) AS full_only, CAST(0 AS BIGINT) AS part_only")
def k26(v: Views):
    """Features rebuilt from trades up to a date, against those of the whole tape: nothing may differ."""
    cut = F.lit("1998-06-29").cast("date")

    def build(views):
        sd = win.rolling(F.stddev_samp, "ret", "inst", "d", 20, 10, 1)
        return views.price.select("inst", "d", F.round(sd, 12).alias("sd")).where(F.col("d") < cut)

    part = Views(v.spark, v.dir)
    part.__dict__["trades"] = v.trades.where(F.col("d") < cut)
    return joins.frame_diff(build(v), build(part), ["inst", "d"], "sd").select("differing", "full_only", "part_only")


@query("K27_persistence_forecast", f"WITH {STATES}, l AS (SELECT inst, d, state, lag(state) OVER (PARTITION BY inst ORDER BY d) AS p FROM states) SELECT year(d) AS year, avg((state = p)::INT) AS persistence, avg((state = 'neutral')::INT) AS prior FROM l WHERE p IS NOT NULL GROUP BY 1", "persistence prior")
def k27(v: Views):
    l = v.states.withColumn("p", F.lag("state").over(Window.partitionBy("inst").orderBy("d"))).where("p is not null")
    return l.groupBy(F.year("d").alias("year")).agg(F.avg((F.col("state") == F.col("p")).cast("double")).alias("persistence"), F.avg((F.col("state") == "neutral").cast("double")).alias("prior"))
