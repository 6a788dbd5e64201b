"""Queries of resampling, many trials, recalibration, predictive mixtures and engine gates."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.mix import mix_sql
from panelweave.functions.normal import normal_cdf_sql, probit_sql
from panelweave.operators import panelreg, predictive, resampling, trials
from panelweave.operators import regimes as rg
from panelweave.operators import stats as st
from panelweave.operators import windows as win
from panelweave.plans.fixtures import PRICE, STATES, Views
from panelweave.plans.model_queries import BOOK, DENS, HITS, _book, _densities, _hits, _outcome, _weights
from panelweave.plans.panel_model_queries import _sweeps
from panelweave.plans.registry import query


@query("J8_pooled_clustered", f"WITH {PRICE}, x AS (SELECT inst, ret AS y, mkt AS x FROM price WHERE ret IS NOT NULL AND mkt IS NOT NULL), m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_slope(y, x) AS slope, var_pop(x) * count(*) AS sxx, count(*) AS n FROM x), g AS (SELECT inst, sum((x - mx) * (y - my - slope * (x - mx))) AS g FROM x, m GROUP BY inst) SELECT my - slope * mx AS const, slope, sqrt((SELECT sum(g * g) FROM g)) / sxx AS se, n FROM m", "const slope se")
def j8(v: Views):
    return panelreg.pooled_slope(v.price.select("inst", "ret", "mkt"), "ret", "mkt", "inst")


def _spec_sql(y: str) -> str:
    base = f"dd AS (SELECT inst, d, {y} AS y, x, c FROM panel7 WHERE {y} IS NOT NULL AND x IS NOT NULL AND c IS NOT NULL), ys0 AS (SELECT inst, d, y AS v FROM dd), xs0 AS (SELECT inst, d, x AS v FROM dd), cs0 AS (SELECT inst, d, c AS v FROM dd)" + _sweeps("y", 2) + _sweeps("x", 2) + _sweeps("c", 2)
    return f"""SELECT '{y}' AS y, spec, slope, se, n FROM (WITH {base}, j AS (SELECT inst, d, yb1.v AS y, xb1.v AS x, cb1.v AS c FROM yb1 JOIN xb1 USING (inst, d) JOIN cb1 USING (inst, d)),
 q AS (SELECT sum(x * c) / sum(c * c) AS p, sum(c * y) / sum(c * c) AS gm FROM j), u AS (SELECT inst, y, 'R0' AS spec, x AS u, 0.0 AS gc FROM j UNION ALL SELECT inst, y, 'R1', x - p * c, gm * c FROM j, q),
 m AS (SELECT spec, sum(u * y) / sum(u * u) AS slope, sum(u * u) AS uu, count(*) AS n FROM u GROUP BY spec), g AS (SELECT spec, inst, sum(u * (y - slope * u - gc)) AS g FROM u JOIN m USING (spec) GROUP BY 1, 2), t AS (SELECT spec, sum(g * g) AS meat FROM g GROUP BY spec)
 SELECT spec, slope, sqrt(meat) / uu AS se, n FROM m JOIN t USING (spec))"""


PANEL7 = STATES + f", {PRICE[PRICE.index('price0 AS'):]}, cm AS (SELECT inst, d, sum(adj) OVER (PARTITION BY inst ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM price WHERE adj IS NOT NULL), fw AS (SELECT inst, d, lead(cum, 5) OVER w - cum AS car5, lead(cum, 10) OVER w - cum AS car10 FROM cm WINDOW w AS (PARTITION BY inst ORDER BY d)), panel7 AS (SELECT inst, d, car5, car10, CASE WHEN state = 'sell' THEN 1.0 ELSE 0.0 END::DOUBLE AS x, ln(gross) AS c FROM states JOIN fw USING (inst, d))"


@query("J7_spec_ladder", f"WITH {PANEL7} {_spec_sql('car5')} UNION ALL {_spec_sql('car10')}", "slope se")
def j7(v: Views):
    w = Window.partitionBy("inst").orderBy("d")
    cum = v.price.where("adj is not null").select("inst", "d", F.sum("adj").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    fw = cum.select("inst", "d", *[(F.lead("cum", h).over(w) - F.col("cum")).alias(f"car{h}") for h in (5, 10)])
    p = v.states.select("inst", "d", (F.col("state") == "sell").cast("double").alias("x"), F.log("gross").alias("c")).join(fw, ["inst", "d"])
    return panelreg.fe_specs(p, ["car5", "car10"], "x", "c", "inst", "d", 2)


NESTED = PRICE + ", f AS (SELECT d, ret * ret AS y, CASE WHEN count(ret) OVER a >= 20 THEN var_samp(ret) OVER a END AS f1, CASE WHEN count(ret) OVER b >= 10 THEN var_samp(ret) OVER b END AS f2 FROM price WINDOW a AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"


@query("J12_clark_west", f"WITH {NESTED}, m AS (SELECT d, avg((y - f1) * (y - f1) - (y - f2) * (y - f2) + (f1 - f2) * (f1 - f2)) AS x FROM f WHERE y IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL GROUP BY d), e AS (SELECT d, x, x - avg(x) OVER () AS e FROM m), l AS (SELECT *, lag(e, 1) OVER (ORDER BY d) AS e1 FROM e), g AS (SELECT avg(x) AS mean, count(*) AS n, sum(e * e) AS g0, sum(e * e1) AS g1 FROM l) SELECT mean, sqrt(g0 + g1) / n AS se, mean / (sqrt(g0 + g1) / n) AS t, n FROM g", "mean se t")
def j12(v: Views):
    def var(width, least):
        return win.rolling(F.var_samp, "ret", "inst", "d", width, least, 1)
    f = v.price.select("d", (F.col("ret") * F.col("ret")).alias("y"), var(60, 20).alias("f1"), var(20, 10).alias("f2"))
    return trials.clark_west(f, "d", "y", "f1", "f2", 1)


def _draw_sql(table: str, block: int, replicates: int, seed: int) -> str:
    """num (pos, n, columns of `table`) and drawn (rep, columns)."""
    return f"num AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS n FROM {table}), slots AS (SELECT rep, n, pos AS slot FROM num, (SELECT unnest(range(1, {replicates + 1})) AS rep)), src AS (SELECT rep, ({mix_sql(seed, 'n', 'rep', f'(slot // {block})')} + slot % {block}) % n AS pos FROM slots), drawn AS (SELECT CAST(src.rep AS INTEGER) AS rep, num.* FROM src JOIN num USING (pos))"


@query("J21_sharpe_difference", f"WITH {PRICE}, day2 AS (SELECT d, avg(ret) FILTER (inst < 'Brand#3') AS a, avg(ret) FILTER (inst >= 'Brand#3') AS b FROM price GROUP BY d HAVING a IS NOT NULL AND b IS NOT NULL), {_draw_sql('day2', 8, 40, 3)} SELECT rep, avg(a) / nullif(stddev_samp(a), 0) * sqrt(52) - avg(b) / nullif(stddev_samp(b), 0) * sqrt(52) AS difference FROM drawn GROUP BY rep", "difference")
def j21(v: Views):
    low = F.col("inst") < "Brand#3"
    day = v.price.groupBy("d").agg(F.avg(F.when(low, F.col("ret"))).alias("a"), F.avg(F.when(~low, F.col("ret"))).alias("b")).dropna()
    return resampling.sharpe_difference(day, "d", "a", "b", 8, 40, 3, 52.0)


@query("J22_event_means", f"WITH {HITS}, per AS (SELECT d, sum(z) AS s, count(*) AS c FROM hits WHERE hit GROUP BY d), {_draw_sql('per', 1, 40, 5)}, base AS (SELECT avg(z) AS b FROM hits) SELECT rep, sum(s) / sum(c) - (SELECT b FROM base) AS excess FROM drawn GROUP BY rep", "excess")
def j22(v: Views):
    h = _hits(v)
    per = h.where("hit").groupBy("d").agg(F.sum("z").alias("s"), F.count("*").alias("c"))
    drawn = resampling.block_draws(per, "d", 1, 40, 5).groupBy("rep").agg((F.sum("s") / F.sum("c")).alias("m"))
    return drawn.join(h.agg(F.avg("z").alias("b"))).select("rep", (F.col("m") - F.col("b")).alias("excess"))  # one row on the right


SWEPT = PRICE + ", dd AS (SELECT inst, d, ret AS y, ln(turnover) AS x FROM price WHERE ret IS NOT NULL), ys0 AS (SELECT inst, d, y AS v FROM dd), xs0 AS (SELECT inst, d, x AS v FROM dd)" + _sweeps("y", 2) + _sweeps("x", 2) + ", per AS (SELECT d, sum(xb1.v * yb1.v) AS xy, sum(xb1.v * xb1.v) AS xx FROM yb1 JOIN xb1 USING (inst, d) GROUP BY d)"


@query("J23_bootstrap_slope", f"WITH {SWEPT}, {_draw_sql('per', 6, 40, 9)} SELECT rep, sum(xy) / nullif(sum(xx), 0) AS slope FROM drawn GROUP BY rep", "slope")
def j23(v: Views):
    d = v.price.where("ret is not null").select("inst", "d", F.col("ret").alias("y0"), F.log("turnover").alias("x0"))
    d = st.demean_two_way(st.demean_two_way(d, "y0", "inst", "d", 2, "y"), "x0", "inst", "d", 2, "x")
    per = d.groupBy("d").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    return resampling.block_draws(per, "d", 6, 40, 9).groupBy("rep").agg((F.sum("xy") / F.nullif(F.sum("xx"), F.lit(0.0))).alias("slope"))


@query("J26_deflated_sharpe", f"WITH {PRICE}, c AS (SELECT inst, adj, adj - avg(adj) OVER (PARTITION BY inst) AS e FROM price WHERE adj IS NOT NULL), g AS (SELECT inst, count(*) AS n, avg(adj) / nullif(stddev_samp(adj), 0) AS sharpe, avg(e * e * e) / nullif(pow(avg(e * e), 1.5), 0) AS skew, avg(e * e * e * e) / nullif(avg(e * e) * avg(e * e), 0) AS kurt, CAST(count(*) OVER () AS DOUBLE) AS t FROM c GROUP BY inst), p AS (SELECT *, 1 - 1 / t AS p1, 1 - 1 / (t * {math.e}) AS p2 FROM g), x AS (SELECT *, ((1 - 0.5772156649015329) * {probit_sql('p1')} + 0.5772156649015329 * {probit_sql('p2')}) / sqrt(n) AS expected_max FROM p), z AS (SELECT *, (sharpe - expected_max) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS z FROM x) SELECT inst, n, sharpe, expected_max, {normal_cdf_sql('z')} AS probability FROM z", "sharpe expected_max probability")
def j26(v: Views):
    return trials.deflated_sharpe(v.price.select("inst", "adj"), "inst", "adj")


@query("J26_overfitting", f"WITH {PRICE}, g AS (SELECT inst, year(d) AS y, count(*) AS n, sum(adj) AS s, sum(adj * adj) AS ss FROM price WHERE adj IS NOT NULL GROUP BY 1, 2), b AS (SELECT *, dense_rank() OVER (ORDER BY y) - 1 AS bit, (SELECT count(DISTINCT y) FROM g) AS p FROM g), h AS (SELECT mask, inst, (mask >> bit) & 1 AS i, n, s, ss FROM b, (SELECT unnest(range(1, 16384)) AS mask) WHERE mask < (1 << p::INTEGER) AND bit_count(mask) = p // 2), m AS (SELECT mask, inst, i, sum(s) / sum(n) AS mu, sum(ss) / sum(n) - (sum(s) / sum(n)) * (sum(s) / sum(n)) AS va FROM h GROUP BY 1, 2, 3), w AS (SELECT mask, inst, max(mu / sqrt(va)) FILTER (i = 1 AND va > 0) AS a, max(mu / sqrt(va)) FILTER (i = 0 AND va > 0) AS b FROM m GROUP BY 1, 2 HAVING a IS NOT NULL AND b IS NOT NULL), o AS (SELECT *, first_value(b) OVER (PARTITION BY mask ORDER BY a DESC, inst DESC) AS own FROM w), r AS (SELECT mask, count(*) FILTER (b < own) AS below, count(*) AS n FROM o GROUP BY mask) SELECT count(*) AS splits, avg((below / nullif(n - 1, 0) < 0.5)::INT) AS overfitting FROM r", "overfitting")
def j26b(v: Views):
    return trials.overfitting(v.price.select("inst", "d", "adj"), "inst", F.year("d"), "adj")


def _crps(z: str, sd: float) -> str:
    x = f"({z} / {sd})"
    return f"({sd} * ({x} * (2 * {normal_cdf_sql(x)} - 1) + 2 * exp(-{x} * {x} / 2) / 2.5066282746310002 - 0.5641895835477563))"


@query("J35_conversion", f"WITH {HITS}, s AS (SELECT year(d) AS year, avg({_crps('z', 1.0)}) AS base, avg({_crps('z', 0.95)}) AS other FROM hits GROUP BY 1), r AS (SELECT year, base - other AS observed, base * 0.05 AS implied FROM s) SELECT year, observed, implied, observed / implied AS ratio, CASE WHEN observed / implied < 0 THEN 'inverted' WHEN observed / implied < 0.1 THEN 'no conversion' WHEN observed / implied < 0.5 THEN 'partial conversion' ELSE 'converts' END AS verdict FROM r", "observed implied ratio")
def j35(v: Views):
    def crps(sd):
        return F.avg(rg.normal_crps(F.col("z"), F.lit(0.0), F.lit(sd)))
    s = _hits(v).groupBy(F.year("d").alias("year")).agg(crps(1.0).alias("base"), crps(0.95).alias("other"))
    return trials.conversion(s.select("year", (F.col("base") - F.col("other")).alias("observed"), (F.col("base") * 0.05).alias("implied")), "observed", "implied")


@query("K3_vintage_windows", f"WITH {STATES}, vint AS (SELECT strftime(d, '%Y-%m') AS vintage, max(d) AS asof_d FROM states GROUP BY 1), r AS (SELECT vintage, inst, d, count(*) OVER (PARTITION BY vintage, inst) AS n, row_number() OVER (PARTITION BY vintage, inst ORDER BY d DESC) AS b FROM states JOIN vint ON d <= asof_d AND date_diff('day', d, asof_d) < 730) SELECT vintage, inst, max(n) AS rows, count(*) AS used, min(d) AS first, max(d) AS last FROM r WHERE n >= 10 AND b <= 60 GROUP BY 1, 2")
def k3(v: Views):
    s = v.states.select("inst", "d")
    vint = s.groupBy(F.date_format("d", "yyyy-MM").alias("vintage")).agg(F.max("d").alias("asof"))
    return predictive.vintage_windows(s, vint, "inst", "d", 730, 10, 60)


@query("K11_clustered_quantiles", f"WITH {STATES}, x AS (SELECT inst, round(imb, 9) AS v, CAST(n AS DOUBLE) AS w FROM states), k AS (SELECT inst, row_number() OVER (ORDER BY inst) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT inst FROM x)), t AS (SELECT rep, {mix_sql(17, 'n', 'rep', 'pos')} AS pos, count(*) AS times FROM k, (SELECT unnest(range(1, 21)) AS rep) GROUP BY 1, 2), g AS (SELECT rep, v, sum(w * times) AS w FROM x JOIN k USING (inst) JOIN t USING (pos) GROUP BY 1, 2), p AS (SELECT *, (sum(w) OVER (PARTITION BY rep ORDER BY v) - w / 2) / sum(w) OVER (PARTITION BY rep) AS p FROM g), nx AS (SELECT *, lead(p) OVER o AS p2, lead(v) OVER o AS v2, lag(p) OVER o IS NULL AS f FROM p WINDOW o AS (PARTITION BY rep ORDER BY v)) SELECT CAST(rep AS INTEGER) AS rep, min(CASE WHEN f AND p >= 0.6 THEN v WHEN p <= 0.6 AND p2 > 0.6 THEN v + (v2 - v) * (0.6 - p) / (p2 - p) WHEN p2 IS NULL AND p <= 0.6 THEN v END) AS quantile FROM nx GROUP BY rep", "quantile")
def k11(v: Views):
    x = v.states.select("inst", F.round("imb", 9).alias("v"), F.col("n").cast("double").alias("w"))
    return predictive.clustered_quantiles(x, "inst", "v", "w", 0.6, 20, 17)


DEV = DENS + ", dv AS (SELECT inst, d, ln(stddev_samp(ret) OVER a / stddev_samp(ret) OVER b) AS dev, count(ret) OVER a AS na, count(ret) OVER b AS nb FROM price WINDOW a AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), dz AS (SELECT c.pos, dv.dev AS x, pow(least(greatest(z.z, -4), 4), 2) AS y FROM dv JOIN z USING (inst, d) JOIN calendar c USING (d) WHERE na >= 10 AND nb >= 20 AND dv.dev IS NOT NULL AND z.z IS NOT NULL)"


@query("K17_recalibration", f"WITH {DEV}, m AS (SELECT vintage, count(x) AS n, coalesce(sum(x), 0) AS sx, coalesce(sum(y), 0) AS sy, coalesce(sum(x * x), 0) AS sxx, coalesce(sum(x * y), 0) AS sxy FROM vint LEFT JOIN dz ON pos + 5 <= asof_pos GROUP BY vintage) SELECT vintage, n, CASE WHEN n >= 100 THEN coalesce(least(greatest(0.5 * ((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0)) / nullif(sy / n, 0), -0.8), 0.8), 0) ELSE 0 END AS k FROM m", "k")
def k17(v: Views):
    def sd(width, least):
        return win.rolling(F.stddev_samp, "ret", "inst", "d", width, least, 1)
    dev = v.price.select("inst", "d", (F.log(F.nullif(sd(20, 10), F.lit(0.0))) - F.log(F.nullif(sd(60, 20), F.lit(0.0)))).alias("dev"))
    df = dev.join(_outcome(v), ["inst", "d"]).join(v.calendar, "d").select("pos", "dev", "z")
    vint = v.calendar.groupBy(F.date_format("d", "yyyy").alias("vintage")).agg(F.max("pos").alias("asof_pos"))
    return predictive.recalibration(df, vint, 5, 4.0, 100, 0.8)


MASSES = DENS + ", ms AS (SELECT vintage, bin, sum(pw) AS w FROM (SELECT vintage, bin, (cdf - coalesce(lag(cdf) OVER (PARTITION BY vintage, cls ORDER BY bin), 0)) * mass AS pw FROM dens) GROUP BY 1, 2)"
NUS = [2.5, 3.0, 4.0, 5.0, 7.0, 10.0, 15.0, 30.0, 60.0]
NU_ROWS = ", ".join(f"({nu}::DOUBLE, {math.sqrt(nu / (nu - 2))!r}::DOUBLE, {predictive.t_constant(nu)!r}::DOUBLE)" for nu in NUS)


@query("K19_student_nu", f"WITH {MASSES}, gr(nu, sc, c) AS (VALUES {NU_ROWS}), l AS (SELECT vintage, nu, round(-sum(w * (c - (nu + 1) / 2 * ln(1 + ((-4 + (bin + 0.5) * 0.5) * sc) * ((-4 + (bin + 0.5) * 0.5) * sc) / nu) + ln(sc))), 6) AS nll FROM ms, gr GROUP BY 1, 2) SELECT vintage, arg_min(nu, (nll, nu)) AS nu FROM l GROUP BY vintage")
def k19(v: Views):
    return predictive.student_nu(_densities(v), -4.0, 0.5, NUS)


@query("K20_spliced_tail", f"WITH {MASSES}, f AS (SELECT *, sum(w) OVER (PARTITION BY vintage ORDER BY bin) / sum(w) OVER (PARTITION BY vintage) AS cdf FROM ms), u AS (SELECT *, min(CASE WHEN cdf >= 0.05 THEN bin END) OVER (PARTITION BY vintage) AS ub FROM f), t AS (SELECT vintage, max(ub) AS ub, max(CASE WHEN bin = ub THEN cdf END) AS pu, sum(CASE WHEN bin <= ub THEN w * (ub - bin + 0.5) * 0.5 END) / nullif(sum(CASE WHEN bin <= ub THEN w END), 0) AS mean, sum(CASE WHEN bin <= ub THEN w * pow((ub - bin + 0.5) * 0.5, 2) END) / nullif(sum(CASE WHEN bin <= ub THEN w END), 0) AS m2 FROM u GROUP BY vintage), g AS (SELECT *, mean * mean / CASE WHEN m2 - mean * mean > 1e-9 THEN m2 - mean * mean END AS q FROM t), x AS (SELECT vintage, ub, pu, 0.5 * (1 - q) AS xi, 0.5 * mean * (q + 1) AS sc FROM g), s AS (SELECT f.vintage, f.bin, f.cdf, x.ub, x.pu, x.xi, x.sc, 1 + x.xi * (x.ub - f.bin) * 0.5 / x.sc AS base FROM f JOIN x USING (vintage)) SELECT vintage, bin, CASE WHEN bin < ub AND sc IS NOT NULL THEN pu * CASE WHEN base <= 0 THEN 0 WHEN abs(xi) < 1e-9 THEN exp(-(ub - bin) * 0.5 / sc) ELSE exp(-ln(base) / xi) END ELSE cdf END AS cdf FROM s", "cdf")
def k20(v: Views):
    return predictive.spliced_tail(_densities(v), -4.0, 0.5, 0.05)


@query("P6_engine_gates", f"WITH {BOOK} SELECT count(*) AS days, sum(gross) AS gross, sum(turnover) AS turnover, sum(gross) - 0.0015 * sum(turnover) - sum(net) AS cost_error, 0.0::DOUBLE AS exact_error FROM book", "gross turnover cost_error exact_error", 5)
def p6(v: Views):
    """The book against a second computation of its gross return by joins on positions, and the identity of its costs."""
    b = _book(v)
    w = _weights(v).join(v.calendar, "d").select("inst", (F.col("pos") + 2).alias("q"), "w")
    r = v.price.where("ret is not null").join(v.calendar, "d").select("inst", "d", F.col("pos").alias("q"), "ret")
    again = w.join(r, ["inst", "q"]).groupBy("d").agg(F.sum(F.col("w") * F.col("ret")).alias("again"))
    j = b.join(again, "d", "left").withColumn("again", F.coalesce("again", F.lit(0.0)))
    return j.agg(
        F.count("*").alias("days"), F.sum("gross").alias("gross"), F.sum("turnover").alias("turnover"),
        (F.sum("gross") - 0.0015 * F.sum("turnover") - F.sum("net")).alias("cost_error"), F.max(F.abs(F.col("gross") - F.col("again"))).alias("exact_error"),
    )
