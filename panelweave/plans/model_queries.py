"""Queries of estimators, tests, regimes, densities and books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.normal import normal_cdf_sql, probit_sql
from panelweave.operators import aggregates as agg
from panelweave.operators import portfolio as pf
from panelweave.operators import regimes as rg
from panelweave.operators import stats as st
from panelweave.operators import windows as win
from panelweave.plans.fixtures import CALENDAR, EVENTS, PRICE, RUNS, SCORES, STATES, TRADES, Views, avg_rank
from panelweave.plans.registry import query


@query("J1_ols", f"WITH {PRICE} SELECT inst, count(*) AS n, regr_intercept(ret, mkt) AS b_const, regr_slope(ret, mkt) AS b_mkt FROM price WHERE ret IS NOT NULL AND mkt IS NOT NULL GROUP BY inst", "b_const b_mkt")
def j1(v: Views):
    return st.ols(v.price.select("inst", "ret", "mkt"), "ret", ["mkt"], ["inst"])


@query("J2_ar_innovations")
def j2(v: Views):
    w = Window.partitionBy("inst").orderBy("d")
    x = v.price.select("inst", "d", "ret", *[F.lag("ret", k).over(w).alias(f"l{k}") for k in range(1, 6)])
    b = st.ols(x, "ret", [f"l{k}" for k in range(1, 6)], ["inst"]).where("n >= 120")
    fit = F.col("b_const") + sum(F.col(f"b_l{k}") * F.col(f"l{k}") for k in range(1, 6))
    return x.join(b, "inst").select("inst", "d", F.round(F.col("ret") - fit, 8).alias("innovation"))


@query("J3_hac_mean", f"WITH {PRICE}, m AS (SELECT d, avg(adj) AS x FROM price WHERE adj IS NOT NULL GROUP BY d), e AS (SELECT d, x, x - avg(x) OVER () AS e FROM m), l AS (SELECT *, lag(e, 1) OVER (ORDER BY d) AS e1, lag(e, 2) OVER (ORDER BY d) AS e2, lag(e, 3) OVER (ORDER BY d) AS e3 FROM e), g AS (SELECT avg(x) AS mean, count(*) AS n, sum(e * e) AS g0, sum(e * e1) AS g1, sum(e * e2) AS g2, sum(e * e3) AS g3 FROM l) SELECT mean, sqrt(g0 + 1.5 * g1 + g2 + 0.5 * g3) / n AS se, mean / (sqrt(g0 + 1.5 * g1 + g2 + 0.5 * g3) / n) AS t, n FROM g", "mean se t")
def j3(v: Views):
    m = v.price.where("adj is not null").groupBy("d").agg(F.avg("adj").alias("x"))
    return st.hac_mean(m, "d", "x", 3)


@query("J4_two_way_demean", f"WITH {PRICE}, a AS (SELECT inst, d, ret - avg(ret) OVER (PARTITION BY inst) AS x FROM price WHERE ret IS NOT NULL), b AS (SELECT inst, d, x - avg(x) OVER (PARTITION BY d) AS x FROM a), c AS (SELECT inst, d, x - avg(x) OVER (PARTITION BY inst) AS x FROM b) SELECT inst, d, x - avg(x) OVER (PARTITION BY d) AS x FROM c", "x")
def j4(v: Views):
    return st.demean_two_way(v.price.where("ret is not null").select("inst", "d", "ret"), "ret", "inst", "d", 2, "x").select("inst", "d", "x")


@query("J9_lag_profile", f"WITH {PRICE}, l AS (SELECT ret, unnest([0, 1, 2, 3]) AS k, unnest([mkt, lag(mkt, 1) OVER w, lag(mkt, 2) OVER w, lag(mkt, 3) OVER w]) AS x FROM price WINDOW w AS (PARTITION BY inst ORDER BY d)) SELECT k, count(*) AS n, regr_intercept(ret, x) AS b_const, regr_slope(ret, x) AS b_x FROM l WHERE ret IS NOT NULL AND x IS NOT NULL GROUP BY k", "b_const b_x")
def j9(v: Views):
    w = Window.partitionBy("inst").orderBy("d")
    cells = F.array(*[F.struct(F.lit(k).alias("k"), (F.lag("mkt", k).over(w) if k else F.col("mkt")).alias("x")) for k in range(4)])
    x = v.price.withColumn("c", cells).select("ret", F.inline("c"))
    return st.ols(x, "ret", ["x"], ["k"])


@query("J11_daily_differential", f"WITH {SCORES}, m AS (SELECT day AS d, avg((p - y::INT) * (p - y::INT) - (p2 - y::INT) * (p2 - y::INT)) AS x FROM scores GROUP BY day), e AS (SELECT d, x, x - avg(x) OVER () AS e FROM m), l AS (SELECT *, lag(e, 1) OVER (ORDER BY d) AS e1 FROM e), g AS (SELECT avg(x) AS mean, count(*) AS n, sum(e * e) AS g0, sum(e * e1) AS g1 FROM l) SELECT mean, sqrt(g0 + g1) / n AS se, mean / (sqrt(g0 + g1) / n) AS t, n FROM g", "mean se t")
def j11(v: Views):
    y = F.col("y").cast("double")
    s = v.scores.select("day", ((F.col("p") - y) ** 2).alias("a"), ((F.col("p2") - y) ** 2).alias("b"))
    return st.daily_differential(s, "day", "a", "b", 1)


HITS = PRICE + ", h0 AS (SELECT inst, d, ret, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS sd FROM price WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), hits AS (SELECT inst, d, ret / sd AS z, ret / sd < -1.645 AS hit FROM h0 WHERE sd IS NOT NULL AND ret IS NOT NULL)"


def _hits(v: Views):
    sd = win.rolling(F.stddev_samp, "ret", "inst", "d", 60, 20, 1)
    h = v.price.select("inst", "d", "ret", sd.alias("sd")).where("sd is not null and ret is not null")
    return h.select("inst", "d", (F.col("ret") / F.nullif(F.col("sd"), F.lit(0.0))).alias("z")).withColumn("hit", F.col("z") < -1.645)


def xlogy(x: str, y: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN 0 ELSE {x} * ln({y}) END)"


@query("J13_kupiec", f"WITH {HITS}, g AS (SELECT inst, count(*) AS n, CAST(sum(hit::INT) AS DOUBLE) AS x FROM hits GROUP BY inst) SELECT inst, n, x, x / n AS rate, -2 * ({xlogy('(n - x)', 'CAST(0.95 AS DOUBLE)')} + {xlogy('x', 'CAST(0.05 AS DOUBLE)')} - {xlogy('(n - x)', '(1 - x / n)')} - {xlogy('x', '(x / n)')}) AS lr FROM g", "rate lr")
def j13(v: Views):
    return st.kupiec(_hits(v), "hit", 0.05, ["inst"])


@query("J14_christoffersen", f"WITH {HITS}, p AS (SELECT inst, hit::INT AS h, lag(hit::INT) OVER (PARTITION BY inst ORDER BY d) AS p FROM hits), g AS (SELECT inst, CAST(count(*) FILTER (p = 0 AND h = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (p = 0 AND h = 1) AS DOUBLE) AS n01, CAST(count(*) FILTER (p = 1 AND h = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (p = 1 AND h = 1) AS DOUBLE) AS n11 FROM p WHERE p IS NOT NULL GROUP BY inst), q AS (SELECT *, n01 / nullif(n00 + n01, 0) AS p0, n11 / nullif(n10 + n11, 0) AS p1, (n01 + n11) / (n00 + n01 + n10 + n11) AS pp FROM g) SELECT inst, n00, n01, n10, n11, 2 * ({xlogy('n00', '(1 - p0)')} + {xlogy('n01', 'p0')} + {xlogy('n10', '(1 - p1)')} + {xlogy('n11', 'p1')} - {xlogy('(n00 + n10)', '(1 - pp)')} - {xlogy('(n01 + n11)', 'pp')}) AS lr FROM q", "lr")
def j14(v: Views):
    return st.christoffersen(_hits(v), "inst", "d", "hit")


@query("J15_effective_n", f"WITH {HITS}, g AS (SELECT d, CAST(count(*) AS DOUBLE) AS m, CAST(sum(hit::INT) AS DOUBLE) AS x FROM hits GROUP BY d), a AS (SELECT sum(m) AS n, count(*) AS k, sum(x) AS sx, sum(m * m) AS m2, sum(x * x / m) AS b FROM g), s AS (SELECT *, (n - m2 / n) / nullif(k - 1, 0) AS m0, (b - sx * sx / n) / nullif(k - 1, 0) AS msb, (sx - b) / nullif(n - k, 0) AS msw FROM a), r AS (SELECT *, coalesce(greatest(0, (msb - msw) / nullif(msb + (m0 - 1) * msw, 0)), 0) AS icc FROM s) SELECT n, icc, n / (1 + (n / k - 1) * icc) AS effective_n FROM r", "icc effective_n")
def j15(v: Views):
    return st.effective_n(_hits(v), "d", "hit")


@query("J16_pit_histogram", f"WITH {HITS} SELECT CAST(least(floor({normal_cdf_sql('z')} * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM hits GROUP BY 1")
def j16(v: Views):
    from panelweave.functions.normal import normal_cdf

    return _hits(v).groupBy(F.least(F.floor(normal_cdf(F.col("z")) * 20), F.lit(19)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("J18_stratified_rates", f"WITH {HITS}, s AS (SELECT unnest(['all', 'year ' || CAST(year(d) AS VARCHAR)]) AS stratum, hit FROM hits) SELECT stratum, count(*) AS n, avg(hit::INT) AS rate, 1.96 * sqrt(avg(hit::INT) * (1 - avg(hit::INT)) / count(*)) AS half_width FROM s GROUP BY stratum HAVING count(*) >= 50", "rate half_width")
def j18(v: Views):
    strata = F.explode(F.array(F.lit("all"), F.concat(F.lit("year "), F.year("d").cast("string"))))
    s = _hits(v).select(strata.alias("stratum"), F.col("hit").cast("double").alias("h"))
    g = s.groupBy("stratum").agg(F.count("*").alias("n"), F.avg("h").alias("rate")).where("n >= 50")
    return g.withColumn("half_width", 1.96 * F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n")))


@query("J19_two_samples", f"WITH {STATES}, x AS (SELECT state, round(gross, 2) AS g FROM states WHERE state IN ('buy', 'sell')), r AS (SELECT *, {avg_rank('g', '1')} AS r FROM x), a AS (SELECT avg(g) FILTER (state = 'buy') AS ma, avg(g) FILTER (state = 'sell') AS mb, var_samp(g) FILTER (state = 'buy') AS va, var_samp(g) FILTER (state = 'sell') AS vb, count(*) FILTER (state = 'buy') AS na, count(*) FILTER (state = 'sell') AS nb, sum(r) FILTER (state = 'buy') AS s FROM r) SELECT (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d, s - na * (na + 1) / 2 AS u, (SELECT max(abs(ca / CAST(ta AS DOUBLE) - cb / CAST(tb AS DOUBLE))) FROM (SELECT count(*) FILTER (state = 'buy') OVER (ORDER BY g) AS ca, count(*) FILTER (state = 'sell') OVER (ORDER BY g) AS cb, count(*) FILTER (state = 'buy') OVER () AS ta, count(*) FILTER (state = 'sell') OVER () AS tb FROM x)) AS ks, na, nb FROM a", "d u ks")
def j19(v: Views):
    return st.cohen_d(v.states.withColumn("gross", F.round("gross", 2)), "state", "gross", "buy", "sell")


@query("J25_holm", f"WITH {TRADES}, t AS (SELECT inst, (count(*) % 97) / 1000.0 AS p FROM trades GROUP BY inst), s AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, inst) + 1)) AS s, least(1.0, p * count(*) OVER ()) AS bonferroni FROM t) SELECT inst, p, bonferroni, max(s) OVER (ORDER BY p, inst) AS holm FROM s", "p bonferroni holm")
def j25(v: Views):
    t = v.trades.groupBy("inst").agg((F.count("*") % 97 / 1000).alias("p"))
    return st.holm(t, "p", "inst")


IC = PRICE + ", x AS (SELECT inst, d, round(-ret, 9) AS sig, round(lead(adj) OVER (PARTITION BY inst ORDER BY d), 9) AS nxt FROM price), y AS (SELECT * FROM x WHERE sig IS NOT NULL AND nxt IS NOT NULL)"


def _signal(v: Views):
    nxt = F.lead("adj").over(Window.partitionBy("inst").orderBy("d"))
    return v.price.select("inst", "d", F.round(-F.col("ret"), 9).alias("sig"), F.round(nxt, 9).alias("nxt"))


@query("J27_daily_ic", f"WITH {IC}, r AS (SELECT d, {avg_rank('sig', 'd')} AS a, {avg_rank('nxt', 'd')} AS b FROM y) SELECT d, corr(a, b) AS ic, count(*) AS names FROM r GROUP BY d HAVING count(*) >= 20", "ic")
def j27(v: Views):
    return st.daily_ic(_signal(v), "d", "sig", "nxt", 20)


@query("J28_quintile_spread", f"WITH {IC}, q AS (SELECT d, nxt, ceil({avg_rank('sig', 'd')} / count(*) OVER (PARTITION BY d) * 5) AS q FROM y) SELECT d, avg(nxt) FILTER (q = 5) - avg(nxt) FILTER (q = 1) AS spread FROM q GROUP BY d", "spread")
def j28(v: Views):
    q = win.quintile(_signal(v).where("sig is not null and nxt is not null"), "d", "sig")
    return q.groupBy("d").agg((F.avg(F.when(F.col("quintile") == 5, F.col("nxt"))) - F.avg(F.when(F.col("quintile") == 1, F.col("nxt")))).alias("spread"))


@query("J29_auc_scores", f"WITH {SCORES}, r AS (SELECT *, {avg_rank('p', 'g')} AS r FROM scores), a AS (SELECT g, CAST(sum(y::INT) AS DOUBLE) AS k, CAST(count(*) AS DOUBLE) AS n, sum(r * y::INT) AS s, avg(-(y::INT * ln(p) + (1 - y::INT) * ln(1 - p))) AS log_loss, avg((p - y::INT) * (p - y::INT)) AS brier, avg(((p >= 0.5) = y)::INT) AS accuracy FROM r GROUP BY g) SELECT g, (s - k * (k + 1) / 2) / (k * (n - k)) AS auc, log_loss, brier, accuracy FROM a", "auc log_loss brier accuracy")
def j29(v: Views):
    return st.auc_scores(v.scores, "y", "p", ["g"])


@query("J30_reliability", f"WITH {SCORES}, b AS (SELECT CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(p) AS forecast, avg(y::INT) AS observed FROM scores GROUP BY 1), t AS (SELECT *, sum(n * observed) OVER () / sum(n) OVER () AS base, sum(n) OVER () AS tn FROM b) SELECT bin, n, forecast, observed, (forecast - observed) * (forecast - observed) * n / tn AS reliability, (observed - base) * (observed - base) * n / tn AS resolution FROM t", "forecast observed reliability resolution")
def j30(v: Views):
    return st.reliability(v.scores, "y", "p", 10)


@query("J31_paired_t", f"WITH {SCORES}, d AS (SELECT day, avg(p - p2) AS x FROM scores GROUP BY day) SELECT avg(x) AS mean, avg(x) / stddev_samp(x) * sqrt(count(x)) AS t, count(x) AS days FROM d", "mean t", )
def j31(v: Views):
    return st.paired_t(v.scores, "day", "p", "p2")


AGES = RUNS + ", ages AS (SELECT inst, d, row_number() OVER (PARTITION BY inst, run ORDER BY d) AS age, d = max(d) OVER (PARTITION BY inst, run) AS ends, run = max(run) OVER (PARTITION BY inst) AS censored FROM runs), hz0 AS (SELECT least(age, 8) AS age, count(*) AS n, sum(ends::INT) AS k FROM ages WHERE NOT censored GROUP BY 1), hz AS (SELECT age, n, CASE WHEN n >= 30 THEN k / n ELSE sum(k) OVER () / sum(n) OVER () END AS hazard FROM hz0)"


def _hazard(v: Views):
    runs = win.run_ages(win.with_runs(v.states, "inst", "d", "state"), "inst", "d").where("not censored")
    return st.hazard_by_age(runs.withColumn("ends", F.col("d") == F.col("run_end")), "age", "ends", 8, 30)


@query("J32_hazard", f"WITH {AGES} SELECT age, n, hazard FROM hz", "hazard")
def j32(v: Views):
    return _hazard(v)


@query("J32_hazard_within", f"WITH {AGES} SELECT age, 1 - exp(sum(ln(1 - least(hazard, 1 - 1e-12))) OVER w + (3 - count(*) OVER w) * ln(1 - least(last_value(hazard) OVER (ORDER BY age ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 1 - 1e-12))) AS within FROM hz WINDOW w AS (ORDER BY age ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)", "within")
def j32b(v: Views):
    return st.hazard_within(_hazard(v), 3)


EVT = RUNS + f", {PRICE.replace(TRADES + ', ', '')}, cm AS (SELECT inst, d, sum(adj) OVER (PARTITION BY inst ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM price WHERE adj IS NOT NULL), fw AS (SELECT inst, d, lead(cum, 5) OVER (PARTITION BY inst ORDER BY d) - cum AS car FROM cm), st0 AS (SELECT inst, state, min(d) AS d FROM runs GROUP BY inst, run, state)"


@query("J33_event_study", f"WITH {EVT}, base AS (SELECT avg(car) AS b FROM fw) SELECT state, count(car) AS n, avg(car) - (SELECT b FROM base) AS excess FROM st0 JOIN fw USING (inst, d) GROUP BY state", "excess")
def j33(v: Views):
    w = Window.partitionBy("inst").orderBy("d")
    cum = v.price.where("adj is not null").select("inst", "d", F.sum("adj").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"))
    fw = cum.select("inst", "d", (F.lead("cum", 5).over(w) - F.col("cum")).alias("car"))
    e = win.episodes(win.with_runs(v.states, "inst", "d", "state"), "inst", "d", "state", "imb").select("inst", "state", F.col("start").alias("d"))
    base = fw.agg(F.avg("car").alias("b"))
    return e.join(fw, ["inst", "d"]).groupBy("state").agg(F.count("car").alias("n"), F.avg("car").alias("m")).join(F.broadcast(base)).select("state", "n", (F.col("m") - F.col("b")).alias("excess"))


@query("J36_crisis_share", f"WITH {HITS} SELECT sum(z) FILTER (d BETWEEN DATE '1997-07-01' AND DATE '1998-12-31') / sum(z) AS share, avg(z) FILTER (NOT d BETWEEN DATE '1997-07-01' AND DATE '1998-12-31') AS outside FROM hits", "share outside", 4)
def j36(v: Views):
    inside = F.col("d").between("1997-07-01", "1998-12-31")
    return _hits(v).agg((F.sum(F.when(inside, F.col("z"))) / F.sum("z")).alias("share"), F.avg(F.when(~inside, F.col("z"))).alias("outside"))


@query("K8_rule_backbone", f"WITH {STATES}, q AS (SELECT quantile_cont(imb, 0.3) AS a, quantile_cont(imb, CAST(0.75 AS DOUBLE)) AS b FROM states) SELECT inst, d, CASE WHEN imb < a THEN 'sell' WHEN imb > b THEN 'buy' ELSE 'neutral' END AS rule FROM states, q")
def k8(v: Views):
    return rg.rule_backbone(v.states, "imb", 0.3, 0.25).select("inst", "d", "rule")


@query("K10_weighted_quantile", f"WITH {EVENTS}, g AS (SELECT event_type, value, sum(CAST(1 + user_id % 3 AS DOUBLE)) AS w FROM ev GROUP BY 1, 2), p AS (SELECT *, (sum(w) OVER (PARTITION BY event_type ORDER BY value) - w / 2) / sum(w) OVER (PARTITION BY event_type) AS p FROM g), n AS (SELECT *, lead(p) OVER o AS p2, lead(value) OVER o AS v2, lag(p) OVER o IS NULL AS f FROM p WINDOW o AS (PARTITION BY event_type ORDER BY value)) SELECT event_type, min(CASE WHEN f AND p >= 0.7 THEN value WHEN p <= 0.7 AND p2 > 0.7 THEN value + (v2 - value) * (0.7 - p) / (p2 - p) WHEN p2 IS NULL AND p <= 0.7 THEN value END) AS quantile FROM n GROUP BY event_type", "quantile", 4)
def k10(v: Views):
    return st.weighted_quantile(v.events.withColumn("w", (1 + F.col("user_id") % 3).cast("double")), "event_type", "value", "w", 0.7)


HARD = "CASE WHEN state = 'neutral' THEN 'quiet' WHEN state = 'sell' AND n > 8 THEN 'concentrated_sell' WHEN state = 'sell' THEN 'dispersed_sell' WHEN gross > 400000 THEN 'block_buy' ELSE 'steady_buy' END"


@query("K12_hard_class", f"WITH {STATES} SELECT inst, d, {HARD} AS cls FROM states")
def k12(v: Views):
    return v.states.select("inst", "d", rg.hard_class(F.col("state"), F.col("gross"), F.col("n"), 400000.0, 8.0).alias("cls"))


SOFT = f"x AS (SELECT inst, d, 0.5 * (1 - imb) * 0.8 AS ps, 0.2 AS pn, 0.5 * (1 + imb) * 0.8 AS pb, (n - 6) / 2.0 AS c, (gross - 300000) / 100000 AS b FROM states), w AS (SELECT inst, d, CAST(pn AS DOUBLE) AS w1, ps * {normal_cdf_sql('((c - 0.5) / 1.5)')} AS w2, ps * (1 - {normal_cdf_sql('((c - 0.5) / 1.5)')}) AS w3, pb * {normal_cdf_sql('((b - 0.2) / 1.5)')} AS w4, pb * (1 - {normal_cdf_sql('((b - 0.2) / 1.5)')}) AS w5 FROM x)"


def _ent(w: str) -> str:
    return f"CASE WHEN {w} > 0 THEN {w} * ln({w}) ELSE 0 END"


@query("K13_soft_bands", f"WITH {STATES}, {SOFT} SELECT inst, d, w1 + w2 + w3 + w4 + w5 AS total, greatest(w1, w2, w3, w4, w5) AS top, -({' + '.join(_ent(f'w{i}') for i in range(1, 6))}) AS entropy FROM w", "total top entropy")
def k13(v: Views):
    s = v.states
    ps, pb = 0.5 * (1 - F.col("imb")) * 0.8, 0.5 * (1 + F.col("imb")) * 0.8
    w = rg.soft_bands(ps, F.lit(0.2), pb, (F.col("gross") - 300000) / 100000, (F.col("n") - 6) / 2, 0.2, 0.5, 1.5)
    total, top, entropy = rg.band_summary(F.col("w"))
    return s.select("inst", "d", w.alias("w")).select("inst", "d", total.alias("total"), top.alias("top"), entropy.alias("entropy"))


ZED = PRICE + ", zz AS (SELECT inst, d, CASE WHEN count(ret) OVER w >= 20 THEN stddev_samp(ret) OVER w END AS sd, CASE WHEN abs(ret) <= 0.5 THEN ln(1 + ret) END AS g FROM price WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), z AS (SELECT inst, d, CASE WHEN sd > 0 THEN CASE WHEN count(g) OVER f = 5 THEN sum(g) OVER f END / (sd * sqrt(5)) END AS z FROM zz WINDOW f AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"


def _outcome(v: Views):
    sd = win.rolling(F.stddev_samp, "ret", "inst", "d", 60, 20, 1)
    return rg.standardised_outcome(v.price.select("inst", "d", "ret", sd.alias("sd")), "inst", "d", "ret", "sd", 5, 0.5).select("inst", "d", "z")


@query("K14_standardised_outcome", f"WITH {ZED} SELECT inst, d, z FROM z", "z")
def k14(v: Views):
    return _outcome(v)


DENS = ZED + f", {CALENDAR}, obs AS (SELECT c.pos, CASE WHEN z.inst < 'Brand#2' THEN 'a' ELSE 'b' END AS cls, round(z.z, 6) AS z, 1.0 + c.pos % 3 AS w FROM z JOIN calendar c ON z.d = c.d WHERE z.z IS NOT NULL), vint AS (SELECT strftime(d, '%Y') AS vintage, max(pos) AS asof_pos FROM calendar GROUP BY 1), cells AS (SELECT vintage, cls, CAST(greatest(0, least(floor((z + 4) / 0.5), 15)) AS INTEGER) AS bin, sum(w) AS w, sum(w * w) AS w2 FROM obs JOIN vint ON pos + 5 <= asof_pos GROUP BY 1, 2, 3), grid AS (SELECT vintage, cls, bin FROM vint, (SELECT DISTINCT cls, bin FROM cells)), full_ AS (SELECT g.*, coalesce(w, 0) AS w, coalesce(w2, 0) AS w2 FROM grid g LEFT JOIN cells USING (vintage, cls, bin)), dens AS (SELECT vintage, cls, bin, sum(w) OVER (PARTITION BY vintage, cls ORDER BY bin) / sum(w) OVER c AS cdf, sum(w) OVER c AS mass, (sum(w) OVER c) * (sum(w) OVER c) / sum(w2) OVER c AS ess FROM full_ WINDOW c AS (PARTITION BY vintage, cls) QUALIFY sum(w) OVER c > 0)"


def _densities(v: Views):
    obs = _outcome(v).where("z is not null").join(v.calendar, "d").select("pos", F.when(F.col("inst") < "Brand#2", "a").otherwise("b").alias("cls"), F.round("z", 6).alias("z"), (1.0 + F.col("pos") % 3).alias("w"))
    vint = v.calendar.groupBy(F.date_format("d", "yyyy").alias("vintage")).agg(F.max("pos").alias("asof_pos"))
    return rg.past_densities(obs, vint, 5, -4.0, 0.5, 16)


@query("K15_past_densities", f"WITH {DENS} SELECT vintage, cls, bin, cdf, mass, ess FROM dens", "cdf mass ess")
def k15(v: Views):
    return _densities(v)


@query("K16_density_gates", f"WITH {DENS}, s AS (SELECT *, cdf - lag(cdf) OVER (PARTITION BY vintage, cls ORDER BY bin) AS s FROM dens) SELECT vintage, cls, count(*) FILTER (s < -1e-12) AS steps_down, max(cdf) AS top, max(ess) AS ess FROM s GROUP BY 1, 2", "top ess")
def k16(v: Views):
    return rg.density_gates(_densities(v))


@query("K22_normal_crps", f"WITH {HITS} SELECT inst, avg(z * (2 * {normal_cdf_sql('z')} - 1) + 2 * exp(-z * z / 2) / 2.5066282746310002 - 0.5641895835477563) AS crps FROM hits GROUP BY inst", "crps")
def k22(v: Views):
    h = _hits(v)
    return h.groupBy("inst").agg(F.avg(rg.normal_crps(F.col("z"), F.lit(0.0), F.lit(1.0))).alias("crps"))


@query("K23_pinball", f"WITH {HITS} SELECT inst, avg(CASE WHEN z >= -1.645 THEN (z + 1.645) * 0.05 ELSE (-1.645 - z) * 0.95 END) AS pinball05, avg((z < -1.645)::INT) AS hit05, avg((z < -2.326)::INT) AS hit01 FROM hits GROUP BY inst", "pinball05 hit05 hit01")
def k23(v: Views):
    z = F.col("z")
    return _hits(v).groupBy("inst").agg(F.avg(rg.pinball(z, F.lit(-1.645), 0.05)).alias("pinball05"), F.avg((z < -1.645).cast("double")).alias("hit05"), F.avg((z < -2.326).cast("double")).alias("hit01"))


@query("K4_forward_filter", f"""WITH RECURSIVE {PRICE}, o AS (SELECT inst, d, ret, row_number() OVER (PARTITION BY inst ORDER BY d) AS k, greatest(1e-300, CASE WHEN ret IS NULL THEN 1 ELSE exp(-(ret + 0.05) * (ret + 0.05) / 0.02) / 0.1 END)::DOUBLE AS a, greatest(1e-300, CASE WHEN ret IS NULL THEN 1 ELSE exp(-(ret - 0.05) * (ret - 0.05) / 0.08) / 0.2 END)::DOUBLE AS b FROM price),
 f AS (SELECT inst, d, k, (0.5 * a / (0.5 * a + 0.5 * b))::DOUBLE AS p FROM o WHERE k = 1 UNION ALL
 SELECT o.inst, o.d, o.k, ((f.p * 0.9 + (1 - f.p) * 0.2) * o.a / ((f.p * 0.9 + (1 - f.p) * 0.2) * o.a + (f.p * 0.1 + (1 - f.p) * 0.8) * o.b))::DOUBLE FROM f JOIN o ON o.inst = f.inst AND o.k = f.k + 1)
 SELECT inst, d, p FROM f""", "p")
def k4(v: Views):
    f = rg.forward_filter(v.price, "inst", "d", "ret", [-0.05, 0.05], [0.1, 0.2], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5])
    return f.select("inst", "d", F.col("p")[0].alias("p"))


@query("K28_stickiness", f"WITH {STATES}, l AS (SELECT state, lead(state) OVER (PARTITION BY inst ORDER BY d) AS nx FROM states) SELECT state, count(*) AS n, avg((state = nx)::INT) AS self_rate FROM l WHERE nx IS NOT NULL GROUP BY state", "self_rate")
def k28(v: Views):
    l = v.states.withColumn("nx", F.lead("state").over(Window.partitionBy("inst").orderBy("d"))).where("nx is not null")
    return l.groupBy("state").agg(F.count("*").alias("n"), F.avg((F.col("state") == F.col("nx")).cast("double")).alias("self_rate"))


@query("L9_matched_coverage", f"WITH {HITS} SELECT inst, quantile_cont(-z, 0.99) AS scale99, avg(-z - 1.645) FILTER (hit) AS mean_excess FROM hits GROUP BY inst", "scale99 mean_excess")
def l9(v: Views):
    return _hits(v).groupBy("inst").agg(F.percentile(-F.col("z"), F.lit(0.99)).alias("scale99"), F.avg(F.when(F.col("hit"), -F.col("z") - 1.645)).alias("mean_excess"))


@query("L10_controlled_pair", f"WITH {SCORES}, a AS (SELECT day, avg(p) AS x FROM scores WHERE g <> 'N' GROUP BY day), b AS (SELECT day, avg(p2) AS x FROM scores WHERE g <> 'A' GROUP BY day) SELECT count(*) AS days, avg(a.x - b.x) AS mean FROM a JOIN b USING (day)", "mean")
def l10(v: Views):
    a = v.scores.where("g <> 'N'").groupBy("day").agg(F.avg("p").alias("x"))
    b = v.scores.where("g <> 'A'").groupBy("day").agg(F.avg("p2").alias("y"))
    return a.join(b, "day").agg(F.count("*").alias("days"), F.avg(F.col("x") - F.col("y")).alias("mean"))


def _w_sql() -> str:
    out, prev = "", "al"
    for i in range(4):
        out += f", a{i} AS (SELECT inst, d, w - avg(w) OVER (PARTITION BY d) AS w FROM {prev}), b{i} AS (SELECT inst, d, greatest(least(w / nullif(sum(abs(w)) OVER (PARTITION BY d), 0), 0.08), -0.08) AS w FROM a{i})"
        prev = f"b{i}"
    return out + f", wt AS (SELECT inst, d, w / nullif(sum(abs(w)) OVER (PARTITION BY d), 0) AS w FROM {prev})"


WEIGHTS = PRICE + ", al AS (SELECT inst, d, -sum(ret) OVER v AS w FROM price WINDOW v AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) QUALIFY count(ret) OVER v = 4)" + _w_sql()


def _weights(v: Views):
    return pf.weights(pf.reversal(v.price, "inst", "d", "ret", 4), "d", "alpha", 0.08).select("inst", "d", "w")


@query("P1_weights", f"WITH {WEIGHTS} SELECT inst, d, w FROM wt", "w")
def p1(v: Views):
    return _weights(v)


BOOK = WEIGHTS + f", {CALENDAR}, held AS (SELECT w.inst, c.pos + 2 AS pos, w.w FROM wt w JOIN calendar c USING (d) WHERE c.pos + 2 <= (SELECT max(pos) FROM calendar)), gone AS (SELECT inst, pos + 1 AS pos, -w AS w FROM held WHERE pos + 1 <= (SELECT max(pos) FROM calendar)), turn AS (SELECT pos, sum(abs(dw)) AS turnover FROM (SELECT inst, pos, sum(w) AS dw FROM (SELECT * FROM held UNION ALL SELECT * FROM gone) GROUP BY inst, pos) GROUP BY pos), pnl AS (SELECT h.pos, sum(h.w * p.ret) AS gross FROM held h JOIN calendar c ON h.pos = c.pos JOIN price p ON p.inst = h.inst AND p.d = c.d GROUP BY h.pos), book AS (SELECT c.d, coalesce(p.gross, 0) AS gross, coalesce(t.turnover, 0) AS turnover, coalesce(t.turnover, 0) / 2 AS half_turnover, coalesce(p.gross, 0) - 0.0015 * coalesce(t.turnover, 0) AS net FROM calendar c LEFT JOIN pnl p USING (pos) LEFT JOIN turn t USING (pos))"


def _book(v: Views):
    return pf.book(_weights(v), v.price.select("inst", "d", "ret"), v.calendar, 1, 15.0)


@query("P2_book", f"WITH {BOOK} SELECT d, gross, turnover, half_turnover, net FROM book", "gross turnover half_turnover net")
def p2(v: Views):
    return _book(v)


@query("P3_metrics", f"WITH {BOOK}, c AS (SELECT *, sum(net) OVER (ORDER BY d) AS cum FROM book), r AS (SELECT *, cum - max(cum) OVER (ORDER BY d ROWS UNBOUNDED PRECEDING) AS dd FROM c), a AS (SELECT avg(net) AS m, stddev_samp(net) AS s, sqrt(avg(least(net, 0) * least(net, 0))) AS dn, min(dd) AS dd, avg((net > 0)::INT) AS hit, sum(net) / sum(turnover) * 10000 AS margin_bps FROM r) SELECT m * 52 AS ret, s * sqrt(52) AS vol, m * 52 / (s * sqrt(52)) AS sharpe, m * 52 / (dn * sqrt(52)) AS sortino, dd AS max_drawdown, m * 52 / -dd AS calmar, hit, margin_bps FROM a", "ret vol sharpe sortino max_drawdown calmar hit margin_bps")
def p3(v: Views):
    return pf.metrics(_book(v), "d", "net", 52.0)


@query("P4_cost_grid", f"WITH {BOOK} SELECT cost_bps, avg(gross - cost_bps * 0.0001 * turnover) / stddev_samp(gross - cost_bps * 0.0001 * turnover) * sqrt(52) AS sharpe, sum(gross) / sum(turnover) * 10000 AS breakeven_bps FROM book, (SELECT unnest([0.0, 5.0, 15.0]) AS cost_bps) GROUP BY cost_bps", "cost_bps sharpe breakeven_bps")
def p4(v: Views):
    return pf.cost_grid(_book(v), [0.0, 5.0, 15.0], 52.0)


@query("P5_reversal_signal", f"WITH {PRICE} SELECT inst, d, CASE WHEN count(ret) OVER v = 4 THEN -sum(ret) OVER v END AS alpha FROM price WINDOW v AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "alpha")
def p5(v: Views):
    return pf.reversal(v.price, "inst", "d", "ret", 4).select("inst", "d", "alpha")


M0 = f"""WITH {TRADES}, adm AS (SELECT * FROM trades WHERE side IN (1, 4) AND rate > 0 AND kind IN ('A', 'N', 'R')), pn AS (SELECT inst, d, count(*) AS n, sum(CASE WHEN side = 4 THEN value ELSE 0 END) AS sell_value FROM adm GROUP BY 1, 2),
 ev AS (SELECT inst, d, entity, sum(value) AS v FROM adm WHERE side = 4 AND entity IS NOT NULL GROUP BY 1, 2, 3), cc AS (SELECT inst, d, sum(v * v) / (sum(v) * sum(v)) AS c, sum(v) AS vv FROM ev GROUP BY 1, 2),
 m AS (SELECT pn.inst, pn.d, n, sell_value, CASE WHEN vv / nullif(sell_value, 0) >= 0.5 THEN round(c, 9) END AS concentration FROM pn LEFT JOIN cc ON cc.inst = pn.inst AND cc.d = pn.d WHERE n >= 3),
 r AS (SELECT *, (rank() OVER (PARTITION BY d ORDER BY concentration) + (count(*) OVER (PARTITION BY d, concentration) - 1) / 2.0) / (count(*) OVER (PARTITION BY d) + 1) AS p FROM m WHERE concentration IS NOT NULL)
 SELECT inst, d, n, sell_value, concentration, {probit_sql('p')} AS score FROM r ORDER BY score DESC, d, inst LIMIT 50"""


@query("M0_concentrated_selling", M0, "sell_value score")
def flagship(v: Views):
    from panelweave.plans.flagship import concentrated_selling

    return concentrated_selling(v.spark, v.dir, "week", 50)
