"""Queries of aggregations, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.functions.normal import normal_cdf, normal_cdf_sql, probit, probit_sql
from panelweave.operators import aggregates as agg
from panelweave.operators import windows as win
from panelweave.operators.stats import quantiles
from panelweave.plans.fixtures import CALENDAR, EVENTS, PANEL, PRICE, RUNS, STATES, TRADES, Views, avg_rank
from panelweave.plans.registry import query


@query("E1_stockday_panel", f"WITH {PANEL} SELECT * FROM panel", "buy_value sell_value total_qty size_sd valid_gross net gross mean_size coverage")
def e1(v: Views):
    return v.panel


HHI = "e AS (SELECT entity, inst, d, sum(value) AS v FROM trades WHERE side = 4 AND entity IS NOT NULL GROUP BY 1, 2, 3)"


@query("E2_concentration", f"WITH {TRADES}, {HHI} SELECT inst, d, sum(v * v) / (sum(v) * sum(v)) AS concentration, sum(v) AS valid_value FROM e GROUP BY inst, d", "concentration valid_value", 4)
def e2(v: Views):
    return agg.concentration(v.trades, 4)


@query("E3_book_focus", f"WITH {TRADES}, {HHI}, o AS (SELECT entity, d, sum(v * v) / (sum(v) * sum(v)) AS hhi FROM e GROUP BY 1, 2) SELECT inst, d, sum(v * hhi) / sum(v) AS focus FROM e JOIN o USING (entity, d) GROUP BY inst, d", "focus")
def e3(v: Views):
    return agg.book_focus(v.trades, 4)


@query("E4_coverage_gate", f"WITH {TRADES}, t AS (SELECT inst, d, count(DISTINCT entity) AS ents, sum(value) FILTER (entity % 3 = 0) AS known, sum(value) AS total FROM trades GROUP BY 1, 2) SELECT inst, d, CASE WHEN known / total >= 0.5 THEN ents END AS ents FROM t")
def e4(v: Views):
    t = v.trades.groupBy("inst", "d").agg(F.countDistinct("entity").alias("ents"), F.sum(F.when(F.col("entity") % 3 == 0, F.col("value"))).alias("known"), F.sum("value").alias("total"))
    return agg.gate_coverage(t, "known", "total", ["ents"]).select("inst", "d", "ents")


@query("E5_composition", f"WITH {TRADES}, v AS (SELECT inst, kind, entity, sum(value) AS v FROM trades GROUP BY 1, 2, 3), s AS (SELECT *, v / sum(v) OVER (PARTITION BY inst, kind) AS s FROM v) SELECT inst, kind, count(*) AS parts, max(s) AS top_share, -sum(s * ln(s)) AS entropy, sum(s * s) AS hhi FROM s GROUP BY 1, 2", "top_share entropy hhi")
def e5(v: Views):
    return agg.composition(v.trades, ["inst", "kind"], "entity")


@query("E6_market_imbalance", f"WITH {PANEL} SELECT d, sum(net) / sum(gross) AS imbalance FROM panel GROUP BY d", "imbalance")
def e6(v: Views):
    return agg.market_flow(v.panel).select("d", "imbalance")


@query("E7_market_flow", f"WITH {PANEL} SELECT d, sum(net) AS net, sum(gross) AS gross, avg(sign(net)) AS breadth FROM panel GROUP BY d", "net gross breadth", 4)
def e7(v: Views):
    return agg.market_flow(v.panel).select("d", "net", "gross", "breadth")


@query("E8_census", f"WITH {STATES}, c AS (SELECT year(d) AS y, state, count(*) AS n FROM states GROUP BY 1, 2) SELECT y, state, n, n / sum(n) OVER (PARTITION BY y) AS share, n / sum(n) OVER () AS share_all FROM c", "share share_all")
def e8(v: Views):
    return agg.census(v.states.withColumn("y", F.year("d")), "y", "state")


@query("E9_transitions", f"WITH {STATES}, x AS (SELECT state, lead(state) OVER (PARTITION BY inst ORDER BY d) AS nx FROM states) SELECT state, avg(CASE WHEN nx = 'buy' THEN 1.0 ELSE 0 END) AS to_buy, avg(CASE WHEN nx = 'neutral' THEN 1.0 ELSE 0 END) AS to_neutral, avg(CASE WHEN nx = 'sell' THEN 1.0 ELSE 0 END) AS to_sell FROM x WHERE nx IS NOT NULL GROUP BY state", "to_buy to_neutral to_sell")
def e9(v: Views):
    return agg.transition_matrix(v.states, "inst", ["d"], "state", ["buy", "neutral", "sell"])


@query("E10_kappa", f"WITH {STATES}, x AS (SELECT state AS a, CASE WHEN imb > 0.05 THEN 'buy' WHEN imb < -0.05 THEN 'sell' ELSE 'neutral' END AS b FROM states), m AS (SELECT count(*) AS t, sum(CASE WHEN a = b THEN 1 ELSE 0 END) AS g FROM x), e AS (SELECT sum(na * nb) AS x FROM (SELECT a AS k, count(*) AS na FROM x GROUP BY a) JOIN (SELECT b AS k, count(*) AS nb FROM x GROUP BY b) USING (k)) SELECT g / t AS observed, x / (CAST(t AS DOUBLE) * t) AS expected, (g / t - x / (CAST(t AS DOUBLE) * t)) / (1 - x / (CAST(t AS DOUBLE) * t)) AS kappa FROM m, e", "observed expected kappa")
def e10(v: Views):
    other = F.when(F.col("imb") > 0.05, "buy").when(F.col("imb") < -0.05, "sell").otherwise("neutral")
    return agg.kappa(v.states.withColumn("other", other), "state", "other")


@query("E11_funnel", f"WITH {TRADES} SELECT 0 AS step, 'buys' AS name, count(*) FILTER (side = 1) AS rows, sum(value) FILTER (side = 1) / sum(value) AS value_share FROM trades UNION ALL SELECT 1, 'large', count(*) FILTER (side = 1 AND quantity > 20), sum(value) FILTER (side = 1 AND quantity > 20) / sum(value) FROM trades UNION ALL SELECT 2, 'kind A', count(*) FILTER (side = 1 AND quantity > 20 AND kind = 'A'), sum(value) FILTER (side = 1 AND quantity > 20 AND kind = 'A') / sum(value) FROM trades", "value_share")
def e11(v: Views):
    return agg.funnel(v.trades, "value", [("buys", "side = 1"), ("large", "quantity > 20"), ("kind A", "kind = 'A'")])


@query("E12_latency_curve", f"WITH {TRADES}, calendar AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT day AS d FROM trades GROUP BY day HAVING count(DISTINCT inst) >= 10)), j AS (SELECT t.value, b.pos - a.pos AS lag FROM trades t JOIN calendar a ON t.day = a.d LEFT JOIN calendar b ON t.rpt = b.d), g AS (SELECT lag, sum(value) AS v, count(*) AS n FROM j GROUP BY lag), w AS (SELECT *, sum(v) OVER () AS tv, sum(n) OVER () AS tn FROM g) SELECT lag, sum(v) OVER (ORDER BY lag) / tv AS value_share, sum(n) OVER (ORDER BY lag) / tn AS count_share FROM w WHERE lag BETWEEN 0 AND 4", "value_share count_share")
def e12(v: Views):
    return agg.latency_curve(v.trades, win.trading_calendar(v.trades, "day", "inst", 10), "day", "rpt", 4)


@query("E13_persistence", f"WITH {TRADES}, m AS (SELECT entity, count(DISTINCT date_trunc('month', day)) AS months FROM trades GROUP BY entity) SELECT count(*) AS keys, median(months) AS median_months, avg(months) AS mean_months FROM m", "median_months mean_months")
def e13(v: Views):
    return agg.persistence(v.trades, "entity", "day")


@query("E14_record", f"WITH {TRADES} SELECT count(*) AS n, min(day) AS first, max(day) AS last, count(DISTINCT inst) AS distinct_inst, count(DISTINCT entity) AS distinct_entity FROM trades")
def e14(v: Views):
    return agg.record(v.trades, "day", ["inst", "entity"])


@query("E15_variance_split", f"WITH {PRICE}, g AS (SELECT inst, count(ret) AS n, avg(ret) AS m, var_pop(ret) AS v FROM price GROUP BY inst), w AS (SELECT sum(n) AS t, sum(n * m) / sum(n) AS mu, sum(n * v) AS wn, sum(n * m * m) AS sq FROM g) SELECT sq / t - mu * mu AS between_var, wn / t AS within_var, (sq / t - mu * mu) / (sq / t - mu * mu + wn / t) AS between_share FROM w", "between_var within_var between_share")
def e15(v: Views):
    return agg.variance_split(v.price, "inst", "ret")


@query("E16_median_ac1", f"WITH {PRICE}, l AS (SELECT inst, ret, lag(ret) OVER (PARTITION BY inst ORDER BY d) AS p FROM price), c AS (SELECT inst, corr(ret, p) AS r FROM l WHERE ret IS NOT NULL AND p IS NOT NULL GROUP BY inst HAVING count(*) >= 30) SELECT median(r) AS median_ac1, count(r) AS keys FROM c", "median_ac1")
def e16(v: Views):
    return agg.median_autocorrelation(v.price, "inst", "d", "ret", 30)


@query("E17_correlations", f"WITH {PANEL}, x AS (SELECT corr(net, gross) AS c1, corr(net, n) AS c2, corr(gross, n) AS c3, avg(CASE WHEN net IS NULL THEN 1.0 ELSE 0 END) AS z FROM panel) SELECT * FROM (SELECT 'net' AS a, 'gross' AS b, c1 AS corr, z AS null_a, z AS null_b FROM x UNION ALL SELECT 'net', 'n', c2, z, z FROM x UNION ALL SELECT 'gross', 'n', c3, z, z FROM x) WHERE abs(corr) >= 0.3", "corr null_a null_b")
def e17(v: Views):
    return agg.null_and_correlation(v.panel, ["net", "gross", "n"], 0.3)


@query("E18_enrichment", f"WITH {TRADES}, g AS (SELECT kind, count(*) AS n, CAST(sum(CASE WHEN quantity >= 45 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM trades GROUP BY kind), o AS (SELECT *, sum(n) OVER () - n AS oth, sum(k) OVER () - k AS ok FROM g) SELECT kind, n, k, k / n AS rate, (k / n) / (ok / oth) AS ratio, (k / n - ok / oth) / sqrt(((k + ok) / (n + oth)) * (1 - (k + ok) / (n + oth)) * (1.0 / n + 1.0 / oth)) AS z FROM o", "rate ratio z")
def e18(v: Views):
    return agg.enrichment(v.trades.withColumn("hit", F.col("quantity") >= 45), "kind", "hit")


@query("E19_roll_spread", f"WITH {PRICE}, l AS (SELECT inst, ret, lag(ret) OVER (PARTITION BY inst ORDER BY d) AS p FROM price), g AS (SELECT inst, covar_pop(ret, p) AS c, avg(CASE WHEN ret = 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0 END) AS zero_share, median(abs(ret)) AS median_abs FROM l GROUP BY inst) SELECT inst, CASE WHEN c < 0 THEN 2 * sqrt(-c) END AS spread, zero_share, median_abs FROM g", "spread zero_share median_abs")
def e19(v: Views):
    return agg.roll_spread(v.price, "inst", "d", "ret")


@query("E20_range_proxy", f"WITH {TRADES}, r AS (SELECT inst, d, max(rate) AS hi, min(rate) AS lo, sum(value) / sum(quantity) AS c FROM trades GROUP BY 1, 2), m AS (SELECT inst, median((hi - lo) / c) AS m FROM r GROUP BY inst) SELECT median(m) AS median_range, count(*) AS keys FROM m", "median_range")
def e20(v: Views):
    r = v.trades.groupBy("inst", "d").agg(F.max("rate").alias("hi"), F.min("rate").alias("lo"), (F.sum("value") / F.sum("quantity")).alias("c"))
    return agg.range_proxy(r, "inst", "hi", "lo", "c")


@query("E21_dissect", f"WITH {STATES} SELECT state, quantile_cont(imb, 0.25) AS q25, quantile_cont(imb, 0.5) AS q50, quantile_cont(imb, 0.75) AS q75, avg(CASE WHEN imb < -0.5 THEN 1.0 ELSE 0 END) AS low, avg(CASE WHEN imb BETWEEN -0.5 AND 0.5 THEN 1.0 ELSE 0 END) AS mid, avg(CASE WHEN imb > 0.5 THEN 1.0 ELSE 0 END) AS high FROM states GROUP BY state", "q25 q50 q75 low mid high")
def e21(v: Views):
    return agg.dissect(v.states, "state", "imb")


@query("E22_yearly_shares", f"WITH {STATES} SELECT inst, year(d) AS year, ln(sum(gross)) AS log_value, avg(CASE WHEN state = 'buy' THEN 1.0 ELSE 0 END) AS share_buy, avg(CASE WHEN state = 'sell' THEN 1.0 ELSE 0 END) AS share_sell FROM states GROUP BY 1, 2", "log_value share_buy share_sell")
def e22(v: Views):
    return agg.yearly_shares(v.states, "inst", "d", "gross", "state", ["buy", "sell"])


def _runs(v: Views):
    return win.with_runs(v.states, "inst", "d", "state")


def _episodes(v: Views):
    return win.episodes(_runs(v), "inst", "d", "state", "imb")


EPISODES = RUNS + ", eps0 AS (SELECT inst, run, any_value(state) AS state, min(d) AS start, max(d) AS \"end\", count(*) AS length, avg(imb) AS mean_value FROM runs GROUP BY 1, 2), eps AS (SELECT *, lead(state) OVER (PARTITION BY inst ORDER BY run) AS next_state FROM eps0)"


@query("E23_episode_summary", f"WITH {EPISODES} SELECT state, count(*) AS episodes, avg(length) AS mean, median(length) AS median, quantile_cont(length, 0.9) AS p90, max(length) AS longest FROM eps GROUP BY state", "mean median p90")
def e23(v: Views):
    return agg.episode_summary(_episodes(v), "state")


@query("E24_truncation", f"WITH {PRICE}, l AS (SELECT lead(d, 20) OVER (PARTITION BY inst ORDER BY d) AS a FROM price) SELECT avg(CASE WHEN a IS NULL THEN 1.0 ELSE 0 END) AS truncated, count(*) AS n FROM l", "truncated")
def e24(v: Views):
    return agg.truncation_share(v.price, "inst", "d", 20)


@query("E25_match_attrition", f"WITH {EVENTS}, p AS (SELECT DISTINCT user_id, day FROM ev WHERE event_type = 'purchase') SELECT e.event_type, count(*) AS n, avg(CASE WHEN k.user_id IS NULL THEN 1.0 ELSE 0 END) AS key_absent, avg(CASE WHEN k.user_id IS NOT NULL AND p.user_id IS NULL THEN 1.0 ELSE 0 END) AS other_date, avg(CASE WHEN p.user_id IS NOT NULL THEN 1.0 ELSE 0 END) AS matched FROM ev e LEFT JOIN (SELECT DISTINCT user_id FROM p) k ON e.user_id = k.user_id LEFT JOIN p ON e.user_id = p.user_id AND e.day = p.day GROUP BY 1", "key_absent other_date matched")
def e25(v: Views):
    right = v.events.where("event_type = 'purchase'")
    return agg.match_attrition(v.events, right, "user_id", "day", "event_type")


@query("E26_duplicate_keys", f"WITH {TRADES}, g AS (SELECT inst, d, entity, count(*) AS n FROM trades GROUP BY 1, 2, 3) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, count(*) FILTER (n > 1) AS repeated, max(n) AS most FROM g")
def e26(v: Views):
    return agg.duplicate_keys(v.trades, ["inst", "d", "entity"])


@query("E27_universe", f"WITH {TRADES} SELECT kind, year(d) AS year, count(*) AS rows, count(DISTINCT inst) AS keys, count(DISTINCT d) AS days FROM trades GROUP BY 1, 2")
def e27(v: Views):
    return agg.universe(v.trades, "kind", "inst", "d")


def frame(w: int, lag: int) -> str:
    end = "CURRENT ROW" if lag == 0 else f"{lag} PRECEDING"
    return f"OVER (PARTITION BY inst ORDER BY d ROWS BETWEEN {w - 1 + lag} PRECEDING AND {end})"


def rolled(f: str, x: str, w: int, n: int, lag: int) -> str:
    return f"CASE WHEN count({x}) {frame(w, lag)} >= {n} THEN {f}({x}) {frame(w, lag)} END"


@query("F1_lag_roll_mean", f"WITH {PANEL} SELECT inst, d, {rolled('avg', 'gross', 20, 10, 1)} AS base FROM panel", "base", 4)
def f1(v: Views):
    return v.panel.select("inst", "d", win.rolling(F.avg, "gross", "inst", "d", 20, 10, 1).alias("base"))


@query("F2_rolling_stats", f"WITH {PRICE} SELECT inst, d, {rolled('stddev_samp', 'ret', 20, 10, 0)} AS sd, {rolled('sum', 'ret', 5, 3, 0)} AS total, {rolled('max', 'ret', 10, 1, 0)} AS top FROM price", "sd total top")
def f2(v: Views):
    def r(f, w, n):
        return win.rolling(f, "ret", "inst", "d", w, n)
    return v.price.select("inst", "d", r(F.stddev_samp, 20, 10).alias("sd"), r(F.sum, 5, 3).alias("total"), r(F.max, 10, 1).alias("top"))


def _moment(x: str) -> str:
    return "(" + rolled("avg", x, 30, 15, 1) + ")"


@query("F3_flow_beta", f"WITH {PANEL}, m AS (SELECT d, sum(net) / sum(gross) AS y FROM panel GROUP BY d), j AS (SELECT inst, d, net / gross AS x, y FROM panel JOIN m USING (d)), b AS (SELECT inst, d, {_moment('x * y')} AS mxy, {_moment('x')} AS mx, {_moment('y')} AS my, {rolled('stddev_samp', 'x', 30, 15, 1)} AS sx, {rolled('stddev_samp', 'y', 30, 15, 1)} AS sy FROM j) SELECT inst, d, CASE WHEN sx > 0 AND sy > 0 THEN (mxy - mx * my) / (sx * sy) END AS beta FROM b", "beta")
def f3(v: Views):
    j = v.panel.select("inst", "d", (F.col("net") / F.col("gross")).alias("x")).join(agg.market_flow(v.panel).select("d", F.col("imbalance").alias("y")), "d")
    return j.select("inst", "d", win.flow_beta("x", "y", "inst", "d", 30, 15).alias("beta"))


def _mb(x: str) -> str:
    return "(" + rolled("avg", x, 60, 30, 1) + ")"


@query("F4_market_beta", f"WITH {PRICE}, b AS (SELECT inst, d, {_mb('ret * mkt')} AS xy, {_mb('ret')} AS x, {_mb('mkt')} AS y, {_mb('mkt * mkt')} AS yy FROM price) SELECT inst, d, CASE WHEN yy - y * y > 0 THEN (xy - x * y) / (yy - y * y) END AS beta FROM b", "beta")
def f4(v: Views):
    return v.price.select("inst", "d", win.market_beta("ret", "mkt", "inst", "d", 60, 30).alias("beta"))


@query("F5_price_impact", f"WITH {PRICE}, {PANEL.replace(TRADES + ', ', '')}, j AS (SELECT p.inst, p.d, p.ret, q.net / 1000000 AS z FROM price p JOIN panel q ON p.inst = q.inst AND p.d = q.d), b AS (SELECT inst, d, {_mb('ret * z')} AS xy, {_mb('ret')} AS x, {_mb('z')} AS y, {_mb('z * z')} AS yy FROM j) SELECT inst, d, CASE WHEN yy - y * y > 0 THEN (xy - x * y) / (yy - y * y) END AS impact FROM b", "impact", 4)
def f5(v: Views):
    j = v.price.select("inst", "d", "ret").join(v.panel.select("inst", "d", (F.col("net") / 1000000).alias("z")), ["inst", "d"])
    return j.select("inst", "d", win.market_beta("ret", "z", "inst", "d", 60, 30).alias("impact"))


@query("F6_characteristics", f"WITH {PRICE}, c AS (SELECT *, abs(ret) / turnover * 1e6 AS il, sum(ln(1 + ret)) OVER (PARTITION BY inst ORDER BY d) AS cum FROM price) SELECT inst, d, {rolled('avg', 'il', 20, 10, 1)} AS illiquidity, ln(turnover) AS log_turnover, volume / ({rolled('avg', 'volume', 20, 10, 1)}) AS rel_volume, {rolled('stddev_samp', 'ret', 20, 10, 1)} AS vol20, lag(cum, 4) OVER (PARTITION BY inst ORDER BY d) - lag(cum, 26) OVER (PARTITION BY inst ORDER BY d) AS momentum FROM c", "illiquidity log_turnover rel_volume vol20 momentum")
def f6(v: Views):
    w = Window.partitionBy("inst").orderBy("d")
    c = v.price.withColumn("il", F.abs("ret") / F.col("turnover") * 1e6).withColumn("cum", F.sum(F.log(1 + F.col("ret"))).over(w))
    def r(f, x):
        return win.rolling(f, x, "inst", "d", 20, 10, 1)
    return c.select("inst", "d", r(F.avg, "il").alias("illiquidity"), F.log("turnover").alias("log_turnover"), (F.col("volume") / r(F.avg, "volume")).alias("rel_volume"), r(F.stddev_samp, "ret").alias("vol20"), (F.lag("cum", 4).over(w) - F.lag("cum", 26).over(w)).alias("momentum"))


CUM = PRICE + ", c AS (SELECT inst, d, sum(greatest(least(adj, 0.5), -0.5)) OVER (PARTITION BY inst ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM price WHERE adj IS NOT NULL)"


def _cum(v: Views):
    x = F.greatest(F.least("adj", F.lit(0.5)), F.lit(-0.5))
    w = Window.partitionBy("inst").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return v.price.where("adj is not null").select("inst", "d", F.sum(x).over(w).alias("cum"))


@query("F7_forward_car", f"WITH {CUM} SELECT inst, d, coalesce(lead(cum, 10) OVER (PARTITION BY inst ORDER BY d), last_value(cum) OVER (PARTITION BY inst ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - cum AS car, lead(cum, 10) OVER (PARTITION BY inst ORDER BY d) IS NULL AS cut FROM c", "car")
def f7(v: Views):
    car, cut = win.forward_car("cum", "inst", "d", 10)
    return _cum(v).select("inst", "d", car.alias("car"), cut.alias("cut"))


@query("F8_running_sum", f"WITH {CUM} SELECT inst, d, cum FROM c", "cum")
def f8(v: Views):
    return _cum(v)


@query("F9_runs", f"WITH {RUNS} SELECT inst, d, state, run FROM runs")
def f9(v: Views):
    return _runs(v).select("inst", "d", "state", "run")


@query("F10_streak", f"WITH {STATES}, s AS (SELECT inst, d, CAST(sign(net) AS INTEGER) AS g FROM states), n AS (SELECT *, CASE WHEN g IS DISTINCT FROM lag(g) OVER (PARTITION BY inst ORDER BY d) THEN 1 ELSE 0 END AS new FROM s), r AS (SELECT *, sum(new) OVER (PARTITION BY inst ORDER BY d) AS run FROM n), k AS (SELECT *, row_number() OVER (PARTITION BY inst, run ORDER BY d) * g AS now FROM r) SELECT inst, d, lag(now) OVER (PARTITION BY inst ORDER BY d) AS streak FROM k")
def f10(v: Views):
    s = v.states.select("inst", "d", F.signum("net").cast("int").alias("g"))
    return win.streak(s, "inst", "d", "g").select("inst", "d", "streak")


@query("F11_episodes", f"WITH {EPISODES} SELECT inst, run, state, start, \"end\", length, mean_value, next_state FROM eps", "mean_value")
def f11(v: Views):
    return _episodes(v)


@query("F12_run_ages", f"WITH {RUNS} SELECT inst, d, row_number() OVER (PARTITION BY inst, run ORDER BY d) AS age, count(*) OVER (PARTITION BY inst, run) - row_number() OVER (PARTITION BY inst, run ORDER BY d) AS remaining, max(d) OVER (PARTITION BY inst, run) AS run_end, run = max(run) OVER (PARTITION BY inst) AS censored FROM runs")
def f12(v: Views):
    return win.run_ages(_runs(v), "inst", "d").select("inst", "d", "age", "remaining", "run_end", "censored")


@query("F13_probit_rank", f"WITH {PANEL}, x AS (SELECT inst, d, CASE WHEN n >= 3 THEN round(net / gross, 9) END AS m FROM panel), r AS (SELECT inst, d, CASE WHEN m IS NOT NULL THEN {avg_rank('m', 'd')} / (count(m) OVER (PARTITION BY d) + 1) END AS p FROM x) SELECT inst, d, {probit_sql('p')} AS score FROM r", "score")
def f13(v: Views):
    x = v.panel.select("inst", "d", F.round(F.col("net") / F.col("gross"), 9).alias("m"), (F.col("n") >= 3).alias("ok"))
    return win.probit_rank(x, "d", "m", "score", "ok").select("inst", "d", "score")


@query("F14_quintile", f"WITH {PRICE}, x AS (SELECT inst, d, round(ret, 9) AS r FROM price WHERE ret IS NOT NULL) SELECT inst, d, CAST(ceil({avg_rank('r', 'd')} / count(*) OVER (PARTITION BY d) * 5) AS INTEGER) AS quintile FROM x")
def f14(v: Views):
    x = v.price.where("ret is not null").select("inst", "d", F.round("ret", 9).alias("r"))
    return win.quintile(x, "d", "r").select("inst", "d", "quintile")


@query("F15_global_quintile", f"WITH {PRICE}, q AS (SELECT quantile_cont(turnover, [0.2, 0.4, 0.6, 0.8]) AS e FROM price) SELECT inst, d, CAST((turnover > e[1])::INT + (turnover > e[2])::INT + (turnover > e[3])::INT + (turnover > e[4])::INT AS INTEGER) AS bucket FROM price, q")
def f15(v: Views):
    e = quantiles(v.price, "turnover", [0.2, 0.4, 0.6, 0.8], out="e")
    p = v.price.join(F.broadcast(e))  # one row
    return p.select("inst", "d", F.size(F.filter("e", lambda x: F.col("turnover") > x)).alias("bucket"))


@query("F16_own_past_quintile", f"WITH {EVENTS}, x AS (SELECT user_id, day, round(avg(value), 6) AS v FROM ev GROUP BY 1, 2) SELECT a.user_id, a.day, CAST(least(5, 1 + floor(5 * count(*) FILTER (b.v < a.v) / count(*))) AS INTEGER) AS quintile FROM x a JOIN x b ON a.user_id = b.user_id AND b.day <= a.day GROUP BY a.user_id, a.day, a.v")
def f16(v: Views):
    x = v.events.groupBy("user_id", "day").agg(F.round(F.avg("value"), 6).alias("v"))
    return win.own_past_quintile(x, "user_id", "day", "v")


@query("F17_lags", f"WITH {PRICE} SELECT inst, d, lag(ret, 1) OVER w AS l1, lag(ret, 5) OVER w AS l5, lead(ret, 1) OVER w AS f1 FROM price WINDOW w AS (PARTITION BY inst ORDER BY d)", "l1 l5 f1")
def f17(v: Views):
    w = Window.partitionBy("inst").orderBy("d")
    return v.price.select("inst", "d", F.lag("ret", 1).over(w).alias("l1"), F.lag("ret", 5).over(w).alias("l5"), F.lead("ret", 1).over(w).alias("f1"))


@query("F18_forward_fill", f"WITH {PANEL} SELECT inst, d, last_value(CASE WHEN n >= 8 THEN n END IGNORE NULLS) OVER (PARTITION BY inst ORDER BY d ROWS UNBOUNDED PRECEDING) AS n FROM panel")
def f18(v: Views):
    w = Window.partitionBy("inst").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return v.panel.select("inst", "d", F.last(F.when(F.col("n") >= 8, F.col("n")), ignorenulls=True).over(w).alias("n"))


@query("F19_ewma_variance", f"""WITH RECURSIVE {PRICE}, o AS (SELECT inst, d, ret, row_number() OVER (PARTITION BY inst ORDER BY d) AS k FROM price),
 z AS (SELECT inst, d, k, CASE WHEN ret IS NULL THEN 0 ELSE 1 END AS n, CASE WHEN ret IS NULL THEN 0.0 ELSE ret * ret END::DOUBLE AS v FROM o WHERE k = 1
 UNION ALL SELECT o.inst, o.d, o.k, z.n + CASE WHEN o.ret IS NULL THEN 0 ELSE 1 END, (CASE WHEN o.ret IS NULL THEN z.v WHEN z.n + 1 <= 20 THEN z.v + (o.ret * o.ret - z.v) / (z.n + 1) ELSE z.v * 0.94 + o.ret * o.ret * 0.06 END)::DOUBLE FROM z JOIN o ON o.inst = z.inst AND o.k = z.k + 1)
 SELECT inst, d, CASE WHEN n >= 60 THEN v END AS variance FROM z""", "variance")
def f19(v: Views):
    return win.ewma_variance(v.price, "inst", "d", "ret", 0.94, 20, 60)


@query("F20_forward_return", f"WITH {PRICE} SELECT inst, d, CASE WHEN count(ret) OVER w = 5 THEN sum(ln(1 + ret)) OVER w END AS fwd FROM price WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)", "fwd")
def f20(v: Views):
    w = Window.partitionBy("inst").orderBy("d").rowsBetween(1, 5)
    return v.price.select("inst", "d", F.when(F.count("ret").over(w) == 5, F.sum(F.log(1 + F.col("ret"))).over(w)).alias("fwd"))


@query("F21_realised_vol", f"WITH {PRICE} SELECT inst, d, sum(ln(1 + ret)) OVER w AS trail, sqrt(sum(ret * ret) OVER w) AS rv, sqrt(sum(least(ret, 0) * least(ret, 0)) OVER w) AS down FROM price WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)", "trail rv down")
def f21(v: Views):
    w = Window.partitionBy("inst").orderBy("d").rowsBetween(-9, 0)
    neg = F.least("ret", F.lit(0.0))
    return v.price.where("ret is not null").select("inst", "d", F.sum(F.log(1 + F.col("ret"))).over(w).alias("trail"), F.sqrt(F.sum(F.col("ret") * F.col("ret")).over(w)).alias("rv"), F.sqrt(F.sum(neg * neg).over(w)).alias("down"))


@query("F22_flow_features", f"WITH {PANEL}, m AS (SELECT d, sum(net) / sum(gross) AS nf, avg(sign(net)) AS br, sum(gross) AS g FROM panel GROUP BY d) SELECT d, lag(nf, 2) OVER w AS nf_lag2, avg(nf) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS persist4, br - avg(br) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS breadth_dev, ln(g / avg(g) OVER (ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) AS gross_ratio FROM m WINDOW w AS (ORDER BY d)", "nf_lag2 persist4 breadth_dev gross_ratio")
def f22(v: Views):
    m = agg.market_flow(v.panel)  # one row a date
    o = Window.partitionBy(F.lit(1)).orderBy("d")
    past = o.rowsBetween(-20, -1)
    return m.select("d", F.lag("imbalance", 2).over(o).alias("nf_lag2"), F.avg("imbalance").over(o.rowsBetween(-3, 0)).alias("persist4"), (F.col("breadth") - F.avg("breadth").over(past)).alias("breadth_dev"), F.log(F.col("gross") / F.avg("gross").over(past)).alias("gross_ratio"))


@query("F23_share_volume", f"WITH {PRICE}, x AS (SELECT inst, d, ln(turnover / ({rolled('avg', 'turnover', 60, 20, 1)})) AS lv FROM price) SELECT inst, d, lv - avg(lv) OVER (PARTITION BY d) AS lv FROM x", "lv")
def f23(v: Views):
    x = v.price.select("inst", "d", F.log(F.col("turnover") / win.rolling(F.avg, "turnover", "inst", "d", 60, 20, 1)).alias("lv"))
    return x.withColumn("lv", F.col("lv") - F.avg("lv").over(Window.partitionBy("d")))


@query("F24_calendar_gap", f"WITH {TRADES}, {CALENDAR}, x AS (SELECT DISTINCT t.inst, t.d, c.pos FROM trades t JOIN calendar c ON t.d = c.d WHERE t.quantity > 30) SELECT inst, d, least(250, pos - lag(pos) OVER (PARTITION BY inst ORDER BY d)) AS gap FROM x")
def f24(v: Views):
    x = v.trades.where("quantity > 30").select("inst", "d").distinct().join(v.calendar, "d")
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("inst").orderBy("d"))
    return x.select("inst", "d", F.when(gap.isNotNull(), F.least(F.lit(250), gap)).otherwise(F.lit(250)).alias("gap"))


@query("F25_demean", f"WITH {PRICE}, m AS (SELECT inst, avg(ret) AS m FROM price WHERE d <= DATE '1997-06-30' GROUP BY inst) SELECT p.inst, p.d, p.ret - avg(p.ret) OVER (PARTITION BY p.d) AS by_day, p.ret - m.m AS by_train FROM price p LEFT JOIN m ON p.inst = m.inst", "by_day by_train")
def f25(v: Views):
    m = v.price.where("d <= '1997-06-30'").groupBy("inst").agg(F.avg("ret").alias("m"))
    return v.price.join(m, "inst", "left").select("inst", "d", (F.col("ret") - F.avg("ret").over(Window.partitionBy("d"))).alias("by_day"), (F.col("ret") - F.col("m")).alias("by_train"))


@query("F26_tercile", f"WITH {PRICE}, x AS (SELECT inst, d, year(d) AS y, ret FROM price WHERE ret IS NOT NULL), e AS (SELECT y, quantile_cont(ret, 0.5) AS m, quantile_cont(ret, CAST(1 AS DOUBLE) / 3) AS a, quantile_cont(ret, CAST(2 AS DOUBLE) / 3) AS b FROM x GROUP BY y) SELECT inst, d, ret > m AS upper, CASE WHEN ret <= a THEN 1 WHEN ret <= b THEN 2 ELSE 3 END AS tercile FROM x JOIN e USING (y)")
def f26(v: Views):
    x = v.price.where("ret is not null").withColumn("y", F.year("d"))
    e = x.groupBy("y").agg(*[F.percentile("ret", F.lit(q)).alias(n) for n, q in (("m", 0.5), ("a", 1 / 3), ("b", 2 / 3))])
    j = x.join(e, "y")
    return j.select("inst", "d", (F.col("ret") > F.col("m")).alias("upper"), F.when(F.col("ret") <= F.col("a"), 1).when(F.col("ret") <= F.col("b"), 2).otherwise(3).alias("tercile"))


@query("F27_thin", """WITH RECURSIVE ev AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events WHERE event_type = 'purchase'), t AS (SELECT user_id, min(day) AS day FROM ev GROUP BY user_id
 UNION ALL SELECT t.user_id, (SELECT min(e.day) FROM ev e WHERE e.user_id = t.user_id AND e.day >= t.day + 7) FROM t WHERE t.day IS NOT NULL) SELECT user_id, day FROM t WHERE day IS NOT NULL""")
def f27(v: Views):
    return win.thin(v.events.where("event_type = 'purchase'"), "user_id", "day", 7)


@query("F28_every_kth", f"WITH {PRICE} SELECT inst, d FROM price QUALIFY row_number() OVER (PARTITION BY inst ORDER BY d) % 5 = 0")
def f28(v: Views):
    k = F.row_number().over(Window.partitionBy("inst").orderBy("d"))
    return v.price.withColumn("k", k).where("k % 5 = 0").select("inst", "d")


@query("F29_end_impulse", f"WITH {STATES}, s AS (SELECT inst, d, CASE WHEN lag(state) OVER (PARTITION BY inst ORDER BY d) = 'sell' AND state <> 'sell' THEN 1 ELSE 0 END AS i FROM states) SELECT inst, d, max(i) OVER (PARTITION BY inst ORDER BY d ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS held FROM s")
def f29(v: Views):
    w = Window.partitionBy("inst").orderBy("d")
    i = F.when((F.lag("state").over(w) == "sell") & (F.col("state") != "sell"), 1).otherwise(0)
    return v.states.withColumn("i", i).select("inst", "d", F.max("i").over(w.rowsBetween(-4, 0)).alias("held"))


@query("F30_drawdown", f"WITH {CUM} SELECT inst, d, cum - max(cum) OVER (PARTITION BY inst ORDER BY d ROWS UNBOUNDED PRECEDING) AS drawdown FROM c", "drawdown")
def f30(v: Views):
    w = Window.partitionBy("inst").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return _cum(v).select("inst", "d", (F.col("cum") - F.max("cum").over(w)).alias("drawdown"))


@query("F31_flip_rate", f"WITH {STATES}, l AS (SELECT inst, state, lag(state) OVER (PARTITION BY inst ORDER BY d) AS p FROM states) SELECT inst, avg(CASE WHEN state <> p THEN 1.0 ELSE 0 END) AS flip_rate, count(*) AS n FROM l WHERE p IS NOT NULL GROUP BY inst", "flip_rate")
def f31(v: Views):
    l = v.states.withColumn("p", F.lag("state").over(Window.partitionBy("inst").orderBy("d"))).where("p is not null")
    return l.groupBy("inst").agg(F.avg((F.col("state") != F.col("p")).cast("double")).alias("flip_rate"), F.count("*").alias("n"))


@query("G1_sort", f"WITH {PANEL} SELECT inst, d, n FROM panel ORDER BY n DESC, inst, d")
def g1(v: Views):
    return v.panel.select("inst", "d", "n").orderBy(F.desc("n"), "inst", "d")


@query("G2_top_k", f"WITH {PANEL} SELECT inst, d, round(net, 2) AS net FROM panel ORDER BY abs(round(net, 2)) DESC, inst, d LIMIT 25")
def g2(v: Views):
    x = v.panel.select("inst", "d", F.round("net", 2).alias("net"))
    return x.orderBy(F.desc(F.abs("net")), "inst", "d").limit(25)


@query("G3_best_per_group", f"WITH {PANEL} SELECT inst, arg_max(d, (round(gross, 2), d)) AS best FROM panel GROUP BY inst")
def g3(v: Views):
    return v.panel.groupBy("inst").agg(F.max_by("d", F.struct(F.round("gross", 2), "d")).alias("best"))


@query("H1_union", "SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def h1(v: Views):
    s = v.table("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return s.unionByName(v.table("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")))


@query("H2_distinct", f"WITH {TRADES} SELECT DISTINCT inst, kind FROM trades")
def h2(v: Views):
    return v.trades.select("inst", "kind").dropDuplicates()


@query("H3_intersect_except", f"WITH {TRADES}, a AS (SELECT DISTINCT entity FROM trades WHERE quantity = 50), b AS (SELECT DISTINCT entity FROM trades WHERE quantity = 1) SELECT entity, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT entity, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def h3(v: Views):
    a, b = v.trades.where("quantity = 50").select("entity").distinct(), v.trades.where("quantity = 1").select("entity").distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.exceptAll(b).withColumn("side", F.lit("first")))


@query("I8_normal_functions", f"WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity - 25.5) / 6 AS z, l_quantity / 51 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, {normal_cdf_sql('z')} AS cdf, {probit_sql('p')} AS quantile FROM x", "cdf quantile", 9)
def i8(v: Views):
    x = v.table("lineitem")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", normal_cdf((F.col("l_quantity") - 25.5) / 6).alias("cdf"), probit(F.col("l_quantity") / 51).alias("quantile"))
