"""Queries of the special functions and of the tests of forecasts that use them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions import distributions as ds
from panelweave.functions.mix import mix_sql
from panelweave.functions.normal import normal_cdf, normal_cdf_sql, probit_sql
from panelweave.operators import calibration as cal
from panelweave.plans.fixtures import Views
from panelweave.plans.model_queries import HITS, _hits, xlogy
from panelweave.plans.registry import query

PER = HITS + ", per AS (SELECT inst, count(*) AS n, avg(z) AS m, sum(z * z) AS s, 2.5 + CAST(right(inst, 1) AS DOUBLE) * 1.5 AS nu FROM hits GROUP BY inst)"


def _per(v: Views):
    nu = 2.5 + F.substring("inst", -1, 1).cast("double") * 1.5
    return _hits(v).groupBy("inst").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.sum(F.col("z") * F.col("z")).alias("s")).withColumn("nu", nu)


@query("I8_chi_square", f"WITH {PER} SELECT inst, n, {ds.chi2_tail_sql('s', 'n')} AS p FROM per", "p", 9)
def i8a(v: Views):
    """Is the sum of squares of an instrument's standardised returns too large for unit variance?"""
    return _per(v).select("inst", "n", ds.chi2_tail(F.col("s"), F.col("n")).alias("p"))


@query("I8_student_t", f"WITH {PER} SELECT inst, nu, {ds.student_cdf_sql('m * sqrt(n)', 'nu')} AS cdf, {ds.student_log_pdf_sql('m', 'nu')} AS log_pdf, {ds.student_quantile_sql('CAST(0.01 AS DOUBLE)', 'nu')} AS q01 FROM per", "cdf log_pdf q01", 8)
def i8b(v: Views):
    return _per(v).select("inst", "nu", ds.student_cdf(F.col("m") * F.sqrt("n"), F.col("nu")).alias("cdf"), ds.student_log_pdf(F.col("m"), F.col("nu")).alias("log_pdf"), ds.student_quantile(F.lit(0.01), F.col("nu")).alias("q01"))


@query("I8_pareto", f"WITH {HITS} SELECT inst, count(*) AS n, avg({ds.pareto_cdf_sql('(-z - 1)', 'CAST(0.2 AS DOUBLE)', 'CAST(0.7 AS DOUBLE)')}) AS mean_cdf FROM hits WHERE z < -1 GROUP BY inst", "mean_cdf", 9)
def i8c(v: Views):
    return _hits(v).where("z < -1").groupBy("inst").agg(F.count("*").alias("n"), F.avg(ds.pareto_cdf(-F.col("z") - 1, F.lit(0.2), F.lit(0.7))).alias("mean_cdf"))


@query("J13_effective_coverage", f"""WITH {HITS}, g AS (SELECT d, CAST(count(*) AS DOUBLE) AS m, CAST(sum(hit::INT) AS DOUBLE) AS x FROM hits GROUP BY d),
 a AS (SELECT sum(m) AS n, count(*) AS k, sum(x) AS x, sum(m * m) AS m2, sum(x * x / m) AS b FROM g),
 s AS (SELECT *, (n - m2 / n) / nullif(k - 1, 0) AS m0, (b - x * x / n) / nullif(k - 1, 0) AS msb, (x - b) / nullif(n - k, 0) AS msw FROM a),
 r AS (SELECT *, coalesce(greatest(0, (msb - msw) / nullif(msb + (m0 - 1) * msw, 0)), 0) AS icc, -2 * ({xlogy('(n - x)', 'CAST(0.95 AS DOUBLE)')} + {xlogy('x', 'CAST(0.05 AS DOUBLE)')} - {xlogy('(n - x)', '(1 - x / n)')} - {xlogy('x', '(x / n)')}) AS lr FROM s),
 e AS (SELECT *, n / (1 + (n / k - 1) * icc) AS ne FROM r), l AS (SELECT *, lr * ne / n AS le FROM e)
 SELECT CAST(n AS BIGINT) AS n, x, x / n AS rate, lr, icc, ne AS effective_n, {ds.chi2_tail_sql('lr', '1')} AS p, le AS lr_effective, {ds.chi2_tail_sql('le', '1')} AS p_effective FROM l""", "rate lr icc effective_n p lr_effective p_effective")
def j13e(v: Views):
    return cal.coverage(_hits(v), "hit", 0.05, "d")


def walk_sql(table: str, mean_block: int, replicates: int, seed: int) -> str:
    """num (pos, n, columns of `table`) and walked (rep, columns)."""
    jump = f"pos = 0 OR {mix_sql(seed, mean_block, 'rep', 'pos')} = 0"
    return f"""num AS (SELECT *, row_number() OVER (ORDER BY d) - 1 AS pos, count(*) OVER () AS dates FROM {table}),
 w AS (SELECT rep, pos, dates, CASE WHEN {jump} THEN {mix_sql(seed + 1, 'dates', 'rep', 'pos')} END AS a, CASE WHEN {jump} THEN pos END AS f FROM num, (SELECT unnest(range(1, {replicates + 1})) AS rep)),
 src AS (SELECT rep, (last_value(a IGNORE NULLS) OVER o + pos - last_value(f IGNORE NULLS) OVER o) % dates AS pos FROM w WINDOW o AS (PARTITION BY rep ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 walked AS (SELECT rep, num.* FROM src JOIN num USING (pos))"""


BINS = range(10)
CHI = "(" + " + ".join(f"sum(r{k}) * sum(r{k})" for k in BINS) + ") / (sum(n) / 10)"


@query("J16_pit_uniformity", f"""WITH {HITS}, b AS (SELECT d, CAST(least(floor({normal_cdf_sql('z')} * 10), 9) AS INTEGER) AS b FROM hits),
 c AS (SELECT d, count(*) AS n, {', '.join(f'count(*) FILTER (b = {k}) - count(*) / 10.0::DOUBLE AS r{k}' for k in BINS)} FROM b GROUP BY d),
 m AS (SELECT d, n, {', '.join(f'r{k} - avg(r{k}) OVER () AS r{k}' for k in BINS)} FROM c), {walk_sql('m', 8, 200, 21)},
 nl AS (SELECT rep, {CHI} AS s FROM walked GROUP BY rep), q AS (SELECT quantile_cont(s, 0.5) AS null_median, quantile_cont(s, CAST(0.95 AS DOUBLE)) AS crit95 FROM nl), o AS (SELECT CAST(sum(n) AS BIGINT) AS n, {CHI} AS chi2 FROM c)
 SELECT n, chi2, {ds.chi2_tail_sql('chi2', '9')} AS p, null_median, crit95, chi2 > crit95 AS reject FROM o, q""", "chi2 p null_median crit95")
def j16u(v: Views):
    h = _hits(v).select("d", normal_cdf(F.col("z")).alias("u"))
    return cal.pit_uniformity(h, "d", "u", 10, 200, 8, 21)


def _box(col: str, out: str, lags: int = 5) -> str:
    terms = " + ".join(f"(g{k} / g0) * (g{k} / g0) / (n - {k})" for k in range(1, lags + 1))
    return f"""e{out} AS (SELECT inst, d, {col} - avg({col}) OVER (PARTITION BY inst) AS e FROM pz), l{out} AS (SELECT inst, e, {', '.join(f'lag(e, {k}) OVER w AS e{k}' for k in range(1, lags + 1))} FROM e{out} WINDOW w AS (PARTITION BY inst ORDER BY d)),
 s{out} AS (SELECT inst, count(*) AS n, sum(e * e) AS g0, {', '.join(f'sum(e * e{k}) AS g{k}' for k in range(1, lags + 1))} FROM l{out} GROUP BY inst), {out} AS (SELECT inst, n, n * (n + 2) * ({terms}) AS q FROM s{out})"""


@query("J17_pit_independence", f"""WITH {HITS}, pu AS (SELECT inst, d, {normal_cdf_sql('z')} AS u FROM hits WHERE z IS NOT NULL), pc AS (SELECT inst, d, u, least(greatest(u, 1e-6), 1 - 1e-6) AS c FROM pu), pp AS (SELECT inst, d, u, {probit_sql('c')} AS y FROM pc), pz AS (SELECT *, y * y AS yy FROM pp), {_box('y', 'la')}, {_box('yy', 'lb')},
 k0 AS (SELECT inst, u, row_number() OVER (PARTITION BY inst ORDER BY u) AS i, count(*) OVER (PARTITION BY inst) AS n FROM pz), k1 AS (SELECT inst, n, max(greatest(i / n - u, u - (i - 1) / n)) AS dd FROM k0 GROUP BY inst, n), k2 AS (SELECT inst, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * dd AS s FROM k1)
 SELECT la.inst, la.n, la.q, {ds.chi2_tail_sql('la.q', '5')} AS p, lb.q AS q_squares, {ds.chi2_tail_sql('lb.q', '5')} AS p_squares,
  CASE WHEN s < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * s * s))))) END AS ks_p
 FROM la JOIN lb USING (inst) JOIN k2 USING (inst) WHERE la.n >= 50""", "q p q_squares p_squares ks_p", 5)
def j17p(v: Views):
    return cal.pit_independence(_hits(v).select("inst", "d", normal_cdf(F.col("z")).alias("u")), "inst", "d", "u", 5)


@query("K23_student_scores", f"""WITH {HITS}, x AS (SELECT inst, d, z AS y, 0.9::DOUBLE AS sc, 3.0 + CAST(right(inst, 1) AS DOUBLE) % 3 * 2 AS nu FROM hits WHERE z IS NOT NULL),
 tq AS MATERIALIZED (SELECT nu, tau, {ds.student_quantile_sql('tau', 'nu')} AS q FROM (SELECT DISTINCT nu FROM x), (SELECT unnest(range(1, 100)) / 100.0::DOUBLE AS tau)),
 l AS (SELECT inst, d, any_value(y) AS y, any_value(sc) AS sc, any_value(x.nu) AS nu, 2 * avg(greatest(tau * (y - sc * q), (tau - 1) * (y - sc * q))) AS crps, 2 * avg(greatest(tau * (y - sc * q), (tau - 1) * (y - sc * q))) FILTER (tau <= 0.05) AS tail_crps FROM x JOIN tq ON x.nu = tq.nu GROUP BY inst, d),
 m AS (SELECT inst, nu, avg(crps) AS crps, avg(tail_crps) AS tail_crps, avg(ln(exp({ds.student_log_pdf_sql('(y / sc)', 'nu')})) - ln(sc)) AS log_score, max(y / sc) AS top FROM l GROUP BY inst, nu)
 SELECT inst, crps, tail_crps, log_score, {ds.student_cdf_sql('top', 'nu')} AS top_pit FROM m""", "crps tail_crps log_score top_pit")
def k23s(v: Views):
    """Student-t forecasts of scale 0.9: their scores, in the tail too, and the transform of each instrument's best return."""
    nu = 3.0 + F.substring("inst", -1, 1).cast("double") % 3 * 2
    x = _hits(v).where("z is not null").select("inst", F.col("z").alias("y"), F.lit(0.9).alias("sc"), nu.alias("nu"))
    s = cal.student_scores(x, "y", "sc", "nu")
    return s.groupBy("inst").agg(F.avg("crps").alias("crps"), F.avg("tail_crps").alias("tail_crps"), F.avg("log_score").alias("log_score"), F.max("pit").alias("top_pit"))
