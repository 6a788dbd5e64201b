"""Queries of walk-forward models, decisions, structural estimates and volatility engines."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.operators import calibration as cal
from panelweave.operators import structural as sc
from panelweave.operators import supervised as sv
from panelweave.operators import windows as win
from panelweave.operators.saved import saved
from panelweave.operators.stats import daily_differential
from panelweave.plans.fixtures import CALENDAR, PANEL, PRICE, STATES, Views
from panelweave.plans.model_queries import HITS, _hits
from panelweave.plans.registry import query

GRID = [0.15, 0.2, 0.25, 0.3, 0.4, 0.5]
RUNS = STATES + f""", {PRICE[PRICE.index('price0 AS'):]}, n0 AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR state <> lag(state) OVER w OR date_diff('day', lag(d) OVER w, d) > 21 THEN 1 ELSE 0 END AS new FROM states WINDOW w AS (PARTITION BY inst ORDER BY d)),
 n1 AS (SELECT *, sum(new) OVER (PARTITION BY inst ORDER BY d) AS run FROM n0), sd AS (SELECT *, row_number() OVER (PARTITION BY inst, run ORDER BY d) AS age, count(*) OVER (PARTITION BY inst, run) - row_number() OVER (PARTITION BY inst, run ORDER BY d) AS lft, max(d) OVER (PARTITION BY inst, run) AS run_end, max(d) OVER (PARTITION BY inst, run) = max(d) OVER (PARTITION BY inst) AS censored FROM n1 WHERE state = 'sell')"""


def _runs(v: Views):
    return sv.run_rows(v.states.select("inst", "d", "imb", "n", F.log("gross").alias("size"), "state"), "inst", "d", "state", "sell", 21)


@query("L3_run_targets", f"WITH {RUNS} SELECT inst, d, age, lft AS \"left\", run_end, censored, CASE WHEN NOT (censored AND lft < 1) THEN (lft <= 0)::INT END AS y1, CASE WHEN NOT (censored AND lft < 3) THEN (lft <= 2)::INT END AS y3 FROM sd")
def l3t(v: Views):
    """Age, rows left and the censored targets of every day of a selling run."""
    return _runs(v).select("inst", "d", F.col("age").cast("long"), F.col("left").cast("long"), "run_end", "censored", sv.ends_within(1).alias("y1"), sv.ends_within(3).alias("y3"))


@query("L3_hazard_walk")
def l3(v: Views):
    """Does a selling run end this week?  Yearly refits behind an embargo against age and share alone: scores by year, and what training saw."""
    p, folds = sv.walk_forward_hazard(_runs(v), "d", ["age", "imb", "n", "size"], 1, [1996, 1997, 1998], least=150, trees=8, depth=3)
    ps = saved(p)
    y = F.col("y").cast("double")
    loss = {c: F.avg(-(y * F.log(c) + (1 - y) * F.log(1 - F.col(c)))) for c in ("p_model", "p_age", "p_share")}
    s = ps.groupBy(F.year("d").alias("year")).agg(F.avg(y).alias("rate"), *[F.round(e, 6).alias(f"loss_{c[2:]}") for c, e in loss.items()])
    return folds.join(s, "year").withColumn("embargo_kept", F.datediff(F.make_date("year", F.lit(1), F.lit(1)), "last_train") > 10)


def _p(age: str = "age") -> str:
    return f"(0.1 + 0.6 * (1 - exp(-{age} / 2.0)) * abs(imb))"


GAINS = RUNS + f""", cp AS (SELECT inst, d, sum(greatest(least(coalesce(adj, 0), 0.5), -0.5)) OVER (PARTITION BY inst ORDER BY d ROWS UNBOUNDED PRECEDING) AS cum FROM price), cn AS (SELECT *, coalesce(lead(cum) OVER (PARTITION BY inst ORDER BY d), cum) AS nxt FROM cp),
 fc AS (SELECT 'model' AS rule, inst, run, d, run_end, {_p()} AS p FROM sd WHERE NOT censored UNION ALL SELECT 'age', inst, run, d, run_end, 0.02 + 0.13 * age FROM sd WHERE NOT censored),
 tr AS (SELECT rule, inst, run, theta, min(d) AS at_, any_value(run_end) AS run_end FROM fc, (SELECT unnest([{', '.join(map(str, GRID))}]::DOUBLE[]) AS theta) WHERE p > theta GROUP BY ALL),
 gn AS (SELECT tr.*, b.nxt - a.cum AS gain, year(run_end) AS year FROM tr JOIN cn a ON a.inst = tr.inst AND a.d = tr.at_ JOIN cn b ON b.inst = tr.inst AND b.d = tr.run_end),
 yr AS (SELECT DISTINCT rule, year FROM gn), pa AS (SELECT yr.rule, yr.year, g.theta, count(*) AS n, avg(g.gain) AS m FROM yr JOIN gn g ON g.rule = yr.rule AND g.year < yr.year GROUP BY ALL HAVING count(*) >= 20),
 ch AS (SELECT rule, year, arg_max(theta, (round(m, 12), -theta)) AS theta FROM pa GROUP BY 1, 2), de AS (SELECT gn.* FROM gn JOIN ch USING (rule, year, theta))"""


@query("L4_decision", f"WITH {GAINS} SELECT rule, year, theta, count(*) AS n, avg(gain) AS gain, NULL::DOUBLE AS t FROM de GROUP BY 1, 2, 3 UNION ALL SELECT 'paired', a.year, NULL, count(*), avg(a.gain - b.gain), avg(a.gain - b.gain) / nullif(stddev_samp(a.gain - b.gain), 0) * sqrt(count(*)) FROM de a JOIN de b ON a.rule = 'model' AND b.rule = 'age' AND a.inst = b.inst AND a.run = b.run GROUP BY a.year", "theta gain t")
def l4(v: Views):
    """Act on a run's first day above a threshold that earlier years chose: gains of a forecast, of age alone, and of the first less the second."""
    r = saved(_runs(v).where("not censored"))
    cum = F.sum(F.greatest(F.least(F.coalesce("adj", F.lit(0.0)), F.lit(0.5)), F.lit(-0.5))).over(Window.partitionBy("inst").orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    price = v.price.select("inst", "d", cum.alias("cum"))
    acts = {}
    for rule, p in (("model", F.expr(_p())), ("age", 0.02 + 0.13 * F.col("age"))):
        acts[rule] = saved(sv.decisions(sv.episode_gains(r.withColumn("p", p), price, "inst", "d", "p", GRID), 20))
    one = [a.groupBy(F.lit(k).alias("rule"), "year", "theta").agg(F.count("*").alias("n"), F.avg("gain").alias("gain"), F.lit(None).cast("double").alias("t")) for k, a in acts.items()]
    pair = sv.paired_gains(acts["model"], acts["age"], "inst").select(F.lit("paired").alias("rule"), "year", F.lit(None).cast("double").alias("theta"), "n", F.col("mean").alias("gain"), "t")
    return one[0].unionByName(one[1]).unionByName(pair)


def _ladder(v: Views):
    """Next week's return against what is known this week; years up to 1997 to train, later ones to test."""
    w = Window.partitionBy("inst").orderBy("d")
    x = v.price.select("inst", "d", "ret", F.log("turnover").alias("size"), win.rolling(F.stddev_samp, "ret", "inst", "d", 20, 10, 1).alias("vol"), F.lead("adj").over(w).alias("next"))
    x = x.join(v.states.select("inst", "d", "imb", "n", "state"), ["inst", "d"]).where("next is not null")
    return saved(x.where("d <= '1997-12-20'")), saved(x.where("d >= '1998-01-10'"))


BLOCKS = {"public": ["ret", "vol"], "flow": ["imb"], "comp": ["n", "size"]}


@query("L1_boosted_ladder")
def l1(v: Views):
    """Daily rank correlations of boosted trees on growing feature blocks, against the rung before and against class means."""
    train, test = _ladder(v)
    scored, _ = sv.boosted_ladder(train, test, "next", BLOCKS, trees=6, depth=3)
    scored = saved(sv.class_means(train, scored, "state", "next", "pred_class"))
    pairs = [("public", "class"), ("flow", "public"), ("comp", "flow")]
    parts = [sv.ic_difference(scored, "d", f"pred_{a}", f"pred_{b}", "next", 10).select(F.lit(a).alias("rung"), F.lit(b).alias("against"), "days", *[F.round(c, 6).alias(c) for c in ("ic_a", "ic_b", "difference", "t")]) for a, b in pairs]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("L2_attribution")
def l2(v: Views):
    """How much of the trees' rank correlation each feature carries, by dealing it out anew within the week."""
    train, test = _ladder(v)
    have = [f for b in BLOCKS.values() for f in b]
    _, models = sv.boosted_ladder(train, test, "next", {"all": have}, trees=6, depth=3)
    scored = models["all"][0].transform(sv.assembled(test, have))
    a = sv.attribution(scored, models["all"][0], have, "pred_all", "d", "inst", "next", 10)
    return a.select("feature", *[F.round(c, 6).alias(c) for c in ("ic", "permuted_ic", "drop")])


STARTS, ROUNDS = [(0.5, 0.5, 1.0), (0.2, 0.3, 1.5)], 8


def _pin_sql() -> str:
    """The rounds of the estimation as a chain of common table expressions."""
    starts = ", ".join(f"({i}, {a}::DOUBLE, {e}::DOUBLE, {m}::DOUBLE)" for i, (a, e, m) in enumerate(STARTS))
    post = """j{0} AS (SELECT k.*, p.restart, p.days, p.a, p.e, p.mu, p.eb, p.es, ln(1 - a) - eb + b * ln(eb) - es + s * ln(es) AS l0, ln(a * e) - eb + b * ln(eb) - (es + mu) + s * ln(es + mu) AS l1, ln(a * (1 - e)) - (eb + mu) + b * ln(eb + mu) - es + s * ln(es) AS l2 FROM k JOIN p{0} p USING (inst, y)),
 t{0} AS (SELECT *, greatest(l0, l1, l2) AS t FROM j{0}), u{0} AS (SELECT *, exp(l0 - t) + exp(l1 - t) + exp(l2 - t) AS al FROM t{0})"""
    move = """w{0} AS (SELECT *, n * exp(l1 - t) / al AS w1, n * exp(l2 - t) / al AS w2 FROM u{0}),
 p{1} AS MATERIALIZED (SELECT inst, y, restart, any_value(days) AS days, least(greatest((sum(w1) + sum(w2)) / any_value(days), 1e-9), 1 - 1e-9) AS a, least(greatest(sum(w1) / greatest(sum(w1) + sum(w2), 1e-9), 1e-9), 1 - 1e-9) AS e,
  greatest(sum(w2 * b * mu / (eb + mu) + w1 * s * mu / (es + mu)) / greatest(sum(w1) + sum(w2), 1e-9), 1e-9) AS mu, greatest(sum(n * b - w2 * b * mu / (eb + mu)) / any_value(days), 1e-9) AS eb, greatest(sum(n * s - w1 * s * mu / (es + mu)) / any_value(days), 1e-9) AS es FROM w{0} GROUP BY 1, 2, 3)"""
    chain = ", ".join(post.format(r) + ", " + move.format(r, r + 1) for r in range(ROUNDS)) + ", " + post.format(ROUNDS)
    return f"""WITH {PANEL}, k AS (SELECT inst, year(d) AS y, CAST(n_buys AS DOUBLE) AS b, CAST(n_sells AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n FROM panel GROUP BY 1, 2, 3, 4),
 g AS (SELECT inst, y, sum(n) AS days, sum(n * abs(b - s)) / sum(n) AS gap, sum(n * b) / sum(n) AS mb, sum(n * s) / sum(n) AS ms FROM k GROUP BY 1, 2 HAVING sum(n) >= 20), st(restart, a, e, m) AS (VALUES {starts}),
 p0 AS MATERIALIZED (SELECT inst, y, restart, days, a, e, greatest(gap, 1) * m AS mu, greatest(mb * 0.75, 0.5) AS eb, greatest(ms * 0.75, 0.5) AS es FROM g, st), {chain},
 f AS (SELECT inst, y, restart, any_value(days) AS days, sum(n * (t + ln(al))) AS ll, any_value(a) AS a, any_value(mu) AS mu, any_value(eb) AS eb, any_value(es) AS es FROM u{ROUNDS} GROUP BY 1, 2, 3),
 z AS (SELECT inst, y, arg_max({{'days': days, 'll': ll, 'a': a, 'mu': mu, 'eb': eb, 'es': es}}, (round(ll, 6), -restart)) AS b FROM f GROUP BY 1, 2)
 SELECT inst, y AS year, CAST(b.days AS BIGINT) AS days, b.ll AS loglik, b.a * b.mu / (b.a * b.mu + b.eb + b.es) AS pin FROM z"""


@query("L5_informed_trading", _pin_sql(), "loglik pin", 4)
def l5(v: Views):
    x = v.panel.select("inst", F.year("d").alias("year"), "n_buys", "n_sells")
    p = sc.informed_trading(x, ["inst", "year"], "n_buys", "n_sells", STARTS, ROUNDS, 20)
    return p.select("inst", "year", F.col("days").cast("long").alias("days"), "loglik", "pin")


@query("K9_natural_threshold")
def k9(v: Views):
    """Where the tails of selling and buying weeks begin, from the early years, checked on the later ones."""
    x = v.states.withColumn("size", F.log("gross"))
    train, test = x.where("d <= '1995-12-31'"), x.where("d > '1995-12-31'")
    parts = [sc.natural_threshold(train.where(f"state = '{s}'"), test.where(f"state = '{s}'"), "size", tail, 0.3).withColumn("state", F.lit(s)) for s, tail in (("sell", "low"), ("sell", "high"), ("buy", "high"))]
    d = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return d.select("state", "tail", "rows", "components", "method", *[F.round(c, 5).alias(c) for c in ("boundary", "test_boundary", "shift", "threshold", "three_means")])


MARKET = PRICE + ", mk AS (SELECT d, any_value(mkt) AS r, row_number() OVER (ORDER BY d) AS k FROM price WHERE mkt IS NOT NULL GROUP BY d)"
FIRST, REFIT, BURN = 100, 40, 20
PARS = ", ".join(f"({i}, {a}::DOUBLE, {g}::DOUBLE, {b}::DOUBLE)" for i, (a, g, b) in enumerate(sc.GJR))


@query("L6_asymmetric_variance", f"""WITH RECURSIVE {MARKET}, gr(i, a, g, b) AS (VALUES {PARS}), v0 AS (SELECT greatest(var_pop(r) FILTER (k <= {BURN}), 1e-9) AS h0, greatest(var_pop(r) FILTER (k <= {FIRST}), 1e-9) AS uv FROM mk),
 h AS (SELECT i, a, g, b, 1::BIGINT AS k, h0::DOUBLE AS h, 0.0::DOUBLE AS nll, uv FROM gr, v0 UNION ALL
  SELECT h.i, a, g, b, h.k + 1, (uv * (1 - a - 0.5 * g - b) + (a + CASE WHEN r < 0 THEN g ELSE 0 END) * r * r + b * h)::DOUBLE, (nll + CASE WHEN h.k > {BURN} THEN 0.5 * (ln(h) + r * r / h) ELSE 0 END)::DOUBLE, uv FROM h JOIN mk ON mk.k = h.k),
 ch AS (SELECT k - 1 AS k, arg_min(i, (round(nll, 9), i)) AS i FROM h WHERE k - 1 >= {FIRST} AND (k - 1 - {FIRST}) % {REFIT} = 0 GROUP BY k),
 fr AS (SELECT mk.d, mk.k, (SELECT max(ch.k) FROM ch WHERE ch.k <= mk.k) AS ck FROM mk WHERE mk.k >= {FIRST})
 SELECT fr.d, sqrt(h.h) AS sigma, a AS alpha, g AS gamma, b AS beta, nll FROM fr JOIN ch ON ch.k = fr.ck JOIN h ON h.i = ch.i AND h.k = fr.k + 1""", "sigma alpha gamma beta nll")
def l6(v: Views):
    """The market's volatility for the next week, by parameters that only the past has chosen."""
    m = v.price.where("mkt is not null").groupBy("d").agg(F.first("mkt").alias("r")).withColumn("key", F.lit(1))
    return sc.asymmetric_variance(m, "key", "d", "r", FIRST, REFIT, BURN).drop("key")


SCALES, NUS, THETAS = [0.8, 0.9, 1.0, 1.1, 1.25], [4.0, 8.0, 30.0], [-0.4, -0.2, 0.0, 0.2, 0.4]
TILTS = ", ".join(f"({s}::DOUBLE, {n}::DOUBLE, {t}::DOUBLE, {math.lgamma((n + 1) / 2) - math.lgamma(n / 2) - 0.5 * math.log(n * math.pi)!r}::DOUBLE)" for s in SCALES for n in NUS for t in THETAS)
DAILY = HITS + f", {CALENDAR}, dz AS (SELECT d, pos, avg(z) * sqrt(count(*)) AS z, avg(abs(z)) - 0.8 AS x0 FROM hits JOIN calendar USING (d) WHERE z IS NOT NULL GROUP BY d, pos), td AS (SELECT *, round(lag(x0) OVER (ORDER BY d), 6) AS x FROM dz)"


def _daily(v: Views):
    h = _hits(v).where("z is not null").join(v.calendar, "d")
    g = h.groupBy("d", "pos").agg((F.avg("z") * F.sqrt(F.count("*"))).alias("z"), (F.avg(F.abs("z")) - 0.8).alias("x0"))
    return g.withColumn("x", F.round(F.lag("x0").over(Window.partitionBy(F.lit(1)).orderBy("d")), 6))  # one row a date


def _years(v: Views):
    return v.calendar.groupBy(F.date_format("d", "yyyy").alias("vintage")).agg(F.max("pos").alias("asof_pos"))


YEARS = "vint AS (SELECT strftime(d, '%Y') AS vintage, max(pos) AS asof_pos FROM calendar GROUP BY 1)"


@query("L7_tilted_scale", f"""WITH {DAILY}, {YEARS}, gr(scale, nu, theta, c) AS (VALUES {TILTS}), l AS (SELECT vintage, scale, nu, theta, count(*) AS n, sum(ln(scale) + theta * x - c + (nu + 1) / 2 * ln(1 + pow(z * exp(-(ln(scale) + theta * x)), 2) / nu)) AS nll FROM vint JOIN td ON pos + 1 <= asof_pos, gr WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 50)
 SELECT vintage, b.n AS n, b.scale AS scale, b.nu AS nu, b.theta AS theta FROM (SELECT vintage, arg_min({{'n': n, 'scale': scale, 'nu': nu, 'theta': theta}}, (round(nll, 6), abs(theta), abs(ln(scale)), nu)) AS b FROM l GROUP BY vintage)""", "scale nu theta")
def l7(v: Views):
    """The scale, tail and tilt by last week's dispersion that fit best what each year end knows."""
    return sc.tilted_scale(_daily(v).select("pos", "z", "x"), _years(v), 1, SCALES, NUS, THETAS, 50)


@query("L8_engine_gates")
def l8(v: Views):
    """Engines of growing feature sets on the same days: mean score, and its daily difference from the engine without features."""
    d = saved(_daily(v).withColumn("flow", F.round(F.lag("z").over(Window.partitionBy(F.lit(1)).orderBy("d")), 6)))
    years = saved(_years(v))
    in_force = years.agg(F.array_sort(F.collect_list(F.struct("asof_pos", "vintage"))).alias("vs"))  # a vintage a year
    d = d.join(in_force).withColumn("vintage", F.try_element_at(F.filter("vs", lambda e: e["asof_pos"] < F.col("pos")), F.lit(-1))["vintage"]).drop("vs")
    out = []
    for name, x, thetas in (("M0", F.lit(0.0), [0.0]), ("M1", F.col("x"), THETAS), ("M2", F.col("flow"), THETAS)):
        e = d.withColumn("f", x)
        fit = sc.tilted_scale(e.select("pos", "z", F.col("f").alias("x")), years, 1, SCALES, NUS, thetas, 50)
        s = e.join(fit, "vintage").withColumn("sigma", sc.tilt(F.col("scale"), F.col("theta"), F.col("f"), 0.5, 2.0))
        out.append(saved(cal.student_scores(s.select("d", F.col("z"), "sigma", "nu"), "z", "sigma", "nu").select("d", F.col("crps").alias(name))))
    both = out[0].join(out[1], "d").join(out[2], "d")  # common scored days
    parts = [daily_differential(both, "d", m, "M0", 4).select(F.lit(m).alias("engine"), F.col("n").alias("days"), F.round("mean", 6).alias("difference"), F.round("t", 4).alias("t"), (F.col("t") <= -2).alias("passed")) for m in ("M1", "M2")]
    return parts[0].unionByName(parts[1])


SHARES = HITS + f", {CALENDAR}, {YEARS}, bv AS (SELECT inst, d, sum(CASE WHEN side = 1 THEN value ELSE 0 END) AS buy FROM trades GROUP BY 1, 2), pr AS (SELECT price.inst, price.d, turnover, buy FROM price JOIN bv USING (inst, d)), nm AS (SELECT *, CASE WHEN count(*) OVER w >= 10 THEN avg(buy) OVER w END AS bn, CASE WHEN count(*) OVER w >= 10 THEN avg(turnover) OVER w END AS tn FROM pr WINDOW w AS (PARTITION BY inst ORDER BY d ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), sh AS (SELECT inst, d, ln(buy / bn) - ln(turnover / tn) AS s, ln(turnover / tn) AS v FROM nm WHERE buy > 0 AND bn > 0), dm AS (SELECT inst, d, s - avg(s) OVER (PARTITION BY d) AS x, v - avg(v) OVER (PARTITION BY d) AS v FROM sh JOIN hits USING (inst, d) WHERE s IS NOT NULL AND v IS NOT NULL), ob AS (SELECT pos, x, v, pow(least(greatest(z, -4), 4), 2) AS y FROM dm JOIN hits USING (inst, d) JOIN calendar USING (d) WHERE z IS NOT NULL)"


@query("K18_share_correction", f"""WITH {SHARES}, m AS (SELECT vintage, count(x) AS n, sum(x) AS sx, sum(v) AS sv, sum(y) AS sy, sum(x * x) AS sxx, sum(v * v) AS svv, sum(x * v) AS sxv, sum(x * y) AS sxy, sum(v * y) AS svy FROM vint LEFT JOIN ob ON pos + 1 <= asof_pos GROUP BY vintage),
 c AS (SELECT vintage, n, n * (sxx * svv - sxv * sxv) - sx * (sx * svv - sxv * sv) + sv * (sx * sxv - sxx * sv) AS d, sy * (sxx * svv - sxv * sxv) - sx * (sxy * svv - sxv * svy) + sv * (sxy * sxv - sxx * svy) AS l, n * (sxy * svv - sxv * svy) - sy * (sx * svv - sxv * sv) + sv * (sx * svy - sxy * sv) AS a, n * (sxx * svy - sxy * sxv) - sx * (sx * svy - sxy * sv) + sy * (sx * sxv - sxx * sv) AS b FROM m)
 SELECT vintage, n, CASE WHEN n >= 100 AND abs(d) > 1e-12 AND l / d > 1e-9 THEN a / l ELSE 0 END AS b_share, CASE WHEN n >= 100 AND abs(d) > 1e-12 AND l / d > 1e-9 THEN b / l ELSE 0 END AS b_volume FROM c""", "b_share b_volume", 5)
def k18(v: Views):
    """How much of the squared standardised return goes with the buyers' share and the volume of the week."""
    buy = v.trades.groupBy("inst", "d").agg(F.sum(F.when(F.col("side") == 1, F.col("value")).otherwise(0.0)).alias("buy"))
    p = v.price.select("inst", "d", "turnover").join(buy, ["inst", "d"])
    p = p.select("*", win.rolling(F.avg, "buy", "inst", "d", 20, 10, 1).alias("bn"), win.rolling(F.avg, "turnover", "inst", "d", 20, 10, 1).alias("tn")).where("buy > 0 and bn > 0 and turnover > 0 and tn > 0")
    vo = F.log("turnover") - F.log("tn")
    s = p.select("inst", "d", (F.log("buy") - F.log("bn") - vo).alias("share"), vo.alias("volume"))
    df = _hits(v).select("inst", "d", "z").join(s, ["inst", "d"]).join(v.calendar, "d").select("pos", F.col("d").alias("day"), "z", "share", "volume")
    return sc.share_correction(df, _years(v), 1, 4.0, 100)
