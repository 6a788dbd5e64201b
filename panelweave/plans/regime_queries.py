"""Queries of regime models: restarts, paths over gaps, carried beliefs, two chains, frozen splits."""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelweave.operators import hmm
from panelweave.operators import regimes as rg
from panelweave.plans.fixtures import CALENDAR, STATES, Views
from panelweave.plans.registry import query

MEANS, SDS, TRANS, START, MOST = [-0.15, 0.2], [0.2, 0.25], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5], 6
PAR = {"means": np.array(MEANS), "sds": np.array(SDS), "trans": np.array(TRANS), "start": np.array(START)}


def _seen(v: Views):
    """Weeks with a clear direction, at their place in the calendar; the others are gaps."""
    size = F.log("gross") - F.avg(F.log("gross")).over(Window.partitionBy("inst"))
    x = v.states.where("gross > 0").withColumn("size", size).where("abs(imb) > 0.1")
    return x.join(v.calendar, "d").select("inst", "d", "pos", "imb", "size")


# Powers of the two-state transitions in closed form; beyond MOST the stationary distribution.
LAMBDA = "(CASE WHEN gap > 6 THEN 0.0::DOUBLE ELSE pow(0.7::DOUBLE, gap) END)"
A00, A01, A10, A11 = f"(2.0 / 3 + 1.0 / 3 * {LAMBDA})", f"(1.0 / 3 * (1 - {LAMBDA}))", f"(2.0 / 3 * (1 - {LAMBDA}))", f"(1.0 / 3 + 2.0 / 3 * {LAMBDA})"
SEEN = STATES + f", {CALENDAR}, o AS MATERIALIZED (SELECT inst, d, imb AS x, row_number() OVER w AS k, coalesce(pos - lag(pos) OVER w, 1) AS gap, (-0.5 * pow((imb + 0.15) / 0.2, 2) - ln(0.2))::DOUBLE AS la, (-0.5 * pow((imb - 0.2) / 0.25, 2) - ln(0.25))::DOUBLE AS lb FROM states JOIN calendar USING (d) WHERE gross > 0 AND abs(imb) > 0.1 WINDOW w AS (PARTITION BY inst ORDER BY pos))"
PATHS = f"""v AS (SELECT inst, k, (ln(0.5) + la)::DOUBLE AS a, (ln(0.5) + lb)::DOUBLE AS b, 0 AS ca, 0 AS cb FROM o WHERE k = 1 UNION ALL
 SELECT o.inst, o.k, (greatest(v.a + ln({A00}), v.b + ln({A10})) + o.la)::DOUBLE, (greatest(v.a + ln({A01}), v.b + ln({A11})) + o.lb)::DOUBLE, CASE WHEN v.a + ln({A00}) >= v.b + ln({A10}) THEN 0 ELSE 1 END, CASE WHEN v.a + ln({A01}) >= v.b + ln({A11}) THEN 0 ELSE 1 END
 FROM v JOIN o ON o.inst = v.inst AND o.k = v.k + 1),
 p AS (SELECT inst, k, CASE WHEN a >= b THEN 0 ELSE 1 END AS path FROM v WHERE (inst, k) IN (SELECT (inst, max(k)) FROM o GROUP BY inst) UNION ALL SELECT v.inst, v.k - 1, CASE p.path WHEN 0 THEN v.ca ELSE v.cb END FROM p JOIN v ON v.inst = p.inst AND v.k = p.k WHERE v.k > 1)"""
BELIEF = f"""f AS (SELECT inst, k, (exp(la) / (exp(la) + exp(lb)))::DOUBLE AS p, (0.5 * exp(la) + 0.5 * exp(lb))::DOUBLE AS c FROM o WHERE k = 1 UNION ALL
 SELECT o.inst, o.k, ((f.p * {A00} + (1 - f.p) * {A10}) * exp(o.la) / ((f.p * {A00} + (1 - f.p) * {A10}) * exp(o.la) + (f.p * {A01} + (1 - f.p) * {A11}) * exp(o.lb)))::DOUBLE, ((f.p * {A00} + (1 - f.p) * {A10}) * exp(o.la) + (f.p * {A01} + (1 - f.p) * {A11}) * exp(o.lb))::DOUBLE
 FROM f JOIN o ON o.inst = f.inst AND o.k = f.k + 1)"""


@query("K5_viterbi", f"WITH RECURSIVE {SEEN}, {PATHS} SELECT inst, d, path FROM p JOIN o USING (inst, k)")
def k5(v: Views):
    return hmm.decode(_seen(v), "inst", "d", "pos", "imb", PAR, MOST).select("inst", "d", "path")


@query("K4_gap_filter", f"WITH RECURSIVE {SEEN}, {BELIEF}, y AS (SELECT max(d) AS e FROM calendar GROUP BY year(d)) SELECT inst, d, p, (SELECT max(e) FROM y WHERE e < o.d) AS \"asof\", CAST(date_diff('day', (SELECT max(e) FROM y WHERE e < o.d), d) AS INTEGER) AS param_age FROM f JOIN o USING (inst, k)", "p")
def k4g(v: Views):
    """The carried belief over gaps, with a new start beyond six positions, and the age of the parameters in force."""
    f = rg.forward_filter(_seen(v), "inst", "d", "imb", MEANS, SDS, TRANS, START, "pos", MOST)
    ends = v.calendar.groupBy(F.year("d").alias("y")).agg(F.max("d").alias("e")).agg(F.array_sort(F.collect_list("e")).alias("ends"))  # one a year
    asof = F.try_element_at(F.filter("ends", lambda e: e < F.col("d")), F.lit(-1))
    r = f.join(ends).withColumn("asof", asof)  # one row on the right
    return r.select("inst", "d", F.col("p")[0].alias("p"), "asof", F.datediff("d", "asof").alias("param_age"))


@query("K28_decode_stickiness", f"WITH RECURSIVE {SEEN}, {PATHS}, {BELIEF}, l AS (SELECT o.inst, o.k, u.name, u.label FROM o JOIN p USING (inst, k) JOIN f USING (inst, k), LATERAL (SELECT unnest(['filtered', 'path', 'rule']) AS name, unnest([CASE WHEN f.p >= 0.5 THEN 0 ELSE 1 END, p.path, CASE WHEN o.x < 0 THEN 0 ELSE 1 END]) AS label) u), n AS (SELECT name, label, lead(label) OVER (PARTITION BY inst, name ORDER BY k) AS nx FROM l) SELECT name, label, count(*) AS n, avg((label = nx)::INT) AS self_rate FROM n WHERE nx IS NOT NULL GROUP BY 1, 2", "self_rate")
def k28d(v: Views):
    """How often a label is followed by itself, under three ways of labelling."""
    x = _seen(v)
    d = hmm.decode(x, "inst", "d", "pos", "imb", PAR, MOST).join(x.select("inst", "d", "imb"), ["inst", "d"])
    labels = {"filtered": F.when(F.col("filtered")[0] >= 0.5, 0).otherwise(1), "path": F.col("path"), "rule": F.when(F.col("imb") < 0, 0).otherwise(1)}
    l = d.select("inst", "d", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), c.alias("label")) for n, c in labels.items()])))
    l = l.withColumn("nx", F.lead("label").over(Window.partitionBy("inst", "name").orderBy("d"))).where("nx is not null")
    return l.groupBy("name", "label").agg(F.count("*").alias("n"), F.avg((F.col("label") == F.col("nx")).cast("double")).alias("self_rate"))


@query("K1_em_round", f"""WITH RECURSIVE {SEEN}, {BELIEF}, nxt AS (SELECT f.inst, f.k, f.p, f.c, o.x, o.la, o.lb, o.gap FROM f JOIN o USING (inst, k)),
 bk AS (SELECT inst, k, 1.0::DOUBLE AS u, 1.0::DOUBLE AS w FROM o WHERE (inst, k) IN (SELECT (inst, max(k)) FROM o GROUP BY inst) UNION ALL
 SELECT n.inst, n.k - 1, (({A00}) * exp(n.la) * bk.u / n.c + ({A01}) * exp(n.lb) * bk.w / n.c)::DOUBLE, (({A10}) * exp(n.la) * bk.u / n.c + ({A11}) * exp(n.lb) * bk.w / n.c)::DOUBLE FROM bk JOIN nxt n ON n.inst = bk.inst AND n.k = bk.k WHERE n.k > 1),
 g AS (SELECT n.*, n.p * bk.u AS g0, (1 - n.p) * bk.w AS g1 FROM nxt n JOIN bk USING (inst, k)),
 s AS (SELECT sum(ln(c) - 0.9189385332046727) AS loglik, sum(g0) AS n0, sum(g1) AS n1, sum(g0 * x) AS x0, sum(g1 * x) AS x1, sum(g0 * x * x) AS q0, sum(g1 * x * x) AS q1, sum(g0) FILTER (k = 1) AS s0, count(*) FILTER (k = 1) AS m FROM g)
 SELECT loglik, x0 / n0 AS mean0, x1 / n1 AS mean1, sqrt(q0 / n0 - x0 / n0 * x0 / n0) AS sd0, sqrt(q1 / n1 - x1 / n1 * x1 / n1) AS sd1, s0 / m AS start0 FROM s""", "loglik mean0 mean1 sd0 sd1 start0", 5)
def k1e(v: Views):
    """The log-likelihood of given parameters and what one round of expectation-maximisation makes of them."""
    x = _seen(v).withColumn("g", F.lit(0))
    begin = {(0, 0): {"means": np.array(MEANS)[:, None], "variances": np.array(SDS)[:, None] ** 2, "trans": np.array(TRANS), "start": np.array(START)}}
    got = hmm.fit_many(x, "g", "inst", "pos", ["imb"], begin, 1, 0.0, MOST, partial(hmm.update, floor=1e-12))[0, 0]  # the round's own variances, however small
    m, s = got["means"][:, 0], np.sqrt(got["variances"][:, 0])
    row = (got["history"][0], float(m[0]), float(m[1]), float(s[0]), float(s[1]), float(got["start"][0]))
    return v.spark.createDataFrame([row], "loglik double, mean0 double, mean1 double, sd0 double, sd1 double, start0 double")


def _vintages(v: Views):
    """Rows of a year and the one before it, under the year; no vintage sees what comes after it."""
    x = _seen(v).withColumn("vintage", F.explode(F.array(F.year("d"), F.year("d") + 1)))
    return x.join(v.calendar.select(F.year("d").alias("vintage")).distinct(), "vintage", "left_semi")


@query("K2_restart_fits")
def k2(v: Views):
    """Per yearly vintage the best of four starts that passes the gate, its states matched with those of the year before."""
    x = _vintages(v)
    starts = hmm.spread_starts(x, "vintage", ["imb", "size"], 2, 4, 0.5, 42)
    fits = hmm.fit_many(x, "vintage", "inst", "pos", ["imb", "size"], starts, 12, 1e-5)
    table = hmm.fits_table(v.spark, fits, "vintage", "int")
    best = hmm.aligned(hmm.winners(table, "vintage", 0.05, 0.1), "vintage", 2)
    return best.select("vintage", "tried", "passed", "restart", "rounds", F.round("loglik", 3).alias("loglik"), F.round("spread", 3).alias("spread"), F.round("cost_of_gate", 3).alias("cost_of_gate"), F.round(F.col("means")[0][0], 4).alias("low_mean"), F.round(F.col("means")[1][0], 4).alias("high_mean"), F.round(F.col("trans")[0][0], 4).alias("low_self"), F.round(F.col("trans")[1][1], 4).alias("high_self"), "match", F.round("match_cost", 4).alias("match_cost"), F.round("second_cost", 4).alias("second_cost"))


@query("K6_two_chains")
def k6(v: Views):
    """Two chains that move alone and add their means: direction beside size, fitted from two starts."""
    x = _seen(v).withColumn("g", F.lit(0))
    s = x.agg(F.stddev_samp("imb").alias("a"), F.stddev_samp("size").alias("b")).first()
    starts = {}
    for j, share in enumerate((1.0, 0.5)):
        one, two = np.array([[-1.0, 0.0], [1.0, 0.0]]) * share * s["a"], np.array([[0.0, -1.0], [0.0, 1.0]]) * share * s["b"]
        keep = np.array([[0.9, 0.1], [0.1, 0.9]])
        starts[0, j] = {"means": (one[:, None] + two[None]).reshape(4, 2), "variances": np.tile([s["a"] ** 2, s["b"] ** 2], (4, 1)), "trans": np.kron(keep, keep), "start": np.full(4, 0.25), "chains": (2, 2)}
    fits = hmm.fit_many(x, "g", "inst", "pos", ["imb", "size"], starts, 8, 1e-5, improve=hmm.update_two_chains)
    best = max(fits, key=lambda k: fits[k]["loglik"])
    p = fits[best]
    rows = [(name, i, *[round(float(m), 5) for m in p[name][i]], round(float(p[f"trans_{name}"][i, i]), 5), round(p["loglik"], 3), p["monotone"]) for name in ("one", "two") for i in range(2)]
    return v.spark.createDataFrame(rows, "chain string, state int, direction double, size double, self double, loglik double, monotone boolean")


@query("K7_frozen_split")
def k7(v: Views):
    """A model fitted on the early years alone, then frozen: census and transitions of its paths in either era."""
    era = F.when(F.col("d") <= "1995-12-31", "TRAIN").otherwise("TEST")
    x = _seen(v).withColumn("era", era)
    train = x.where("era = 'TRAIN'")
    starts = hmm.spread_starts(train, "era", ["imb", "size"], 2, 3, 0.5, 7)
    fits = hmm.fit_many(train, "era", "inst", "pos", ["imb", "size"], starts, 8, 1e-5)
    par = hmm._ordered(fits[max(fits, key=lambda k: (fits[k]["loglik"], -k[1]))])
    d = hmm.decode(x, "inst", "d", "pos", ["imb", "size"], par).select("inst", "d", F.col("path").alias("state")).join(x.select("inst", "d", "era"), ["inst", "d"])
    return hmm.era_replication(d, "inst", "d", "era", "state").withColumn("share", F.round("share", 6))
