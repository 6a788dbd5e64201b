import math
from datetime import date, timedelta
from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from panelweave.functions.normal import normal_cdf, probit
from panelweave.operators import aggregates as agg
from panelweave.operators import calibration as cal
from panelweave.operators import cleaning as cl
from panelweave.operators import identity as idn
from panelweave.operators import joins as jn
from panelweave.operators import panelreg as pr
from panelweave.operators import portfolio as pf
from panelweave.operators import regimes as rg
from panelweave.operators import stats as st
from panelweave.operators import windows as win
from panelweave.sources import tables as tb

D0 = date(2020, 1, 1)


def day(k):
    return D0 + timedelta(days=k)


def test_normal_functions(spark):
    ps = [1e-12, 1e-5, 0.01, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    nd = NormalDist()
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", probit(F.col("p")).alias("q")).withColumn("back", normal_cdf(F.col("q"))).collect():
        assert abs(r.q - nd.inv_cdf(r.p)) < 1e-8 and abs(r.back - r.p) < 1e-12
    assert spark.range(1).select(probit(F.lit(1.0)).alias("x")).first().x is None


def test_entity_and_year_repair(spark):
    rows = [("(null)", None), (" AB ", "AB"), ("A" * 11 + "200131", "A" * 11), ("A" * 13 + "200131", "A" * 13), ("A" * 14 + "200131", "A" * 14 + "200131"), (None, None)]
    got = [r.e for r in spark.createDataFrame([(a,) for a, _ in rows], "x string").select(cl.entity_id(F.col("x")).alias("e")).collect()]
    assert got == [b for _, b in rows]
    r = spark.range(1).select(cl.repair_year(F.make_date(F.lit(20), F.lit(3), F.lit(4))).alias("a"), cl.repair_year(F.lit(date(2019, 5, 6))).alias("b")).first()
    assert (r.a, r.b) == (date(2020, 3, 4), date(2019, 5, 6))


def test_asof_bounds_and_ties(spark):
    left = spark.createDataFrame([("a", day(k), k) for k in (0, 1, 2, 5)] + [("b", day(1), 9)], "k string, t date, i int")
    right = spark.createDataFrame([("a", day(1), 10), ("a", day(4), 20), ("a", day(4), 25)], "k string, s date, v int")
    def run(**kw):
        return {r.i: r.v for r in jn.asof_join(left, right, ["k"], "t", "s", ["v"], **kw).collect()}
    assert run() == {0: None, 1: 10, 2: 10, 5: 25, 9: None}
    assert run(strict=True) == {0: None, 1: None, 2: 10, 5: 25, 9: None}
    assert run(direction="forward") == {0: 10, 1: 10, 2: 25, 5: None, 9: None}
    assert run(direction="forward", strict=True) == {0: 10, 1: 25, 2: 25, 5: None, 9: None}


def test_future_changes_nothing_past(spark):
    """Rolling features of rows up to T are the same on data cut at T."""
    rows = [(k % 3, day(k), float((k * 37) % 17)) for k in range(90)]
    df = spark.createDataFrame(rows, "inst int, d date, x double")
    def build(f):
        return f.select("inst", "d", win.rolling(F.avg, "x", "inst", "d", 5, 2, 1).alias("v"))
    full, part = build(df), build(df.where(F.col("d") <= F.lit(day(50))))
    diff = jn.frame_diff(full.where(F.col("d") <= F.lit(day(50))), part, ["inst", "d"], "v").first()
    assert (diff.differing, diff.full_only, diff.part_only) == (0, 0, 0)


def test_chain_stops_at_cycles_and_backward_dates(spark):
    chain = [(f"n{k}", f"n{k + 1}", day(20 + k // 2), "1" if k != 4 else "3") for k in range(9)]  # longer than any fixed depth, with equal dates
    e = spark.createDataFrame([("a", "b", day(1), "2"), ("b", "c", day(5), "1"), ("c", "a", day(9), "1"), ("x", "y", day(8), "1"), ("y", "z", day(2), "1"), *chain], "old_id string, new_id string, ca_date date, tier string")
    rows = idn.chain_intervals(e).collect()
    got = {(r.old_id, r.canonical_id, r.depth) for r in rows if r.depth and r.old_id in "abcxy"}
    assert got == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("b", "a", 2), ("c", "a", 1), ("x", "y", 1), ("y", "z", 1)}
    long = sorted((r for r in rows if r.old_id == "n0"), key=lambda r: r.depth)
    assert [r.canonical_id for r in long] == [f"n{k}" for k in range(10)] and {r.confidence for r in long[1:]} == {"3"} and long[0].confidence == "SELF"
    assert long[0].effective_from is None and all(a.effective_to == b.effective_from for a, b in zip(long, long[1:], strict=False)) and long[-1].effective_to is None
    gates = idn.interval_gates(idn.chain_intervals(e)).first()
    assert (gates.not_monotone, gates.self, gates.holes) == (0, 0, 0)
    assert idn.hindsight_gate(e, str(day(22))).first().hindsight == 0


def test_reciprocal_pairs(spark):
    e = spark.createDataFrame([("INE1", "T1", day(1)), ("T1", "INE1", day(2)), ("A", "B", day(1)), ("B", "A", day(1)), ("C", "D", day(1))], "old_id string, new_id string, ca_date date")
    got = {(r.old_id, r.new_id) for r in idn.break_reciprocal(e, "id like 'INE%'").collect()}
    assert got == {("T1", "INE1"), ("C", "D")}


def test_runs_break_on_gaps_and_streak_is_of_yesterday(spark):
    df = spark.createDataFrame([("a", day(k), s) for k, s in ((0, 1), (1, 1), (2, -1), (20, -1), (21, -1))], "k string, t date, s int")
    assert [r.run for r in win.with_runs(df, "k", "t", "s", 7).orderBy("t").collect()] == [1, 1, 2, 3, 3]
    assert [r.streak for r in win.streak(df, "k", "t", "s").orderBy("t").collect()] == [None, 1, 2, -1, -2]


def test_thinning(spark):
    df = spark.createDataFrame([("a", day(k)) for k in (0, 3, 7, 9, 14, 20)], "k string, t date")
    assert [r.t for r in win.thin(df, "k", "t", 7).orderBy("t").collect()] == [day(0), day(7), day(14)]


def test_weights_and_book(spark):
    rows = [(f"i{j}", day(k), math.sin(j * 7 + k * 3.0)) for j in range(12) for k in range(6)]
    a = spark.createDataFrame(rows, "inst string, d date, alpha double")
    w = pf.weights(a, "d", "alpha", 0.2)
    for r in w.groupBy("d").agg(F.sum(F.abs("w")).alias("g"), F.max(F.abs("w")).alias("m")).collect():
        assert abs(r.g - 1) < 1e-12 and r.m < 0.25
    cal = win.trading_calendar(a, "d", "inst", 3)
    ret = a.select("inst", "d", (F.col("alpha") / 10).alias("ret"))
    got = {r.d: r for r in pf.book(w.select("inst", "d", "w"), ret, cal, 1, 10.0).collect()}
    plain = {(r.inst, r.d): r.w for r in w.collect()}
    rets = {(i, d): x / 10 for i, d, x in rows}
    held_before = {}
    for k in range(6):
        held = {i: plain[i, day(k - 2)] for i in {r[0] for r in rows}} if k >= 2 else {}
        gross = sum(x * rets[i, day(k)] for i, x in held.items())
        turn = sum(abs(held.get(i, 0) - held_before.get(i, 0)) for i in {*held, *held_before})
        assert abs(got[day(k)].gross - gross) < 1e-12 and abs(got[day(k)].turnover - turn) < 1e-12
        assert abs(got[day(k)].net - (gross - 0.001 * turn)) < 1e-12
        held_before = held


def test_planted_slope_is_found_and_noise_is_not(spark):
    import random

    rng = random.Random(1)
    rows = [("k", x := rng.gauss(0, 1), 2 * x + rng.gauss(0, 0.1) + 1, rng.gauss(0, 1)) for _ in range(500)]
    r = st.ols(spark.createDataFrame(rows, "k string, x double, y double, z double"), "y", ["x", "z"], ["k"]).first()
    assert abs(r.b_x - 2) < 0.05 and abs(r.b_const - 1) < 0.05 and abs(r.b_z) < 0.05


def test_filter_is_a_probability_and_waits_on_missing(spark):
    rows = [("a", day(k), x) for k, x in enumerate((-1.0, None, 1.2, 1.0, None))]
    f = rg.forward_filter(spark.createDataFrame(rows, "k string, t date, x double"), "k", "t", "x", [-1.0, 1.0], [0.5, 0.5], [[0.9, 0.1], [0.2, 0.8]], [0.5, 0.5]).orderBy("t").collect()
    p = [r.p for r in f]
    assert all(abs(sum(q) - 1) < 1e-12 for q in p)
    assert abs(p[1][0] - (p[0][0] * 0.9 + p[0][1] * 0.2)) < 1e-12 and p[3][1] > 0.99


def test_filter_moves_over_gaps(spark):
    a = [[0.9, 0.1], [0.2, 0.8]]
    rows = [("a", day(0), 0, -1.0), ("a", day(9), 3, None), ("a", day(20), 400, None)]
    p = [r.p for r in rg.forward_filter(spark.createDataFrame(rows, "k string, t date, pos int, x double"), "k", "t", "x", [-1.0, 1.0], [0.5, 0.5], a, [0.5, 0.5], "pos").orderBy("t").collect()]
    q = p[0]
    for _ in range(3):
        q = [q[0] * 0.9 + q[1] * 0.2, q[0] * 0.1 + q[1] * 0.8]
    assert abs(p[1][0] - q[0]) < 1e-12 and abs(p[2][0] - 2 / 3) < 1e-9


def test_degenerate_tables_do_not_stop_a_job(spark):
    """Constant series, one class, no hits, one day: nulls or zeros, no error."""
    flat = spark.createDataFrame([("a", day(k), 1.0, 0.0, False, 0.0) for k in range(5)], "key string, d date, x double, z double, hit boolean, turnover double")
    one = flat.limit(1)
    for df in (flat, one, flat.limit(0)):
        hidden = [
            st.hac_mean(df, "d", "x", 1), st.paired_t(df, "d", "x", "z"), st.effective_n(df, "d", "hit"), st.cohen_d(df, "key", "x", "a", "b"), st.auc_scores(df, "hit", "z", ["key"]),
            agg.kappa(df.withColumn("k2", F.col("key")), "key", "k2"), agg.enrichment(df, "key", "hit"), agg.market_flow(df.select("d", F.lit(0.0).alias("net"), F.lit(0.0).alias("gross"))),
            agg.stockday_panel(df.select(F.col("key").alias("inst"), "d", F.lit(1).alias("side"), F.lit(0.0).alias("value"), F.lit(1.0).alias("quantity"), F.lit(1).alias("entity"))),
            agg.gate_coverage(df, "z", "z", ["x"]), pr.ljung_box(df, "key", "d", "x", 2), pr.fe_slope(df, "x", "z", "key", "d", 1),
            agg.variance_split(df, "key", "x"), agg.funnel(df, "z", [("all", "true")]), st.quantiles(df, "z", [0.1, 0.9]), st.quantiles(df, "z", [0.5], ["key"]), cal.coverage(df, "hit", 0.05, "d"),
            agg.latency_curve(df.select(F.col("d").alias("e"), F.col("d").alias("r"), F.lit(0.0).alias("value")), df.select("d", F.lit(1).alias("pos")), "e", "r", 2), cal.pit_uniformity(df, "d", "z", 4, 3, 2, 1),
            df.select(cl.confirm(F.lit(0.0), F.lit(1.0))), cal.pit_independence(df, "key", "d", "z", 2, 1), cal.student_scores(df.withColumn("nu", F.lit(4.0)), "x", "z", "nu"), st.weighted_quantile(df, "key", "x", "z", 0.5),
            pf.metrics(df, "d", "z", 52.0), pf.cost_grid(df.withColumn("gross", F.lit(0.0)), [1.0], 52.0),
        ]
        for h in hidden:
            h.collect()
    assert st.effective_n(flat, "d", "hit").first().icc == 0.0


def test_past_quintile_and_cumulated_counts(spark):
    rows = [("a", day(k), v) for k, v in enumerate((3.0, 1.0, 2.0, 9.0, 9.0))]
    got = win.own_past_quintile(spark.createDataFrame(rows, "k string, t date, v double"), "k", "t", "v").orderBy("t").collect()
    assert [r.quintile for r in got] == [1, 1, 2, 4, 4]
    c = spark.createDataFrame([(g, v, (v * 7) % 5 + 1) for g in "ab" for v in range(300)], "g string, v int, n int")
    want = {(g, v): sum((x * 7) % 5 + 1 for x in range(v)) for g in "ab" for v in range(300)}
    assert {(r.g, r.v): r.below for r in st.cumulated(c, ["g"], "v", "n").collect()} == want


def test_embargo(spark):
    """An outcome counts in a vintage just if it ended by then."""
    obs = spark.createDataFrame([(k, "c", 0.1 * k, 1.0) for k in range(1, 11)], "pos int, cls string, z double, w double")
    vint = spark.createDataFrame([("v1", 5), ("v2", 9), ("v0", 1)], "vintage string, asof_pos int")
    got = {r.vintage: r.mass for r in rg.past_densities(obs, vint, 3, -4.0, 0.5, 16).collect()}
    assert got == {"v1": 2.0, "v2": 6.0}


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "1,234.5", " 03-Jan-2021"), (2, "x", "bad")], "id int, amount string, day string")
    tb.write_with_lineage(df, str(tmp_path / "t"), "t", ["src"], str(tmp_path / "lineage"), {"k": "v"})
    line = spark.read.parquet(str(tmp_path / "lineage")).first()
    assert (line["name"], line["rows"], line["extras"]) == ("t", 2, {"k": "v"})
    tb.write_csv(df.withColumnRenamed("amount", " amount "), str(tmp_path / "c"))
    back = tb.read_dirty_csv(spark, str(tmp_path / "c"), {"amount": "number", "day": "dd-MMM-yyyy"}).collect()
    assert sorted(back, key=str) == sorted([(1234.5, date(2021, 1, 3)), (None, None)], key=str)
    dens = spark.createDataFrame([(1, "w", "x", [0.1, 1.0])], "h int, weighting string, window string, cdf array<double>")
    tb.write_densities(dens, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).where("h = 1").first().cdf == [0.1, 1.0]


def test_series_drops_bad_cells(spark):
    df = spark.createDataFrame([("2020-01-01", "1.5"), ("2020-01-02", "."), ("x", "2")], "DATE string, X string")
    assert [tuple(r) for r in tb.series(df, "DATE", "X").collect()] == [(date(2020, 1, 1), 1.5)]


def test_overlaps_see_open_ends_and_far_neighbours(spark):
    rows = [("k", "a", day(1), day(100)), ("k", "b", day(5), day(6)), ("k", "c", day(50), day(60)), ("k", "d", day(200), None), ("k", "e", day(300), day(301)), ("j", "f", day(1), day(2)), ("j", "g", day(2), day(3)), ("k", "n", None, day(3))]
    df = spark.createDataFrame(rows, "k string, n string, a date, b date")
    got = {r.n: r.prev_end for r in idn.overlaps(df, "k", "a", "b", "n").collect()}
    assert got == {"b": day(100), "c": day(100), "e": None}


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(5)
    rows = [("ab"[int(i % 3 == 0)], float(x)) for i, x in enumerate(rng.integers(0, 50, 400))] + [(None, 1.5), (None, 2.5), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    qs = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    for by in ([], ["g"]):
        want = {r.g if by else 0: r.q for r in df.groupBy(*by).agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
        got = {r.g if by else 0: r.q for r in st.quantiles(df, "v", qs, by).collect()}
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert st.quantiles(df.limit(0), "v", qs).collect()[0].q == [None] * len(qs)


def test_uniform_transforms_pass_and_piled_up_ones_do_not(spark):
    rng = np.random.default_rng(6)
    def table(f):
        return spark.createDataFrame([("k", day(d), float(f(rng.uniform()))) for d in range(60) for _ in range(20)], "k string, d date, u double")
    even, odd = (cal.pit_uniformity(table(f), "d", "u", 10, 200, 4, 3).first() for f in (lambda u: u, lambda u: u * u))
    assert not even.reject and odd.reject and even.n == 1200 and odd.p < 1e-9 < even.p
    r = cal.uniform_distance(table(lambda u: u), "k", "u").first()
    s = cal.uniform_distance(table(lambda u: u * u), "k", "u").first()
    assert r.p > 0.01 and s.p < 1e-9 and abs(s.d - 0.25) < 0.05


def test_clustered_hits_are_worth_less(spark):
    rows = [(day(d), d % 10 == 0) for d in range(100) for _ in range(30)]
    r = cal.coverage(spark.createDataFrame(rows, "d date, hit boolean"), "hit", 0.05, "d").first()
    assert r.rate == 0.1 and abs(r.effective_n - 100) < 1 and r.p < 1e-9 and 0.02 < r.p_effective < 0.1


def test_student_scores_of_planted_quantiles(spark):
    rows = [(float(x), 2.0, 5.0) for x in np.random.default_rng(7).standard_t(5, 2000) * 2] + [(1.0, 0.0, 5.0), (None, 1.0, 5.0), (1.0, 1.0, None)]
    got = cal.student_scores(spark.createDataFrame(rows, "y double, s double, nu double"), "y", "s", "nu")
    wide = cal.student_scores(spark.createDataFrame([(y, 4.0, n) for y, _, n in rows[:2000]], "y double, s double, nu double"), "y", "s", "nu").agg(F.avg("crps")).first()[0]
    r = got.agg(F.avg("crps").alias("c"), F.avg("pit").alias("p"), F.count("crps").alias("n")).first()
    assert r.n == 2000 and r.c < wide and abs(r.p - 0.5) < 0.03


def test_difference_within_the_tolerance_does_not_count(spark):
    full = spark.createDataFrame([(1, 0.15), (2, 1.0), (3, 2.0)], "k int, v double")
    part = spark.createDataFrame([(1, 0.15 + 1e-9), (2, 1.5), (3, 2.0)], "k int, v double")
    got = jn.frame_diff(full, part, ["k"], "v", 0.1).first()
    assert got.differing == 1 and got.worst == 0.5 and jn.frame_diff(full, part, ["k"], "v").first().differing == 2


def test_what_edges_come_from_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = [(f"i{k}", f"i{k + 1}", day(k), "1") for k in range(6)]
    e = spark.createDataFrame(rows, "old_id string, new_id string, ca_date date, tier string").withColumn("new_id", counted.asNondeterministic()("new_id"))
    assert idn.chain_intervals(e).count() == 6 + 21 and seen.value == 6
    assert idn.hindsight_gate(e, str(day(9))).first().hindsight == 0 and seen.value == 12
