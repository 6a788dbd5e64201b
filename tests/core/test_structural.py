import math
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from panelweave.operators import structural as sc
from panelweave.operators import supervised as sv

D0 = date(2020, 1, 1)


def day(k):
    return D0 + timedelta(k)


def test_informed_trading_recovers_planted_rates(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for key, (a, e, mu, eb, es) in {"x": (0.4, 0.3, 30.0, 20.0, 25.0), "y": (0.2, 0.7, 15.0, 8.0, 6.0)}.items():
        want[key] = (a, e, mu, eb, es)
        for _ in range(1500):
            news = rng.random() < a
            bad = rng.random() < e
            rows.append((key, 2020, int(rng.poisson(eb + (mu if news and not bad else 0))), int(rng.poisson(es + (mu if news and bad else 0)))))
    rows += [("few", 2020, 3, 4)] * 10 + [("x", 2020, None, 4)]
    df = spark.createDataFrame(rows, "k string, y int, b int, s int")
    got = {r.k: r for r in sc.informed_trading(df, ["k", "y"], "b", "s", [(0.5, 0.5, 1.0), (0.1, 0.9, 3.0)], 25).collect()}
    assert set(got) == {"x", "y"}
    for k, r in got.items():
        assert r.worst_step >= -1e-6 and r.days == 1500
        assert abs(r.alpha - want[k][0]) < 0.04 and abs(r.delta - want[k][1]) < 0.06
        assert all(abs(a - b) < 0.06 * b + 0.2 for a, b in zip((r.mu, r.eb, r.es), want[k][2:], strict=True))
        a, _, mu, eb, es = want[k]
        assert abs(r.pin - a * mu / (a * mu + eb + es)) < 0.03


def test_natural_threshold_of_two_parts_and_fallback_of_one(spark):
    rng = np.random.default_rng(2)

    def two(n):
        return [(float(x),) for x in np.where(rng.random(n) < 0.3, rng.normal(-2, 0.4, n), rng.normal(1, 0.6, n))]

    train, test = spark.createDataFrame(two(4000), "x double"), spark.createDataFrame(two(4000), "x double")
    r = sc.natural_threshold(train, test, "x", "low", 0.25).first()
    assert r.components == 2 and r.method == "mixture" and -1.2 < r.threshold < -0.6 and r.shift < 0.1 and abs(r.three_means - r.threshold) < 1.5
    one = spark.createDataFrame([(float(x),) for x in rng.normal(0, 1, 4000)], "x double")
    r = sc.natural_threshold(one, one, "x", "high", 0.25).first()
    assert r.method == "quantile" and r.components == 1 and abs(r.threshold - 0.674) < 0.08
    moved = test.withColumn("x", F.col("x") + 2)
    r = sc.natural_threshold(train, moved, "x", "low", 0.25).first()
    assert r.method == "quantile" and r.shift > 1.5
    assert sc.natural_threshold(train.limit(0), train.limit(0), "x", "low", 0.25).first().threshold is None


def test_variance_grid_equals_a_loop(spark):
    rng = np.random.default_rng(3)
    r = rng.standard_t(5, 260) * 0.01
    df = spark.createDataFrame([("k", day(i), float(x)) for i, x in enumerate(r)] + [("k", day(900), None), ("short", day(1), 0.1)], "k string, d date, r double")
    got = sc.asymmetric_variance(df, "k", "d", "r", 120, 50, 30).orderBy("d").collect()
    assert len(got) == 260 - 119 and got[0].d == day(119)

    def walk(a, g, b, n):
        h0, uv = np.var(r[:30]), np.var(r[:120])
        h, nll = h0, 0.0
        for i in range(n):
            if i >= 30:
                nll += 0.5 * (math.log(h) + r[i] ** 2 / h)
            h = uv * (1 - a - 0.5 * g - b) + (a + g * (r[i] < 0)) * r[i] ** 2 + b * h
        return nll, math.sqrt(h)

    for x in got[::20]:
        n = (x.d - D0).days + 1
        at = 120 + (n - 120) // 50 * 50
        best = min(sc.GJR, key=lambda p: round(walk(*p, at)[0], 9))
        assert (x.alpha, x.gamma, x.beta) == best and abs(x.sigma - walk(*best, n)[1]) < 1e-12
    later = sc.asymmetric_variance(df.withColumn("r", F.when(F.col("d") > day(200), 5.0).otherwise(F.col("r"))), "k", "d", "r", 120, 50, 30).where(F.col("d") <= day(200)).orderBy("d").collect()
    assert [x.sigma for x in later] == [x.sigma for x in got[: len(later)]]


def test_planted_tilt_comes_back_and_the_embargo_holds(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, 3000)
    z = 1.1 * np.exp(0.4 * x) * rng.standard_t(8, 3000)
    rows = [(i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(z, x, strict=True))]
    df = spark.createDataFrame(rows, "pos int, z double, x double")
    vint = spark.createDataFrame([("v1", 400), ("v2", 1500), ("v3", 3000)], "vintage string, asof_pos int")
    grid = ([0.9, 1.0, 1.1, 1.2], [4.0, 8.0, 30.0], [-0.4, 0.0, 0.2, 0.4, 0.6])
    got = {r.vintage: r for r in sc.tilted_scale(df, vint, 5, *grid).collect()}
    assert set(got) == {"v2", "v3"} and got["v2"].n == 1495 and got["v3"].n == 2995
    assert all((r.scale, r.theta) == (1.1, 0.4) and r.nu == 8.0 for r in got.values())
    wild = df.withColumn("z", F.when(F.col("pos") > 1495, 1e6).otherwise(F.col("z")))
    assert {r.vintage: r for r in sc.tilted_scale(wild, vint, 5, *grid).collect()}["v2"] == got["v2"]


def test_share_correction_equals_least_squares(spark):
    rng = np.random.default_rng(5)
    rows = [(p, day(p), float(rng.normal(0, 1 + 0.3 * abs(s))), float(s), float(v)) for p in range(1, 200) for s, v in rng.normal(0, 1, (6, 2))]
    df = spark.createDataFrame(rows, "pos int, day date, z double, share double, volume double")
    vint = spark.createDataFrame([("a", 50), ("b", 199), ("few", 3)], "vintage string, asof_pos int")
    got = {r.vintage: r for r in sc.share_correction(df, vint, 2, 4.0, 100).collect()}
    by = {}
    for p, _, z, s, v in rows:
        by.setdefault(p, []).append((z, s, v))
    for name, asof in (("a", 50), ("b", 199)):
        m, y = [], []
        for p, cells in by.items():
            if p + 2 <= asof:
                c = np.array(cells)
                m += [[1, s, v] for s, v in c[:, 1:] - c[:, 1:].mean(0)]
                y += (np.clip(c[:, 0], -4, 4) ** 2).tolist()
        b = np.linalg.lstsq(np.array(m), np.array(y), rcond=None)[0]
        assert got[name].n == len(y) and np.allclose([got[name].b_share, got[name].b_volume], b[1:] / b[0], atol=1e-8)
    assert (got["few"].b_share, got["few"].n) == (0.0, 6)


def test_runs_ages_and_censoring(spark):
    states = [("k", 0, "s"), ("k", 1, "s"), ("k", 2, "b"), ("k", 3, "s"), ("k", 40, "s"), ("k", 41, "s")]
    df = spark.createDataFrame([(k, day(t), s) for k, t, s in states], "k string, d date, s string")
    got = [(r.age, r.left, r.censored, r.y2) for r in sv.run_rows(df, "k", "d", "s", "s", 21).withColumn("y2", sv.ends_within(2)).orderBy("d").collect()]
    assert got == [(1, 1, False, 1), (2, 0, False, 1), (1, 0, False, 1), (1, 1, True, None), (2, 0, True, None)]


def hazard_rows(spark, n=900):
    rng = np.random.default_rng(6)
    rows, t = [], 0
    for run in range(n):
        x = float(rng.normal())
        age = 0
        while True:
            age += 1
            end = rng.random() < (0.6 if x > 0 else 0.15)
            rows.append((run % 20, run, day(t), age, x, end))
            t += 1 if len(rows) % 3 == 0 else 0
            if end or age > 12:
                break
    df = spark.createDataFrame(rows, "k int, run int, d date, age int, x double, end boolean")
    from pyspark.sql import Window

    whole = Window.partitionBy("run")
    return df.withColumn("left", F.count("*").over(whole) - F.col("age")).withColumn("run_end", F.max("d").over(whole)).withColumn("censored", F.lit(False))


def test_walk_forward_sees_no_embargoed_row_and_beats_the_baselines(spark):
    rows = hazard_rows(spark)
    years = [2021, 2022]
    p, folds = sv.walk_forward_hazard(rows, "d", ["x", "age"], 1, years, embargo_days=10, least=100, trees=5, depth=2, thin=20)
    for f in folds.collect():
        assert (date(f.year, 1, 1) - f.last_train).days > 10 and f.first_test.year == f.year
    y = F.col("y").cast("double")
    loss = p.agg(*[F.avg(-(y * F.log(c) + (1 - y) * F.log(1 - F.col(c)))).alias(c) for c in ("p_model", "p_age", "p_share")]).first()
    assert loss.p_model < loss.p_age - 0.02 and loss.p_model < loss.p_share - 0.02
    none, empty = sv.walk_forward_hazard(rows, "d", ["x"], 1, [2021], least=10**9)
    assert none.count() == 0 and empty.count() == 0 and {"p_model", "p_age", "p_share"} <= set(none.columns)


def test_decisions_use_earlier_years_alone(spark):
    gains = [("k", r, th, day(365 * y), day(365 * y + 5), g) for y in range(4) for r, th, g in ((10 * y, 0.2, (1.0, 1.0, -9.0, 5.0)[y]), (10 * y, 0.4, (0.0, 0.5, 3.0, 7.0)[y]))]
    df = spark.createDataFrame(gains, "k string, run int, theta double, at date, run_end date, gain double")
    c = {r.year: (r.theta, r.prior_runs) for r in sv.chosen_thresholds(df, 1).collect()}
    assert c[2021] == (0.2, 1) and c[2022] == (0.2, 2) and 2020 not in c
    got = {r.year: (r.theta, r.gain) for r in sv.decisions(df, 1).collect()}
    assert all(got[y][0] == c[y][0] for y in got)
    price = spark.createDataFrame([("k", day(i), 0.01 * i) for i in range(6)], "k string, d date, cum double")
    f = spark.createDataFrame([("k", 1, day(3), day(t), p) for t, p in ((1, 0.1), (2, 0.3), (3, 0.9))] + [("k", 2, day(5), day(5), 0.9)], "k string, run int, run_end date, d date, p double")
    g = {(r.run, r.theta): (r.at, round(r.gain, 9)) for r in sv.episode_gains(f, price, "k", "d", "p", [0.2, 0.5]).collect()}
    assert g == {(1, 0.2): (day(2), 0.02), (1, 0.5): (day(3), 0.01), (2, 0.2): (day(5), 0.0), (2, 0.5): (day(5), 0.0)}


def test_trees_find_the_planted_signal(spark):
    rng = np.random.default_rng(7)
    rows = [(day(d), k, float(a), float(b), float(c), float(2 * b + 0.5 * rng.normal())) for d in range(40) for k, (a, b, c) in enumerate(rng.normal(0, 1, (25, 3)))]
    df = spark.createDataFrame(rows, "d date, k int, a double, b double, c double, y double")
    train, test = df.where(F.col("d") < day(25)), df.where(F.col("d") >= day(25))
    scored, models = sv.boosted_ladder(train, test, "y", {"one": ["a"], "two": ["b"]}, trees=6, depth=3)
    d = sv.ic_difference(scored, "d", "pred_two", "pred_one", "y", 10).first()
    assert d.days == 15 and d.difference > 0.5 and d.t > 5
    model, have = models["two"]
    got = {r.feature: r.drop for r in sv.attribution(model.transform(sv.assembled(test, have)), model, have, "pred_two", "d", "k", "y", 10).collect()}
    assert max(got, key=got.get) == "b" and got["b"] > 0.5 > abs(got["a"]) * 5
    p = sv.permuted(test, "d", "k", "b", 3).orderBy("d", "k").collect()
    t = test.orderBy("d", "k").collect()
    assert [sorted(r.b for r in p if r.d == day(30)), [r.a for r in p]] == [sorted(r.b for r in t if r.d == day(30)), [r.a for r in t]] and [r.b for r in p] != [r.b for r in t]


def test_hac_slope_equals_its_formula(spark):
    from panelweave.operators import stats as st

    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, 200)
    y = 0.5 + 0.3 * x + np.convolve(rng.normal(0, 1, 202), [1, 0.5, 0.2], "valid")
    df = spark.createDataFrame([(day(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(day(900), None, 1.0)], "d date, x double, y double")
    r = st.hac_slope(df, "d", "y", "x", 3).first()
    u = x - x.mean()
    b = (u @ y) / (u @ u)
    s = u * (y - y.mean() - b * u)
    var = s @ s + 2 * sum((1 - k / 4) * (s[k:] @ s[:-k]) for k in (1, 2, 3))
    assert np.allclose([r.slope, r.const, r.se, r.t], [b, y.mean() - b * x.mean(), math.sqrt(var) / (u @ u), b / (math.sqrt(var) / (u @ u))]) and r.n == 200
    assert st.hac_slope(df.limit(0), "d", "y", "x", 2).first().slope is None


def test_issuers_merge_what_follows_and_keep_what_stands_side_by_side(spark):
    from panelweave.operators import identity as idn

    rows = [("AA1", t) for t in range(5)] + [("AA2", t) for t in range(4, 9)] + [("BB1", t) for t in range(9)] + [("BB2", t) for t in range(9)] + [("CC1", 0), (None, 1)]
    df = spark.createDataFrame([(k, day(t)) for k, t in rows], "k string, d date")
    got = {r.key: (r.canonical, r.overlap_days) for r in idn.issuer_groups(df, "k", "d", F.substring("k", 1, 2), 2).collect()}
    assert got == {"AA1": ("AA2", 1), "AA2": ("AA2", 1), "BB1": ("BB1", 9), "BB2": ("BB2", 9), "CC1": ("CC1", 0)}


def test_detection_lags_and_bounce_free_returns(spark):
    from panelweave.operators import windows as win

    labels = [(0, 1), (0, 0), (0, 0), (1, 0), (1, 0), (0, 0), (1, 1)]
    df = spark.createDataFrame([("k", day(i), s, c, float(i * i)) for i, (s, c) in enumerate(labels)], "k string, d date, s int, c int, cum double")
    got = {r.label: (r.runs, r.found, r.lag) for r in win.detection_lag(df, "k", "d", "c", "s").collect()}
    assert got == {0: (2, 2, 0.5), 1: (2, 1, 0.0)}
    car, cut = win.bounce_free_car("cum", "k", "d", 1, 3)
    assert [(r.car, r.cut) for r in df.select("d", car.alias("car"), cut.alias("cut")).orderBy("d").collect()] == [(8.0, False), (12.0, False), (16.0, False), (20.0, False), (11.0, True), (0.0, True), (0.0, True)]


def test_recalibration_table_and_frontier(spark):
    from panelweave.operators import predictive, regimes

    rows = [(p, 0.05 if p % 2 else -0.05, 1.0 if p % 2 else 0.5) for p in range(1, 101)] + [(5, None, 1.0), (6, 0.1, None)]
    vint = spark.createDataFrame([("a", 0), ("b", 101)], "vintage string, asof_pos int")
    got = {(r.vintage, r.bin): (r.n, r.ratio) for r in predictive.recalibration_table(spark.createDataFrame(rows, "pos int, dev double, z double"), vint, 1, 4.0, -0.1, 0.1, 2, 10.0).collect()}
    m = (50 * 1.0 + 50 * 0.25) / 100
    assert got["a", 0] == (0, 1.0) and got["b", 1] == (50, (50 + 10 * m) / (60 * m)) and got["b", 0] == (50, (12.5 + 10 * m) / (60 * m))
    d = spark.createDataFrame([("v1", "x", 99.0), ("v2", "x", 10.0), ("v3", "x", 80.0), ("v4", "x", 90.0), ("v4", "y", 1.0)], "vintage string, cls string, ess double")
    v = spark.createDataFrame([(f"v{i}", i) for i in range(1, 5)], "vintage string, asof_pos int")
    assert {r.cls: r.valid_from for r in regimes.frontier(d, v, 60.0).collect()} == {"x": "v3", "y": None}


def test_no_year_with_enough_rows_keeps_the_columns(spark):
    day0 = date(2020, 1, 1)
    rows = sv.run_rows(spark.createDataFrame([("i", day0 + timedelta(7 * i), float(i), "sell") for i in range(80)], "k string, d date, x double, state string"), "k", "d", "state", "sell", 21)
    some = sv.walk_forward_hazard(rows.withColumn("left", F.col("age") % 3), "d", ["x"], 1, [2021], least=10, trees=2, depth=2)[1]
    _, none = sv.walk_forward_hazard(rows, "d", ["x"], 1, [2021], least=10**9)
    assert none.dtypes == some.dtypes and none.count() == 0
