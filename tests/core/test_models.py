import itertools

import numpy as np
from pyspark.sql import functions as F

from panelweave.operators import hmm, resampling


def simulate(seed, keys=12, n=160, seen=0.6):
    rng = np.random.default_rng(seed)
    trans = np.array([[0.92, 0.08], [0.12, 0.88]])
    rows = []
    for k in range(keys):
        s = rng.integers(2)
        for t in range(n):
            s = rng.choice(2, p=trans[s])
            if rng.random() < seen:
                rows.append((k, t, float(rng.normal((-1.0, 1.5)[s], 0.5))))
    return rows, trans


def test_likelihood_rises_and_gappy_transitions_come_back(spark):
    rows, trans = simulate(1)
    par, history = hmm.fit(spark.createDataFrame(rows, "k int, step int, x double"), "k", "step", "x", states=2, rounds=8)
    assert all(b >= a - 1e-6 for a, b in zip(history, history[1:], strict=False))
    assert np.abs(par["means"] - [-1.0, 1.5]).max() < 0.1 and np.abs(par["trans"] - trans).max() < 0.05


def test_smoothing_equals_enumeration():
    rng = np.random.default_rng(2)
    means, sds, start = np.array([-1.0, 1.0]), np.array([0.7, 0.9]), np.array([0.4, 0.6])
    trans = np.array([[0.8, 0.2], [0.3, 0.7]])
    x, gaps = rng.normal(0, 1, 4), np.array([1, 3, 1, 2])
    steps = np.cumsum(gaps) - 1
    total, post, xi = 0.0, np.zeros((4, 2)), np.zeros((2, 2))
    n = steps[-1] + 1
    for code in range(2**n):
        path = [(code >> i) & 1 for i in range(n)]
        p = start[path[0]]
        for a, b in zip(path, path[1:], strict=False):
            p *= trans[a, b]
        for t, s in enumerate(steps):
            p *= np.exp(-((x[t] - means[path[s]]) / sds[path[s]]) ** 2 / 2) / sds[path[s]] / np.sqrt(2 * np.pi)
        total += p
        for t, s in enumerate(steps):
            post[t, path[s]] += p
        for a, b in zip(path, path[1:], strict=False):
            xi[a, b] += p
    f, g, got, logl = hmm.smooth(x, gaps, means, sds, trans, start)
    assert np.allclose(g, post / total) and np.allclose(got, xi / total) and abs(logl - np.log(total)) < 1e-9
    assert np.allclose(f.sum(1), 1)


def test_bootstrap_repeats_and_covers(spark):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(rng.normal(2, 1)), 1.0) for i in range(120)], "d int, s double, n double")
    a = sorted(r.estimate for r in resampling.block_bootstrap(df, "d", "s", "n", 300, 5, 1).collect())
    b = sorted(r.estimate for r in resampling.block_bootstrap(df.repartition(5), "d", "s", "n", 300, 5, 1).collect())
    assert np.allclose(a, b) and len(a) == 300
    mean = df.agg(F.avg("s")).first()[0]
    assert abs(np.mean(a) - mean) < 0.05 and 0.04 < np.std(a) < 0.2


def test_permutation_keeps_labels_and_breaks_runs(spark):
    rows = [(k, t, "s" if (t // 10) % 2 else "b") for k in range(4) for t in range(60)]
    got = {r.rep: r.runs for r in resampling.run_permutation(spark.createDataFrame(rows, "k int, t int, l string"), "k", "t", "l", "s", 20, 9).collect()}
    assert got[0] == 4 * 3 and min(v for k, v in got.items() if k) > 12


def test_best_path_equals_enumeration():
    rng = np.random.default_rng(4)
    trans, start = np.array([[0.7, 0.2, 0.1], [0.2, 0.6, 0.2], [0.1, 0.3, 0.6]]), np.array([0.5, 0.3, 0.2])
    for n, most in ((5, 250), (6, 3)):
        logb, gaps = rng.normal(0, 1, (n, 3)), np.array([1, 4, 1, 2, 9, 1][:n])
        best, want = -np.inf, None
        for path in itertools.product(range(3), repeat=n):
            p = np.log(start[path[0]]) + logb[0, path[0]]
            for t in range(1, n):
                a = np.linalg.matrix_power(trans, gaps[t]) if gaps[t] <= most else np.tile(hmm.stationary(trans), (3, 1))
                p += np.log(a[path[t - 1], path[t]]) + logb[t, path[t]]
            if p > best:
                best, want = p, path
        assert tuple(hmm.viterbi(logb, gaps, trans, start, most)) == want


def planted(seed, group, keys=10, n=150):
    rng = np.random.default_rng(seed)
    trans = np.array([[0.93, 0.05, 0.02], [0.05, 0.9, 0.05], [0.02, 0.05, 0.93]])
    rows = []
    for k in range(keys):
        s = rng.integers(3)
        for t in range(n):
            s = rng.choice(3, p=trans[s])
            if rng.random() < 0.8:
                rows.append((group, k, t, float(rng.normal((-1.5, 0.0, 1.5)[s], 0.4)), float(rng.normal((1.0, 0.0, -1.0)[s], 0.6))))
    return rows, trans


def test_restarts_gate_and_alignment_recover_planted_states(spark):
    rows = []
    for g in ("v1", "v2"):
        more, trans = planted(len(g) + ord(g[1]), g)
        rows += more
    df = spark.createDataFrame(rows, "v string, k int, t int, x double, y double")
    fits = hmm.fit_many(df, "v", "k", "t", ["x", "y"], hmm.spread_starts(df, "v", ["x", "y"], 3, 3, 0.3, 1), 15, 1e-6)
    assert all(f["monotone"] for f in fits.values()) and len(fits) == 6
    table = hmm.fits_table(spark, fits, "v", "string")
    best = {r.v: r for r in hmm.aligned(hmm.winners(table, "v"), "v", 3).collect()}
    top = {g: max(f["loglik"] for (v, _), f in fits.items() if v == g) for g in best}
    assert set(best) == {"v1", "v2"} and all(abs(best[g].loglik - top[g]) < 1e-9 for g in best)
    for r in best.values():
        assert np.abs(np.array(r.means)[:, 0] - [-1.5, 0, 1.5]).max() < 0.15 and np.abs(np.array(r.means)[:, 1] - [1, 0, -1]).max() < 0.2
        assert np.abs(np.array(r.trans) - trans).max() < 0.06
    assert best["v1"].match is None and best["v2"].match == [0, 1, 2] and best["v2"].match_cost < 0.5 < best["v2"].second_cost
    assert hmm.winners(table, "v", 0.99).count() == 0  # nothing that fails the gate is published


def test_match_follows_swapped_states(spark):
    df = spark.createDataFrame([([[0.0], [5.0], [9.0]], [[9.1], [0.2], [5.1]])], "a array<array<double>>, b array<array<double>>")
    c = df.select(hmm.match_cost(F.col("a"), F.col("b"), 3).alias("c")).first().c
    assert c[0]["order"] == [1, 2, 0] and abs(c[0]["cost"] - 0.4) < 1e-9 and len(c) == 6


def test_two_chains_come_back_and_one_chain_is_the_plain_model(spark):
    rng = np.random.default_rng(6)
    one, two, rows = np.array([[-2.0, 0.0], [2.0, 0.0]]), np.array([[0.0, -1.5], [0.0, 1.5]]), []
    ta, tb = np.array([[0.95, 0.05], [0.1, 0.9]]), np.array([[0.8, 0.2], [0.2, 0.8]])
    for k in range(8):
        a, b = rng.integers(2), rng.integers(2)
        for t in range(200):
            a, b = rng.choice(2, p=ta[a]), rng.choice(2, p=tb[b])
            m = one[a] + two[b] + rng.normal(0, 0.4, 2)
            rows.append((0, k, t, float(m[0]), float(m[1])))
    df = spark.createDataFrame(rows, "g int, k int, t int, x double, y double")
    keep = np.array([[0.9, 0.1], [0.1, 0.9]])
    start = {"means": (0.5 * one[:, None] + 0.5 * two[None]).reshape(4, 2), "variances": np.ones((4, 2)), "trans": np.kron(keep, keep), "start": np.full(4, 0.25), "chains": (2, 2)}
    p = hmm.fit_many(df, "g", "k", "t", ["x", "y"], {(0, 0): start}, 15, 1e-8, improve=hmm.update_two_chains)[0, 0]
    assert p["monotone"] and np.abs(p["trans_one"] - ta).max() < 0.04 and np.abs(p["trans_two"] - tb).max() < 0.06
    assert np.abs((p["one"][1] - p["one"][0]) - [4, 0]).max() < 0.1 and np.abs((p["two"][1] - p["two"][0]) - [0, 3]).max() < 0.1
    stats = np.concatenate([[-5.0], [0.4, 0.6], [30.0, 50.0], [-60.0, 20.0], [150.0, 40.0], [20.0, 9.0, 8.0, 40.0]])
    base = {"means": np.array([[-1.0], [1.0]]), "variances": np.ones((2, 1)), "trans": keep, "start": np.array([0.5, 0.5]), "chains": (2, 1)}
    a, b = hmm.update(stats, base)[1], hmm.update_two_chains(stats, base)[1]
    assert np.allclose(a["means"], b["means"]) and np.allclose(a["trans"], b["trans"]) and np.allclose(a["start"], b["start"])
    assert np.allclose(b["variances"][0], (a["variances"][:, 0] * [30, 50]).sum() / 80)  # one spread for all states


def test_eras_do_not_mix(spark):
    df = spark.createDataFrame([("k", 1, "A", 0), ("k", 2, "A", 0), ("k", 3, "B", 1), ("k", 4, "B", 0), ("j", 5, "B", 1)], "k string, t int, era string, s int")
    got = {(r.era, r.s, r.next): (r.n, r.share) for r in hmm.era_replication(df, "k", "t", "era", "s").collect()}
    assert got == {("A", 0, None): (2, 1.0), ("A", 0, 0): (1, 1.0), ("B", 0, None): (1, 1 / 3), ("B", 1, None): (2, 2 / 3), ("B", 1, 0): (1, 1.0)}


def test_one_round_keeps_a_small_variance():
    par = {"means": np.zeros((1, 1)), "variances": np.ones((1, 1)), "trans": np.ones((1, 1)), "start": np.ones(1)}
    x = np.array([0.14, 0.15, 0.16])
    stats = np.concatenate([[0.0], [1.0], [3.0], [x.sum()], [(x**2).sum()], [2.0]])
    assert np.allclose(hmm.update(stats, par, 1e-12)[1]["variances"], x.var()) and hmm.update(stats, par)[1]["variances"] == hmm.FLOOR
