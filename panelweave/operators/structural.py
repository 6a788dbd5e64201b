"""Structural estimates: informed trading, natural thresholds, asymmetric variance, tilted densities, volatility corrections."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.regimes import admits
from panelweave.operators.saved import carried, saved
from panelweave.operators.stats import quantiles

TINY = 1e-9


def informed_trading(
    df: DataFrame, by: list[str], buys: str, sells: str, starts: list[tuple[float, float, float]], rounds: int, least: int = 60,
) -> DataFrame:
    """(*by, days, loglik, worst_step, alpha, delta, mu, eb, es, pin): the probability of informed trading per group.

    Days are quiet, or with probability alpha have news that is bad with probability delta;
    news adds mu to the Poisson rate of sells (bad) or buys (good), whose own rates are es and
    eb.  Expectation-maximisation: a day's weights are columns, and as a count in a day with
    news is the sum of a count without and one of news, rates are sums of weighted counts
    over sums of weights.  starts: (alpha, delta, mu as a multiple of the mean imbalance), each
    a row beside the group; the best log-likelihood (without the counts' factorials) is kept,
    of equal ones the first.  worst_step is the least rise of it between rounds.  Days of one
    group with the same counts are one row with a weight, so work does not grow with them.
    Groups of fewer than `least` days are left out.
    """
    b, s, n = F.col("b"), F.col("s"), F.col("n")
    d = df.where(F.col(buys).isNotNull() & F.col(sells).isNotNull()).groupBy(*by, F.col(buys).cast("double").alias("b"), F.col(sells).cast("double").alias("s")).agg(F.count("*").cast("double").alias("n"))
    d = saved(d)
    g = d.groupBy(*by).agg(F.sum("n").alias("days"), (F.sum(n * F.abs(b - s)) / F.sum("n")).alias("gap"), (F.sum(n * b) / F.sum("n")).alias("mb"), (F.sum(n * s) / F.sum("n")).alias("ms")).where(F.col("days") >= least)
    cells = F.array(*[F.struct(F.lit(i).alias("restart"), F.lit(float(a)).alias("alpha"), F.lit(float(e)).alias("delta"), F.lit(float(m)).alias("times")) for i, (a, e, m) in enumerate(starts)])
    p = g.select(*by, "days", F.explode(cells).alias("c"), "gap", "mb", "ms")
    p = p.select(*by, "days", "c.restart", "c.alpha", "c.delta", (F.greatest("gap", F.lit(1.0)) * F.col("c.times")).alias("mu"), F.greatest(F.col("mb") * 0.75, F.lit(0.5)).alias("eb"), F.greatest(F.col("ms") * 0.75, F.lit(0.5)).alias("es"), F.lit(None).cast("double").alias("loglik"), F.lit(None).cast("double").alias("worst_step"))
    names = [*by, "restart"]
    for r in range(rounds + 1):
        j = d.join(p, by)
        a, e, mu, eb, es = (F.col(c) for c in ("alpha", "delta", "mu", "eb", "es"))
        quiet = -eb + b * F.log(eb) - es + s * F.log(es)
        bad = F.log(a * e) - eb + b * F.log(eb) - (es + mu) + s * F.log(es + mu)
        good = F.log(a * (1 - e)) - (eb + mu) + b * F.log(eb + mu) - es + s * F.log(es)
        j = j.withColumns({"l0": F.log(1 - a) + quiet, "l1": bad, "l2": good}).withColumn("top", F.greatest("l0", "l1", "l2"))
        j = j.withColumn("all", F.exp(F.col("l0") - F.col("top")) + F.exp(F.col("l1") - F.col("top")) + F.exp(F.col("l2") - F.col("top")))
        j = j.withColumns({"w1": n * F.exp(F.col("l1") - F.col("top")) / F.col("all"), "w2": n * F.exp(F.col("l2") - F.col("top")) / F.col("all")})
        more_b, more_s = F.col("w2") * b * mu / (eb + mu), F.col("w1") * s * mu / (es + mu)
        m = j.groupBy(*names).agg(
            F.first("days").alias("days"), F.first("alpha").alias("alpha0"), F.first("delta").alias("delta0"), F.first("mu").alias("mu0"), F.first("eb").alias("eb0"), F.first("es").alias("es0"),
            F.sum(n * (F.col("top") + F.log("all"))).alias("ll"), F.first("loglik").alias("before"), F.first("worst_step").alias("worst"),
            F.sum("w1").alias("r1"), F.sum("w2").alias("r2"), F.sum(n * b - more_b).alias("tb"), F.sum(n * s - more_s).alias("ts"), F.sum(more_b + more_s).alias("tm"),
        )
        worst = F.least("worst", F.col("ll") - F.col("before"))
        if r == rounds:
            p = m.select(*names, "days", F.col("ll").alias("loglik"), worst.alias("worst_step"), *[F.col(f"{c}0").alias(c) for c in ("alpha", "delta", "mu", "eb", "es")])
            break
        news = F.col("r1") + F.col("r2")

        def inside(x: Column) -> Column:
            return F.least(F.greatest(x, F.lit(TINY)), F.lit(1 - TINY))

        p = saved(m.select(*by, "days", "restart", inside(news / F.col("days")).alias("alpha"), inside(F.col("r1") / F.greatest(news, F.lit(TINY))).alias("delta"), F.greatest(F.col("tm") / F.greatest(news, F.lit(TINY)), F.lit(TINY)).alias("mu"), F.greatest(F.col("tb") / F.col("days"), F.lit(TINY)).alias("eb"), F.greatest(F.col("ts") / F.col("days"), F.lit(TINY)).alias("es"), F.col("ll").alias("loglik"), worst.alias("worst_step")))
    cols = ["days", "loglik", "worst_step", "alpha", "delta", "mu", "eb", "es"]
    best = p.groupBy(*by).agg(F.max_by(F.struct(*cols), F.struct(F.round("loglik", 6), -F.col("restart"))).alias("b")).select(*by, "b.*")
    return best.withColumn("pin", F.col("alpha") * F.col("mu") / (F.col("alpha") * F.col("mu") + F.col("eb") + F.col("es")))


def _histogram(df: DataFrame, col: str, cells: int, width: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Cell means and counts of a column, standardised cells of which there are at most `cells`; and the number of rows."""
    x = df.where(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    m = x.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    at = F.greatest(F.lit(-cells // 2), F.least(F.floor((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0)) / width), F.lit(cells // 2 - 1)))
    got = x.join(m).groupBy(at.alias("c")).agg(F.avg("x").alias("x"), F.count("*").alias("n")).orderBy("x").collect()  # one row on the right; at most `cells` rows out
    return np.array([r["x"] for r in got]), np.array([r["n"] for r in got], float), float(sum(r["n"] for r in got))


def normal_mixture(x: np.ndarray, n: np.ndarray, k: int, seed: int, starts: int = 3, rounds: int = 300) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, weights, means, sds) of `k` normals fitted to values `x` with counts `n`, the best of some starts."""
    rng = np.random.default_rng(seed)
    mean = (n @ x) / n.sum()
    sd = math.sqrt(max((n @ (x - mean) ** 2) / n.sum(), 1e-12))
    best = None
    for j in range(starts):
        q = (np.arange(k) + 0.5) / k if j == 0 else np.sort(rng.random(k))
        mu = x[np.searchsorted(np.cumsum(n) / n.sum(), q).clip(max=len(x) - 1)].astype(float)
        s, w = np.full(k, sd if k == 1 else sd / 2), np.full(k, 1 / k)
        last = -np.inf
        for _ in range(rounds):
            logp = np.log(w) - np.log(s) - 0.5 * math.log(2 * math.pi) - 0.5 * ((x[:, None] - mu) / s) ** 2
            top = logp.max(1, keepdims=True)
            each = np.exp(logp - top)
            total = each.sum(1, keepdims=True)
            ll = float(n @ (top + np.log(total))[:, 0])
            r = each / total * n[:, None]
            t = np.maximum(r.sum(0), 1e-12)
            w, mu = t / n.sum(), (r * x[:, None]).sum(0) / t
            s = np.sqrt(np.maximum((r * (x[:, None] - mu) ** 2).sum(0) / t, 1e-6 * sd * sd))
            if ll - last < 1e-9 * abs(ll):
                break
            last = ll
        if best is None or ll > best[0]:
            best = (ll, w, mu, s)
    return best


def mixture_boundary(x: np.ndarray, n: np.ndarray, tail: str, seed: int) -> tuple[int, float | None]:
    """(components that BIC prefers, where the `tail` (low or high) component, seen from its mean, stops being the likelier one; None if nowhere or one component)."""
    if len(x) < 3:
        return 1, None
    fits = {k: normal_mixture(x, n, k, seed) for k in (1, 2, 3)}
    k = min(fits, key=lambda k: -2 * fits[k][0] + (3 * k - 1) * math.log(n.sum()))
    if k == 1:
        return 1, None
    _, w, mu, s = fits[k]
    comp = int(mu.argmin() if tail == "low" else mu.argmax())
    spread = math.sqrt((n @ (x - (n @ x) / n.sum()) ** 2) / n.sum())
    grid = np.linspace((n @ x) / n.sum() - 4 * spread, (n @ x) / n.sum() + 4 * spread, 2001)
    p = w / s * np.exp(-0.5 * ((grid[:, None] - mu) / s) ** 2)
    wins = p[:, comp] >= 0.5 * p.sum(1)
    at = int(np.clip(np.searchsorted(grid, mu[comp]), 0, len(grid) - 1))
    if not wins[at]:
        return k, None
    lost = np.flatnonzero(~wins[at:]) if tail == "low" else np.flatnonzero(~wins[: at + 1])  # a wide component wins again far out on the other side
    if not len(lost):
        return k, None
    return k, float(grid[at + lost[0] - 1] if tail == "low" else grid[lost[-1] + 1])


def three_means(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The centres of three groups of the values, from their 1/6, 3/6 and 5/6 quantiles on."""
    c = x[np.searchsorted(np.cumsum(n) / n.sum(), [1 / 6, 0.5, 5 / 6]).clip(max=len(x) - 1)].astype(float)
    for _ in range(200):
        own = np.abs(x[:, None] - c).argmin(1)
        new = np.array([(n[own == i] @ x[own == i]) / n[own == i].sum() if (own == i).any() else c[i] for i in range(3)])
        if np.allclose(new, c):
            break
        c = new
    return np.sort(c)


def natural_threshold(train: DataFrame, test: DataFrame, col: str, tail: str, fallback: float, most_shift: float = 0.25, seed: int = 42, cells: int = 3200, width: float = 0.005) -> DataFrame:
    """One row: the threshold that cuts off a tail of `col`, how it was found, and what speaks for it.

    A mixture of one to three normals is chosen by BIC on the training values; the threshold
    is where the tail component becomes the likelier one.  With one component, a component
    that never is the likelier one, or a boundary that moves by `most_shift` or more when it is
    found again on the test values, the `fallback` quantile (from that tail) is taken.
    three_means is the boundary that the tail's neighbouring group means give.  Values enter
    as counts in cells of `width` standard deviations, so what reaches the driver is bounded.
    """
    x, n, rows = _histogram(train, col, cells, width)
    y, m, _ = _histogram(test, col, cells, width)
    k, found = mixture_boundary(x, n, tail, seed)
    again = mixture_boundary(y, m, tail, seed)[1] if found is not None else None
    shift = abs(found - again) if found is not None and again is not None else None
    keep = found is not None and shift is not None and shift < most_shift
    q = quantiles(train, col, [fallback if tail == "low" else 1 - fallback]).first()["q"][0]
    c = three_means(x, n) if len(x) else None
    cut = None if c is None else float((c[0] + c[1]) / 2 if tail == "low" else (c[1] + c[2]) / 2)
    row = (col, tail, int(rows), k, found, again, shift, "mixture" if keep else "quantile", found if keep else q, cut)
    return train.sparkSession.createDataFrame([row], "feature string, tail string, rows long, components int, boundary double, test_boundary double, shift double, method string, threshold double, three_means double")


GJR = [(a, g, b) for a in (0.0, 0.02, 0.05, 0.1) for g in (0.0, 0.05, 0.1, 0.2) for b in (0.7, 0.8, 0.85, 0.9, 0.94) if a + 0.5 * g + b < 0.9999]


def asymmetric_variance(df: DataFrame, key: str, ts: str, ret: str, first_fit: int, refit: int, burn: int, grid: list[tuple[float, float, float]] = GJR) -> DataFrame:
    """(key, ts, sigma, alpha, gamma, beta, nll): each row's forecast of the next row's volatility, from the past alone.

    h' = w + (alpha + gamma if r < 0) r^2 + beta h, where w fits the variance of the first
    `first_fit` returns.  One pass a series runs the recursion for all parameters of the grid
    side by side and adds up their negative log-likelihoods after `burn` rows; every `refit`
    rows from `first_fit` on, the parameters of the least one so far come into force (of equal
    ones the first).  Rows before have no forecast; null returns are passed over.  The state
    is the first returns and two numbers a parameter.
    """
    par = np.array(grid, float)
    a, g, b = par.T

    def start():
        return [[], None, None, 0, 0]

    def advance(state, r):
        h, nll, n = state[1], state[2], state[3]
        if n >= burn:
            nll += 0.5 * (np.log(h) + r * r / h)
        state[1] = state[4] * (1 - a - 0.5 * g - b) + (a + (g if r < 0 else 0)) * r * r + b * h
        state[3] = n + 1

    def step(state, r):
        if r is None:
            return state, None
        if state[1] is None:
            state[0].append(r)
            if len(state[0]) < first_fit:
                return state, None
            held, state[0] = state[0], []
            state[1], state[2], state[4] = np.full(len(par), max(float(np.var(held[:burn])), TINY)), np.zeros(len(par)), max(float(np.var(held)), TINY)
            for x in held[:-1]:
                advance(state, x)
        advance(state, r)
        if (state[3] - first_fit) % refit == 0:
            state.append(int(np.argmin(np.round(state[2], 9))))
            del state[5:-1]
        i = state[5]
        return state, (float(np.sqrt(state[1][i])), *map(float, par[i]), float(state[2][i]))

    rows = df.select(key, ts, F.col(ret).cast("double").alias("__r"))
    return carried(rows, key, ts, ["__r"], start, step, "sigma double, alpha double, gamma double, beta double, nll double")


def _admitted(df: DataFrame, vintages: DataFrame, h: int) -> DataFrame:
    """`df` (pos, ...) with asof_pos, the first vintage that knows the row's outcome."""
    v = vintages.agg(F.array_sort(F.collect_list("asof_pos")).alias("__a"))  # a few hundred vintages
    at = F.try_element_at(F.filter("__a", lambda a: admits(F.col("pos"), h, a)), F.lit(1))
    return df.join(v).withColumn("asof_pos", at).drop("__a")  # one row on the right


def tilted_scale(df: DataFrame, vintages: DataFrame, h: int, scales: list[float], nus: list[float], thetas: list[float], least: int = 500) -> DataFrame:
    """(vintage, n, scale, nu, theta): the forecast z ~ scale * exp(theta x) * t(nu) that fits best what a vintage knows.

    df: (pos, z, x).  Negative log-likelihoods of all grid points are added up by the vintage
    that first knows a row, then over vintages, so training ends h positions before a vintage
    and no row meets a vintage.  Of equal points the one with the least tilt is taken;
    vintages with fewer than `least` rows have no row.
    """
    points = [F.struct(F.lit(s).alias("scale"), F.lit(nu).alias("nu"), F.lit(t).alias("theta"), F.lit(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi)).alias("c")) for s in scales for nu in nus for t in thetas]
    o = _admitted(df.where("z is not null and x is not null").select("pos", "z", "x"), vintages, h).where("asof_pos is not null")
    o = o.withColumn("g", F.explode(F.array(*points))).select("asof_pos", "z", "x", "g.*")
    m = F.log("scale") + F.col("theta") * F.col("x")
    u = F.col("z") * F.exp(-m)
    nll = m - F.col("c") + (F.col("nu") + 1) / 2 * F.log1p(u * u / F.col("nu"))
    new = o.groupBy("asof_pos", "scale", "nu", "theta").agg(F.sum(nll).alias("nll"), F.count("*").alias("n"))
    grid = vintages.select("vintage", "asof_pos").join(new.select("scale", "nu", "theta").distinct())  # vintages x points
    up = Window.partitionBy("scale", "nu", "theta").orderBy("asof_pos").rowsBetween(Window.unboundedPreceding, 0)
    c = grid.join(new, ["asof_pos", "scale", "nu", "theta"], "left").na.fill(0, ["nll", "n"])
    c = c.select("vintage", "scale", "nu", "theta", F.sum("nll").over(up).alias("nll"), F.sum("n").over(up).alias("n")).where(F.col("n") >= least)
    best = c.groupBy("vintage").agg(F.min_by(F.struct("n", "scale", "nu", "theta"), F.struct(F.round("nll", 6), F.abs("theta"), F.abs(F.log("scale")), "nu")).alias("b"))
    return best.select("vintage", "b.*")


def tilt(scale: Column, theta: Column, x: Column, low: float, high: float) -> Column:
    """The scale of a row, its tilt held between two bounds; without x there is none."""
    return scale * F.coalesce(F.least(F.greatest(F.exp(theta * x), F.lit(low)), F.lit(high)), F.lit(1.0))


def share_correction(df: DataFrame, vintages: DataFrame, h: int, clip: float, least: int) -> DataFrame:
    """(vintage, n, b_share, b_volume): by how much z^2 moves with the institutional share and the volume of its day, relative to its level.

    df: (pos, day, z, share, volume), the last two being log ratios to their own past.  Both are
    centred within the day.  Cross-products are added up by the vintage that first knows a
    row, then over vintages; the three normal equations are solved by determinants.  Vintages
    with fewer than `least` rows, or without a solution of positive level, have zeros.
    """
    d = df.where("share is not null and volume is not null")
    w = Window.partitionBy("day")
    d = d.select("pos", "z", (F.col("share") - F.avg("share").over(w)).alias("x"), (F.col("volume") - F.avg("volume").over(w)).alias("v"))
    y = F.least(F.greatest(F.col("z"), F.lit(-clip)), F.lit(clip)) ** 2
    o = _admitted(d.where("z is not null").withColumn("y", y), vintages, h).where("asof_pos is not null")
    x, v, y = F.col("x"), F.col("v"), F.col("y")
    parts = {"n": F.lit(1.0), "sx": x, "sv": v, "sy": y, "sxx": x * x, "svv": v * v, "sxv": x * v, "sxy": x * y, "svy": v * y}
    m = o.groupBy("asof_pos").agg(*[F.sum(e).alias(c) for c, e in parts.items()])
    up = Window.partitionBy(F.lit(1)).orderBy("asof_pos").rowsBetween(Window.unboundedPreceding, 0)  # a row a vintage
    c = vintages.join(m, "asof_pos", "left").select("vintage", *[F.coalesce(F.sum(k).over(up), F.lit(0.0)).alias(k) for k in parts])
    n, sx, sv, sy, sxx, svv, sxv, sxy, svy = (F.col(k) for k in parts)

    def det(a, b, c_, d_, e, f, g, h_, i):
        return a * (e * i - f * h_) - b * (d_ * i - f * g) + c_ * (d_ * h_ - e * g)

    whole = det(n, sx, sv, sx, sxx, sxv, sv, sxv, svv)
    level, one, two = det(sy, sx, sv, sxy, sxx, sxv, svy, sxv, svv), det(n, sy, sv, sx, sxy, sxv, sv, svy, svv), det(n, sx, sy, sx, sxx, sxy, sv, sxv, svy)
    c = c.withColumns({"__d": whole, "__l": level, "__1": one, "__2": two})
    good = (n >= least) & (F.abs("__d") > 1e-12) & (F.col("__l") / F.nullif(F.col("__d"), F.lit(0.0)) > 1e-9)
    return c.select("vintage", n.cast("long").alias("n"), *[F.when(good, F.col(k) / F.nullif(F.col("__l"), F.lit(0.0))).otherwise(0.0).alias(name) for k, name in (("__1", "b_share"), ("__2", "b_volume"))])
