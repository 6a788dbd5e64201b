"""Gap-aware Gaussian hidden Markov models: many fits at once by expectation-maximisation over Spark groups, and decodes.

One rule for gaps holds everywhere: a row k positions after the one before it is reached by
the k-th power of the transitions; beyond `most_gap` positions the chain starts anew from its
stationary distribution.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.operators.saved import saved
from panelweave.operators.stats import quantiles

FLOOR = 1e-3


def stationary(trans: np.ndarray) -> np.ndarray:
    """The distribution that the transitions keep (of least norm, if several)."""
    k = len(trans)
    a = np.concatenate([trans.T - np.eye(k), np.ones((1, k))])
    p = np.clip(np.linalg.lstsq(a, np.append(np.zeros(k), 1.0), rcond=None)[0], 0, None)
    return p / p.sum()


def jumps(gaps: np.ndarray, trans: np.ndarray, most_gap: int) -> dict[int, np.ndarray]:
    """The transition matrix of each gap that occurs."""
    return {int(g): np.linalg.matrix_power(trans, int(g)) if g <= most_gap else np.tile(stationary(trans), (len(trans), 1)) for g in np.unique(gaps)}


def log_emissions(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Rows x states; x is rows x features, a nan feature says nothing."""
    z = (x[:, None, :] - means[None]) ** 2 / variances[None] + np.log(2 * np.pi * variances)[None]
    return -0.5 * np.nansum(z, 2)


def forward_backward(logb: np.ndarray, gaps: np.ndarray, trans, start, most_gap: int = 250) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Filtered and smoothed state probabilities of one sequence, expected one-step transitions, log-likelihood.

    gaps[t] is the number of steps since the row before (1: none missing).  Steps without
    an observation are missing data: the transitions inside a gap are counted in
    expectation along it, so the transition update stays a row-normalised count.
    """
    n, k = logb.shape
    top = logb.max(1)
    b = np.maximum(np.exp(logb - top[:, None]), 1e-280)
    move = jumps(gaps[1:], trans, most_gap)
    f, scale = np.empty((n, k)), np.empty(n)
    p = np.asarray(start) * b[0]
    for t in range(n):
        if t:
            p = (p @ move[gaps[t]]) * b[t]
        scale[t] = p.sum()
        f[t] = p = p / scale[t]
    g, back, xi = np.empty((n, k)), np.ones(k), np.zeros((k, k))
    for t in range(n - 1, -1, -1):
        g[t] = f[t] * back
        if t:
            v, m = b[t] * back / scale[t], int(gaps[t])
            if m <= most_gap:
                ahead = [v]
                for _ in range(m - 1):
                    ahead.append(trans @ ahead[-1])
                left = f[t - 1]
                for u in reversed(ahead):
                    xi += np.outer(left, u) * trans
                    left = left @ trans
            back = move[m] @ v
    return f, g, xi, float(np.log(scale).sum() + top.sum())


def smooth(x: np.ndarray, gaps: np.ndarray, means, sds, trans, start, most_gap: int = 250):
    """`forward_backward` of one feature."""
    return forward_backward(log_emissions(np.asarray(x, float)[:, None], np.asarray(means, float)[:, None], np.asarray(sds, float)[:, None] ** 2), gaps, trans, start, most_gap)


def viterbi(logb: np.ndarray, gaps: np.ndarray, trans, start, most_gap: int = 250) -> np.ndarray:
    """The most probable states of the rows of one sequence; of equal ones the lower state.

    The best predecessor of every state is kept for each row and followed back from the end.
    States within a gap are summed over, as in the likelihood that is fitted.
    """
    n, k = logb.shape
    with np.errstate(divide="ignore"):
        move = {g: np.log(a) for g, a in jumps(gaps[1:], trans, most_gap).items()}
        best = np.log(np.asarray(start, float)) + logb[0]
    came = np.zeros((n, k), int)
    for t in range(1, n):
        to = best[:, None] + move[gaps[t]]
        came[t] = to.argmax(0)
        best = to.max(0) + logb[t]
    path = np.empty(n, int)
    path[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def _gaps(pos: np.ndarray) -> np.ndarray:
    return np.maximum(np.diff(pos, prepend=pos[0] - 1), 1).astype(int)


def _ordered(par: dict) -> dict:
    """States by the mean of the first feature."""
    o = np.argsort(par["means"][:, 0], kind="stable")
    return {"means": par["means"][o], "variances": par["variances"][o], "trans": par["trans"][np.ix_(o, o)], "start": par["start"][o]}


def _parts(stats: np.ndarray, k: int, d: int):
    cut = np.cumsum([1, k, k, k * d, k * d])
    logl, g0, n, sx, sxx, xi = np.split(stats, cut)
    return float(logl[0]), g0, n, sx.reshape(k, d), sxx.reshape(k, d), xi.reshape(k, k)


def update(stats: np.ndarray, par: dict, floor: float = FLOOR) -> tuple[float, dict]:
    """(log-likelihood of `par`, next parameters) from summed statistics: each state has its own means and variances, of `floor` at least."""
    k, d = par["means"].shape
    logl, g0, n, sx, sxx, xi = _parts(stats, k, d)
    n = np.maximum(n, 1e-12)[:, None]
    means = sx / n
    rows = np.maximum(xi.sum(1, keepdims=True), 1e-300)
    return logl, {**par, "means": means, "variances": np.maximum(sxx / n - means**2, floor), "trans": np.where(xi.sum(1, keepdims=True) > 0, xi / rows, par["trans"]), "start": g0 / g0.sum()}


def update_two_chains(stats: np.ndarray, par: dict) -> tuple[float, dict]:
    """The update of two chains that move alone and add their means; `par` has their sizes in `chains`.

    States are pairs, the second chain's running faster.  Transitions and starts are the
    Kronecker products of the chains' own, whose counts are sums over the other chain; means
    solve the normal equations of the two-way table, the second chain's weighted mean being
    moved into the first; all states share their variances.
    """
    k, d = par["means"].shape
    a, b = par["chains"]
    logl, g0, n, sx, sxx, xi = _parts(stats, k, d)
    pairs, table = xi.reshape(a, b, a, b), n.reshape(a, b)
    moves = [m / np.maximum(m.sum(1, keepdims=True), 1e-300) for m in (pairs.sum((1, 3)), pairs.sum((0, 2)))]
    first = [s / s.sum() for s in (g0.reshape(a, b).sum(1), g0.reshape(a, b).sum(0))]
    design = np.block([[np.diag(table.sum(1)), table], [table.T, np.diag(table.sum(0))]])
    target = np.concatenate([sx.reshape(a, b, d).sum(1), sx.reshape(a, b, d).sum(0)])
    both = np.linalg.lstsq(design, target, rcond=None)[0]
    shift = table.sum(0) @ both[a:] / table.sum()
    one, two = both[:a] + shift, both[a:] - shift
    means = (one[:, None] + two[None]).reshape(k, d)
    var = np.maximum((sxx - 2 * means * sx + n[:, None] * means**2).sum(0) / n.sum(), FLOOR)
    return logl, {**par, "means": means, "variances": np.tile(var, (k, 1)), "trans": np.kron(*moves), "start": np.kron(*first), "one": one, "two": two, "trans_one": moves[0], "trans_two": moves[1]}


def fit_many(df: DataFrame, group: str, key: str, step: str, obs: list[str], starts: dict, rounds: int, tol: float = 1e-4, most_gap: int = 250, improve=update) -> dict:
    """{(group, restart): parameters with loglik, rounds, monotone, converged} for all `starts` {(group, restart): parameters}.

    Each round one group map reads a (group, key) sequence once and runs it under all
    restarts of its group that still move; Spark adds the statistics of the keys, and the
    driver updates a few dozen numbers a model.  A sequence meets in one task: it has at most
    one row a date.  Rows without a value in the first feature are left out.
    """
    rows = saved(df.where(F.col(obs[0]).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("key"), F.col(step).alias("step"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(obs)]))
    kind, names = dict(rows.dtypes)["g"], [f"x{i}" for i in range(len(obs))]
    live = {k: dict(p) for k, p in starts.items()}
    done: dict = {}
    history: dict = {k: [] for k in starts}

    def expectation(models: dict):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("step")
            x, gaps = pdf[names].to_numpy(float), _gaps(pdf["step"].to_numpy())
            full = np.nan_to_num(x)
            out = []
            for (g, restart), par in models.items():
                if g == pdf["g"].iloc[0]:
                    _, p, xi, logl = forward_backward(log_emissions(x, par["means"], par["variances"]), gaps, par["trans"], par["start"], most_gap)
                    v = np.concatenate([[logl], p[0], p.sum(0), (p.T @ full).ravel(), (p.T @ full**2).ravel(), xi.ravel()])
                    out.append(pd.DataFrame({"g": g, "restart": restart, "i": range(len(v)), "v": v}))
            return pd.concat(out) if out else pd.DataFrame({"g": [], "restart": [], "i": [], "v": []}).astype({"g": object, "restart": int, "i": int, "v": float})

        return run

    for r in range(rounds + 1):
        found: dict = {}
        for x in rows.groupBy("g", "key").applyInPandas(expectation(live), f"g {kind}, restart int, i int, v double").groupBy("g", "restart", "i").agg(F.sum("v").alias("v")).collect():  # a few dozen numbers a model
            found.setdefault((x["g"], x["restart"]), {})[x["i"]] = x["v"]
        for k, par in list(live.items()):
            if k not in found:
                del live[k]  # no rows
                continue
            logl, new = improve(np.array([found[k][i] for i in range(len(found[k]))]), par)
            h = history[k]
            h.append(logl)
            still = len(h) > 1 and abs(h[-1] - h[-2]) <= tol * abs(h[-2])
            if still or r == rounds:
                monotone = all(b >= a - 1e-6 * abs(a) for a, b in zip(h, h[1:], strict=False))
                done[k] = {**par, "loglik": logl, "rounds": r, "monotone": monotone, "converged": still, "history": list(h)}
                del live[k]
            else:
                live[k] = new
        if not live:
            break
    return done


def spread_starts(df: DataFrame, group: str, obs: list[str], states: int, restarts: int, jitter: float, seed: int) -> dict:
    """{(group, restart): parameters}: means at quantiles of the first feature, all but the last restart moved by noise."""
    q = quantiles(df.where(F.col(obs[0]).isNotNull()), obs[0], [(i + 0.5) / states for i in range(states)], [group])
    m = df.where(F.col(obs[0]).isNotNull()).groupBy(group).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(obs) for n, f in (("m", F.avg), ("v", F.var_pop))])
    at = {r[group]: r["q"] for r in q.collect()}  # a row a group
    out = {}
    trans = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(trans, 0.9 if states > 1 else 1.0)
    for n, r in enumerate(sorted(m.collect(), key=lambda r: str(r[group]))):
        for j in range(restarts):
            means = np.tile([r[f"m{i}"] or 0.0 for i in range(len(obs))], (states, 1))
            means[:, 0] = at[r[group]]
            sd = np.sqrt([max(r[f"v{i}"] or 0.0, FLOOR) for i in range(len(obs))])
            if j < restarts - 1:
                means = means + np.random.default_rng(seed + 1000 * n + j).normal(0, jitter, means.shape) * sd
            out[r[group], j] = {"means": means, "variances": np.tile(sd**2, (states, 1)), "trans": trans, "start": np.full(states, 1 / states)}
    return out


def fits_table(spark, fits: dict, group: str, kind: str) -> DataFrame:
    """One row a fit: parameters as arrays, states by the mean of the first feature, and what the gate looks at."""
    rows = []
    for (g, restart), p in sorted(fits.items(), key=str):
        o = _ordered(p)
        gap = float(np.diff(o["means"][:, 0]).min()) if len(o["means"]) > 1 else float("inf")
        rows.append((g, restart, p["loglik"], p["rounds"], p["monotone"], p["converged"], float(np.diag(o["trans"]).min()), gap, o["means"].tolist(), o["variances"].tolist(), o["trans"].tolist(), o["start"].tolist()))
    return spark.createDataFrame(rows, f"`{group}` {kind}, restart int, loglik double, rounds int, monotone boolean, converged boolean, min_self double, min_gap double, means array<array<double>>, variances array<array<double>>, trans array<array<double>>, start array<double>")


def winners(fits: DataFrame, group: str, least_self: float = 0.5, least_gap: float = 0.5) -> DataFrame:
    """Per group the fit of the highest likelihood among those that pass the gate, and what the gate cost.

    The gate: every state keeps itself with more than `least_self`, first-feature means lie
    `least_gap` apart or more, and the likelihood never fell.  A group without such a fit has
    no row: nothing that failed the gate is published.
    """
    ok = (F.col("min_self") > least_self) & (F.col("min_gap") >= least_gap) & F.col("monotone")
    best = F.max_by(F.struct(*[c for c in fits.columns if c != group]), F.when(ok, F.struct("loglik", -F.col("restart"))))
    g = fits.groupBy(group).agg(F.count("*").alias("tried"), F.count(F.when(ok, 1)).alias("passed"), F.max("loglik").alias("top"), F.min("loglik").alias("low"), best.alias("b"))
    return g.where("passed > 0").select(group, "tried", "passed", (F.col("top") - F.col("low")).alias("spread"), (F.col("b.loglik") - F.col("top")).alias("cost_of_gate"), "b.*")


def match_cost(new: Column, old: Column, states: int) -> Column:
    """Costs of the assignments of new to old states, cheapest first: (cost, order), order[i] being the old state of new state i."""

    def distance(i: int, j: int) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(new[i], old[j], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))

    costs = [F.struct(sum((distance(i, j) for i, j in enumerate(p)), F.lit(0.0)).alias("cost"), F.array(*map(F.lit, p)).alias("order")) for p in permutations(range(states))]
    return F.array_sort(F.array(*costs))


def aligned(chosen: DataFrame, group: str, states: int) -> DataFrame:
    """`chosen` with match (the old state of each state), match_cost and the next best cost, against the group before."""
    w = Window.partitionBy(F.lit(1)).orderBy(group)  # a row a vintage
    d = chosen.withColumn("__old", F.lag("means").over(w)).withColumn("__c", F.when(F.col("__old").isNotNull(), match_cost(F.col("means"), F.col("__old"), states)))
    second = F.col("__c")[1]["cost"] if states > 1 else F.lit(None).cast("double")
    return d.select(*chosen.columns, F.col("__c")[0]["order"].alias("match"), F.col("__c")[0]["cost"].alias("match_cost"), second.alias("second_cost"))


def fit(df: DataFrame, key: str, step: str, obs: str, states: int = 3, rounds: int = 12, most_gap: int = 250) -> tuple[dict, list[float]]:
    """(parameters, log-likelihood per round) of one model of one feature for all keys."""
    one = df.withColumn("__g", F.lit(0))
    starts = spread_starts(one, "__g", [obs], states, 1, 0.0, 0)
    got = fit_many(one, "__g", key, step, [obs], starts, rounds, 0.0, most_gap)[0, 0]
    o = _ordered(got)
    return {"means": o["means"][:, 0], "sds": np.sqrt(o["variances"][:, 0]), "trans": o["trans"], "start": o["start"]}, got["history"]


def decode(df: DataFrame, key: str, ts: str, step: str, obs: str | list[str], par: dict, most_gap: int = 250) -> DataFrame:
    """Per row the filtered and smoothed probabilities, the state of the highest smoothed one, and the most probable path's state."""
    cols = [obs] if isinstance(obs, str) else list(obs)
    means = np.asarray(par["means"], float).reshape(-1, len(cols))
    var = np.asarray(par["variances"], float).reshape(means.shape) if "variances" in par else np.asarray(par["sds"], float).reshape(means.shape) ** 2
    trans, start = np.asarray(par["trans"], float), np.asarray(par["start"], float)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(step)
        logb, gaps = log_emissions(pdf[cols].to_numpy(float), means, var), _gaps(pdf[step].to_numpy())
        f, g, _, _ = forward_backward(logb, gaps, trans, start, most_gap)
        return pd.DataFrame({key: pdf[key], ts: pdf[ts], "filtered": list(f), "smoothed": list(g), "state": g.argmax(1), "path": viterbi(logb, gaps, trans, start, most_gap)})

    rows = df.where(F.col(cols[0]).isNotNull()).select(*dict.fromkeys([key, ts, step, *cols]))
    kinds = dict(rows.dtypes)
    return rows.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, filtered array<double>, smoothed array<double>, state int, path int")


def era_replication(decoded: DataFrame, key: str, ts: str, era: str, state: str) -> DataFrame:
    """(era, state, next, n, share): the census of each era (next null) and its row-normalised transitions, never across eras or keys."""
    w = Window.partitionBy(key, era).orderBy(ts)
    moves = decoded.select(era, state, F.lead(state).over(w).alias("next")).where(F.col("next").isNotNull())
    census = decoded.groupBy(era, state).agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(era)))
    t = moves.groupBy(era, state, "next").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(era, state)))
    return census.select(era, state, F.lit(None).cast(dict(t.dtypes)["next"]).alias("next"), "n", "share").unionByName(t.select(era, state, "next", "n", "share"))
