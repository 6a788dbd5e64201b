import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelweave.llm import gru_lm as lm

SCHEMA = "doc_id long, text string, held_out string, base string"


def corpus(n=160, seed=1):
    """Two vocabularies; a text stays within one, so its past tells what is to come."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = rng.choice("ab")
        words = [f"{v}{min(int(rng.expovariate(0.05)), 400)}" for _ in range(rng.choice((3, 40, 160)))]
        rows.append((i, rng.choice((" ", "\n", " \t")).join(words).replace("a1", "A1"), "x", "y"))
    return rows


def test_gradient_is_the_slope():
    rng = np.random.default_rng(0)
    net = lm.GatedNet(3)
    net.p = {k: a.astype(np.float64) for k, a in net.p.items()}
    x = rng.integers(0, lm.FREQUENT + lm.BUCKETS, (5, 4)).astype(np.int16)
    y = rng.integers(-1, lm.FREQUENT + lm.BUCKETS, (5, 4)).astype(np.int16)
    y[:, 0] = (0, 3, 17, 70, 300)
    reset = rng.random((5, 4)) < 0.3
    h0 = rng.normal(0, 1, (lm.HIDDEN, 4))
    g, _, base = net.gradients(x, y, reset, h0)
    for k in net.p:
        top = np.argsort(-np.abs(g[k]).ravel())[:4]
        for i in top:
            at = np.unravel_index(i, net.p[k].shape)
            loss = []
            for d in (1e-5, -1e-5):
                net.p[k][at] += d
                loss.append(net.gradients(x, y, reset, h0)[2])
                net.p[k][at] -= d
            assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-5, k


def test_probabilities_sum_to_one():
    net = lm.GatedNet(1).start_from_counts(np.arange(lm.FREQUENT, 0, -1.0), np.full(lm.RARE, 9.0))
    h = np.random.default_rng(2).normal(0, 1, (lm.HIDDEN, 1)).astype(np.float32)
    y = np.arange(lm.FREQUENT + lm.RARE)
    for scale in (1, 80):  # weights too large for plain exponentials, too
        net.p["V"] *= scale
        logp, _ = net.log_probabilities(np.repeat(h, len(y), 1), y)
        assert abs(np.exp(logp.astype(np.float64)).sum() - 1) < 1e-4


def step_by_step(net, d):
    h, total = np.zeros((lm.HIDDEN, 1), np.float32), 0.0
    for a, b in zip([0, *d], [*d, 0], strict=True):
        h = net.forward(np.array([[a]]), np.array([[False]]), h).copy()
        total += float(net.log_probabilities(h, np.array([b]))[0][0])
    return total


def test_lanes_and_windows_give_the_likelihood_of_each_document():
    rng = np.random.default_rng(5)
    net = lm.GatedNet(2)
    docs = [rng.integers(1, 2000, n).astype(np.int16) for n in (0, 1, 70, 3, 24, 23, 120)]
    for lanes in (1, 3, 512):
        for d, s in zip(docs, lm.score_docs(net, docs, lanes), strict=True):
            assert abs(step_by_step(net, d) - s) < 1e-2


def test_parts_of_long_documents_hold_every_token_once():
    docs = [np.arange(1, n + 1, dtype=np.int16) for n in (0, 5, 9, 10, 11, 40)]
    x, y, reset, which = lm.lanes_of(docs, 3, 10)
    for k, d in enumerate(docs):
        here = (which == k) & (y >= 0)
        assert sorted(zip(x[here].tolist(), y[here].tolist(), strict=True)) == sorted(zip([0, *d.tolist()], [*d.tolist(), 0], strict=True))
    assert reset.sum() == 1 + 1 + 1 + 2 + 2 + 5


def test_training_lowers_the_loss():
    rng = np.random.default_rng(1)
    docs = [np.tile(rng.integers(1, 2000, 3), 200).astype(np.int16) for _ in range(40)]
    net = lm.GatedNet(1)
    before = lm.score_docs(net, docs).sum()
    for _ in range(4):
        lm.train_on(net, docs, 8)
    assert lm.score_docs(net, docs).sum() > 0.8 * before


def test_averaging_in_levels(spark):
    net = lm.GatedNet()
    size = sum(a.size for a in net.p.values())
    rows = [(k, k + 1, (np.full(size, float(k)) * (k + 1)).tobytes()) for k in range(40)]
    lm._average(net, spark.createDataFrame(rows, "task int, weight long, params binary"), 40, 3)
    want = sum(k * (k + 1) for k in range(40)) / sum(range(41))
    assert all(np.allclose(a, want) for a in net.p.values())


def test_listed_words_take_a_share_of_the_last_count(spark, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 120)
    rows = [(f"w{k}".encode(), 5) for k in range(400)] + [(f"x{k}".encode(), 6 + k) for k in range(40)] + [(b"y", 1)]
    got = lm.most_frequent(spark.createDataFrame(rows, "word binary, c long"))
    assert got[:40] == [(f"x{k}".encode(), 6 + k) for k in reversed(range(40))] and {c for _, c in got[40:]} == {5} and 80 < len(got) < 170
    assert got[40:] == sorted(got[40:])
    monkeypatch.setattr(lm, "LISTED", 10_000)
    assert len(lm.most_frequent(spark.createDataFrame(rows, "word binary, c long"))) == len(rows)


def test_counts_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "LISTED", 120)  # so that most words take the join
    odd = [(900, None, "x", "y"), (901, "", "x", "y"), (902, "never-seen never-seen", "x", None), (3, "a1 a1", "x", "y"), (3, "a1 a1", "x", "y")]
    rows = corpus() + odd
    held = F.pmod(F.col("doc_id"), F.lit(5)) == 1
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = lm.score(docs, held).collect()
    assert len(got) == len(rows)
    toks = [(i, [w.lower() for w in (t or "").split()], i % 5 == 1) for i, t, *_ in rows]
    counts = Counter(w for i, ws, h in toks if not h for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i, h, len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 5)) for i, ws, h in toks)
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    some = [r for r in got if r.held_out and r.n_tokens > 30]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y"), (None, "q", None, None)], SCHEMA)
    none = lm.score(docs, F.lit(True)).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in none] == [(0, 0, 0.0)] * 2 and all(math.isfinite(r.score) for r in none)
    assert lm.score(spark.createDataFrame([], SCHEMA), F.lit(False)).count() == 0


def test_words_are_split_at_the_six_white_space_characters():
    rng = random.Random(5)
    texts = [None, "", " ", "\n\n", *("".join(rng.choice("aB\u00c4\u00e9\u00a0\u2003\x1c\x85 \t\n\r\x0b\x0c") for _ in range(rng.choice((1, 5, 60)))) for _ in range(200))]
    words, size = lm.split_words(pa.array(texts).slice(1))
    want = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts[1:]]
    assert [w.decode() for w in words.to_pylist()] == [w for x in want for w in x]
    assert size.tolist() == [len(x) for x in want]
    assert lm.split_words(pa.array([], pa.string()))[1].tolist() == []
