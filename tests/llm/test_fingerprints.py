import math
import random
from collections import Counter
from hashlib import sha256

from pyspark.sql import functions as F

from panelweave.llm.fingerprints import edited_pairs, fingerprint, sampled, weighted, word_shingles

SCHEMA = "doc_id long, text string, row string, d string"


def grams(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return Counter(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(len(w), 1))))


def jaccard(a, b):
    a, b = grams(a), grams(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def edit(t, nxt):
    h = len(t) // 2
    return t[: len(t) - h] + nxt[:h]


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocab, k=rng.choice((1, 4, 50, 300))))
        rows.append((i * 7 - 50, text * rng.choice((1, 1, 2)), "x", None))
    return rows


def test_shingles_and_weights(spark):
    texts = ["a b c d e F g\n a b c d e f G", "", "  ", "one two", "é ß É ss x y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("g", weighted(word_shingles(F.col("t"))))
    for r in df.collect():
        assert sorted(x.weight for x in r.g or []) == sorted(grams(r.t).values())


def test_pairs(spark):
    rows = corpus(60) + [(1000, None, "x", "y"), (1001, "", "x", "y"), (1002, " \t", "x", "y"), (1003, "Big " * 30000, "x", "y"), (1004, "naïve 🎉 " * 9, None, "y")]
    rows.append((1005, rows[3][1], "x", None))
    got = {r.doc_id: r for r in edited_pairs(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    off = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        e, r = edit(t, nxt), got[i]
        assert r.n_chars == len(t) and r.edited_sha256 == sha256(e.encode()).hexdigest()
        off += [r.near_edited - jaccard(t, e), r.near_next - jaccard(t, nxt)]
    assert got[1005].fingerprint == got[rows[3][0]].fingerprint
    assert got[1000].fingerprint == got[1001].fingerprint == got[1002].fingerprint and got[1000].near_next == 1.0
    assert abs(sum(off) / len(off)) < 0.02 and max(map(abs, off)) < 0.45


def test_collision_rate_is_generalised_jaccard(spark):
    """Integer and fractional weights over several thousand samples."""
    a, b = {1: 5.0, 2: 1.0, 3: 0.4, 4: 2.5}, {1: 2.0, 2: 3.5, 3: 0.4, 9: 1.0}
    rows = [(f"{k}{rep}", 1000 * rep + t, math.log(w)) for rep in range(150) for k, d in (("a", a), ("b", b)) for t, w in d.items()]
    sig = {r.k: r.signature for r in sampled(spark.createDataFrame(rows, "k string, term long, log_weight double"), ["k"], 32).collect()}
    rate = sum(x == y for i in range(150) for x, y in zip(sig[f"a{i}"], sig[f"b{i}"], strict=True)) / (150 * 32)
    want = sum(min(a.get(t, 0), b.get(t, 0)) for t in {*a, *b}) / sum(max(a.get(t, 0), b.get(t, 0)) for t in {*a, *b})
    assert abs(rate - want) < 4 * math.sqrt(want * (1 - want) / (150 * 32))


def test_odd_tables(spark):
    assert edited_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = edited_pairs(spark.createDataFrame([(3, "a b c d", "x", "y")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    again = edited_pairs(spark.createDataFrame([(3, "a b", "x", "y"), (3, "a b", "x", "y"), (None, "q", "x", "y")], SCHEMA)).collect()
    assert sorted((r.doc_id is None, r.near_next) for r in again) == [(False, 0.0), (False, 1.0), (True, 0.0)]


def test_general_fingerprint(spark):
    docs = spark.createDataFrame([(1, "a b", "k", None), (1, "a b", "k", None), (2, "A  b", "k", None), (3, None, None, None)], SCHEMA)
    got = fingerprint(docs)
    assert got.columns == [*docs.columns, "fingerprint"] and got.count() == 4
    assert len({r.fingerprint for r in got.collect()}) == 2


def test_terms_are_dealt_out_in_compiled_code(spark):
    """Row by row, without the lambdas of the shingles in the same step."""
    docs = spark.createDataFrame(corpus(5), SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (edited_pairs(docs), fingerprint(docs)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            steps = [x for x in plan.splitlines() if "Generate explode(" in x and "true, [t" in x]
            assert len(steps) == 1 and "*(" in steps[0] and "lambda" not in steps[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
