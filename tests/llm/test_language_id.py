import random

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm.language_id import WINDOW, ByteConvNet, crc32_of_id, identify, labelled_sample, reject_unknown, usual_score, windows_of

SCHEMA = "doc_id long, text string, lang string, score string, n string"
WORDS = {
    "en": "the of and with thing water house over under people other about".split(),
    "de": "der und nicht schön über straße haus wasser leute andere für größe".split(),
    "fr": "le été avec où maison eau français être gens autre près garçon".split(),
}


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choices(WORDS[lang], k=rng.choice((4, 30, 400)))), lang if i % 9 else None, "x", lang))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    odd = [(900, None, "en", "x", "und"), (901, "", "en", "x", "und"), (902, "12 34 !!", "en", "x", "und"), (None, "der und nicht schön über straße", None, "x", "de"), (903, "the of and " * 40000, "en", None, "en")]
    rows = corpus() + odd
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    fold = F.pmod(crc32_of_id(), F.lit(3))
    got = identify(docs, fold != 1).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 for r in got)
    right = [r.lang_pred == r.n for r in got]
    assert np.mean(right) > 0.97
    assert all(r.lang_pred == "und" for r in got if r.n == "und")


def test_label_and_id_are_no_inputs(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    a = {r.text: (r.lang_pred, round(r.score, 6)) for r in identify(docs, "doc_id % 3 <> 1").collect()}
    moved = docs.withColumn("lang", F.when(F.expr("doc_id % 3 = 1"), "zz").otherwise(F.col("lang")))
    b = {r.text: (r.lang_pred, round(r.score, 6)) for r in identify(moved, "doc_id % 3 <> 1").collect()}
    assert a == b


def test_nothing_labelled_and_empty(spark):
    docs = spark.createDataFrame([(1, "the of", None, "x", "")], SCHEMA)
    assert [r.lang_pred for r in identify(docs, F.lit(True)).collect()] == ["und"]
    assert identify(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    assert reject_unknown(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reject_keeps_clean_rows_and_columns(spark):
    rows = corpus() + [(900, None, "en", "x", ""), (901, " 77 ", "en", "x", ""), (5, rows_text := "le été avec où", None, "x", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = reject_unknown(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows if r[0] not in (900, 901)) and rows_text


def test_letters_are_those_of_unicode(spark):
    net = ByteConvNet(["a", "b"])
    texts = ["²", "Ⅷ", "٣ _ 7", "é", "ß 1", "字", "\u0301", None, ""]
    assert [k == "und" for k in net.predict(texts)[0]] == [True, True, True, False, False, False, True, True, True]
    docs = spark.createDataFrame([(i, t, None, "x", "") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in reject_unknown(docs).collect()) == [3, 4, 5]


def test_sample_is_bounded_and_takes_copies_once(spark):
    rows = [(i % 400, f"text {i % 400}", "en", "x", "") for i in range(3000)] + [(5, None, "en", "x", ""), (6, "", "en", "x", ""), (7, "no label", None, "x", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(labelled_sample(docs, 10**6, "doc_id", "text", "lang")) == 400
    assert 20 < len(labelled_sample(docs, 750, "doc_id", "text", "lang")) < 200


def test_tables_equal_convolution():
    net = ByteConvNet(["a", "b", "c"], seed=4)
    x = windows_of(bytes(range(256)) * 3 + b"tail")
    assert x.shape == (7, WINDOW) and bytes(x.reshape(-1)).rstrip(b"\0").endswith(b"tail")
    got, p = net.log_probabilities(x), net.p
    for row, lp in zip(x, got, strict=True):
        h = []
        for w in (2, 3, 4):
            z = [np.concatenate([p["E"][row[t + j]] for j in range(w)]) @ p[f"K{w}"] + p[f"b{w}"] for t in range(WINDOW - w + 1)]
            h.append(np.maximum(np.max(z, 0), 0))
        s = np.concatenate(h) @ p["V"] + p["c"]
        assert np.allclose(lp, s - np.log(np.exp(s).sum()), atol=1e-4)


def test_gradient_is_the_slope_of_the_loss():
    net = ByteConvNet(["a", "b"], seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (5, WINDOW), dtype=np.uint8), np.array([0, 1, 1, 0, 1])
    g = net._gradients(x, y)
    for k in ("V", "c", "K3", "b2", "E"):
        for i in range(0, net.p[k].size, max(1, net.p[k].size // 7)):
            at = np.unravel_index(i, net.p[k].shape)
            loss = []
            for d in (1e-5, -1e-5):
                net.p[k][at] += d
                loss.append(-net.log_probabilities(x)[np.arange(5), y].mean())
                net.p[k][at] -= d
            assert abs((loss[0] - loss[1]) / 2e-5 - g[k][at]) < 1e-3


def test_the_bound_comes_from_every_labelled_row_once(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS[rng.choice(sorted(WORDS))], k=rng.randrange(1, 30))), "en", "", "") for i in range(2500)]
    net = ByteConvNet(["de", "en", "fr"])
    want = np.quantile(net.predict([r[1] for r in rows])[1], 0.01)
    twice = [*rows, *rows[:900], (9001, "12", "en", "", ""), (9002, None, "en", "", ""), (9003, rows[0][1], None, "", ""), (None, "", "en", "", "")]
    for parts in (1, 5):
        got = usual_score(net, spark.createDataFrame(twice, SCHEMA).repartition(parts), 0.01, "doc_id", "text", "lang")
        assert abs(got - want) < 2e-5
    assert usual_score(net, spark.createDataFrame([], SCHEMA), 0.01, "doc_id", "text", "lang") == 0.0
