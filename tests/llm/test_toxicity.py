import random

import numpy as np
from pyspark.sql import functions as F

from panelweave.llm import toxicity as tx

SCHEMA = "doc_id long, text string, lang string, score string, _0 int"


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(0)
    terms = sorted({"".join(rng.choices("abcd", k=rng.choice((2, 3, 4, 5, 7, 8, 10)))) for _ in range(40)} | {"élan", "idiot", "disgusting"})
    automaton = tx.TermAutomaton(terms)
    words = ["", "idiot", "1diot", "idi", "disgustng", "dissgustting", "elan", "x" * 50]
    for _ in range(1500):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choices("abcdx", k=rng.randrange(2))
        words.append("".join(w))
    for w in words:
        want = tuple((i, e) for i, t in enumerate(terms) if (e := distance(w, t)) <= tx.reach(len(t)))
        assert automaton.matches(w) == want, w


def test_places_of_matches():
    m = tx.Matcher(tx.TermAutomaton(["idiot"]))
    at = {"he said the word idiot aloud": tx.QUOTED, "“what an idiot” it went on": tx.QUOTED, 'it read "idiot" there': tx.QUOTED, "an idi0t walked by": tx.PLAIN, "you are an IDIOT, mate": tx.DIRECTED, "you said idiot": tx.PLAIN}
    for text, place in at.items():
        assert [p for _, _, p in m.of(text)] == [place], text
    far = "said " + "filler " * 20 + "idiot"
    assert m.of(far) == [(0, 0, tx.PLAIN)] and m.of(None) == m.of("") == []


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in ("ver", "lan", "mor", "tis") for b in ("ta", "ke", "lo", "nu", "si") for c in ("n", "r", "ss", "m")]
    rows, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=rng.choice((12, 60, 200)))
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["grobnak", "grobnaks", "zlimtor", "scum", "sc*m", "zl1mtor"]))
        rows.append((i, " ".join(w), "xx", None, None))
        if i % 10:
            labels.append((i, int(bad)))
    return rows, labels


def test_held_out_labels_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(2000, None, None, "s", 1), (2001, "", "en", None, None), (2002, "grobnack zlimtor", None, None, None), (None, "grobnak zlimtor", None, None, None), (1, rows[1][1], "xx", None, None), (2003, "lantan " * 50000 + "zlimtor grobnak scum", None, None, None)]
    docs = spark.createDataFrame(rows + odd, SCHEMA).repartition(4)
    more = [(5000, None), (None, 1), (3, 0), (3, 0)]
    lab = spark.createDataFrame([(i, 1, t) for i, t in labels + more], "doc_id long, quality int, toxic int")
    got = tx.score_toxicity(docs, lab, F.expr("doc_id % 4 <> 2 and doc_id < 1000")).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    test = [(r.predicted, int(r.doc_id % 9 == 0)) for r in got if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 4 == 2]
    assert np.mean([a == b for a, b in test]) == 1
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score and by[2000].predicted == 0
    assert by[2002].predicted == by[None].predicted == by[2003].predicted == 1
    assert len({r.score for r in got if r.doc_id == 1}) == 1


def test_labels_are_no_inputs_and_partitions_do_not_count(spark):
    rows, labels = corpus(400)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = lab.withColumn("toxic", F.when(F.col("doc_id") % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    docs = spark.createDataFrame(rows, SCHEMA)
    fold = F.expr("doc_id % 4 <> 2")
    a = {r.doc_id: r.score for r in tx.score_toxicity(docs, lab, fold).collect()}
    b = {r.doc_id: r.score for r in tx.score_toxicity(docs.withColumn("lang", F.lit("q")).repartition(7), flipped, fold).collect()}
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_without_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = spark.createDataFrame([(1, "you are an idiot and scum", "en", None, None), (2, "the word idiot is rude", "en", None, None), (3, "a fine day", "en", None, None)], SCHEMA)
    got = {r.doc_id: r for r in tx.score_toxicity(docs, none, F.lit(True)).collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[3].predicted == 0 and got[1].score > got[2].score > got[3].score
    assert tx.score_toxicity(docs.limit(0), none, F.lit(True)).count() == 0


def test_copies_are_one_witness(spark):
    """A word that only copies of one toxic text hold is not learnt; one that many texts hold is."""
    clean = [(f"plain text number {i} goes on", 0) for i in range(300)]
    toxic = [("same old quoxel text again and again", 1)] * 40 + [(f"text {i} zarb with other{i % 7}", 1) for i in range(40)]
    lab = spark.createDataFrame(clean + toxic, "t string, y int")
    got = tx.learn_terms(lab, "t", "y", 0.003, 0.01)
    assert "zarb" in got and "quoxel" not in got
