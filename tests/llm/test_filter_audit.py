import random
import re
from itertools import permutations

from panelweave.llm.filter_audit import filter_audit

SCHEMA = "doc_id long, text string, lang string, rid string, part int"


def brute(docs, labels):
    """Every order applied to every document in turn."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(n, d):
        t = d[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        big = float("inf")
        mine = big if d[0] is None else d[0]
        return {k for k, v in {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                               "E": any((o[1] or "") == t and (big if o[0] is None else o[0]) < mine for o in docs)}.items() if v}

    seen = [(d[2] or "", fails(n, d), d[0] in good, d[0] in toxic) for n, d in enumerate(docs)]
    out, shap = {}, {}
    for p in {s[0] for s in seen}:
        mine = [s for s in seen if s[0] == p]
        for order in permutations("ABCDE"):
            left, before = mine, set()
            for step, f in enumerate(order):
                gone = [s for s in left if f in s[1]]
                left = [s for s in left if f not in s[1]]
                shap[p, f] = shap.get((p, f), 0) + len(gone)
                out[p, "".join(order), step + 1] = [f, len(left), len(gone), sum(f in s[1] and bool(s[1] & before) for s in mine), sum(s[1] == {f} for s in mine), sum(s[2] for s in gone), sum(s[3] for s in gone)]
                before.add(f)
    return {k: (*v[1:], shap[k[0], v[0]]) for k, v in out.items()}


def table(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_equals_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(120):
        pool = words if rng.random() < 0.6 else words[:40]
        t = " ".join(rng.choices(pool, k=rng.choice((3, 150, 199, 200, 420))))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.3:
            t += rng.choice(("#", " $5", "|", "\t%"))
        docs.append((i, t, rng.choice(("en", "de", None, "")), "x", 1))
    docs += [(200 + i, docs[3][1], "en", None, None) for i in range(30)]
    docs += [(300, None, "en", None, None), (301, "", "de", None, None), (None, docs[3][1], "fr", None, None), (None, "only here", "fr", None, None), (5, docs[5][1], docs[5][2], None, None), (400, "a b c " * 60000, None, None, None)]
    labels = [(i, int(i % 2 == 0), int(i % 5 == 0)) for i in range(0, 230, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (7, None, None)]
    got = table(filter_audit(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    want = brute(docs, labels)
    assert len(got) == len(want) == 4 * 600
    assert got == want


def test_shares_add_up_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit(spark.createDataFrame([], SCHEMA), none).count() == 0
    one = table(filter_audit(spark.createDataFrame([(1, "a b", "en", None, None)], SCHEMA), none))
    assert len(one) == 600 and one["en", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    assert all(v[6] == (120 if k[1][k[2] - 1] == "A" else 0) for k, v in one.items())
