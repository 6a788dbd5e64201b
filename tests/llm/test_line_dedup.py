import random

from panelweave.llm.line_dedup import dedup_lines

SCHEMA = "doc_id long, text string, _0 string, __th string"


def brute(rows):
    docs = sorted({(i, t) for i, t, *_ in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, out = set(), {}
    for i, t in docs:
        ls, gone = t.split("\n"), set()
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if not any(x.strip(" ") for x in w):
                continue
            if w in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(w)
        out[i, t] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(ls), len(gone))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(12)] + ["", " "]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randrange(0, 14))), "x", None) for i in range(150)]
    rows += [(500, None, "x", "y"), (501, "", None, "y"), (502, "a\n" * 4000, "x", "y"), (503, "z", "x", "y"), (504, "\n\n\n\n", "x", "y"), (None, "line 1\nline 2\nline 3", "x", "y"), rows[4], (502, "a\n" * 4000, "x", "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = dedup_lines(docs, detail=("n_lines", "n_removed"))
    want = brute(rows)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == len(rows)
    assert {(r["_0"], r["__th"]) for r in got.collect()} == {r[2:] for r in rows}
    have = sorted([(str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in got.collect()], key=str)
    assert have == sorted([(str(i), *(want[i, t] if t is not None else (None, 0, 0))) for i, t, *_ in rows], key=str)


def test_plain_and_empty(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd", "", ""), (2, "x\na\nb\nc", "", "")], SCHEMA)
    got = dedup_lines(docs)
    assert got.columns == docs.columns and {r.doc_id: r.text for r in got.collect()} == {1: "a\nb\nc\nd", 2: "x"}
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
