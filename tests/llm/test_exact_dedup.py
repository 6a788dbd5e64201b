import re
from hashlib import sha256

from panelweave.llm.exact_dedup import _digests, drop_exact_copies, exact_copies, merge_runs

SCHEMA = "doc_id long, text string, _0 string, __id string"
ROWS = [
    (1, "a b", "r", None), (2, "ab", "r", None), (3, "a\tb ", "r", "x"), (4, None, "r", "x"), (5, "", None, "x"),
    (6, " \n", "r", "x"), (7, "a b", "r", "x"), (8, "xyz", "r", "x"), (8, "xyz", "r", "x"), (8, "other", "r", "x"),
    (None, "xyz", "r", "x"), (9, "long " * 30000, "r", "x"), (10, "long" * 30000, "r", "x"), (3, "a\tb ", "r", "x"),
]


def expected(rows):
    def norm(t):
        return re.sub("[\x20\x09-\x0d]", "", t or "")

    groups: dict = {}
    for r in rows:
        groups.setdefault(norm(r[1]), []).append(r)
    out = []
    for text, g in groups.items():
        best = min(g, key=lambda r: (-len(r[1] or ""), r[0] is not None, r[0] or 0))
        seen = False
        for r in g:
            same = (r[0], len(r[1] or "")) == (best[0], len(best[1] or ""))
            kept = same and not seen
            seen |= kept
            out.append((r[0], best[0], len(g), kept, sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def test_copies(spark):
    for parts, bits in ((1, 4), (9, 1)):
        df = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
        got = exact_copies(df, bits=bits).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_drop_keeps_columns_and_one_of_each(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(5)
    got = drop_exact_copies(df)
    assert got.columns == df.columns
    assert {(r["_0"], r["__id"]) for r in got.collect()} <= {r[2:] for r in ROWS}  # other columns stay as they were
    want = sorted((r[0], r[4]) for r in expected(ROWS) if r[3] and r[0] is not None)
    rows = [r for r in got.collect() if r.doc_id is not None]
    have = sorted((r.doc_id, sha256(re.sub("[\x20\x09-\x0d]", "", r.text or "").encode()).hexdigest()) for r in rows)
    assert have == want and got.where("doc_id is null").count() == 1


def test_every_level_keeps_the_best(spark):
    from pyspark.sql import functions as F

    df = _digests(spark.createDataFrame([(i, "x" * (i % 7), None, None) for i in range(200)], SCHEMA), "doc_id", "text")
    df = df.withColumn("run", (F.col("doc_id") % 40).cast("int")).withColumn("row", F.col("doc_id"))
    got = {r.norm_chars: (r.best.doc_id, r.group_size) for r in merge_runs(df, 40, 2).collect()}
    assert got == {k: (k, len(range(k, 200, 7))) for k in range(7)}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_copies(df).count() == 0 and drop_exact_copies(df).count() == 0
