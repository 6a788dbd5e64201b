import math

import numpy as np
import pytest

from panelweave.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _0 int"


def brute(rows, entries=256, rounds=4):
    """Codes, errors and books by comparing every part with every entry in Python integers."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(1024 * v) for v in r[1]] for r in kept]
    w = len(x[0]) // 4
    books = [[v[k * w : (k + 1) * w] for v in x[:entries]] for k in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(book))

    for turn in range(rounds + 1):
        own = [[near(v[k * w : (k + 1) * w], books[k]) for k in range(4)] for v in x]
        if turn < rounds:
            for k in range(4):
                for i in range(len(books[k])):
                    mine = [v[k * w : (k + 1) * w] for v, o in zip(x, own, strict=True) if o[k][1] == i]
                    if mine:
                        books[k][i] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return [(r[0], r[2], "".join(f"{i:02x}" for _, i in o), sum(d for d, _ in o)) for r, o in zip(kept, own, strict=True)], books


def vectors(n, seed=0, dim=8):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(v)) for v in rng.normal(0, 0.1, dim)], i % 3, None, None) for i in range(n)]


@pytest.mark.parametrize("shape", [(2000, 4, 50), (3000, 2, 3), (40, 3, 300)])
def test_tree_owns_what_brute_force_owns(shape):
    n, p, spread = shape
    rng = np.random.default_rng(1)
    x = rng.integers(-spread, spread, (n, p))
    x[: n // 3] = x[0]
    tree = vc.MetricTree.loads(vc.MetricTree.of(x).dumps())
    assert sorted(tree.order) == list(range(n))
    for e in (x[: min(n, 60)], rng.integers(-2, 2, (5, p)), np.concatenate([x[:5], x[:5]])):
        own = np.full(n, -1)
        for ball, a, z, who in tree.owners(e):
            own[a:z] = who
            if ball is not None:
                assert (tree.x[a:z].sum(0) == tree.total[ball]).all()
        want = ((tree.x[:, None] - e[None]) ** 2).sum(2).argmin(1)
        assert (own == want).all()


def test_balls_are_owned_whole_where_clusters_are_apart():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(-5, 5, (500, 4)) + 1000 * k for k in range(4)])
    tree = vc.MetricTree.of(x)
    whole = sum(z - a for ball, a, z, _ in tree.owners(np.full((4, 4), 1000) * np.arange(4)[:, None]) if ball is not None)
    assert whole == len(x)


def test_anchors_give_each_point_to_its_nearest():
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (500, 3))
    dealt = vc.anchors(x, np.arange(500), 20)
    pivots = [x[0]]
    assert sorted(np.concatenate(dealt)) == list(range(500)) and len(dealt) == 20 and pivots


def test_codes_equal_brute_force(spark):
    rows = vectors(700)
    rows += [(900, None, 1, "x", 1), (901, [1.0, float("nan")] * 4, 1, None, None), (902, [1.0, None] * 4, 1, None, None), (903, [float("inf")] * 8, 1, None, None)]
    rows += [(3, rows[3][1], 0, None, None), (3, rows[3][1], 0, None, None), (None, rows[7][1], None, None, None), (77, rows[8][1], None, None, None)]
    rows += [(1000 + i, rows[5][1], 2, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    codes, books = vc.vector_codes(df, carry=("label",))
    want, want_books = brute(rows)
    assert books.tolist() == want_books
    got = sorted(((r.vec_id, r.label, r.code, r.error) for r in codes.collect()), key=str)
    assert got == sorted(want, key=str)
    label = {}
    for _, name, _, e in want:
        label[name] = label.get(name, 0) + e
    found = vc.with_label_error(codes, "label", "vec_id").collect()
    assert len(found) == len(want) and all(r.label_error == label[r.label] for r in found)
    back = vc.decode(codes, books).where("vec_id = 1").first()
    assert len(back.vector) == 8 and sum(math.floor(1024 * (a - b) + 0.5) ** 2 for a, b in zip([math.floor(1024 * v) / 1024 for v in rows[1][1]], back.vector, strict=True)) == back.error


def test_odd_widths_and_sizes_stay_without_a_code(spark):
    rows = vectors(20) + [(100, [1.0, 2.0], 0, None, None), (101, [], 0, None, None), (102, [1e30] * 8, 0, None, None)]
    codes, books = vc.vector_codes(spark.createDataFrame(rows, SCHEMA), carry=("label",))
    got = {r.vec_id: r for r in codes.collect()}
    assert len(got) == 23 and all(got[i].code is None and got[i].error is None for i in (100, 101, 102)) and books.shape == (4, 20, 2)
    assert all(got[i].error == 0 for i in range(20))  # every vector is an entry


def test_large_whole_numbers_are_exact():
    rng = np.random.default_rng(4)
    x, e = rng.integers(-(1 << 28), 1 << 28, (50, 4)), rng.integers(-(1 << 28), 1 << 28, (9, 4))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in e] for p in x]
    assert vc.squared(x, e).tolist() == want


def test_empty_tables(spark):
    for rows in ([], [(1, None, 0, None, None)], [(1, [], 0, None, None)]):
        codes, books = vc.vector_codes(spark.createDataFrame(rows, SCHEMA), carry=("label",))
        assert len(codes.collect()) == (rows == [(1, [], 0, None, None)]) and books.size == 0
        assert vc.with_label_error(codes, "label", "vec_id").count() == len(codes.collect())
        assert vc.books_sha256(books) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
