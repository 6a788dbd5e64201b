import random

import numpy as np

from panelweave.llm import ngram_join, trie_join
from panelweave.llm.ngram_join import drop_near_copies, ngram_components
from panelweave.llm.trie_join import PrefixTree

SCHEMA = "doc_id long, text string, node string, size string"


def sets(text, n=4):
    data = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        data = data.replace(c, " ")
    words = [w for w in data.split(" ") if w]
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def brute(rows, n, num, den):
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(sets(t, n))
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = [i for i in ids if i is not None]
    for a in keys:
        for b in keys:
            if a < b and any(x and y and den * len(x & y) >= num * len(x | y) for x in ids[a] for y in ids[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in keys}


def corpus(seed=5, n=150):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocab).upper()
        else:
            words = rng.choices(vocab, k=rng.choice((0, 1, 3, 5, 40, 90)))
        rows.append((i * 3, rng.choice((" ", "\n", "\t ")).join(words), "x", None))
    return rows + [(1, None, "x", "y"), (2, "  \n", "x", "y"), (4, "word " * 9000, "x", "y"), (5, "word " * 9001, "x", "y")]


def test_components_equal_brute_force(spark):
    for seed, parts in ((5, 3), (7, 7)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        out, links = ngram_components(docs)
        want = brute(rows, 4, 85, 100)
        got = {r.doc_id: r for r in out.collect()}
        assert {i: r.component_id for i, r in got.items()} == want
        assert {i: r.n_shingles for i, r in got.items()} == {r[0]: len(sets(r[1])) for r in rows}
        text = {r[0]: sets(r[1]) for r in rows}
        for a, b in links.collect():
            assert 100 * len(text[a] & text[b]) >= 85 * len(text[a] | text[b])


def test_chains_that_the_least_document_does_not_touch(spark):
    words = [f"u{i}" for i in range(60)]
    rows = [(0, " ".join(words), "x", None)]
    for k in range(1, 8):  # each differs a little from the one before, the ends by much
        words = words[:-2] + [f"n{k}a", f"n{k}b"] if k % 2 else [f"m{k}a", f"m{k}b"] + words[2:]
        rows.append((100 - k, " ".join(words), "x", None))
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert got == brute(rows, 4, 85, 100)


def test_odd_rows(spark):
    rows = [(None, "a b c d e", "x", None), (1, "a b c d e", "x", None), (1, "a b c d e", "x", None), (7, "A b\tc d e", "x", None), (1, "q r s", None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_components(spark.createDataFrame(rows, SCHEMA))[0].collect()), key=str)
    assert got == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (7, 2, 1), (None, 2, None)]
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_components(empty)[0].count() == 0 and drop_near_copies(empty).count() == 0


def test_drop_near_copies(spark):
    rows = corpus(9)
    words = [f"q{i}" for i in range(60)]
    near = " ".join([*words[:30], "other", *words[31:]])
    rows += [(1003, " ".join(words), "x", "y"), (1007, near, "x", "y"), (1007, "a text of its own under an id that is not", "x", "y"), (None, near, "x", "y"), (1003, " ".join(words), "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _0 string, text_hash string")
    want = brute([r for r in rows if r[0] not in (1003, 1007, None)], 5, 80, 100)
    got = drop_near_copies(docs)
    assert got.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in got.collect())
    left = [(str(i), t) for i, t, *_ in rows if i in want and want[i] == i]
    assert got == sorted([*left, *[(str(rows[k][0]), rows[k][1]) for k in (-5, -3, -2, -1)]])


def test_large_groups_are_dealt_again(spark, monkeypatch):
    """One key that every set holds, in groups beyond the bound, with links that no hub has."""
    monkeypatch.setattr(trie_join, "HOT", 0)
    rng = random.Random(8)
    rows = []
    for g in range(40):
        base = [f"z{g}w{i}" for i in range(60)]
        for k in range(rng.randrange(1, 4)):
            own = list(base)
            own[rng.randrange(10, 60)] = f"e{k}"
            rows.append((len(rows), " ".join([*"a very common lead that all of them have".split(), *own]), "x", None))
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert got == brute(rows, 4, 85, 100)
    monkeypatch.setattr(ngram_join, "common_buckets", lambda docs, n: np.full(1 << 17, 255, np.uint8))  # all n-grams alike: the common ones are keys
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, SCHEMA))[0].collect()}
    assert got == brute(rows, 4, 85, 100)


def test_large_groups_keep_links_of_one_common_item(spark, monkeypatch):
    """At one half a set of one item links with sets of two that have but it in common."""
    monkeypatch.setattr(trie_join, "BLOCK", 4)
    monkeypatch.setattr(trie_join, "HOT", 1)
    rows = [(i, f"a w{i}", "x", None) for i in range(40)] + [(100, "a", "x", None), (101, "b c", "x", None), (102, "a w3 w4 w5", "x", None)]
    want = brute(rows, 1, 1, 2)
    assert want[7] == want[100] == 0 and want[101] == 101
    got = {r.doc_id: r.component_id for r in ngram_components(spark.createDataFrame(rows, SCHEMA), n=1, num=1, den=2)[0].collect()}
    assert got == want


def test_tree_finds_all_and_only_similar_sets():
    rng = np.random.default_rng(1)
    for _ in range(40):
        pool = np.sort(rng.choice(10_000, 60, replace=False)).astype("<u8")
        some = [np.sort(rng.choice(pool, rng.integers(1, 55), replace=False)) for _ in range(30)]
        tree = PrefixTree(some)
        for probe in some[:10]:
            want = {(i, len(np.intersect1d(s, probe))) for i, s in enumerate(some)}
            want = {(i, k) for i, k in want if 10 * k >= 6 * (len(some[i]) + len(probe) - k)}
            assert set(tree.search(probe, 6, 10)) == want


def test_a_tree_is_walked_only_for_sets_that_sketches_allow(monkeypatch):
    """Groups of unlike sets with one common item cost no walk each pair; the links are those of all pairs."""
    from panelweave.llm import trie_join as tj

    rng = np.random.default_rng(4)
    sets = [np.unique(np.concatenate([[np.uint64(7)], rng.integers(0, 1 << 62, int(k), dtype=np.uint64)])) for k in rng.integers(30, 300, 120)]
    sets += [np.unique(np.concatenate([s[: len(s) - len(s) // d], rng.integers(0, 1 << 62, len(s) // 40, dtype=np.uint64)])) for s in sets[:40] for d in (12, 30)]
    sets = [sets[i] for i in rng.permutation(len(sets))]

    def linked(a, b):
        both = len(np.intersect1d(a, b))
        return 100 * both >= 85 * (len(a) + len(b) - both)

    tree, sketches = tj.PrefixTree(sets), tj.Sketches(sets)
    for p in sets[::7]:
        want = {m for m, s in enumerate(sets) if linked(p, s)}
        near = sketches.near(p, 85, 100)
        assert want <= set(near.tolist())
        assert {m for m, _ in tree.search(p, 85, 100, among=near)} == want == {m for m, _ in tree.search(p, 85, 100)}
        assert {m for m, _ in tree.search(p, 85, 100, among=near[::2])} == want & set(near[::2].tolist())

    tries = 0
    plain = tj.PrefixTree.search

    def counted(self, *a, **k):
        nonlocal tries
        tries += 1
        return plain(self, *a, **k)

    monkeypatch.setattr(tj.PrefixTree, "search", counted)
    for lo, hi in ((0, 0), (0, 1)):
        block = [i % 2 if hi else 0 for i in range(len(sets))]
        columns = [[5] * len(sets), [lo] * len(sets), [hi] * len(sets), block, list(range(len(sets))), list(range(len(sets))), [s.astype("<u8").tobytes() for s in sets]]
        batch = tj.pa.RecordBatch.from_arrays([tj.pa.array(c) for c in columns], ["g", "lo", "hi", "block", "node", "comp", "items"])
        tries = 0
        got = [e for b in tj._join_groups(85, 100)([batch]) for e in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        assert tries < len(sets) // 2 + 10
        forest, want = tj._Forest(), tj._Forest()
        assert all(linked(sets[a], sets[b]) and forest.join(a, b) for a, b in got)
        pairs = [(a, b) for a in range(len(sets)) for b in range(a) if (not hi or block[a] != block[b]) and linked(sets[a], sets[b])]
        for a, b in pairs:
            want.join(a, b)
        assert all(forest.root(i) == want.root(i) for i in range(len(sets)))
