import random

import numpy as np
import pytest

from panelweave.llm.common import components, free_names, id_filter, xxhash64_longs
from panelweave.llm.substring_dedup import LEAD, RADIUS, Units, bands_for, dedup_substrings, without_words
from panelweave.llm.trie_join import parity_sketch

SCHEMA = "doc_id long, text string, word string, _0 string"


def ascii_words(text):
    return text.encode().lower().split()


def grams(ws, n=5):
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))}


def cuts_of(ws):
    """By definition: strictly below the places before, not above those after; values as the code hashes them."""
    from panelweave.llm.ngram_join import _HASH
    from panelweave.llm.substring_dedup import _grams

    g = [int(x) for x in _grams(np.array([_HASH[w] for w in ws], np.uint64), LEAD)]
    return [i for i in range(len(ws)) if i == 0 or (i < len(g) and all(g[j] > g[i] for j in range(max(0, i - RADIUS), i)) and all(g[j] >= g[i] for j in range(i + 1, min(len(g), i + RADIUS + 1))))]


def brute(rows):
    """Texts left, as words."""
    return {x: [w for k, w in enumerate(ascii_words(x[1])) if k not in g] for x, g in removed_words(rows).items()}


def removed_words(rows, min_words=20, least=20, n=5):
    """Numbers of the words that go: all pairs of units of a kind, single links, first occurrences stay."""
    docs = sorted({(i, t) for i, t, *_ in rows if t}, key=lambda x: (x[0] is not None, x[0] or 0))
    units = []
    for d, (_, t) in enumerate(docs):
        at = 0
        for line in t.encode().lower().split(b"\n"):
            k = len(line.split())
            if k >= min_words:
                units.append((0, d, at, k))
            at += k
        ws = ascii_words(t)
        c = [*cuts_of(ws), len(ws)] if len(ws) >= least else []
        units += [(1, d, a, b - a) for a, b in zip(c, c[1:], strict=False) if b - a >= n]
    sets = [grams(ascii_words(docs[d][1])[a : a + k]) for _, d, a, k in units]
    up = list(range(len(units)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    of: dict = {}
    for k, (kind, *_) in enumerate(units):
        for g in sets[k]:
            of.setdefault((kind, g), []).append(k)
    for some in of.values():
        for k in some[1:]:
            if root(k) != root(some[0]) and 100 * len(sets[k] & sets[some[0]]) >= 80 * len(sets[k] | sets[some[0]]):
                up[root(k)] = root(some[0])
    for some in of.values():
        for i, a in enumerate(some):
            for b in some[:i]:
                if root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    up[root(a)] = root(b)

    def repeats(ks):
        first = {}
        for k in ks:
            first[root(k)] = min(first.get(root(k), (1 << 60, 0)), units[k][1:3])
        return [units[k][1:] for k in ks if units[k][1:3] != first[root(k)]]

    gone = {d: set() for d in range(len(docs))}
    for d, a, k in repeats([k for k, u in enumerate(units) if u[0] == 0]):
        gone[d].update(range(a, a + k))
    free = [k for k, (kind, d, a, m) in enumerate(units) if kind == 1 and gone[d].isdisjoint(range(a, a + m))]
    chains: dict = {}
    for d, a, m in sorted(repeats(free)):
        here = chains.setdefault(d, [])
        if here and here[-1][0] + here[-1][1] == a:
            here[-1][1] += m
        else:
            here.append([a, m])
    for d, here in chains.items():
        for a, m in here:
            if m >= least:
                gone[d].update(range(a, a + m))
    return {docs[d]: g for d, g in gone.items()}


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(600)]
    pool, rows = [rng.choices(vocab, k=k) for k in (51, 52, 60, 75, 120)], []
    for i in range(n):
        ws: list = []
        for _ in range(rng.randrange(1, 4)):
            if rng.random() < 0.4:
                some = list(rng.choice(pool))
                for _ in range(rng.randrange(3)):
                    some[rng.randrange(len(some))] = rng.choice(vocab)
            else:
                some = rng.choices(vocab, k=rng.choice((1, 8, 19, 20, 60, 90)))
            if len(some) > 18 and rng.random() < 0.3:
                pool.append(some)
            ws += [*some, "\n"] if rng.random() < 0.6 else some
        width = rng.choice((7, 19, 100, 10_000))  # hard-wrapped lines hold no paragraph of 20 words
        rows.append((i, "\n".join(" ".join(ws[a : a + width]) for a in range(0, len(ws), width)), "x", None))
    odd = [(500, None, "x", None), (501, "", None, "x"), (502, "\n \n", "x", "x"), (503, "a b" * 40 + " " + "c\x1cd " * 30, "x", "x"), (504, "tail " * 30000, "x", "x"), (505, "tail " * 30000, "x", "x")]
    return rows + odd + [rows[9], (None, rows[6][1], "x", "x"), (501, "p q r", "x", "x")]


def test_equals_brute_force(spark):
    for seed in (1,):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
        got = dedup_substrings(docs, recall=0.9999999)
        assert got.columns == docs.columns
        want = brute(rows)
        got = got.collect()
        assert len(got) == len(rows)
        have = sorted((str(r.doc_id), ascii_words(r.text)) for r in got if r.text)
        full = [(str(i), want[i, t]) for i, t, *_ in rows if t]
        assert have == sorted((i, w) for i, w in full if w or (i, w) in have)
        before = {(str(i), t) for i, t, *_ in rows}
        assert sum((str(r.doc_id), r.text) in before for r in got) > 60  # texts without a repeat are as they were


def test_passages_that_begin_and_end_within_lines_are_caught_and_clean_texts_stay(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    passages = [rng.choices(vocab, k=rng.randrange(51, 90)) for _ in range(60)]
    rows = []
    for i in range(300):
        ws = rng.choices(vocab, k=rng.randrange(30, 300))
        if i < 180:
            a = rng.randrange(len(ws) + 1)
            ws[a:a] = passages[i % 60]
        width = rng.choice((9, 40, 200))
        rows.append((i, "\n".join(" ".join(ws[a : a + width]) for a in range(0, len(ws), width)), "x", "x"))
    got = {r.doc_id: r.removed for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA), detail="removed").collect()}
    caught = [got[i] is not None for i in range(60, 180)]
    assert np.mean(caught) >= 0.95 and all(got[i] is None for i in [*range(60), *range(180, 300)])


def test_detail_and_white_space(spark):
    p = " ".join(f"x{i}" for i in range(60))
    rows = [(5, "a\n" + p, "", ""), (9, p + "\nb", "", ""), (11, "c\n" + p, "", "")]
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA), detail="removed").collect()}
    assert got[5].removed is None and got[5].text == "a\n" + p
    assert [tuple(x) for x in got[9].removed] == [(0, 60, 5)] and got[9].text == "b"
    assert [tuple(x) for x in got[11].removed] == [(1, 60, 5)] and got[11].text == "c"
    assert without_words("a\nb c\nd", [(1, 2)]) == "a\nd" and without_words("a\nb c\nd", [(1, 1)]) == "a\nc\nd"
    assert without_words(" a b\n", [(0, 2)]) == " " and without_words("a b c d", [(1, 1), (3, 1)]) == "a c"


def test_bands_follow_the_threshold():
    for num in (50, 70, 80, 90):
        for rows in (1, 2, 3):
            b = bands_for(num, 100, rows, 0.99)
            s = num / 100
            assert 1 - (1 - s**rows) ** b >= 0.99 and (b == 1 or 1 - (1 - s**rows) ** (b - 1) < 0.99)


def test_units_and_sketches_equal_their_definition():
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "B", "c\n", "dd", "e"], k=rng.randrange(0, 300))).encode() for _ in range(40)]
    u = Units(texts, 5, 20, 20)
    want = []
    for k, t in enumerate(texts):
        at = 0
        for line in t.split(b"\n"):
            if len(line.split()) >= 20:
                want.append((k, at, len(line.split())))
            at += len(line.split())
    assert list(zip(u.text[: u.paragraphs], u.word[: u.paragraphs], u.words[: u.paragraphs], strict=True)) == want
    for j in range(len(u.size)):
        ws = ascii_words(texts[u.text[j]].decode())[u.word[j] : u.word[j] + u.words[j]]
        items = u.items[u.ends[j] - u.size[j] : u.ends[j]]
        assert len(items) == len(grams(ws)) and (np.diff(items.astype(np.int64)) > 0).all()
    assert u.sketches() == [parity_sketch(u.items[e - k : e]) for e, k in zip(u.ends, u.size, strict=True)]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup_substrings(empty).count() == 0 and dedup_substrings(empty, detail="x").columns == [*empty.columns, "x"]
    with pytest.raises(ValueError):
        dedup_substrings(empty, min_words=3)


def test_components_and_filter(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(30)] + [(-5, 2000), (7, None)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    nodes = {x for e in edges for x in e if e[1] is not None and e[0] != e[1]}
    assert got == {x: root(x) for x in nodes}
    from pyspark.sql import functions as F

    ids = spark.createDataFrame([(i * i - 50,) for i in range(500)], "node long")
    own = np.array([i * i - 50 for i in range(500)])
    assert [r[0] for r in ids.select(F.xxhash64("node")).collect()] == xxhash64_longs(own).view(np.int64).tolist()
    test = id_filter(ids, "node")
    assert test.many(own).all() and test.many(10**9 + np.arange(10_000)).sum() < 1000
    assert free_names(spark.createDataFrame([], SCHEMA), 2) == ["_1", "_2"]


def test_large_groups_of_one_phrase_are_not_paired_block_by_block(spark, monkeypatch):
    """All links inside a group whose sets share a phrase, from rows that grow with the sets and not with their square."""
    from panelweave.llm import trie_join

    monkeypatch.setattr(trie_join, "BLOCK", 16)
    made = []
    plain = trie_join._block_pairs
    monkeypatch.setattr(trie_join, "_block_pairs", lambda *a: made.append(plain(*a)) or made[-1])

    def run(n, seed):
        rng = np.random.default_rng(seed)
        phrase = rng.integers(0, 1 << 44, 7)
        sets = [{*phrase.tolist()}, {*phrase[:6].tolist()}]  # links with every set of one more item; with none but the first
        for _ in range(n):
            sets.append({*phrase[: rng.integers(1, 8)].tolist(), *rng.integers(0, 1 << 44, rng.integers(1, 30)).tolist()})
        sets += [{*sorted(s)[: len(s) - int(rng.integers(0, 3))], int(phrase[0]), *rng.integers(0, 1 << 44, rng.integers(0, 2)).tolist()} for s in sets[2 : 2 + n // 3]]
        sets += [{*s, int(rng.integers(0, 1 << 44))} for s in sets[n // 2 : n]]
        sets = [np.array(sorted(s), "<u8") for s in sets]
        rows = [(i, len(s), parity_sketch(s), s.tobytes()) for i, s in enumerate(sets)]
        table = spark.createDataFrame(rows, "node long, size long, sketch binary, items binary")
        keys = table.selectExpr("5L as key", "node", "size")
        made.clear()
        links, comp = trie_join.linked_components(table.select("node", "size", "sketch"), keys, lambda nodes: table.join(nodes, "node", "left_semi").select("node", "items"), 80, 100, by_tree=False)
        forest, whole = trie_join._Forest(), [set(s.tolist()) for s in sets]
        for a in range(len(sets)):
            for b in range(a):
                both = len(whole[a] & whole[b])
                if 100 * both >= 80 * (len(whole[a]) + len(whole[b]) - both):
                    forest.join(a, b)
        got = {r.node: r.component for r in comp.collect()}
        assert [got.get(i, i) for i in range(len(sets))] == [forest.root(i) for i in range(len(sets))]
        assert len({*got.values()}) > n // 4 and links.count() >= len(got) - len({*got.values()})
        return len(sets), sum(x.count() for x in made)

    for n, seed in ((60, 1), (300, 2)):
        sets, rows = run(n, seed)
        assert rows < 8 * sets, (sets, rows)


def test_large_groups_are_dealt_out_by_a_few_items_of_each_set(spark, monkeypatch):
    """No table has a row for each item of a large group's sets, nor does a join make one."""
    from panelweave.llm import trie_join

    rng = np.random.default_rng(6)
    phrase = rng.integers(0, 1 << 44, 6).tolist()
    sets = [np.array(sorted({*phrase, *rng.integers(0, 1 << 44, 14).tolist()}), "<u8") for _ in range(80)]
    sets += [np.array(sorted({*s.tolist(), int(rng.integers(0, 1 << 44))}), "<u8") for s in sets]
    table = spark.createDataFrame([(i, s.tobytes()) for i, s in enumerate(sets)], "node long, items binary")
    rows = table.selectExpr("5L as key", "node", "node as comp")
    made = []
    plain = trie_join.materialize
    monkeypatch.setattr(trie_join, "materialize", lambda df, tag: made.append(plain(df, tag)) or made[-1])
    dealt = trie_join._dealt_by_rarest(rows, table, 80, 100).collect()
    reach = sum(len(s) - -(-80 * len(s) // 100) + 1 for s in sets)
    assert len(dealt) <= reach and all(t.count() <= len(sets) for t in made)
    groups = {}
    for r in dealt:
        groups.setdefault(r.key, []).append((r.node, r.late))
    assert all(any({(i, False), (i + 80, False)} <= {*g} or {(i, False), (i + 80, True)} <= {*g} for g in groups.values()) for i in range(80))
