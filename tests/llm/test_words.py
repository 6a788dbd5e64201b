import random
import tracemalloc

import numpy as np
import pyarrow as pa

from panelweave.llm import words
from panelweave.llm.trie_join import parity_sketch
from panelweave.llm.words import binaries, distinct, parity_sketches, shingles, text_bytes, word_hashes


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    """Across chunks, texts that touch, slices of a column, nulls, and words longer than a chunk."""
    rng = random.Random(3)
    pool = ["a", "b", "ab", "Ab", "ba", "é", "Straße", "x" * 70, " ", "1", "a\x00", "\x1f"]
    texts = ["".join(rng.choice(pool) + rng.choice((" ", "\n", "\t", "", "\r\v\f ")) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "  ", "end"]
    seen = {}
    for chunk in (16, 1 << 16):
        monkeypatch.setattr(words, "CHUNK", chunk)
        for column in (pa.array(texts), pa.array(["other", *texts], pa.large_string()).slice(1)):
            data, at = text_bytes(column)
            starts, h = word_hashes(data, at)
            want = [w for t in texts for w in (t or "").encode().lower().split()]
            assert len(h) == len(starts) == len(want)
            assert np.diff(np.searchsorted(starts, at)).tolist() == [len((t or "").encode().split()) for t in texts]
            for w, x in zip(want, h.tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len({*seen.values()}) == len(seen)


def test_shingle_sets_equal_their_definition():
    rng = random.Random(4)
    texts = [" ".join(rng.choices("aBcd", k=rng.choice((0, 1, 2, 3, 4, 5, 60)))) for _ in range(80)] + [None]
    items, size = distinct(*shingles(pa.array(texts), 4))
    of, ends = {}, np.cumsum(size)
    for t, n, z in zip(texts, size.tolist(), ends.tolist(), strict=True):
        w = (t or "").lower().split()
        want = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
        got = items[z - n : z]
        assert n == len(want) and (np.diff(got.astype(object)) > 0).all()
        assert of.setdefault(frozenset(want), got.tobytes()) == got.tobytes()
    assert len({*of.values()}) == len(of)
    assert parity_sketches(items, size) == [parity_sketch(items[z - n : z]) for n, z in zip(size, ends, strict=True)]
    assert binaries(items, size).to_pylist() == [items[z - n : z].tobytes() for n, z in zip(size, ends, strict=True)]


def test_workers_remember_no_words():
    column = pa.array([" ".join(f"w{i}" for i in range(k, k + 5000)) for k in range(0, 100_000, 5000)])
    shingles(column, 4)
    tracemalloc.start()
    for k in range(10):
        shingles(pa.array([" ".join(f"v{k}x{i}" for i in range(10_000))]), 4)
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert left < 1 << 20
