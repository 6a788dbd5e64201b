import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelweave.llm.packing import ChunkEncoder, best_fill, pack, sequences, slack_plan, trimmed

SCHEMA = "doc_id long, text string, length string"
TEXTS = [
    (1, "The quick brown fox.\nIt's  jumping   over 12 dogs ", "x"), (2, None, "x"), (3, "", None), (4, " lead", "x"),
    (5, "naïve Straße \n\n end\t tab", "x"), (5, "naïve Straße \n\n end\t tab", "x"), (6, "word " * 3000 + "end", "x"),
    (7, "a<|endoftext|>b", "x"), (8, "日本語 テキスト 🎉 x", "x"), (9, "a  b c d", "x"), (10, "x" * 5000, "x"),
]


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_encoder_equals_tokenizers(tok):
    rng = random.Random(1)
    texts = [t or "" for _, t, _ in TEXTS]
    texts += ["".join(rng.choice("ab 1,.\n\t'sé ") for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["hello <|endoftext|> x", "<|endoftext|><|endoftext|>", " <|endoftext|>\n <|endoftext", "a <|endoftext|>  b c"]
    enc = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json").removesuffix(".json"), public_tokenizers.PATTERN, keep=50)
    assert tok.encode(texts[-4], add_special_tokens=False).ids == [31373, 220, 50256, 2124]
    for t, raw in zip(texts, enc(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_best_fill_is_best():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        target = rng.randrange(0, 60)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        fill = best_fill(counts, target)
        assert all(k <= counts[n] for n, k in fill.items())
        assert sum(n * k for n, k in fill.items()) == max(s for s in sums if s <= target)


def test_plan_uses_every_length_once():
    rng = random.Random(3)
    counts = {rng.randrange(1, 2049): rng.randrange(1, 50) for _ in range(300)}
    used: dict = {}
    for times, fill in slack_plan(counts, 2048):
        assert times > 0 and sum(n * k for n, k in fill.items()) <= 2048
        for n, k in fill.items():
            used[n] = used.get(n, 0) + times * k
    assert used == counts


def test_trimmed_windows_and_freed_lengths_hold_everything():
    rng = random.Random(4)
    for counts in ({1100: 1000}, {2047: 3, 5: 1}, {rng.randrange(1, 2048): rng.randrange(1, 9) for _ in range(40)}, {}):
        plan = slack_plan(counts, 2048)
        kept, freed = trimmed(plan, 2048, 0.005)
        have = dict(freed)
        for times, fill in kept:
            for n, k in fill.items():
                have[n] = have.get(n, 0) + times * k
        assert have == counts
        windows = sum(times for times, _ in kept)
        assert sum(times * (2048 - sum(n * k for n, k in fill.items())) for times, fill in kept) <= 0.005 * 2048 * windows + 1e-6


def check(rows, texts, tok, capacity=2048):
    """Every id of every document in just one piece, and sequences without gaps; gives the padding."""
    want, times = {}, {}
    for i, t, *_ in texts:
        want[i] = tok.encode(t or "", add_special_tokens=False).ids + [1]
        times[i] = times.get(i, 0) + 1
    covered: dict = {}
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(ids) == r.length > 0 and r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[r.doc_id])
        for k in range(r.start, r.start + r.length):
            covered[r.doc_id, k] = covered.get((r.doc_id, k), 0) + 1
    assert covered == {(i, k): times[i] for i, ids in want.items() for k in range(len(ids))}
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    filled = []
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        filled.append(at)
    assert max(filled) <= capacity
    return 1 - sum(filled) / (capacity * len(filled))


def test_equal_lengths_are_cut_to_fill(spark, tok):
    texts = [(i, "word " * 34 + "end", "x") for i in range(300)] + [(None, "word " * 34 + "end", "x"), (7, "word " * 34 + "end", "x")]
    docs = spark.createDataFrame(texts, SCHEMA).repartition(5)
    rows = pack(docs, capacity=64).collect()
    assert check(rows, texts, tok, 64) < 0.01
    assert pack(docs, capacity=64).select("sequence_id").distinct().count() < 1.01 * sum(r.length for r in rows) / 64 + 1


def test_pack(spark, tok):
    docs = spark.createDataFrame(TEXTS, SCHEMA).repartition(3)
    rows = pack(docs).collect()
    check(rows, TEXTS, tok)
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in TEXTS}
    pieces = sorted((r.doc_id, r.start, r.length) for r in rows)
    for i, ids in want.items():
        times = 2 if i == 5 else 1
        own = [p for p in pieces if p[0] == i]
        assert sum(p[2] for p in own) == len(ids) * times
    for r in rows:
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids.tobytes()) and r.doc_tokens == len(want[r.doc_id])
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by_seq) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_sequences_hold_the_ids(spark, tok):
    docs = spark.createDataFrame([t for t in TEXTS if t[0] != 5], SCHEMA)
    placed = pack(docs)
    got = {r.sequence_id: r.ids for r in sequences(docs, placed).collect()}
    want = {i: tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t, _ in TEXTS}
    for r in placed.collect():
        assert got[r.sequence_id][r.offset : r.offset + r.length] == want[r.doc_id][r.start : r.start + r.length]


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_tables_are_loaded_for_added_tokens_alone(tok):
    """A worker that meets no added token does not hold the vocabulary twice."""
    stem = public_tokenizers.path("byte_bpe_50k.json").removesuffix(".json")
    enc = ChunkEncoder(stem, public_tokenizers.PATTERN)
    assert enc.added == [t.content for t in tok.get_added_tokens_decoder().values()]
    list(enc(["some words here", " two  blanks ", ""]))
    assert "exact" not in vars(enc)
    text = f"a {enc.added[0]} b"
    assert np.frombuffer(next(enc([text])), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    assert "exact" in vars(enc)
