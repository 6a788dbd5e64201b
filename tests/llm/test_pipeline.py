import os
import random
import re
import sys
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from panelweave.llm.substring_dedup import without_words

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from test_substring_dedup import removed_words  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {
    "en": [f"{a}{b}ing" for a in "bcdfglmprst" for b in ("a", "o", "ee", "thou", "wha")] + ["the", "of", "and", "with"],
    "de": [f"{a}{b}ung" for a in "bcdfglmprst" for b in ("ä", "ö", "ie", "schei", "u")] + ["der", "und", "nicht", "für"],
}


def corpus(seed=4):
    rng = random.Random(seed)
    rows, pool = [], []

    def para(lang, n):
        return " ".join(rng.choices(WORDS[lang], k=n))

    for i in range(90):
        lang = rng.choice(["en", "de"])
        if rows and rng.random() < 0.35:
            t, lang = rng.choice(rows)[1:3]
            words = t.split(" ")
            if rng.random() < 0.5 and len(words) > 60:
                words[rng.randrange(len(words))] = rng.choice(WORDS[lang])
            t = " ".join(words) if rng.random() < 0.5 else t + " \n"
        else:
            ps = [para(lang, rng.choice((5, 30, 80))) for _ in range(rng.randrange(1, 5))]
            if pool and rng.random() < 0.4:
                ps.append(rng.choice(pool))
            pool += [p for p in ps if len(p.split()) >= 60]
            t = "\n".join(ps)
        rows.append((i * 3, t, lang, "s", len(t)))
    return rows + [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (4, "123 456", "de", "s", 7), (5, para("en", 7000), "en", "s", 1)]


def grams(t, n=5):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, min(1, len(w))))}


def groups(sets):
    """Root per index of single-link groups at 0.8, the least index."""
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return [root(x) for x in range(len(sets))]


def brute(rows):
    """The texts that reach packing; the learnt stage is taken to reject just texts without letters."""
    docs = {i: t for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    best = {}
    for i, t in docs.items():
        k = re.sub("[\x20\x09-\x0d]", "", t)
        best[k] = min(best.get(k, (0, 1 << 60)), (-len(t), i))
    docs = {i: docs[i] for _, i in best.values()}
    ids = sorted(docs)
    docs = {ids[k]: docs[ids[k]] for k, r in enumerate(groups([grams(docs[i]) for i in ids])) if k == r}
    ids = sorted(docs)
    gone = removed_words([(i, docs[i]) for i in ids])
    return {i: without_words(docs[i], [(k, 1) for k in sorted(gone[i, docs[i]])]) for i in ids}


def test_run_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in brute(rows).items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            want[i, s] = (len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
    assert {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "ngram_join", "substring_dedup", "packing"]
    for _, f in cp.STAGES[:-1]:
        assert f(spark, docs, str(tmp_path)).columns == docs.columns


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_texts_reach_the_workers_in_small_batches(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from panelweave.llm.packing import _encoder

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    cp.language_id(spark, spark.createDataFrame([], SCHEMA), "").collect()
    docs = spark.range(0, 400, 1, 1).select(F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 5000).alias("text"))
    got = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 2 and max(got) < 6 << 20
    encode = _encoder(None)
    assert list(encode(["some words"])) and encode.known
    encode.forget()
    assert not encode.known and list(encode(["some words"]))
