"""A gated recurrent language model, trained and applied as Spark jobs over numpy."""

from __future__ import annotations

import heapq
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import materialize, slices

# Classes of frequent words, by falling count: narrow ones for the words that fill most of the text.
WIDTHS = (16,) * 4 + (32,) * 6 + (128,) * 14
CLASSES, FREQUENT = len(WIDTHS), sum(WIDTHS)  # the end mark and the 2047 most frequent words
RARE = 32  # classes of all other words, by their last two bytes
BUCKETS = 512  # what the network sees of a rare word
HIDDEN, EMBED = 24, 16
LISTED = 200_000  # words whose count every task knows; the counts of all others come by a join
STEPS = 24  # length of a truncated backpropagation window
LANES, PART = 512, 1024  # texts side by side; a longer text is learnt in parts (but scored as a whole)
BLOCK = 2_000_000  # tokens that are kept together
PIECE = 1 << 24  # bytes of text that are split into words at a time

FIRST = np.cumsum((0, *WIDTHS))  # where the words of each class begin
CLASS_OF = np.concatenate([np.repeat(np.arange(CLASSES), WIDTHS), CLASSES + (FREQUENT + np.arange(BUCKETS)) % RARE]).astype(np.int8)


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def _softmax(w: np.ndarray, b: np.ndarray, h: np.ndarray, target: np.ndarray, safe: bool, learn: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of the targets and, to learn from, the gradient with respect to the scores (classes, tokens).

    States lie within -1 and 1, which bounds the scores; only where they are not `safe` for
    plain exponentials is the greatest score taken off first.
    """
    s = w @ h
    s += b[:, None]
    if not safe:
        s -= s.max(0)
    at = np.arange(h.shape[1])
    logp = s[target, at]
    np.exp(s, out=s)
    total = np.ones(len(s), s.dtype) @ s
    logp -= np.log(total)
    if not learn:
        return logp, s
    np.divide(-1, total, out=total)
    s *= total
    s[target, at] += 1
    return logp, s


def _safe(w: np.ndarray, b: np.ndarray) -> bool:
    return bool((np.abs(w).sum(-1) + np.abs(b)).max() < 60)


class GatedNet:
    """GRU over word embeddings with a class-factored softmax.

    The first output classes hold 16 to 128 frequent words each, by falling count, with a
    softmax of their own; the last hold the rare words, within which a word's probability
    is its smoothed share of counts.  States are columns: arrays are (features, tokens),
    the tokens of one step side by side.
    """

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "E": rng.normal(0, 0.3, (FREQUENT + BUCKETS, EMBED)), "W": rng.normal(0, EMBED**-0.5, (3 * h, EMBED)),
            "b": np.zeros(3 * h), "U": rng.normal(0, h**-0.5, (3 * h, h)),
            "C": rng.normal(0, 0.05, (CLASSES + RARE, h)), "c": np.zeros(CLASSES + RARE),
            "V": rng.normal(0, 0.05, (FREQUENT, h)), "v": np.zeros(FREQUENT),
        }
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.rooms: dict[str, np.ndarray] = {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array to be written over, the same one for every window."""
        a = self.rooms.get(name)
        if a is None or a.shape != shape:
            a = self.rooms[name] = np.empty(shape, self.p["U"].dtype)
        return a

    def start_from_counts(self, counts: np.ndarray, rare_mass: np.ndarray):
        """Output biases that make the untrained network a unigram model."""
        mass = np.add.reduceat(counts + 0.5, FIRST[:-1])
        self.p["v"] = np.log((counts + 0.5) / np.repeat(mass, WIDTHS)).astype(np.float32)
        mass = np.concatenate([mass, rare_mass])
        self.p["c"] = np.log(mass / mass.sum()).astype(np.float32)
        return self

    def forward(self, x: np.ndarray, reset: np.ndarray, h: np.ndarray) -> np.ndarray:
        """States (hidden, steps x lanes) from inputs and resets (steps, lanes) and the state before (hidden, lanes).

        The result and the rooms `seen`, `gates` and `given` hold until the next call.
        """
        p, n, (steps, lanes), room = self.p, HIDDEN, x.shape, self._room
        seen = p["E"].take(x.reshape(-1), 0, out=room("seen", x.size, EMBED), mode="clip")
        gates = np.matmul(p["W"], seen.T, out=room("gates", 3 * n, x.size))
        gates += p["b"][:, None]
        given, out, inner = room("given", 3 * n, x.size), room("states", n, x.size), room("inner", n, lanes)
        for t in range(steps):
            at = slice(t * lanes, (t + 1) * lanes)
            if reset[t].any():
                h = h * ~reset[t]
            g = np.matmul(p["U"], h, out=given[:, at])
            zr, m = gates[: 2 * n, at], gates[2 * n :, at]
            zr += g[: 2 * n]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            m += np.multiply(g[2 * n :], zr[n:], out=inner)
            np.tanh(m, out=m)
            h = np.subtract(h, m, out=out[:, at])
            h *= zr[:n]
            h += m
        return out

    def log_probabilities(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log of P(class), times P(word | class) for frequent words, of targets y; with gradients if asked."""
        p = self.p
        k = CLASS_OF[y]
        order = np.argsort(k, kind="stable")
        k, hs = k[order], h.take(order, 1)
        logp, dh = np.empty(len(y), h.dtype), None
        if grad is not None:
            dh = np.empty_like(h)
            grad |= {name: np.zeros_like(p[name]) for name in ("C", "c", "V", "v")}
        safe = _safe(p["C"], p["c"])
        for a in range(0, len(y), 2048):  # in parts that stay in the cache
            at = slice(a, a + 2048)
            logp[at], e = _softmax(p["C"], p["c"], hs[:, at], k[at], safe, grad is not None)
            if grad is not None:
                grad["C"] += e @ hs[:, at].T
                grad["c"] += e.sum(1)
                np.matmul(p["C"].T, e, out=dh[:, at])
        safe = _safe(p["V"], p["v"])
        ends = np.searchsorted(k, np.arange(CLASSES + 1)).tolist()
        for c, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            if a == b:
                continue
            words = slice(FIRST[c], FIRST[c + 1])
            more, e = _softmax(p["V"][words], p["v"][words], hs[:, a:b], y[order[a:b]] - FIRST[c], safe, grad is not None)
            logp[a:b] += more
            if grad is not None:
                grad["V"][words], grad["v"][words] = e @ hs[:, a:b].T, e.sum(1)
                dh[:, a:b] += p["V"][words].T @ e
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return logp[back], None if dh is None else dh.take(back, 1)

    def gradients(self, x, y, reset, h0) -> tuple[dict, np.ndarray, float]:
        """Gradient of the mean log-probability over one window, its last state, and that mean."""
        p, n, g, lanes, room = self.p, HIDDEN, {}, x.shape[1], self._room
        hs = self.forward(x, reset, h0)
        targets = y.reshape(-1)
        real = np.flatnonzero(targets >= 0)
        count = max(1, len(real))
        if len(real) == len(targets):
            logp, dhs = self.log_probabilities(hs, targets, g)
        else:
            logp, d = self.log_probabilities(hs.take(real, 1), targets[real], g)
            dhs = np.zeros_like(hs)
            dhs[:, real] = d
        gates, given = self.rooms["gates"], self.rooms["given"]
        z, r, m = gates[:n], gates[n : 2 * n], gates[2 * n :]
        before = room("before", *hs.shape)
        before[:, :lanes], before[:, lanes:] = h0, hs[:, :-lanes]
        before *= ~reset.reshape(-1)
        some = room("some", *hs.shape)
        to_m = np.subtract(1, z, out=room("to_m", *hs.shape))
        to_z = np.subtract(before, m, out=room("to_z", *hs.shape))
        to_z *= z
        to_z *= to_m
        np.multiply(m, m, out=some)
        to_m *= np.subtract(1, some, out=some)
        to_r = np.multiply(given[2 * n :], r, out=room("to_r", *hs.shape))
        to_r *= np.subtract(1, r, out=some)
        dg = room("dg", 3 * n, x.size)  # with respect to what the state gives
        dm = some  # with respect to the candidate's input
        dh = np.zeros_like(h0)
        back = np.ascontiguousarray(p["U"].T)
        for t in range(len(x) - 1, -1, -1):
            at = slice(t * lanes, (t + 1) * lanes)
            d = dhs[:, at]
            d += dh
            np.multiply(d, to_z[:, at], out=dg[:n, at])
            e = np.multiply(d, to_m[:, at], out=dm[:, at])
            np.multiply(e, to_r[:, at], out=dg[n : 2 * n, at])
            np.multiply(e, r[:, at], out=dg[2 * n :, at])
            dh = np.matmul(back, dg[:, at], out=dh)
            d *= z[:, at]
            dh += d
            if reset[t].any():
                dh *= ~reset[t]
        g["U"] = dg @ before.T
        dg[2 * n :] = dm
        g["b"] = dg.sum(1)
        seen = self.rooms["seen"]
        g["W"] = dg @ seen
        de = np.matmul(dg.T, p["W"], out=seen)
        ids = x.reshape(-1)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        g["E"] = np.zeros_like(p["E"])
        g["E"][ids[first]] = np.add.reduceat(de.take(order, 0), first, axis=0)
        for a in g.values():
            a /= count
        return g, hs[:, -lanes:].copy(), float(logp.sum()) / count


def lanes_of(docs: list[np.ndarray], lanes: int, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents side by side: inputs, targets (-1: none), resets and document numbers, (steps, lanes).

    Each document is led and ended by the end mark 0; lanes are filled longest first.  With
    `most`, a longer document is cut into parts of that length, each of which begins anew.
    """
    parts = []
    for k, d in enumerate(docs):
        n = len(d) + 1
        parts += [(k, a, min(n, a + most)) for a in range(0, n, most)] if most and n > most else [(k, 0, n)]
    sizes = np.array([b - a for _, a, b in parts])
    lanes = int(max(1, min(lanes, len(parts), sizes.sum() // sizes.max() + 1)))
    fill = [(0, i) for i in range(lanes)]
    place = []
    for j in np.argsort(-sizes, kind="stable").tolist():
        at, lane = fill[0]
        place.append((*parts[j], at, lane))
        heapq.heapreplace(fill, (at + int(sizes[j]), lane))
    steps = max(at for at, _ in fill)
    x, y = np.zeros((lanes, steps), np.int16), np.full((lanes, steps), -1, np.int16)
    reset, which = np.zeros((lanes, steps), bool), np.zeros((lanes, steps), np.int32)
    for k, a, b, at, lane in place:
        d, end = docs[k], at + b - a
        if a:
            x[lane, at:end] = d[a - 1 : b - 1]
        else:
            x[lane, at + 1 : end] = d[: b - 1]
        if b > len(d):
            y[lane, at : end - 1], y[lane, end - 1] = d[a:], 0
        else:
            y[lane, at:end] = d[a:b]
        reset[lane, at] = True
        which[lane, at:end] = k
    return tuple(np.ascontiguousarray(z.T) for z in (x, y, reset, which))


def train_on(net: GatedNet, docs: list[np.ndarray], lanes: int = LANES, rate: float = 0.01) -> int:
    """One pass of Adam by truncated backpropagation; the state is carried from window to window.

    Documents of more than `PART` words are learnt in parts side by side.
    """
    x, y, reset, _ = lanes_of(docs, lanes, PART)
    h = np.zeros((HIDDEN, x.shape[1]), np.float32)
    m = {k: np.zeros_like(a) for k, a in net.p.items()}
    v = {k: np.zeros_like(a) for k, a in net.p.items()}
    for t, a in enumerate(range(0, len(x), STEPS), 1):
        g, h, _ = net.gradients(x[a : a + STEPS], y[a : a + STEPS], reset[a : a + STEPS], h)
        lr = rate * float(np.sqrt(1 - 0.99**t)) / (1 - 0.9**t)
        norm = float(np.sqrt(sum(float(np.vdot(d, d)) for d in g.values())))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for k, d in g.items():
            d *= clip
            m[k] += 0.1 * (d - m[k])
            np.square(d, out=d)
            v[k] += 0.01 * (d - v[k])
            net.p[k] += lr * m[k] / (np.sqrt(v[k]) + 1e-6)
    return int((y >= 0).sum())


def score_docs(net: GatedNet, docs: list[np.ndarray], lanes: int = LANES) -> np.ndarray:
    """Natural log-likelihood per document, without the rare words' shares of their classes."""
    x, y, reset, which = lanes_of(docs, lanes)
    lanes = x.shape[1]
    h, out = np.zeros((HIDDEN, lanes), np.float32), np.zeros(len(docs))
    for a in range(0, len(x), STEPS):
        hs = net.forward(x[a : a + STEPS], reset[a : a + STEPS], h)
        h = hs[:, -lanes:].copy()
        targets, of = y[a : a + STEPS].reshape(-1), which[a : a + STEPS].reshape(-1)
        real = np.flatnonzero(targets >= 0)
        if len(real) < len(targets):
            hs, targets, of = hs.take(real, 1), targets[real], of[real]
        logp, _ = net.log_probabilities(hs, targets)
        out += np.bincount(of, logp, len(docs))
    return out


BLOCKS = "id array<long>, held_out array<boolean>, fold array<int>, size array<int>, codes binary, words array<binary>, counts array<long>"


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts after lower-casing A-Z, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text.fill_null("")))
    words = lists.flatten().cast(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end leaves an empty word
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    ends = lists.offsets.to_numpy().astype(np.int64)
    return words.filter(real), np.diff(before[ends - ends[0]])


def _one_row(columns: dict[str, pa.Array | bytes]) -> pa.RecordBatch:
    """A batch of one row: bytes as they are, arrays as lists."""
    out = []
    for c in columns.values():
        out.append(pa.array([c], pa.binary()) if isinstance(c, bytes) else pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c))
    return pa.RecordBatch.from_arrays(out, list(columns))


def text_blocks(docs: DataFrame) -> DataFrame:
    """Tokenised documents, about `BLOCK` tokens to a row: `BLOCKS`.

    docs: id, held_out, fold, text.  `codes` are int32 numbers into the block's own list of
    `words`, document after document; `counts` count each word's tokens that are not held out.
    """

    def block(about: list, words: list, sizes: list) -> pa.RecordBatch:
        coded = pa.concat_arrays(words).dictionary_encode()
        ids, held, fold = (pa.concat_arrays([b.column(name) for b in about]) for name in ("id", "held_out", "fold"))
        size, codes = np.concatenate(sizes), coded.indices.to_numpy().astype(np.int32)
        learnt = np.repeat(~held.to_numpy(zero_copy_only=False), size)
        counts = np.bincount(codes[learnt], minlength=len(coded.dictionary))
        return _one_row({
            "id": ids, "held_out": held, "fold": fold, "size": pa.array(size, pa.int32()), "codes": codes.tobytes(),
            "words": coded.dictionary, "counts": pa.array(counts, pa.int64()),
        })

    def run(batches):
        about, words, sizes, n, held = [], [], [], 0, 0
        for b in slices(batches):
            length = np.cumsum(pc.binary_length(b.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = [*np.flatnonzero(np.diff(length // PIECE, prepend=-1)).tolist(), b.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                about.append(b.slice(a, z - a))
                more, size = split_words(about[-1].column("text"))
                words.append(more)
                sizes.append(size)
                n += len(more) + len(size)
                held += more.nbytes
                if n > BLOCK or held > 4 * PIECE:
                    yield block(about, words, sizes)
                    about, words, sizes, n, held = [], [], [], 0, 0
        if about:
            yield block(about, words, sizes)

    return docs.select("id", "held_out", "fold", "text").mapInArrow(run, BLOCKS)


class Listed:
    """The listed words, by falling count: their rank, count and network id."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.rank = {w: i for i, w in enumerate(words)}
        self.log_count = np.log10(counts + 0.5)

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For a block's words: the rank (-1: not listed) and the network id.

        Ids: 0 the end, then the frequent words, then buckets of rare ones.
        """
        ranks = np.fromiter((self.rank.get(w, -1) for w in words), np.int32, len(words))
        ids = (ranks + 1).astype(np.int16)
        for i in np.flatnonzero((ranks < 0) | (ranks >= FREQUENT - 1)).tolist():
            ids[i] = FREQUENT + bucket_of(words[i])
        return ranks, ids


_LISTS: dict = {}


def _listed(sent) -> Listed:
    """One list a worker; `sent` is a broadcast of at most LISTED words."""
    key = sent.value[0]
    if key not in _LISTS:
        _LISTS.clear()
        _LISTS[key] = Listed(*sent.value[1:])
    return _LISTS[key]


def _opened(batches, names: list[str], code: str):
    """The rows of blocks as tuples: numpy of type `code` for codes, lists for words, numbers for block, arrays for all else."""
    for b in batches:
        for i in range(b.num_rows):
            row = []
            for name in names:
                v = b.column(name)[i]
                if name == "codes":
                    row.append(np.frombuffer(v.as_buffer(), code))
                else:
                    row.append(v.as_py() if name in ("words", "block") else v.values)
            yield row


def count_words(blocks: DataFrame) -> DataFrame:
    """(word, c) over all tokens that are not held out."""
    rows = blocks.select(F.inline(F.arrays_zip("words", "counts"))).where("counts > 0")
    return rows.groupBy(F.col("words").alias("word")).agg(F.sum("counts").alias("c"))


CODED = (
    "id array<long>, held_out array<boolean>, fold array<int>, size array<int>, codes binary, known array<long>, base array<double>, "
    "extra array<double>, far array<array<struct<word:binary,n:long>>>"
)


def coded_blocks(blocks: DataFrame, sent, log_mass: np.ndarray) -> DataFrame:
    """The blocks with the network's ids (int16) in place of words: `CODED`.

    Per document also what the listed words give: `known` and `base` count them and sum
    up log10(c + 0.5), `extra` sums that less `log_mass` of their class over the rare ones;
    `far` are the words that are not listed, with their numbers.
    """

    def run(batches):
        listed = _listed(sent)
        for ids, held, fold, size_, codes, words in _opened(batches, ["id", "held_out", "fold", "size", "codes", "words"], "<i4"):
            ranks, net_ids = listed.of(words)
            size = size_.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(size)), size)
            known = ranks >= 0
            logs = np.zeros(len(words))
            logs[known] = listed.log_count[ranks[known]]
            # A rare word adds its log10(c + 0.5), less that of its class's mass.
            share = np.where(net_ids >= FREQUENT, logs - log_mass[(net_ids - FREQUENT) % RARE], 0.0)
            sums = [np.bincount(doc, x[codes], len(size)) if len(doc) else np.zeros(len(size)) for x in (known, logs, share)]
            far = np.flatnonzero(~known[codes])
            pair, times = np.unique(doc[far] * len(words) + codes[far], return_counts=True)
            at = np.searchsorted(pair, np.arange(len(size) + 1) * max(1, len(words)))
            far_words = pa.array(words, pa.binary()).take(pa.array(pair % max(1, len(words))))
            items = pa.StructArray.from_arrays([far_words, pa.array(times)], ["word", "n"])
            yield _one_row({
                "id": ids, "held_out": held, "fold": fold, "size": size_, "codes": net_ids[codes].tobytes(), "known": pa.array(sums[0].astype(np.int64)),
                "base": pa.array(sums[1]), "extra": pa.array(sums[2]), "far": pa.ListArray.from_arrays(pa.array(at, pa.int32()), items),
            })

    return blocks.select("id", "held_out", "fold", "size", "codes", "words").mapInArrow(run, CODED)


def most_frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """About LISTED most frequent words with their counts, by falling count, then word.

    All words above a count, and of those with just that count the share that is still
    wanted, by a hash of the word.  The count comes from a histogram of levels of
    2 ** (1/8) and then one of the counts of a level, so little but the words reaches the driver.
    """
    level = F.floor(8 * F.log2(F.col("c").cast("double"))).cast("int")
    left, low = LISTED, None
    for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("l")).collect():  # a few hundred levels
        if r["n"] > left:
            low = r["l"]
            break
        left -= r["n"]
    wanted = F.lit(True) if low is None else level > low
    if low is not None:
        for r in counts.where(level == low).groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect():  # counts within a tenth
            if r["n"] > left:
                part = F.shiftrightunsigned(F.xxhash64("word"), 1) < F.lit(2**63 * left // r["n"])
                wanted = wanted | ((F.col("c") == r["c"]) & part)
                break
            left -= r["n"]
            wanted = wanted | (F.col("c") == r["c"])
    return sorted(((bytes(r["word"]), r["c"]) for r in counts.where(wanted).collect()), key=lambda x: (-x[1], x[0]))


def _average(net: GatedNet, parts: DataFrame, tasks: int, fan: int = 16) -> None:
    """Set the parameters to the mean of the tasks' parameters, weighted by their tokens; `fan` are added up at a time."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, np.float64) for p in pdf["params"])
        return pd.DataFrame({"task": pdf["task"][:1], "weight": [pdf["weight"].sum()], "params": [total.tobytes()]})

    while True:
        tasks = -(-tasks // fan)
        parts = parts.withColumn("task", F.floor(F.col("task") / fan).cast("int")).groupBy("task").applyInPandas(add, parts.schema)
        if tasks <= 1:
            break
    for r in parts.collect():
        flat, a = np.frombuffer(r["params"], np.float64) / r["weight"], 0
        for k, old in net.p.items():
            net.p[k] = flat[a : a + old.size].reshape(old.shape).astype(np.float32)
            a += old.size


def train(coded: DataFrame, net: GatedNet, rounds: int = 4, chunk: int = 2_000_000) -> GatedNet:
    """One pass over all documents that are not held out: data-parallel rounds with averaging.

    A round takes the documents of one hash fold; every task trains a copy of the network
    on its part by truncated backpropagation, and the copies are averaged.  What
    reaches the driver is one set of parameters a round, whatever the size of the table.
    The result depends on how the table is partitioned.
    """
    rows = coded.select("held_out", "fold", "size", "codes")
    for r in range(rounds):
        params = net.p

        def fit(batches, params=params, r=r):
            own, docs, n, weight = GatedNet(), [], 0, 0
            own.p = {k: a.copy() for k, a in params.items()}
            for held, fold, size, codes in _opened(batches, ["held_out", "fold", "size", "codes"], "<i2"):
                use = ~held.to_numpy(zero_copy_only=False) & (fold.to_numpy() == r)
                end = np.cumsum(size.to_numpy())
                for i in np.flatnonzero(use).tolist():
                    docs.append(codes[end[i - 1] if i else 0 : end[i]])
                    n += len(docs[-1]) + 1
                    if n > chunk:
                        weight += train_on(own, docs)
                        docs, n = [], 0
            if docs:
                weight += train_on(own, docs)
            if weight:
                flat = np.concatenate([a.ravel() for a in own.p.values()]).astype(np.float64) * weight
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([weight], pa.int64()), pa.array([flat.tobytes()], pa.binary())],
                    ["task", "weight", "params"],
                )

        _average(net, rows.mapInArrow(fit, "task int, weight long, params binary"), rows.rdd.getNumPartitions())
    return net


def score(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", rounds: int = 4, chunk: int = 4_000_000) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from all rows where `held_out` is false (or null).  Tokens are the
    words, then one end.  base_score is the add-half unigram log10 likelihood; score is the
    network's: log10 P(class | history) P(word | class, history), with words outside the
    2047 most frequent taking (c + 0.5) / (mass of their class + 0.5) of their class, so
    that the probabilities of all known words and one unknown word per rare class sum to 1.
    The state is carried through the whole text.

    Texts are tokenised once, into blocks.  Counts cover all training rows; the 200,000 most
    frequent words are sent to every task, the counts of all others meet their documents in
    a join.  A null text is empty (one token).  Without training rows N and V are 0.
    Repeated rows are each scored, rows with a null id too; extra columns are not read; an
    empty table gives an empty result.  Texts of any length are scored whole.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    source = source.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(rounds)).cast("int"))
    blocks = materialize(text_blocks(source), "word-blocks")
    counts = materialize(count_words(blocks), "word-counts")
    ends = blocks.select(F.explode("held_out").alias("h")).where("not h").count()
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = size[0] + ends, size[1] + (ends > 0)
    top = most_frequent(counts)
    sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [w for w, _ in top], np.array([c for _, c in top], np.float64)))

    frequent = np.zeros(FREQUENT)
    frequent[0] = ends
    frequent[1 : 1 + len(top)] = [c for _, c in top[: FREQUENT - 1]]
    tail = F.crc32(F.expr("substring(word, greatest(length(word) - 1, 1), 2)"))
    rare_mass = np.full(RARE, 0.5)
    for r in counts.groupBy(F.pmod(F.pmod(tail, F.lit(BUCKETS)), F.lit(RARE)).alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect():
        rare_mass[r["k"]] += r["m"]
    for w, c in top[: FREQUENT - 1]:
        rare_mass[bucket_of(w) % RARE] -= c + 0.5
    log_mass, base_of_end = np.log10(rare_mass), float(np.log10(ends + 0.5))
    coded = materialize(coded_blocks(blocks, sent, log_mass).withColumn("block", F.monotonically_increasing_id()), "coded-blocks")
    params = train(coded, GatedNet().start_from_counts(frequent, rare_mass), rounds).p
    columns = ["block", "id", "held_out", "size", "codes", "known", "base", "extra"]

    def apply(batches):
        own = GatedNet()
        own.p = params
        docs_, about, todo = [], [], 0

        def flush():
            got = pa.array(score_docs(own, docs_) / np.log(10))
            done, a = [], 0
            for rows, k in about:
                done.append(pa.RecordBatch.from_arrays([*rows.columns, got.slice(a, k)], [*rows.schema.names, "net"]))
                a += k
            return done

        for block, ids, held, size, codes, known, base, extra in _opened(batches, columns, "<i2"):
            size = size.to_numpy().astype(np.int64)
            k = len(size)
            row = [pa.array(np.full(k, block)), pa.array(np.arange(k, dtype=np.int32)), ids, held, pa.array(size + 1), known, base, extra]
            about.append((pa.RecordBatch.from_arrays(row, ["block", "at", "doc_id", "held_out", "n_tokens", "known", "base", "extra"]), k))
            docs_ += [codes[e - n : e] for e, n in zip(np.cumsum(size).tolist(), size.tolist(), strict=True)]
            todo += len(codes)
            if todo > chunk:
                yield from flush()
                docs_, about, todo = [], [], 0
        if about:
            yield from flush()

    schema = "block long, at int, doc_id long, held_out boolean, n_tokens long, known long, base double, extra double, net double"
    scored = coded.select(*columns).mapInArrow(apply, schema)
    far = coded.select("block", F.posexplode("far").alias("at", "f")).select("block", "at", F.inline("f")).join(counts, "word", "left")
    c = F.coalesce("c", F.lit(0))
    far = far.groupBy("block", "at").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("far_log"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("far_known"))
    far_log = F.coalesce("far_log", F.lit(0.0))
    base = F.col("base") + far_log + F.lit(base_of_end) - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))
    return scored.join(far, ["block", "at"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("far_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("net") + F.col("extra") + far_log).alias("score"),
    )
