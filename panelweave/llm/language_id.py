"""Language identification with a byte convolutional network trained in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import slices

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
LETTER = r"\p{L}"  # Unicode category L, here and in SQL
_LETTER = regex.compile(LETTER)


def windows_of(raw: bytes) -> np.ndarray:
    """The whole text as rows of `WINDOW` bytes, the last one padded with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class ByteConvNet:
    """Byte embedding, filters of several widths, max pooling over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"E": rng.normal(0, 0.5, (256, EMBED))}
        for w in WIDTHS:
            self.p[f"K{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["V"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(classes)))
        self.p["c"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        emb = p["E"][x]
        seen, pooled = [], []
        for w in WIDTHS:
            m = WINDOW - w + 1
            cols = np.concatenate([emb[:, j : j + m] for j in range(w)], axis=2)
            z = cols @ p[f"K{w}"] + p[f"b{w}"]
            at = z.argmax(1)
            top = np.take_along_axis(z, at[:, None], 1)[:, 0]
            seen.append((cols, at, top > 0))
            pooled.append(np.maximum(top, 0))
        h = np.concatenate(pooled, 1)
        s = h @ p["V"] + p["c"]
        s = np.exp(s - s.max(1, keepdims=True))
        s /= s.sum(1, keepdims=True)
        s[np.arange(n), y] -= 1
        s /= n
        g = {"V": h.T @ s, "c": s.sum(0), "E": np.zeros_like(p["E"])}
        dh = s @ p["V"].T
        rows = np.arange(n)[:, None]
        for i, (w, (cols, at, on)) in enumerate(zip(WIDTHS, seen, strict=True)):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
            got = cols[rows, at]  # n x filters x (w * embed): only the pooled places pass gradient
            g[f"K{w}"] = np.einsum("nfe,nf->ef", got, d)
            g[f"b{w}"] = d.sum(0)
            de = d[:, :, None] * p[f"K{w}"].T[None]
            for j in range(w):
                np.add.at(g["E"], x[rows, at + j].ravel(), de[:, :, j * EMBED : (j + 1) * EMBED].reshape(-1, EMBED))
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 600, batch: int = 128, rate: float = 0.01, seed: int = 0):
        """Adam on batches that draw every class equally often, and within it windows by their `share`."""
        rng = np.random.default_rng(seed)
        of_class = [np.flatnonzero(y == k) for k in range(len(self.classes))]
        heap = [np.cumsum(share[i]) for i in of_class]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        for t in range(1, steps + 1):
            pick = np.concatenate([i[np.searchsorted(c, rng.random(-(-batch // len(of_class))) * c[-1], "right").clip(max=len(i) - 1)] for i, c in zip(of_class, heap, strict=True)])
            lr = rate * (1 - (t - 1) / steps) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for k, g in self._gradients(x[pick], y[pick]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= (lr * m[k] / (np.sqrt(v[k]) + 1e-7)).astype(np.float32)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Per window; a filter over embedded bytes is a sum of one table row per tap."""
        taps = {w: [self.p["E"] @ self.p[f"K{w}"][j * EMBED : (j + 1) * EMBED] for j in range(w)] for w in WIDTHS}
        out = []
        for k in range(0, len(x), 64):
            part = x[k : k + 64]
            h = []
            for w in WIDTHS:
                m = WINDOW - w + 1
                z = taps[w][0][part[:, :m]]
                for j in range(1, w):
                    z += taps[w][j][part[:, j : j + m]]
                h.append(np.maximum(z.max(1) + self.p[f"b{w}"], 0))
            s = np.concatenate(h, 1) @ self.p["V"] + self.p["c"]
            s -= s.max(1, keepdims=True)
            out.append(s - np.log(np.exp(s).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(self.classes)), np.float32)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of whole texts: window log-probabilities averaged by bytes."""
        raws = [t.encode("utf-8", "surrogatepass") if t and _LETTER.search(t) else b"" for t in texts]
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        a = 0
        while a < len(raws):
            b, n = a, 0
            while b < len(raws) and (b == a or n + len(raws[b]) < 1 << 22):
                n += len(raws[b])
                b += 1
            some = [i for i in range(a, b) if raws[i]]
            a = b
            if not some:
                continue
            parts = [windows_of(raws[i]) for i in some]
            logp = self.log_probabilities(np.concatenate(parts))
            weight = np.concatenate([np.minimum(WINDOW, len(raws[i]) - WINDOW * np.arange(len(w))) for i, w in zip(some, parts, strict=True)])
            first = np.cumsum([0] + [len(w) for w in parts[:-1]])
            mean = np.add.reduceat(logp * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
            mean = np.exp(mean - mean.max(1, keepdims=True))
            mean /= mean.sum(1, keepdims=True)
            for i, k, s in zip(some, mean.argmax(1).tolist(), mean.max(1).tolist(), strict=True):
                lang[i], score[i] = self.classes[k], min(1.0, s)
        return lang, score


def labelled_sample(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, bytes]]:
    """(label, whole text) of about `rows` labelled rows with a text, drawn by a hash of id and text; sorted.

    The hash is compared with a bound that the number of rows gives, so no task gathers
    more than its share, and rows that repeat id, text and label are taken once.
    """
    some = docs.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    n = some.count()
    low = F.shiftrightunsigned(F.xxhash64(id_col, text_col), 1)
    some = some.where(low < F.lit(min(2**63 - 1, 2**63 * rows // max(1, n))))
    found = some.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t"), F.col(id_col).alias("i")).distinct().collect()
    return sorted((r["l"], r["t"].encode("utf-8", "surrogatepass")) for r in found)


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = 3000) -> ByteConvNet | None:
    """Fit on all windows of about `sample` labelled rows (`labelled_sample`); None if no row has a label and text.

    The sample is bounded, so fitting costs the same whatever the size of the table; batches
    draw the languages, then the texts of a language, then the windows of a text alike.
    """
    got = labelled_sample(labelled, sample, id_col, text_col, lang_col)
    if not got:
        return None
    classes = sorted({lang for lang, _ in got})
    parts = [windows_of(raw) for _, raw in got]
    y = np.repeat([classes.index(lang) for lang, _ in got], [len(w) for w in parts])
    share = np.repeat([1 / len(w) for w in parts], [len(w) for w in parts])
    return ByteConvNet(classes).fit(np.concatenate(parts), y, share)


def identify(
    docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """`docs` with lang_pred and score, learnt from the rows where `train_on` holds.

    Every byte of a text takes part: fixed windows of 128 bytes are classified in batches
    and their log-probabilities averaged, weighted by their bytes.  lang_pred is `und`
    (score 0) where the text is null or has no letter, and everywhere if nothing is
    labelled.  Only the text decides: id, label and other columns are never inputs of a
    prediction.  Columns named lang_pred or score are replaced.  Repeated rows are each
    predicted alike, texts of any length whole; an empty table gives an empty result.
    """
    net = train(docs.where(train_on), text_col, lang_col, id_col)
    docs = docs.drop("lang_pred", "score")
    if net is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    def label(batches):
        for b in slices(batches):
            lang, score = net.predict(b.column(text_col).to_pylist())
            yield b.append_column("lang_pred", pa.array(lang, pa.string())).append_column("score", pa.array(score, pa.float64()))

    schema = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    return docs.mapInArrow(label, schema)


def crc32_of_id(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))


def usual_score(net: ByteConvNet, labelled: DataFrame, share: float, id_col: str, text_col: str, lang_col: str) -> float:
    """The `share` quantile of the scores of all labelled texts with a letter, to five digits; 0 if there is none.

    Every labelled row is scored where it lies; Spark counts the rounded scores, so what one
    task holds is bounded by their digits.  Rows that repeat id, text and label count once.
    """
    some = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    rows = some.select(F.xxhash64(id_col, text_col, lang_col).alias("h"), F.sha2(F.col(text_col).cast("binary"), 256).alias("t"), F.col(text_col).alias("x"))

    def score(batches):
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(net.predict(b.column(2).to_pylist())[1], pa.float64())], ["h", "t", "s"])

    scores = rows.mapInArrow(score, "h long, t string, s double").where("s > 0").groupBy("h", "t").agg(F.max("s").alias("s"))
    counts = scores.groupBy(F.round("s", 5).alias("s")).agg(F.count("*").alias("n"))
    return counts.agg(F.percentile("s", share, F.col("n")).alias("q")).first()["q"] or 0.0


def reject_unknown(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float | None = None,
) -> DataFrame:
    """`docs`, all its columns, without texts that have no language.

    Rejected are null texts, texts without a letter and those whose best language has a
    probability below `least`.  Unless it is given, `least` is found on all labelled rows that
    were not learnt from: half of the probability that 99 % of them exceed, so that texts of
    the learnt languages stay (`usual_score`; rows that repeat id, text and label count once).  With few languages a text in
    another one may still have a high probability, and then it stays.  Where nothing is labelled only texts
    without a letter go.  Rows that repeat stay or go together; a null id counts as any
    other; an empty table gives an empty result.
    """
    fold = F.pmod(crc32_of_id(id_col), F.lit(3))
    net = train(docs.where(fold != 1), text_col, lang_col, id_col)
    if net is None:
        return docs.where(F.col(text_col).rlike(LETTER))
    if least is None:
        least = usual_score(net, docs.where(fold == 1), 0.01, id_col, text_col, lang_col) / 2

    def sift(batches):
        for b in slices(batches, 64):
            lang, score = net.predict(b.column(text_col).to_pylist())
            yield b.filter(pa.array([k != "und" and s >= least for k, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(sift, docs.schema)
