"""Toxicity: Levenshtein automata met with a lexicon trie, and scores of the words around."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import free_names, id_filter, materialize, slices

# Insults that are known before anything is learnt.
SEEDS = """idiot idiots moron morons stupid scum trash loser losers clown pathetic worthless disgusting imbecile bastard bitch asshole
dumbass jackass retard faggot whore slut vermin subhuman
vollidiot arschloch dummkopf abschaum schlampe missgeburt hurensohn wichser drecksau
connard connasse salaud salope ordure imbécile abruti enculé crétin
imbécil estúpido estúpida cabrón gilipollas hijoputa pendejo escoria""".split()
# Words that speak of a word or report one, and words that address someone.
MENTIONS = set("""said says wrote writes called calls word words term terms quote quoted quotes insult insults slur slurs sagte nannte wort wörter begriff
zitat dit disait mot mots terme citation dijo llamó palabra palabras término cita""".split())
ADDRESSES = set("you your you're youre yourself du dich dein deine tu toi ton vous tú te eres usted".split())
NEAR = 6  # words on either side that a match is judged by
QUOTED, PLAIN, DIRECTED = 0, 1, 2
_WORD = re.compile(r"\w(?:[\w*@$'’-]*\w)?")
_OPEN, _CLOSE = "“«„‹", "”»“›"


def reach(n: int) -> int:
    """Edits that a term of `n` letters allows."""
    return 0 if n < 4 else 1 if n < 8 else 2


class TermAutomaton:
    """Runs words through the Levenshtein automata of all terms at once.

    The terms are one trie.  A state is a set of (trie node, edits so far), what a word's
    letters so far can have come to by substitutions, insertions and deletions; sets and
    their steps are made when first met and kept, so a word takes a look-up a letter and
    ends with its first letters if no term begins like it.  A node carries the most
    edits that a term below it allows.
    """

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.kids: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]
        for i, t in enumerate(terms):
            at, most = 0, reach(len(t))
            self.most[0] = max(self.most[0], most)
            for c in t:
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                at = self.kids[at][c]
                self.most[at] = max(self.most[at], most)
            self.ends[at] = i
        self.letters = {c for k in self.kids for c in k}
        self.number: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[tuple[int, int], ...]] = []
        self.start = self._state({0: 0})

    def _state(self, edits: dict[int, int]) -> int:
        """The number of a set; deletions are followed first, and a node keeps its fewest edits."""
        todo = sorted(edits.items(), key=lambda x: x[1])
        best: dict[int, int] = {}
        while todo:
            node, e = todo.pop(0)
            if e > self.most[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            todo += [(k, e + 1) for k in self.kids[node].values()]
        key = frozenset(best.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.found.append(tuple(sorted((self.ends[n], e) for n, e in key if self.ends[n] >= 0 and e <= reach(len(self.terms[self.ends[n]])))))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        on: dict[int, int] = {}
        for node, e in self.sets[state]:
            on[node] = min(on.get(node, 99), e + 1)
            for letter, k in self.kids[node].items():
                on[k] = min(on.get(k, 99), e + (letter != c))
        return self._state(on)

    def matches(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of every term within its reach of `word`."""
        at, letters, steps = self.start, self.letters, self.steps
        for c in word:
            if c not in letters:
                c = ""
            to = steps[at].get(c)
            if to is None:
                to = steps[at][c] = self._step(at, c)
            if not self.sets[to]:
                return ()
            at = to
        return self.found[at]


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; signs within a word stay, as in sc*m."""
    return _WORD.findall((text or "").lower())


def place(text: str, spans: list[tuple[int, int]], words: list[str], i: int) -> int:
    """Whether the `i`-th word is quoted, stands plain or is said to someone.

    Signs of quotation are a pair of marks around it within `NEAR` words, and a word near it
    that reports or names words; a sign of abuse is a word near it that addresses someone.
    The side with more signs decides.
    """
    a, b = max(0, i - NEAR), min(len(words), i + NEAR + 1)
    begin, end = spans[a - 1][1] if a else 0, spans[b][0] if b < len(words) else len(text)
    before, after = text[begin : spans[i][0]], text[spans[i][1] : end]
    marks = any(before.rfind(o) > before.rfind(c) and c in after for o, c in zip(_OPEN, _CLOSE, strict=True))
    marks = marks or before.count('"') % 2 == 1 and '"' in after
    around = words[a:i] + words[i + 1 : b]
    quoted = marks + any(w in MENTIONS for w in around)
    directed = any(w in ADDRESSES for w in around)
    return QUOTED if quoted > directed else DIRECTED if directed > quoted else PLAIN


@dataclass
class Matcher:
    """Finds the terms of a text; remembers words, at most `KEEP` at a time."""

    automaton: TermAutomaton
    seen: dict[str, tuple] = field(default_factory=dict)
    KEEP = 1 << 18

    def of(self, text: str | None) -> list[tuple[int, int, int]]:
        """(term, edits, place) of the best term at each word that matches one: fewest edits, then the first."""
        low = (text or "").lower()
        words = _WORD.findall(low)
        seen, found = self.seen, set()
        for w in set(words):
            got = seen.get(w)
            if got is None:
                if len(seen) >= self.KEEP:
                    seen.clear()
                got = seen[w] = self.automaton.matches(w)
            if got:
                found.add(w)
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        out = []
        for i, w in enumerate(words):
            if w in found:
                edits, term = min((e, t) for t, e in seen.get(w) or self.automaton.matches(w))
                out.append((term, edits, place(low, spans, words, i)))
        return out


def _bound(hits: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Minus the log probability bound (Chernoff) of `hits` or more of `n` at the rate `base`; 0 if the rate is not above it."""
    p = hits / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log(p / base), 0) + np.where(p < 1, (1 - p) * np.log((1 - p) / (1 - base)), 0)
    return np.where(p > base, n * kl, 0)


def learn_terms(labelled: DataFrame, text: str, toxic: str, share: float, error: float) -> list[str]:
    """Words that toxic labelled texts hold and others do not, from all labelled texts.

    Texts with the same smallest hash of three words, as near copies have, are one witness: the one whose
    list of words comes last speaks for all.  Candidates have a share of `share` of the toxic
    witnesses, three at least, which bounds their number by the mean number of words of
    a text over `share`.  A word is taken if nine tenths of its witnesses are toxic and chance
    (Chernoff's bound, times the number of candidates) gives that with less than `error`.
    """
    def sign_of(words: list[str]) -> int:
        runs = zip(words, words[1:], words[2:]) if len(words) > 2 else [tuple(words)]
        return min(crc32("\n".join(r).encode("utf-8", "surrogatepass")) for r in runs)

    def tell(wanted: dict[str, int] | None):
        def run(batches):
            for b in slices(batches):
                signs, lists = [], []
                for t in b.column(text).to_pylist():
                    every = words_of(t)
                    found = sorted(set(every)) if wanted is None else sorted({wanted[w] for w in every if w in wanted})
                    if found:
                        signs.append(sign_of(every))
                        lists.append(found)
                yield pa.RecordBatch.from_arrays([pa.array(signs, pa.int64()), pa.array(lists, pa.list_(pa.string() if wanted is None else pa.int32()))], ["s", "w"])

        return run

    def witnesses(label: int, wanted: dict[str, int] | None = None) -> DataFrame:
        kind = "s long, w array<string>" if wanted is None else "s long, w array<int>"
        return labelled.where(F.col(toxic) == label).select(text).mapInArrow(tell(wanted), kind).groupBy("s").agg(F.max("w").alias("w"))

    bad = materialize(witnesses(1), "toxic-witnesses")
    least = max(3, math.ceil(share * bad.count()))
    some = bad.select(F.explode("w").alias("w")).groupBy("w").count().where(F.col("count") >= least).collect()  # at most words of a text / share
    hits = {r["w"]: r["count"] for r in some}
    words = sorted(hits)
    counts = {r["y"]: r["count"] for r in labelled.groupBy(F.col(toxic).alias("y")).count().collect()}
    base = counts.get(1, 0) / max(1, sum(counts.values()))
    if not words or not 0 < base < 1:
        return []
    other = witnesses(0, {w: i for i, w in enumerate(words)}).select(F.explode("w").alias("w")).groupBy("w").count().collect()
    t = np.array([hits[w] for w in words], float)
    n = t.copy()
    for r in other:
        n[r["w"]] += r["count"]
    take = (t / n >= 0.9) & (_bound(t, n, base) >= math.log(len(words) / error))
    return [w for w, ok in zip(words, take, strict=True) if ok]


@dataclass
class ToxicityModel:
    """Terms, the evidence of each by edits (log odds), and the weights of the texts' features."""

    terms: list[str]
    evidence: np.ndarray
    weights: np.ndarray

    def features(self, found: list[tuple[int, int, int]]) -> np.ndarray:
        """The most evidence of a match and the log of all evidence, of matches that are not quoted and of quoted ones; last, the most evidence of one said to someone."""
        x = np.zeros(5)
        for term, edits, at in found:
            e = max(0.0, self.evidence[term, edits])
            k = 2 if at == QUOTED else 0
            x[k] = max(x[k], e)
            x[k + 1] += e
            if at == DIRECTED:
                x[4] = max(x[4], e)
        x[1], x[3] = np.log1p(x[1]), np.log1p(x[3])
        return x

    def score(self, found: list[tuple[int, int, int]]) -> float:
        z = float(self.weights[0] + self.features(found) @ self.weights[1:])
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


#: The constant and weights that are taken where labels say nothing: quoted terms count little, those said to someone most.
PRIOR = np.array([-3.0, 1.0, 0.5, 0.1, 0.05, 0.3])


def fit_weights(x: np.ndarray, y: np.ndarray, pull: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, drawn to `PRIOR`; weights of evidence are not negative."""
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    w = PRIOR.copy()
    draw = np.full(len(w), pull)
    draw[0] = 1e-2 * pull

    def loss(w):
        z = a @ w
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (draw * (w - PRIOR) ** 2).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(draw), a.T @ (p - y) + draw * (w - PRIOR))
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(np.concatenate([(w - size * step)[:1], np.maximum(0, (w - size * step)[1:])])) > now:
            size /= 2
        new = w - size * step
        new[1:] = np.maximum(0, new[1:])
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w


def train(labelled: DataFrame, text: str, toxic: str, share: float = 0.003, error: float = 0.01, sample: int = 50_000) -> ToxicityModel:
    """A model from the rows of `labelled`, whose column `toxic` is 0 or 1.

    Terms, and the counts that give each term's evidence, come from all labelled rows.  The
    five features of about `sample` rows, drawn by a hash, fit the weights; no text is sent.
    """
    terms = sorted({*SEEDS, *learn_terms(labelled, text, toxic, share, error)})
    shared = labelled.sparkSession.sparkContext.broadcast(terms)  # bounded: seeds, and words of a text / share

    def look(batches):
        matcher = Matcher(TermAutomaton(shared.value))
        for b in slices(batches):
            found = [matcher.of(t) for t in b.column(text).to_pylist()]
            kind = pa.list_(pa.struct([("t", pa.int32()), ("e", pa.int32()), ("p", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(toxic).cast(pa.int32()), pa.array([[dict(t=t, e=e, p=p) for t, e, p in f] for f in found], kind)], ["y", "f"])

    seen = materialize(labelled.select(text, toxic).mapInArrow(look, "y int, f array<struct<t int, e int, p int>>"), "toxic-matches")
    counts = np.zeros((2, len(terms), 3))
    each = seen.select("y", F.explode(F.array_distinct(F.transform("f", lambda m: F.struct(m["t"].alias("t"), m["e"].alias("e"))))).alias("m"))
    for r in each.groupBy("y", "m.t", "m.e").count().collect():  # at most 6 a term
        counts[r["y"], r["t"], r["e"]] = r["count"]
    size = {r["y"]: r["count"] for r in seen.groupBy("y").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    base = n1 / (n0 + n1) if n0 + n1 else 0.1
    base = min(max(base, 1e-3), 1 - 1e-3)
    known = np.zeros((len(terms), 3))
    known[[t in set(SEEDS) for t in terms]] = (2.0, 0.5, 0.2)  # toxic texts that a seed counts beforehand
    t, c = counts[1] + 4 * base + known, counts[0] + 4 * (1 - base)
    evidence = np.log(t / c) - math.log(base / (1 - base))
    model = ToxicityModel(terms, evidence, PRIOR)
    if not (n0 and n1):
        return model
    low = F.shiftrightunsigned(F.xxhash64("y", "f", F.monotonically_increasing_id()), 1)
    some = seen.where(low < F.lit(min(2**63 - 1, 2**63 * sample // (n0 + n1))))
    rows = some.where(F.size("f") > 0).groupBy("y", "f").count().collect()  # about `sample` rows at most
    none = {r["y"]: r["count"] for r in some.where(F.size("f") == 0).groupBy("y").count().collect()}
    x = [model.features([(m["t"], m["e"], m["p"]) for m in r["f"]]) for r in rows for _ in range(r["count"])] + [np.zeros(5)] * sum(none.values())
    y = [r["y"] for r in rows for _ in range(r["count"])] + [k for k, n in none.items() for _ in range(n)]
    model.weights = fit_weights(np.array(x), np.array(y, float))
    return model


def score_toxicity(
    docs: DataFrame, labels: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", least: float = 0.3,
) -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 if the score is `least` or more).

    Learnt from the rows of `docs` where `train_on` holds and `labels` has a 0 or 1 for the
    id (the larger one if it has several).  Whole texts are scored, by what terms they hold,
    misspelt or not, and by what stands around; id, labels and other columns are no inputs.
    Null and empty texts score as texts without a term.  Repeated rows score alike.  Without
    labels the seeds and prior weights decide.  An empty table gives an empty result.
    Columns named score or predicted are replaced.
    """
    docs = docs.drop("score", "predicted")
    i, y, t = free_names(docs, 3)
    flags = labels.where(F.col(toxic_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(i)).agg(F.max(toxic_col).cast("int").alias(y))
    own = docs.where(train_on).select(F.col(id_col), F.col(text_col).alias(t))
    if dict(own.dtypes)[id_col] == dict(flags.dtypes)[i] == "bigint":
        flags = materialize(flags, "toxic-flags")
        known = id_filter(flags, i)

        def thin(batches):  # only texts that can have a label are shuffled
            for b in batches:
                ids = b.column(0)
                yield b.filter(pa.array(known.many(ids.fill_null(0).to_numpy(zero_copy_only=False)))) if b.num_rows else b

        own = own.mapInArrow(thin, own.schema)
    labelled = own.join(flags, own[id_col] == flags[i]).select(t, y)
    model = train(materialize(labelled, "toxic-labelled"), t, y)
    shared = docs.sparkSession.sparkContext.broadcast((model.terms, model.evidence, model.weights))

    def run(batches):
        model = ToxicityModel(*shared.value)
        matcher = Matcher(TermAutomaton(model.terms))
        for b in slices(batches):
            s = [model.score(matcher.of(x)) for x in b.column(text_col).to_pylist()]
            yield b.append_column("score", pa.array(s, pa.float64())).append_column("predicted", pa.array([int(v >= least) for v in s], pa.int32()))

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).withColumn("predicted", F.lit(0)).schema)
