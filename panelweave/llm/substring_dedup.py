"""Substring dedup: paragraphs and passages that repeat within or across documents, by MinHash banding."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import free_names, id_filter, materialize, slices
from panelweave.llm.trie_join import linked_components
from panelweave.llm.words import MULT, parity_sketches, set_hashes, text_bytes, word_hashes
from panelweave.llm.words import grams as _grams

RADIUS, LEAD = 6, 3  # a passage begins where a hash of LEAD words is the least of RADIUS neighbours on either side
_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
_BITS = np.uint64(44)  # of an n-gram's hash


def bands_for(num: int, den: int, rows: int, recall: float) -> int:
    """The least number of bands of `rows` minima by which a pair of similarity num/den meets with probability `recall`."""
    bands, miss = 1, 1 - (num / den) ** rows
    while miss**bands > 1 - recall:
        bands += 1
    return bands


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """`f` (minimum or maximum) over every `n` neighbours, by doubling."""
    have = 1
    while have < n:
        step = min(have, n - have)
        x = f(x[:-step], x[step:])
        have += step
    return x


def passage_cuts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Where passages begin, in the words `h` of documents of `sizes` words one after the other.

    A cut is where the hash of LEAD words is less than those of the RADIUS places before
    it and not more than those of the RADIUS after it, in its document: the words nearby
    decide alone, so equal passages are cut alike wherever they stand, and passages
    between two cuts have more than RADIUS words.  The first word of a document is a cut.
    """
    ends = np.cumsum(sizes)
    none = np.uint64((1 << 64) - 1)
    lead = np.full(len(h) + 2 * RADIUS * (len(sizes) + 1), none, np.uint64)
    # Documents stand RADIUS places apart, so that no document sees another.
    at = np.arange(len(h)) + RADIUS * (np.repeat(np.arange(len(sizes)), sizes) + 1)
    grams = np.concatenate([_grams(h, LEAD), np.full(min(LEAD - 1, len(h)), none, np.uint64)])
    for k in range(1, LEAD):
        last = ends - k
        grams[last[last >= 0]] = none
    lead[at] = grams
    least = _slide(lead, RADIUS, np.minimum)
    cut = (grams < least[at - RADIUS]) & (grams <= least[at + 1]) & (grams != none)
    cut[(ends - sizes)[sizes > 0]] = True
    return np.flatnonzero(cut)


class Units:
    """The paragraphs (first) and passages of some texts.

    text, word, words: the text, the first word and the number of words of each; items:
    the sorted distinct n-gram hashes of all units one after the other, unit k's from
    ends[k - 1] to ends[k].
    """

    def __init__(self, texts: list[bytes] | pa.Array, n: int, min_words: int, least: int):
        data, at = text_bytes(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary()))
        starts, h = word_hashes(data, at)
        lines = np.sort(np.concatenate([at[:-1], np.flatnonzero(data == 10) + 1]))
        in_line = np.diff(np.searchsorted(starts, lines), append=len(starts))
        sizes = np.diff(np.searchsorted(starts, at))
        begin = np.cumsum(sizes) - sizes
        long_lines = in_line >= min_words
        first, length = (np.cumsum(in_line) - in_line)[long_lines], in_line[long_lines]
        self.paragraphs = len(first)
        cuts = passage_cuts(h, sizes)
        run = np.diff(cuts, append=len(h))
        of = np.searchsorted(begin + sizes, cuts, "right")
        use = (run >= n) & (sizes[of] >= least) if len(cuts) else np.zeros(0, bool)
        first, length = np.concatenate([first, cuts[use]]), np.concatenate([length, run[use]])
        self.text = np.searchsorted(begin + sizes, first, "right")
        self.word, self.words = first - begin[self.text], length
        grams = length - n + 1
        stop = np.cumsum(grams)
        unit = np.repeat(np.arange(len(first), dtype=np.uint64), grams)
        at = np.arange(len(unit)) + np.repeat(first - stop + grams, grams)
        items = _grams(h, n)[at] >> (np.uint64(64) - _BITS)
        if len(first) < 1 << 20:
            both = np.sort(items | (unit << _BITS))
            items, unit = both & np.uint64((1 << 44) - 1), both >> _BITS
        else:  # a text of many million words
            order = np.lexsort((items, unit))
            items, unit = items[order], unit[order]
        new = np.ones(len(items), bool)
        new[1:] = (items[1:] != items[:-1]) | (unit[1:] != unit[:-1])
        self.items, unit = items[new], unit[new].astype(np.int64)
        self.size = np.bincount(unit, minlength=len(first))
        self.ends = np.cumsum(self.size)
        
    def nodes(self) -> np.ndarray:
        """A 64-bit hash of each set; sets of paragraphs and of passages never share one but by chance."""
        return set_hashes(self.items, self.size, (np.arange(len(self.size)) < self.paragraphs).astype(np.uint64) << np.uint64(40))

    def keys(self, bands: tuple[int, int], rows: tuple[int, int]) -> list[np.ndarray]:
        """The band keys of paragraphs, then of passages: arrays of (units, bands)."""
        cut = int(self.ends[self.paragraphs - 1]) if self.paragraphs else 0
        starts = self.ends - self.size
        out = []
        for kind, (items, first) in enumerate(((self.items[:cut], starts[: self.paragraphs]), (self.items[cut:], starts[self.paragraphs :] - cut))):
            rng = np.random.default_rng(20 + kind)
            a = rng.integers(1, 1 << 63, (rows[kind], bands[kind]), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            b = rng.integers(0, 1 << 63, (rows[kind], bands[kind]), dtype=np.uint64)
            keys = np.repeat((np.arange(bands[kind]) + 64 * kind).astype(np.uint64)[None, :], len(first), axis=0)
            for r, k in np.ndindex(*a.shape):
                if len(first):
                    x = items * a[r, k] + b[r, k]
                    x ^= x >> np.uint64(31)
                    x *= MULT
                    keys[:, k] = (keys[:, k] ^ np.minimum.reduceat(x, first)) * MULT
            out.append((keys ^ (keys >> np.uint64(29))).view(np.int64))
        return out

    def sketches(self) -> list[bytes]:
        """`trie_join.parity_sketch` of each unit."""
        return parity_sketches(self.items, self.size)


def _bulks(batches, n: int, min_words: int, least: int, words: int = 100_000):
    """(doc_ids, text hashes, Units) of the texts of Arrow batches (doc_id, text_hash, text), some at a time."""
    for b in slices(batches):
        full = b.filter(pa.compute.greater(pa.compute.binary_length(b.column(2)), 0))
        todo = np.cumsum(pa.compute.binary_length(full.column(2)).to_numpy()) // (6 * words) if full.num_rows else np.zeros(0)
        ends = np.flatnonzero(np.diff(todo, append=-1)) + 1
        for a, z in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
            part = full.slice(a, z - a)
            yield part.column(0), part.column(1), Units(part.column(2), n, min_words, least)


def repeated_units(
    docs: DataFrame, min_words: int = 20, least: int = 20, n: int = 5, num: int = 80, den: int = 100, recall: float = 0.99,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Every stretch of words that repeats an earlier one: doc_id, text_hash, word, words, keep_doc_id.

    Units are paragraphs (what stands between newlines) of at least `min_words` words, and
    passages that content cuts out of the whole stream of words, across lines
    (`passage_cuts`).  Units are compared as sets of word n-grams: equal sets are one
    class; classes of one kind that share a MinHash band are candidates, verified by the
    exact Jaccard similarity (>= num/den) of whole sets; linked classes form components.
    Bands are tuned so that a pair of just that similarity meets with probability `recall`.

    Of a component the first occurrence, by id (null first), text hash and place, stays
    and all others repeat it.  Paragraphs come first: passages that overlap a repeated
    paragraph are left out, then neighbouring repeated passages of a document are joined,
    and those of at least `least` words in all are given.  Documents are told apart by id
    and text, so rows that repeat both are one document and do not repeat each other.
    Null and empty texts have no unit; extra columns are not read.
    """
    if min(min_words, RADIUS + 1) < n:
        raise ValueError(f"units of fewer than {n} words have no {n}-gram")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    rows = (2, 1)
    bands = tuple(bands_for(num, den, r, recall) for r in rows)

    def sign(batches):
        for docs_, hashes, u in _bulks(batches, n, min_words, least):
            two = u.keys(bands, rows)
            ends = np.concatenate([np.arange(len(two[0])) * bands[0], len(two[0]) * bands[0] + np.arange(len(two[1]) + 1) * bands[1]])
            keys = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([x.reshape(-1) for x in two])))
            of = pa.array(u.text)
            columns = [
                docs_.take(of), hashes.take(of), pa.array(np.arange(len(u.size)) >= u.paragraphs), pa.array(u.word.astype(np.int32)),
                pa.array(u.words.astype(np.int32)), pa.array(u.size), pa.array(u.nodes()), keys, pa.array(u.sketches(), pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "passage", "word", "words", "size", "node", "keys", "sketch"])

    schema = "doc_id long, text_hash long, passage boolean, word int, words int, size long, node long, keys array<long>, sketch binary"
    units = materialize(source.mapInArrow(sign, schema), "units")
    # Most units share no band with any other: only those that may are looked at further.
    again = materialize(units.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "repeated-keys")
    likely = id_filter(again, "key")

    def shared(batches):
        for b in batches:
            keys = b.column("keys")
            hit = likely.many(keys.values.to_numpy()[keys.offsets[0].as_py() : keys.offsets[-1].as_py()])
            first = keys.offsets.to_numpy()[:-1] - keys.offsets[0].as_py()
            yield b.filter(pa.array(np.logical_or.reduceat(hit, first) if len(first) else np.zeros(0, bool)))

    live = materialize(units.mapInArrow(shared, units.schema).dropDuplicates(["doc_id", "text_hash", "passage", "word"]), "shared-units")
    place = F.struct("doc_id", "text_hash", "word")
    classes = live.groupBy("node", "size").agg(F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.min("text_hash").alias("text_hash"))
    classes = materialize(classes, "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted, texts = id_filter(nodes, "node"), id_filter(classes.join(nodes, "node", "left_semi").select("text_hash"), "text_hash")

        def whole(batches):
            for b in batches:
                keep = b.filter(pa.array(texts.many(b.column("text_hash").to_numpy())))
                for _, _, u in _bulks([keep], n, min_words, least):
                    node = u.nodes()
                    use = np.flatnonzero(wanted.many(node))
                    items = [u.items[u.ends[k] - u.size[k] : u.ends[k]].astype("<u8").tobytes() for k in use.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(node[use]), pa.array(items, pa.binary())], ["node", "items"])

        sets = source.mapInArrow(whole, "node long, items binary")
        return sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("items").alias("items"))

    keys = classes.select(F.explode("keys").alias("key"), "node", "size")
    _, comp = linked_components(classes.select("node", "size", "sketch"), keys, sets_of, num, den, by_tree=False)
    member = live.join(comp, "node", "left").select("doc_id", "text_hash", "passage", "word", "words", F.coalesce("component", "node").alias("component"))
    member = materialize(member, "members")

    def repeats(some: DataFrame) -> DataFrame:
        keep = some.groupBy("component").agg(F.min(place).alias("keep"), F.count("*").alias("c")).where("c > 1").select("component", "keep")
        found = some.join(keep, "component").where(place != F.col("keep"))
        return found.select("doc_id", "text_hash", "word", "words", F.col("keep.doc_id").alias("keep_doc_id"))

    paragraphs = materialize(repeats(member.where("not passage")), "repeated-paragraphs")
    # A passage that overlaps a repeated paragraph: some paragraph before it ends within it, or one begins within it.
    w = Window.partitionBy("doc_id", "text_hash").orderBy("word", "passage")
    both = member.where("passage").unionByName(paragraphs.select("doc_id", "text_hash", F.lit(False).alias("passage"), "word", "words", F.lit(None).cast("long").alias("component")))
    mine = F.when(~F.col("passage"), F.col("word"))
    reach = F.max(mine + F.col("words")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    begin = F.min(mine).over(w.rowsBetween(1, Window.unboundedFollowing))
    free = both.withColumn("reach", reach).withColumn("begin", begin).where("passage and coalesce(reach <= word, true) and coalesce(begin >= word + words, true)")
    found = repeats(free.select("doc_id", "text_hash", "word", "words", "component"))
    w = Window.partitionBy("doc_id", "text_hash").orderBy("word")
    new = F.coalesce(F.lag(F.col("word") + F.col("words")).over(w) != F.col("word"), F.lit(True))
    chains = found.withColumn("new", new.cast("int")).withColumn("chain", F.sum("new").over(w))
    chains = chains.groupBy("doc_id", "text_hash", "chain").agg(F.min("word").alias("word"), F.sum("words").cast("int").alias("words"), F.min_by("keep_doc_id", "word").alias("keep_doc_id"))
    return paragraphs.unionByName(chains.where(F.col("words") >= least).drop("chain"))


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of `spans` (first word, number of words; in order, neighbours count as one).

    White space before a span goes with it; from a span that begins a line and ends within
    one, the white space after it goes.
    """
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw)]
    whole: list[list[int]] = []
    for a, n in spans:
        if whole and a <= whole[-1][0] + whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], a + n - whole[-1][0])
        else:
            whole.append([a, n])
    out, done = [], 0
    for a, n in whole:
        z = a + n
        begins = a == 0 or b"\n" in raw[at[a - 1][1] : at[a][0]]
        ends = z == len(at) or b"\n" in raw[at[z - 1][1] : at[z][0]]
        if a == 0 or (begins and not ends):
            cut = (at[a][0], at[z][0] if z < len(at) else len(raw))
        else:
            cut = (at[a - 1][1], at[z - 1][1])
        out.append(raw[done : max(done, cut[0])])
        done = max(done, cut[1])
    return b"".join([*out, raw[done:]]).decode("utf-8", "surrogatepass")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detail: str | None = None, **how) -> DataFrame:
    """`docs`, all columns and rows, with repeated paragraphs and passages taken out of the text.

    With `detail` a column of that name is added: what was removed, an array of (word,
    words, keep_doc_id) in order, null for nothing; places are those in the text as given.
    What counts as a repeat: see `repeated_units`.  Null texts stay null; a text may become
    empty; repeated rows are treated alike; an empty table gives an empty result.
    """
    gone = repeated_units(docs, id_col=id_col, text_col=text_col, **how)
    gone = gone.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("word", "words", "keep_doc_id"))).alias("spans"))
    gone = materialize(gone, "spans")
    likely = id_filter(gone, "text_hash")
    own_id, own_hash, gone_id, gone_hash, spans = free_names(docs, 5)
    marked = docs.withColumns({own_id: F.col(f"`{id_col}`").cast("long"), own_hash: F.xxhash64(f"`{text_col}`")})

    def part(wanted: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(likely.many(b.column(own_hash).to_numpy()) == wanted))

        return marked.mapInArrow(run, marked.schema)

    # Only texts that may have repeats are dealt out for the join.
    names = docs.columns
    gone = gone.toDF(gone_id, gone_hash, spans)
    hit = part(True).join(gone, F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_hash) == F.col(gone_hash)), "left")
    hit = hit.select(*[F.col(f"`{c}`") for c in names], spans)
    out_schema = hit.withColumnRenamed(spans, detail).schema if detail else docs.schema

    def cut(batches):
        for b in slices(batches):
            k = b.schema.get_field_index(text_col)
            texts = b.column(k).to_pylist()
            for i, r in enumerate(b.column(spans).to_pylist()):
                if r:
                    texts[i] = without_words(texts[i], [(x["word"], x["words"]) for x in r])
            columns = [pa.array(texts, f.type) if f.name == text_col else b.column(j) for j, f in enumerate(b.schema)]
            columns, fields = (columns, [*names, detail]) if detail else (columns[:-1], names)
            yield pa.RecordBatch.from_arrays(columns, fields)

    rest = part(False).select(*[F.col(f"`{c}`") for c in names])
    if detail:
        rest = rest.withColumn(detail, F.lit(None).cast(out_schema[detail].dataType))
    return hit.mapInArrow(cut, out_schema).unionByName(rest)
