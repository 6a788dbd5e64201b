"""Packing of tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import give_back, id_filter, materialize, slices

_LOOSE = re.compile(r" (?:\s|$)")


class ChunkEncoder:
    """Byte-level BPE ids of whole texts, four little-endian bytes an id.

    The vocabulary's own splitting pattern always begins a new piece at a space that a
    non-space follows, so that a text whose every space is followed by a non-space
    falls into independent chunks; chunks seen before come from a table of at most
    `keep` entries and the new ones of a batch are encoded in one call.  Any other text
    is encoded as a whole.  A text that holds the string of an added token goes through
    `tokenizers` itself, which gives that token's id; its tables are loaded for the first such text.
    """

    def __init__(self, stem: str, pattern: str, keep: int = 300_000):
        import tiktoken

        self.stem = stem
        with open(f"{stem}.json", encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{stem}.tiktoken", "rb"))}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            self.n_bytes[i] = len(piece)
        self.known: dict[str, bytes] = {}
        self.keep = keep

    @cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(f"{self.stem}.json")

    def forget(self) -> None:
        """Empty the table of chunks seen: the encoder stays with its worker, and other work takes its place."""
        self.known.clear()
        give_back()

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        new = [c for c in chunks if c not in self.known]
        fresh: dict[str, bytes] = {}
        for k in range(0, len(new), 20_000):
            part = new[k : k + 20_000]
            ids = np.array(self.encode(" " + " ".join(part)), "<u4")
            ends = np.cumsum([len(c.encode()) + 1 for c in part])
            cut = np.searchsorted(np.cumsum(self.n_bytes[ids]), ends) + 1
            raw, a = ids.tobytes(), 0
            for c, b in zip(part, (cut * 4).tolist(), strict=True):
                fresh[c] = raw[a:b]
                a = b
        for c in fresh:
            if len(self.known) >= self.keep:
                break
            self.known[c] = fresh[c]
        return fresh

    def _whole(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.encode(text), "<u4").tobytes()

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for k in range(0, len(texts), 500):
            part = [None if _LOOSE.search(t) or "\ud800" <= max(t, default="") <= "\udfff" or any(a in t for a in self.added) else t.split(" ") for t in texts[k : k + 500]]
            fresh = self._learn(set().union(*(p[1:] for p in part if p)))
            known, get = self.known, self.known.__getitem__

            def find(c, known=known, fresh=fresh):
                return known[c] if c in known else fresh[c]

            for t, p in zip(texts[k : k + 500], part, strict=True):
                if not p:
                    yield self._whole(t)
                    continue
                head = np.array(self.encode(p[0]), "<u4").tobytes()
                try:
                    yield head + b"".join(map(get, p[1:]))
                except KeyError:
                    yield head + b"".join(map(find, p[1:]))


_ENCODERS: dict = {}


def _encoder(path: str | None) -> ChunkEncoder:
    import public_tokenizers

    stem = path or public_tokenizers.path("byte_bpe_50k.json").removesuffix(".json")
    if stem not in _ENCODERS:
        _ENCODERS[stem] = ChunkEncoder(stem, public_tokenizers.PATTERN)
    return _ENCODERS[stem]


def best_fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """The multiset of lengths, within `counts`, of the largest sum up to `target`.

    Bounded subset sum on a bitset held in one integer: bit s tells that s can be
    reached.  Counts enter as powers of two; the bitsets before each step are kept so
    that the chosen counts can be walked back.
    """
    mask, reach, steps = (1 << (target + 1)) - 1, 1, []
    for n in sorted(counts, reverse=True):
        left, k = min(counts[n], target // n) if n else 0, 1
        while left > 0 and not reach >> target & 1:
            k = min(k, left)
            steps.append((n, k, reach))
            reach |= reach << (n * k) & mask
            left, k = left - k, k * 2
        if reach >> target & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for n, k, before in reversed(steps):
        if not before >> total & 1:
            chosen[n] = chosen.get(n, 0) + k
            total -= n * k
    return chosen


def slack_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Windows as (how many, {length: how many of it}), together using every length exactly.

    Each window takes the longest remaining length and the fill that leaves least
    slack; the same filling is repeated as often as the counts allow, so that the work
    depends on the number of different lengths (at most `capacity`), not of documents.
    """
    counts = {n: c for n, c in counts.items() if c > 0}
    plan = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        fill = best_fill({n: c for n, c in counts.items() if c}, capacity - longest)
        counts[longest] += 1
        fill[longest] = fill.get(longest, 0) + 1
        times = min(counts[n] // k for n, k in fill.items())
        for n, k in fill.items():
            counts[n] -= times * k
            if not counts[n]:
                del counts[n]
        plan.append((times, fill))
    return plan


def trimmed(plan: list[tuple[int, dict[int, int]]], capacity: int, padding: float) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """`plan` without its loosest windows, and the lengths that these held.

    Windows go, loosest first, until padding is at most that share of what is left.
    """
    def slack(fill):
        return capacity - sum(n * k for n, k in fill.items())

    windows = sum(times for times, _ in plan)
    loose = sum(times * slack(fill) for times, fill in plan)
    kept, freed = [], {}
    for times, fill in sorted(plan, key=lambda x: -slack(x[1])):
        own = slack(fill)
        gone = 0
        if loose > padding * capacity * windows and own > padding * capacity:
            # `gone` of these windows: (loose - gone * own) <= padding * capacity * (windows - gone)
            gone = min(times, -int(-(loose - padding * capacity * windows) // (own - padding * capacity)))
        windows, loose = windows - gone, loose - gone * own
        for n, k in fill.items() if gone else ():
            freed[n] = freed.get(n, 0) + gone * k
        if times > gone:
            kept.append((times - gone, fill))
    return kept, freed


def _slots(plan: list[tuple[int, dict[int, int]]], freed: dict[int, int]) -> list[tuple]:
    """For each length: where its ranks begin in each window kind, and the places there.

    Ranks beyond those stand one after the other in the stream of freed pieces: `stream`
    is the place of the first of them there.
    """
    used: dict[int, int] = {}
    rows: dict[int, list] = {n: [] for n in freed}
    first = 0
    for times, fill in plan:
        at = 0
        for n in sorted(fill, reverse=True):
            rows.setdefault(n, []).append((used.get(n, 0), first, fill[n], at))
            used[n] = used.get(n, 0) + times * fill[n]
            at += n * fill[n]
        first += times
    stream, out = 0, []
    for n, r in rows.items():
        out.append((n, *[[x[i] for x in r] for i in range(4)], used.get(n, 0), stream))
        stream += n * freed.get(n, 0)
    return out


PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, rank long"


def token_pieces(
    docs: DataFrame, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """Each document's ids, ended by `end_id`, cut every `capacity` ids: one row per piece.

    `rank` counts the pieces of one length within a task, `part` is the task.
    """

    def cut(batches):
        encode, end = _encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        seen, task = [0] * (capacity + 1), TaskContext.get().partitionId()
        for b in slices(batches):
            ids = b.column(0).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for doc, raw in zip(ids, encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                raw += end
                n = len(raw) // 4
                for s in range(0, n, capacity):
                    e = min(n, s + capacity)
                    for col, v in zip(out, (doc, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), n, seen[e - s]), strict=True):
                        col.append(v)
                    seen[e - s] += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            columns.insert(5, pa.array(np.full(len(out[0]), task, np.int32)))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "rank"])
        encode.forget()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, PIECES)


def _cut_crcs(docs: DataFrame, cut: DataFrame, capacity: int, end_id: int, id_col: str, text_col: str, vocabulary: str | None) -> DataFrame:
    """(doc_id, start, whole_crc, head, head_crc, tail_crc) of the pieces of `cut` (doc_id, start, ids_crc32, head).

    Only documents that may have such a piece are encoded again.
    """
    likely = id_filter(cut, "doc_id")

    def ids_of(batches):
        encode, end = _encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for b in slices(batches):
            doc = b.column(0).fill_null(0).to_numpy()
            b = b.filter(pa.array(likely.many(doc) | b.column(0).is_null().to_numpy(zero_copy_only=False)))
            out: list[list] = [[], [], [], []]
            for doc, raw in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                raw += end
                s = (len(raw) // 4 - 1) // capacity * capacity
                for col, v in zip(out, (doc, s, zlib.crc32(raw[4 * s :]), raw[4 * s :]), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, [pa.int64(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["doc", "at", "whole_crc", "ids"])
        encode.forget()

    def crcs(batches):
        for b in batches:
            raws, heads = b.column("ids").to_pylist(), b.column("head").to_pylist()
            two = [[zlib.crc32(r[: 4 * h]) for r, h in zip(raws, heads, strict=True)], [zlib.crc32(r[4 * h :]) for r, h in zip(raws, heads, strict=True)]]
            names = ["doc", "at", "whole_crc", "head"]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in names], *[pa.array(x, pa.int64()) for x in two]], [*names, "head_crc", "tail_crc"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(ids_of, "doc long, at long, whole_crc long, ids binary")
    want = cut.select("doc_id", "start", "ids_crc32", "head").distinct()
    same = F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("start")) & (F.col("whole_crc") == F.col("ids_crc32"))
    found = found.join(want, same).dropDuplicates(["doc", "at", "whole_crc", "head"])
    return found.select("doc", "at", "whole_crc", "head", "ids").mapInArrow(crcs, "doc long, at long, whole_crc long, head int, head_crc long, tail_crc long")


def pack(
    docs: DataFrame, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    vocabulary: str | None = None, padding: float = 0.005,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut every `capacity` ids; whole windows stand alone and the rests are
    packed by minimum bin slack.  Where these windows would hold more than the share
    `padding` of padding, the loosest are given up: what they held stands one after the
    other in further windows and is cut at their ends.  Only the table of lengths (at most `capacity` rows)
    reaches the driver.  A piece finds its place by its rank among the pieces of its
    length: ranks are counted within the tasks that cut the pieces, and the counts of
    earlier tasks come by a join, so no length is gathered or sorted.

    A null text is empty and gives the end id alone.  Rows that repeat an id are packed
    like any others, a null id too.  Strings of added tokens in a text give their ids.
    Extra columns are not read; an empty table gives an empty result.  `vocabulary` is the
    common part of the names of a .json and a .tiktoken file.
    """
    spark = docs.sparkSession
    pieces = token_pieces(docs, capacity, end_id, id_col, text_col, vocabulary).withColumn("row", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    whole, rest = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    sizes = materialize(rest.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, freed = trimmed(slack_plan(counts, capacity), capacity, padding)
    windows = sum(times for times, _ in plan)
    base = windows + -(-sum(n * k for n, k in freed.items()) // capacity)
    slots = spark.createDataFrame(
        _slots(plan, freed), "length int, ranks array<long>, firsts array<long>, each array<long>, at array<long>, planned long, stream long"
    )
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = (
        rest.join(sizes, ["length", "part"])
        .join(F.broadcast(slots), "length")  # at most `capacity` rows
        .withColumn("rank", F.col("before") + F.col("rank"))
        .withColumn("length", F.col("length").cast("long"))
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = whole.select("doc_id", "start", F.col("length").cast("long"), "ids_crc32", "doc_tokens", (F.lit(base) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    kind = F.size(F.filter("ranks", lambda r: r <= F.col("rank"))) - 1
    packed = placed.where("rank < planned").withColumn("kind", kind)
    ahead = F.col("rank") - F.get("ranks", F.col("kind"))
    each = F.get("each", F.col("kind"))
    packed = packed.withColumn("sequence_id", (F.get("firsts", F.col("kind")) + F.floor(ahead / each)).cast("long"))
    packed = packed.withColumn("offset", (F.get("at", F.col("kind")) + (ahead % each) * F.col("length")).cast("long"))
    out = full.unionByName(packed.select(*columns))
    if not freed:
        return out
    stream = placed.where("rank >= planned").withColumn("begin", F.col("stream") + (F.col("rank") - F.col("planned")) * F.col("length"))
    stream = stream.withColumn("sequence_id", F.floor(F.col("begin") / capacity) + windows).withColumn("offset", F.col("begin") % capacity)
    stream = materialize(stream.withColumn("head", F.least(F.col("length"), capacity - F.col("offset")).cast("int")).select(*columns, "head"), "stream")
    cut = stream.where("head < length")
    crcs = materialize(_cut_crcs(docs, cut, capacity, end_id, id_col, text_col, vocabulary), "cut-pieces")
    same = F.col("doc").eqNullSafe(F.col("doc_id")) & (F.col("at") == F.col("start")) & (F.col("whole_crc") == F.col("ids_crc32")) & (crcs["head"] == cut["head"])
    two = cut.join(crcs, same).select(
        "doc_id", "doc_tokens",
        F.inline(F.array(
            F.struct("start", cut["head"].cast("long").alias("length"), F.col("head_crc").alias("ids_crc32"), "sequence_id", "offset"),
            F.struct((F.col("start") + cut["head"]).alias("start"), (F.col("length") - cut["head"]).alias("length"), F.col("tail_crc").alias("ids_crc32"), (F.col("sequence_id") + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset")),
        )),
    )
    return out.unionByName(stream.where("head = length").select(*columns)).unionByName(two.select(*columns))


def sequences(docs: DataFrame, placed: DataFrame, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The token ids themselves: one row per sequence, (sequence_id, ids), unpadded.

    `docs` must have unique ids here (one may be null); rows of `placed` without a document
    are left out.  A null text is empty.  A sequence holds at most the packing's capacity;
    empty tables give an empty result.
    """

    def ids_of(batches):
        encode = _encoder(vocabulary)
        for b in slices(batches):
            starts, lengths = b.column("start").to_pylist(), b.column("length").to_pylist()
            raw = encode([t or "" for t in b.column("text").to_pylist()])
            ids = [np.append(np.frombuffer(r, "<u4"), end_id)[s : s + n].astype("int32") for r, s, n in zip(raw, starts, lengths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("sequence_id"), b.column("offset"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "offset", "ids"]
            )

    text = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = placed.select("doc_id", "sequence_id", "offset", "start", "length").join(text, F.col("doc_id").eqNullSafe(F.col("id")))
    rows = rows.select("sequence_id", "offset", "start", "length", "text").mapInArrow(ids_of, "sequence_id long, offset long, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
