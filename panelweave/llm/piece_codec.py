"""SentencePiece encoding with seeded merge-dropout, and lossless decoding."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import slices

SPACE = "▁"
NONE = np.int32(1 << 30)  # a pair that is no candidate
WIDEST = 48  # longer chunks take the agenda one by one
BULK = 1 << 20  # characters that are worked on at once
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_M4, _M5 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class PairTable:
    """(left symbol, right symbol) -> joined piece, for arrays: each pair lies at one of two places."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(8, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table = np.full(1 << bits, -1, np.int64)
        for (a, b), joined in pairs.items():
            entry, first = (a << 40) | (b << 20) | joined, True
            for _ in range(500):
                at = self._places(np.array([entry >> 20], np.int64))[0 if first else 1][0]
                entry, self.table[at] = int(self.table[at]), entry
                if entry < 0:
                    break
                first = bool(self._places(np.array([entry >> 20], np.int64))[0][0] != at)
            else:
                raise ValueError("the pair table is too full")

    def _places(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = key.view(np.uint64)
        return (k * _M1) >> self.shift, (k * _M2) >> self.shift

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The joined piece, or -1; symbols below 0 join with nothing."""
        key = (a.astype(np.int64) << 20) | b
        one, two = self._places(key)
        x, y = self.table[one], self.table[two]
        hit = (x >> 20) == key
        x = np.where(hit, x, y)
        hit |= (y >> 20) == key
        return np.where(hit & (a >= 0) & (b >= 0), x & 0xFFFFF, -1).astype(np.int32)


class PieceCodec:
    """BPE over the pieces and scores of a SentencePiece model with byte fallback.

    A text is the space mark, then the text with spaces as space marks; a space mark in
    the text itself is spelt in bytes, as is any character without a piece, so that
    decoding gives back the text exactly.  Two neighbours that stand next to each other in
    no piece are never joined, so a text falls into independent chunks there.  Chunks of
    many texts are worked on side by side, each by its own agenda: at every step a chunk
    takes its best candidate (best score, then leftmost).
    """

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 0):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.n_pieces = n
        self.bytes_of: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: list[float] = []
        self.byte_id = np.zeros(256, np.int32)
        for i in range(n):
            piece = sp.id_to_piece(i)
            self.score.append(sp.get_score(i))
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                self.ids[piece] = i
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if SPACE not in self.ids or any(SPACE in p.lstrip(SPACE) or " " in p for p in self.ids):
            raise ValueError("a piece spans words, or the space mark is no piece")
        # Symbols: pieces by their ids, then the characters that occur in pieces only.
        symbol = dict(self.ids)
        for p in self.ids:
            for c in p:
                symbol.setdefault(c, len(symbol) + n)
        order = sorted({-self.score[i] for i in self.ids.values()})
        rank = {s: k for k, s in enumerate(order)}
        self.rank = np.full(n + 1, NONE >> 6, np.int32)  # the last stands for no piece
        pairs, near = {}, set()
        for p, i in self.ids.items():
            self.rank[i] = rank[-self.score[i]]
            near.update(zip(p, p[1:], strict=False))
            for k in range(1, len(p)):
                a, b = symbol.get(p[:k]), symbol.get(p[k:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        self.pairs = PairTable(pairs)
        self.near = np.zeros(1 << 20, bool)  # by a hash: a false hit only makes a chunk longer
        for a, b in near:
            self.near[self._near_at(np.array([symbol[a]], np.int32), np.array([symbol[b]], np.int32))] = True
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = i
        self.symbol_of[ord(" ")], self.symbol_of[ord(SPACE)] = self.ids[SPACE], -1
        self.limit = np.uint64(int(dropout * 2**32))
        self.seed = np.uint64((seed * 0x8EBC6AF09C88C6E3 + 0xE7037ED1A0B428DB) & (1 << 64) - 1)

    @staticmethod
    def _near_at(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * _M1 + b.astype(np.uint64) * _M2) >> np.uint64(44)).astype(np.int64)

    def base(self, keys: np.ndarray) -> np.ndarray:
        """What the draws of a text begin with, from the keys of the texts (int64)."""
        x = (keys.view(np.uint64) ^ self.seed) * _M4
        return x ^ (x >> np.uint64(32))

    def dropped(self, base: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Is the candidate that joins the characters start..middle and middle..end skipped?"""
        x = base ^ (start.astype(np.uint64) * _M1 + middle.astype(np.uint64) * _M2 + end.astype(np.uint64) * _M3)
        x = (x ^ (x >> np.uint64(32))) * _M4
        x = (x ^ (x >> np.uint64(29))) * _M5
        return (x >> np.uint64(32)) < self.limit

    def _agenda(self, symbols: list[int], place: int, base: np.ndarray) -> list[int]:
        """One chunk by an agenda of merges; its symbols, -2 where one is part of another."""
        n, agenda = len(symbols), []
        sym, left, right = [*symbols], list(range(-1, n - 1)), [*range(1, n), n]

        def offer(a: int, b: int):
            joined = int(self.pairs.find(np.array([sym[a]], np.int32), np.array([sym[b]], np.int32))[0])
            if joined >= 0:
                heapq.heappush(agenda, (int(self.rank[joined]), a, b, right[b], joined))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, z, joined = heapq.heappop(agenda)
            if sym[a] == -2 or sym[b] == -2 or right[a] != b or right[b] != z:
                continue
            if self.limit and self.dropped(base, *(np.array([place + x]) for x in (a, b, z)))[0]:
                continue
            sym[a], sym[b], right[a] = joined, -2, z
            if z < n:
                left[z] = a
                offer(a, z)
            if left[a] >= 0:
                offer(left[a], a)
        return sym

    def _merge(self, out: np.ndarray, at: np.ndarray, size: np.ndarray, place: np.ndarray, base: np.ndarray) -> None:
        """Chunks side by side, a column each, from `at` on; `out` takes their symbols."""
        most, n = int(size.max()), len(at)
        row = np.arange(most + 2, dtype=np.int32)[:, None]
        sym = np.full((most + 2, n), -1, np.int32)  # rows 0 and most + 1 are borders
        sym[1:-1] = out[np.minimum(at + row[:-2], len(out) - 1)]
        sym[1:-1][row[:-2] >= size] = -1
        joined = self.pairs.find(sym[:-1], sym[1:])
        best_of = self.rank[joined] * 64 + row[:-1]
        left, right = np.repeat(row - 1, n, 1), np.repeat(row + 1, n, 1)

        def put(columns):
            inside = row[:-2] < size[columns]
            out[(at[columns] + row[:-2])[inside]] = sym[1:-1, columns][inside]

        while True:
            best = best_of.min(0)
            on = np.flatnonzero(best < NONE)
            if 2 * len(on) < n:
                put(np.flatnonzero(best >= NONE))
                if not len(on):
                    return
                sym, joined, best_of, left, right = (np.ascontiguousarray(x[:, on]) for x in (sym, joined, best_of, left, right))
                at, size, place, base, best = at[on], size[on], place[on], base[on], best[on]
                n, on = len(on), np.arange(len(on))
            s, g, c, l, r = (x.reshape(-1) for x in (sym, joined, best_of, left, right))
            a = best[on] & 63
            b = r[a * n + on]
            z = r[b * n + on]
            if self.limit:
                p = place[on] - 1
                drop = self.dropped(base[on], p + a, p + b, p + z)
                c[(a * n + on)[drop]] = NONE
                keep = ~drop
                a, b, z, on = a[keep], b[keep], z[keep], on[keep]
            ia, ib, iz = a * n + on, b * n + on, z * n + on
            new = g[ia]
            s[ia], s[ib], c[ib], r[ia], l[iz] = new, -2, NONE, z, a
            g[ia] = after = self.pairs.find(new, s[iz])
            c[ia] = self.rank[after] * 64 + a
            w = l[ia]
            iw = w * n + on
            g[iw] = before = self.pairs.find(s[iw], new)
            c[iw] = self.rank[before] * 64 + w

    def _bulk(self, texts: list[str], bases: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts (not empty, led by their space) one after the other, and how many each has."""
        code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes) - sizes
        out = self.symbol_of[code]
        together = self.near[self._near_at(out[:-1], out[1:])] & (out[:-1] >= 0) & (out[1:] >= 0)
        together[begin[1:] - 1] = False
        first = np.concatenate([[0], np.flatnonzero(~together) + 1])
        length = np.diff(first, append=len(out))
        first, length = first[length > 1], length[length > 1]
        of = np.searchsorted(begin, first, "right") - 1
        place = first - begin[of] + places[of]
        order = np.argsort(np.minimum(length, WIDEST + 1).astype(np.int8), kind="stable")
        a = 0
        while a < len(order):
            k = order[a]
            if length[k] > WIDEST:
                break
            z = a + max(64, (1 << 18) // int(length[k]))
            some = order[a:z]
            some = some[length[some] <= min(WIDEST, length[k] + 1 + length[k] // 4)]
            self._merge(out, first[some], length[some], place[some], bases[of[some]])
            a += len(some)
        for k in order[a:].tolist():
            f, n = int(first[k]), int(length[k])
            out[f : f + n] = self._agenda(out[f : f + n].tolist(), int(place[k]), bases[of[k] : of[k] + 1])
        spelt = (out == -1) | (out >= self.n_pieces)
        n_bytes = np.where(spelt, 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000), (out >= 0).astype(np.int8))
        count = np.add.reduceat(n_bytes, begin, dtype=np.int64)
        if not spelt.any():
            return out[out >= 0], count
        ends = np.cumsum(n_bytes, dtype=np.int64)
        ids = np.empty(int(ends[-1]), np.int32)
        whole = (out >= 0) & ~spelt
        ids[ends[whole] - 1] = out[whole]
        cp, n, end = code[spelt].astype(np.int64), n_bytes[spelt], ends[spelt]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        for k in range(4):  # the k-th byte from the end
            has = n > k
            byte = np.where(n == k + 1, lead | (cp >> 6 * k), 0x80 | (cp >> 6 * k & 0x3F))
            ids[end[has] - 1 - k] = self.byte_id[byte[has]]
        return ids, count

    def encode_many(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text; equal seeds and keys give equal segmentations.

        Each candidate merge is skipped on its own with the probability `dropout`, by a hash
        of the seed, the key and the places in the text of the two symbols that it joins.
        A skipped pair comes up again only after one of its symbols has changed.
        """
        bases = self.base(np.array([k & (1 << 64) - 1 for k in keys], np.uint64).view(np.int64))
        found: list[list[np.ndarray]] = [[] for _ in texts]
        some, own, at, n = [], [], [], 0

        def flush():
            ids, count = self._bulk(some, bases[own], np.array(at))
            for k, x in zip(own, np.split(ids, np.cumsum(count)[:-1]), strict=True):
                found[k].append(x)

        for k, t in enumerate(texts):
            if not t:
                continue
            t, a = " " + t, 0
            while a < len(t):
                z = len(t)
                if z - a > BULK:  # a long text is cut where a space follows another character
                    z = t.rfind(" ", a + 1, a + BULK)
                    while z > a and t[z - 1] == " ":
                        z -= 1
                    z = z if z > a else len(t)
                some.append(t[a:z])
                own.append(k)
                at.append(a)
                n += z - a
                a = z
                if n > BULK:
                    flush()
                    some, own, at, n = [], [], [], 0
        if some:
            flush()
        return [np.concatenate(x) if x else np.zeros(0, np.int32) for x in found]

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        """Ids of one text (see `encode_many`)."""
        return self.encode_many([text], [key])[0]

    def decode(self, ids) -> str:
        """The text of the ids: the leading space of the first piece is not part of it.

        Bytes that are no valid UTF-8 (ids that no text has) become replacement characters.
        """
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist() if hasattr(ids, "tolist") else ids))[1:]
        try:
            return raw.decode("utf-8", "surrogatepass")
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace")


_CODECS: dict = {}


def _codec(path: str | None, *how) -> PieceCodec:
    import public_tokenizers

    key = (path or public_tokenizers.path("piece_bpe_32k.model"), *how)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(*key)
    return _CODECS[key]


def encode_pieces(
    docs: DataFrame, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", model: str | None = None,
) -> DataFrame:
    """doc_id, n_pieces, ids: every whole text encoded with seeded merge-dropout.

    The same seed, id and text give the same ids on any partitioning.  A null text gives
    null ids and 0 pieces, an empty one no pieces; a null id draws as id 0 does.  A very
    long text is encoded in parts that no merge could join.  Repeated rows are each encoded
    alike; extra columns are not read; an empty table gives an empty result.
    """

    def run(batches):
        codec = _codec(model, dropout, seed)
        for b in slices(batches):
            docs_, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            a = 0
            while a < len(texts):
                z, n = a, 0
                while z < len(texts) and (z == a or n < 4 * BULK):
                    n += len(texts[z] or "")
                    z += 1
                got = codec.encode_many([t or "" for t in texts[a:z]], [d or 0 for d in docs_[a:z]])
                sizes = np.array([len(x) for x in got])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(got)), mask=pa.array([t is None for t in texts[a:z]])
                )
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(sizes, pa.int64()), lists], ["doc_id", "n_pieces", "ids"])
                a = z

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, n_pieces long, ids array<int>")


def decode_pieces(encoded: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """`encoded`, all columns, with the column `text` (replaced, if there) decoded from its ids.

    Null ids give a null text, no ids an empty one; ids outside the model raise an error,
    bytes that are no UTF-8 become replacement characters.  Repeated rows are each decoded;
    an empty table gives an empty result.
    """

    def run(batches):
        codec = _codec(model, 0.0, 0)
        for b in slices(batches):
            yield b.append_column("text", pa.array([None if x is None else codec.decode(x) for x in b.column(ids_col).to_pylist()], pa.string()))

    encoded = encoded.drop("text")
    return encoded.mapInArrow(run, encoded.withColumn("text", F.lit(None).cast("string")).schema)
