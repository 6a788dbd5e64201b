"""Set-similarity links inside groups, found with a prefix tree, and their components.

Both near-duplicate operators use this: candidates come as rows (key, node, size), the
sets as rows (node, items).  Sets are sorted in one global order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import BUCKETS, bucket_counts, components, materialize, slices

BLOCK = 256
HOT = 8  # blocks of a group beyond which it is dealt out again by a second item
HOT_SMALL = 1  # the same for groups of small sets, which are dealt out by their rarest items


class PrefixTree:
    """Sorted sets in a path-compressed trie; each node knows the sizes that lie below it.

    `search` walks the tree once per probe.  A node's overlap with the probe is counted
    once for all sets that share its path, and a subtree is left as soon as the overlap
    so far plus what can still be met in it cannot reach the required overlap, and not
    entered if it holds none of the members that the search is for.
    """

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        order = sorted(range(len(sets)), key=lambda i: sets[i].tobytes() if sets[i].dtype.byteorder == ">" else sets[i].astype(">u8").tobytes())
        self.place = np.argsort(order)
        self.root = self._build(order, 0, 0)

    def _build(self, members: list[int], depth: int, at: int):
        """(begin, end, set that spells the segment, sets ending here, children, least and most size, range of places in order)."""
        first, last = self.sets[members[0]], self.sets[members[-1]]
        n = min(len(first), len(last))
        same = np.flatnonzero(first[depth:n] != last[depth:n])
        end = depth + int(same[0]) if len(same) else n
        ending = [m for m in members if len(self.sets[m]) == end]
        rest = [m for m in members if len(self.sets[m]) > end]
        children, a = [], 0
        while a < len(rest):
            b = a
            while b < len(rest) and self.sets[rest[b]][end] == self.sets[rest[a]][end]:
                b += 1
            children.append(self._build(rest[a:b], end, at + len(ending) + a))
            a = b
        sizes = [len(self.sets[m]) for m in members]
        return depth, end, members[0], ending, children, min(sizes), max(sizes), at, at + len(members)

    def search(self, probe: np.ndarray, num: int, den: int, skip=lambda m: False, among: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
        """(member, overlap) of every member (`among`: of these alone) with den * overlap >= num * union."""
        n = len(probe)
        places = None if among is None else np.sort(self.place[among]).tolist()
        wanted = None if among is None else set(among.tolist())
        stack = [(self.root, 0, 0)]
        while stack:
            (depth, end, spell, ending, children, least, most, _, _), overlap, met = stack.pop()
            if den * min(n, most) < num * max(n, least):
                continue
            seg = self.sets[spell][depth:end]
            at = np.searchsorted(probe[met:], seg)
            hit = at < n - met
            hit[hit] = probe[met:][at[hit]] == seg[hit]
            overlap += int(hit.sum())
            if len(seg):
                met += int(at[-1]) + bool(hit[-1])
            for m in ending:
                if (wanted is None or m in wanted) and not skip(m) and (den + num) * overlap >= num * (n + end):
                    yield m, overlap
            # The required overlap with any set below is at least num * (n + least) / (den + num).
            if children and (den + num) * (overlap + min(n - met, most - end)) >= num * (n + max(least, end)):
                if places is not None:
                    children = _holding(children, places)
                stack += [(c, overlap, met) for c in children]


def _holding(children: list[tuple], places: list[int]) -> list[tuple]:
    """Those of a node's children, which follow each other, that hold one of the sorted `places`."""
    found, k = [], bisect_left(places, children[0][-2])
    while k < len(places) and places[k] < children[-1][-1]:
        c = children[bisect_right(children, places[k], key=lambda c: c[-2]) - 1]
        found.append(c)
        k = bisect_left(places, c[-1], k)
    return found


def parity_sketch(s: np.ndarray) -> bytes:
    """Parities of how many items fall on each of b bits, b the power of two at or above the size.

    Two sketches differ in at most as many bits as their sets have unshared items, so a
    pair whose sketches differ in more bits than its similarity allows is no link.
    """
    b = max(64, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1, bitorder="little").tobytes()


def _words(sketch: bytes, n: int) -> np.ndarray:
    """The sketch as 64-bit words, folded to `n` of them."""
    w = np.frombuffer(sketch, np.uint64)
    while len(w) > n:
        w = w[: len(w) // 2] ^ w[len(w) // 2 :]
    return w


def may_link(a: bytes, b: bytes, sizes: int, num: int, den: int) -> bool:
    """False only if the sketches prove that the sets do not link; `sizes`: both sizes together."""
    n = min(len(a), len(b)) // 8
    apart = int(np.bitwise_count(_words(a, n) ^ _words(b, n)).sum())
    return (den + num) * apart <= (den - num) * sizes


class Sketches:
    """The sketches of some sets; `near` asks for those that a further set may link with."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        sketch = [parity_sketch(s) for s in sets]
        width = np.array([len(x) // 8 for x in sketch])
        self.of = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
        self.tables = {(w, w): np.stack([_words(sketch[i], w) for i in ix]) for w, ix in self.of.items()}

    def near(self, probe: np.ndarray, num: int, den: int) -> np.ndarray:
        """The sorted numbers of all sets but those that sizes and sketches prove not to link with `probe`."""
        sketch, out = parity_sketch(probe), []
        for w, ix in self.of.items():
            size = self.size[ix]
            fit = den * np.minimum(size, len(probe)) >= num * np.maximum(size, len(probe))
            if not fit.any():
                continue
            n = min(w, len(sketch) // 8)
            if (w, n) not in self.tables:
                table = self.tables[w, w]
                while table.shape[1] > n:
                    table = table[:, : table.shape[1] // 2] ^ table[:, table.shape[1] // 2 :]
                self.tables[w, n] = table
            apart = np.bitwise_count(self.tables[w, n] ^ _words(sketch, n)).sum(1, dtype=np.int64)
            out.append(ix[fit & ((den + num) * apart <= (den - num) * (size + len(probe)))])
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


class _Forest:
    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (p := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(p, p)
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def _groups(batches: Iterable[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with equal first `n_keys` columns; one group is held at a time."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _members(rows: list[tuple[int, int, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "node", "late"])


def _join_groups(num: int, den: int):
    """Per (group, block pair): probe the tree of the first block with the second's sets.

    A pair is tried only while its ends are not yet connected, so at most one link is
    kept per set: the links of a group form a spanning forest.  In a tree of several sets
    a probe looks for those alone that the sketches allow, so that sets without a partner
    cost no walk; within a block each pair is tried once.
    """

    def run(batches):
        pairs: list = []
        for (_, lo, hi, *_), rows in _groups(batches, 3):
            forest = _Forest()
            left = [r for r in rows if r[0] == lo]
            right = left if lo == hi else [r for r in rows if r[0] == hi]
            if not left or not right:
                continue
            sets = [np.frombuffer(r[3], "<u8") for r in left]
            tree = PrefixTree(sets)
            sketches = Sketches(sets) if len(left) > 1 else None
            for i, (_, node, comp, items) in enumerate(right):
                probe, among = np.frombuffer(items, "<u8"), None
                if sketches:
                    among = sketches.near(probe, num, den)
                    among = among[: np.searchsorted(among, i)] if lo == hi else among
                    among = among[[forest.root(left[m][2]) != forest.root(comp) for m in among.tolist()]] if len(among) else among
                    if not len(among):
                        continue
                find = tree.search(probe, num, den, lambda m: forest.root(left[m][2]) == forest.root(comp), among)
                for m, _overlap in find:
                    if forest.join(left[m][2], comp):
                        pairs.append((left[m][1], node))
            if len(pairs) > 10_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return run


def _compare_groups(num: int, den: int, cells: int = 1 << 22):
    """As `_join_groups`, for small sets: all overlaps of two blocks at once, as a product of 0/1 tables.

    Where a table would have more than `cells` cells the prefix tree does the work.
    """
    by_tree = _join_groups(num, den)

    def run(batches):
        pairs: list = []
        for (g, lo, hi, *_), rows in _groups(batches, 3):
            left = np.array([r[0] == lo for r in rows])
            right = left if lo == hi else np.array([r[0] == hi for r in rows])
            if not left.any() or not right.any():
                continue
            size = np.array([len(r[3]) // 8 for r in rows])
            items, column = np.unique(np.frombuffer(b"".join(r[3] for r in rows), "<u8"), return_inverse=True)
            if len(items) * len(rows) > cells:
                names = ["g", "lo", "hi", "block", "node", "comp", "items"]
                kinds = [pa.int64()] * 6 + [pa.binary()]
                columns = zip(*[(g, lo, hi, *r) for r in rows], strict=True)
                yield from by_tree([pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)])
                continue
            table = np.zeros((len(rows), len(items)), np.float32)
            table[np.repeat(np.arange(len(rows)), size), column] = 1
            a, b = np.flatnonzero(left), np.flatnonzero(right)
            comp = np.array([r[2] for r in rows])
            ok = (den + num) * (table[a] @ table[b].T) >= num * (size[a][:, None] + size[b][None, :])
            ok &= comp[a][:, None] != comp[b][None, :]
            forest = _Forest()
            for i, j in zip(*np.nonzero(ok), strict=True):
                x, y = rows[a[i]], rows[b[j]]
                if forest.join(x[2], y[2]):
                    pairs.append((x[1], y[1]))
            if len(pairs) > 10_000:
                yield _edges(pairs)
                pairs = []
        yield _edges(pairs)

    return run


def _run_groups(rows: DataFrame, join) -> DataFrame:
    """rows: g, lo, hi, block, node, comp, items."""
    dealt = rows.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi", "block", "node")
    dealt = dealt.select("g", "lo", "hi", "block", "node", "comp", "items")
    return dealt.mapInArrow(join, "a long, b long")


def _thin_groups(num: int, den: int):
    """Per (group, block pair): the sets that the sketches leave a partner in another component."""

    def run(batches):
        out: list = []
        for (g, lo, hi), rows in _groups(batches, 3):
            # block, node, comp, size, sketch; by size, so that partners are a range
            rows.sort(key=lambda r: r[3])
            size = np.array([r[3] for r in rows], np.int64)
            comp = np.array([r[2] for r in rows], np.int64)
            width = np.array([len(r[4]) // 8 for r in rows])
            if (width == width[0]).all() and width[0] * len(rows) <= 4096:  # all pairs at once
                own = np.stack([np.frombuffer(r[4], np.uint64) for r in rows])
                apart = np.bitwise_count(own[:, None, :] ^ own[None, :, :]).sum(2, dtype=np.int64)
                both = size[:, None] + size[None, :]
                ok = ((den + num) * apart <= (den - num) * both) & (comp[:, None] != comp[None, :]) & (den * np.minimum(size[:, None], size[None, :]) >= num * np.maximum(size[:, None], size[None, :]))
                out += [(g, rows[i][1], rows[i][0] < 0) for i in np.flatnonzero(ok.any(1)).tolist()]
                if len(out) > 10_000:
                    yield _members(out)
                    out = []
                continue
            at = {w: np.flatnonzero(width == w) for w in np.unique(width).tolist()}
            own = {w: np.stack([_words(rows[i][4], w) for i in ix]) for w, ix in at.items()}
            folded = {w: m[:, : w // 2] ^ m[:, w // 2 :] for w, m in own.items() if w > 1}
            live = np.zeros(len(rows), bool)
            for i, r in enumerate(rows):
                for w, table in ((width[i], own), (width[i] * 2, folded)):
                    if w not in table:
                        continue
                    ix = at[w]
                    a, b = np.searchsorted(ix, i + 1), np.searchsorted(size[ix], size[i] * den // num, "right")
                    if a < b:
                        apart = np.bitwise_count(table[w][a:b] ^ own[width[i]][np.searchsorted(at[width[i]], i)]).sum(1)
                        js = ix[a:b][((den + num) * apart <= (den - num) * (size[ix[a:b]] + size[i])) & (comp[ix[a:b]] != comp[i])]
                        if len(js):
                            live[i] = True
                            live[js] = True
            out += [(g, r[1], r[0] < 0) for r, k in zip(rows, live.tolist(), strict=True) if k]
            if len(out) > 10_000:
                yield _members(out)
                out = []
        yield _members(out)

    return run


def _open_groups(rows: DataFrame) -> DataFrame:
    """(key, n, n_late): groups with sets of more than one component, equal groups once; their blocks, without and of `late` sets."""
    late = F.col("late").cast("long")
    who = F.struct(F.count("*").alias("m"), F.sum(late).alias("late"), F.bit_xor(F.xxhash64("node", "late")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    groups = rows.groupBy("key").agg(who.alias("who"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1 and who.m > who.late")
    groups = groups.groupBy("who").agg(F.min("key").alias("key"))
    return groups.select("key", F.ceil((F.col("who.m") - F.col("who.late")) / BLOCK).alias("n"), F.ceil(F.col("who.late") / BLOCK).alias("n_late"))


def _block_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each set of an open group in every pair of blocks that its own block is part of: g, lo, hi, block.

    Blocks of `late` sets have numbers below 0; they are paired with the others, not with each other.
    """
    rows = rows.join(groups, "key")
    own = F.xxhash64("node", F.lit(1))
    rows = rows.withColumn("block", F.when(F.col("late"), -1 - F.pmod(own, F.col("n_late"))).otherwise(F.pmod(own, F.col("n"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("late"), F.lit(0).cast("long")).otherwise(-F.col("n_late")), F.col("n") - 1)))
    return rows.select(F.col("key").alias("g"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "comp")


def _dealt_by_rarest(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (key, node, comp, late) of large groups under keys of a group and one of the set's rarest items.

    A group's sets share its key's item, and often a whole phrase; what links them is the
    rest.  In any one order of all items, linked sets A and B, |A| <= |B|, share one
    within the first |A| - ceil(2 num |A| / (num + den)) + 1 of A and the first
    |B| - ceil(num |B| / den) + 1 of B.  A set is `late` under items that it has in the
    second range alone: it meets smaller sets there, which are not.  The order is by how
    many sets of large groups hold an item, counted in hashed buckets, then by value.  Items
    alone in their bucket come first and link nothing; they are left out.
    """
    hot = materialize(sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "items"), "large-sets")

    def items_of(b):
        return np.frombuffer(b"".join(b.column(b.num_columns - 1).to_pylist()), "<u8")

    often = bucket_counts(hot.select("items"), items_of)
    level = hot.sparkSession.sparkContext.broadcast(np.minimum(255, 8 * np.log2(np.maximum(1, often))).astype(np.uint8))

    def rarest(batches):
        for b in slices(batches):
            items = items_of(b)
            size = pa.compute.binary_length(b.column("items")).to_numpy().astype(np.int64) // 8
            owner = np.repeat(np.arange(len(size)), size)
            held = level.value[(items & np.uint64(BUCKETS - 1)).astype(np.int64)]
            order = np.lexsort((items, held, owner))
            at = np.arange(len(items)) - np.repeat(np.cumsum(size) - size, size)
            first, reach = (size - -(-k * size // m) + 1 for k, m in ((2 * num, num + den), (num, den)))
            use = (at < reach[owner]) & (held[order] > 0)
            columns = [b.column("node").take(pa.array(owner[use])), pa.array(items[order][use].view(np.int64)), pa.array((at >= first[owner])[use])]
            yield pa.RecordBatch.from_arrays(columns, ["node", "item", "late"])

    dealt = rows.join(hot.mapInArrow(rarest, "node long, item long, late boolean"), "node")
    return dealt.select(F.xxhash64("key", "item").alias("key"), "node", "comp", "late")


def _dealt_again(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (key, node, comp) of large groups under keys of a group and one more item.

    Let p be |A| - ceil(num |A| / den) + 1.  Linked sets share an item within their first
    p, and two within their first p + 1, unless they have but one in common.  So two linked sets
    of one group, which may be that of such an item, meet again under some other item among
    the first p + 1 of each.  One common item links only sets of at most den / num items;
    these keep their own key too, in a group apart from larger sets.
    """

    def first_items(batches):
        for b in batches:
            firsts, small = [], []
            for raw in b.column("items").to_pylist():
                s = np.frombuffer(raw, "<u8")
                firsts.append(s[: len(s) - -(-num * len(s) // den) + 2].view(np.int64))
                small.append(num * len(s) <= den)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(firsts, pa.list_(pa.int64())), pa.array(small, pa.bool_())], ["node", "firsts", "small"])

    firsts = sets.join(rows.select("node").distinct(), "node", "left_semi").select("node", "items").mapInArrow(first_items, "node long, firsts array<long>, small boolean")
    again = rows.join(firsts, "node").select("key", "node", "comp", "small", F.explode("firsts").alias("item")).where("item <> key or small")
    return again.select(F.xxhash64("key", "item").alias("key"), "node", "comp", F.lit(False).alias("late")).distinct()


def linked_components(nodes: DataFrame, keys: DataFrame, sets_of, num: int, den: int, by_tree: bool = True) -> tuple[DataFrame, DataFrame]:
    """(links, components) of all nodes whose sets have Jaccard >= num/den and share a key.

    nodes: rows (node, size, sketch: `parity_sketch`); keys: rows (key, node, size); a pair
    is a candidate if it shares a key.  `sets_of` is a function: DataFrame of nodes ->
    DataFrame (node, items: sorted little-endian u64).

    `by_tree`: sets are compared by prefix trees, else (for small sets) by tables.

    1. In each key's group the least node is the hub.  Pairs (hub, other) that sizes and
       sketches allow, each once whatever the number of shared keys, are verified: the
       others of a hub, in blocks of `BLOCK`, form a prefix tree which the hub's set probes.
    2. What the hubs did not settle: groups whose other members still lie in more than
       one component, equal groups once.  A group of more than `HOT` blocks is dealt out
       again by a second item of its members' sets (`_dealt_again`); of small sets one of
       more than `HOT_SMALL`, by the items that are rarest in all such groups (`_dealt_by_rarest`).  Groups are cut into
       blocks; members that the sketches leave no partner in another component go; each
       pair of blocks of what is left is joined by a prefix tree, skipping connected pairs.
    So no link between different components is lost and no group is gathered beyond a pair
    of blocks.  Pairs of blocks grow with the square of what is left of a group after
    both deals: sets that share a key, a second (or a rarest) item and no link with their hub.
    """
    join = (_join_groups if by_tree else _compare_groups)(num, den)
    hub = keys.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("node", "size")).alias("hub")).where("m > 1")
    grouped = keys.join(hub.select("key", "hub"), "key").select("key", "node", "size", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"))
    grouped = materialize(grouped.where("node <> hub"), "grouped")
    fit = F.lit(den) * F.least("size", "hub_size") >= F.lit(num) * F.greatest("size", "hub_size")
    tried = grouped.where(fit).select("hub", "node").distinct()
    tried = tried.join(nodes, "node").join(nodes.select(F.col("node").alias("hub"), F.col("size").alias("hub_size"), F.col("sketch").alias("hub_sketch")), "hub")

    def allowed(batches):
        for b in batches:
            a, h, n = (b.column(k).to_pylist() for k in ("sketch", "hub_sketch", "sizes"))
            keep = [may_link(x, y, m, num, den) for x, y, m in zip(a, h, n, strict=True)]
            yield b.select(["hub", "node"]).filter(pa.array(keep, pa.bool_()))

    tried = tried.select("hub", "node", "sketch", "hub_sketch", (F.col("size") + F.col("hub_size")).alias("sizes")).mapInArrow(allowed, "hub long, node long")
    tried = materialize(tried, "tried")
    wanted = tried.select("node").union(tried.select(F.col("hub").alias("node"))).distinct()
    sets = materialize(sets_of(wanted), "sets")

    blocks = tried.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).alias("n"))
    part = (F.pmod(F.xxhash64("node"), F.col("n")) + 1).alias("hi")
    members = tried.join(blocks, "hub").select("hub", part, "node").join(sets, "node")
    members = members.select(F.col("hub").alias("g"), F.lit(0).cast("long").alias("lo"), "hi", F.col("hi").alias("block"), "node", F.col("node").alias("comp"), "items")
    hubs = blocks.select("hub", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("hi")).join(sets.withColumnRenamed("node", "hub"), "hub")
    hubs = hubs.select(F.col("hub").alias("g"), F.lit(0).cast("long").alias("lo"), "hi", F.lit(0).cast("long").alias("block"), F.col("hub").alias("node"), F.col("hub").alias("comp"), "items")
    first = materialize(_run_groups(hubs.unionByName(members), join), "links")
    comp = materialize(components(first), "components")

    def with_sets(some: DataFrame) -> DataFrame:
        """Sets of all of `some` nodes: those at hand and, where there are others, theirs."""
        more = some.select("node").distinct().join(sets.select("node"), "node", "left_anti")
        return sets.unionByName(materialize(sets_of(more), "sets"))

    rest = grouped.select("key", "node").join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"), F.lit(False).alias("late"))
    groups = materialize(_open_groups(rest), "open")
    hot, deal = (HOT, _dealt_again) if by_tree else (HOT_SMALL, _dealt_by_rarest)
    pairs = _block_pairs(rest, groups.where(F.col("n") <= hot))
    large = groups.where(F.col("n") > hot).select("key")
    if not large.isEmpty():
        rows = materialize(rest.join(large, "key").drop("late"), "large-groups")
        again = materialize(deal(rows, with_sets(rows), num, den), "dealt-again")
        pairs = pairs.unionByName(_block_pairs(again, materialize(_open_groups(again), "open")))
    dealt = pairs.join(nodes, "node").repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    dealt = dealt.select("g", "lo", "hi", "block", "node", "comp", "size", "sketch")
    live = dealt.mapInArrow(_thin_groups(num, den), "key long, node long, late boolean").distinct()
    live = live.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"), "late")
    live = materialize(live, "live")
    if live.isEmpty():
        return first, comp
    pairs = _block_pairs(live, materialize(_open_groups(live), "open"))
    second = materialize(_run_groups(pairs.join(with_sets(live), "node"), join), "links")
    if second.isEmpty():
        return first, comp
    links = first.unionByName(second)
    return links, materialize(components(links), "components")
