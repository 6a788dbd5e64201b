"""Vector codes of parts: k-means over anchors-hierarchy metric trees."""

from __future__ import annotations

import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import free_names, materialize

PARTS = 4
BLOCK = 4096  # vectors of one tree
LEAF = 32  # points that a ball keeps without splitting
SCALE = 1024


class Ball:
    """A node while a tree is built: the points it owns, and its two halves or its ready parts."""

    def __init__(self, points: np.ndarray, own: np.ndarray, halves: tuple = ()):
        self.own, self.halves = own, halves
        x = points[own]
        self.total = x.sum(0)
        self.centre = self.total / len(own)
        self.radius = float(np.sqrt(((x - self.centre) ** 2).sum(1).max()))


def anchors(points: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """`own` dealt out to at most `k` anchors, each point to its nearest.

    A new anchor stands at the point farthest from its own anchor.  Every anchor keeps its
    points by falling distance, so only the head of a list, at half the distance between
    two anchors or more, can change hands.
    """
    first = points[own[0]]
    d = np.sqrt(((points[own] - first) ** 2).sum(1))
    o = np.argsort(-d, kind="stable")
    have = [(first, own[o], d[o])]
    while len(have) < k:
        widest = max(range(len(have)), key=lambda i: have[i][2][0] if len(have[i][2]) else 0.0)
        pivot, mine, far = have[widest]
        if not len(far) or far[0] <= 0:
            break
        new = points[mine[0]]
        got, got_d = [], []
        for i, (p, ids, dist) in enumerate(have):
            gap = float(np.sqrt(((p - new) ** 2).sum()))
            head = int(np.searchsorted(-dist, -gap / 2, "right"))
            if not head:
                continue
            to_new = np.sqrt(((points[ids[:head]] - new) ** 2).sum(1))
            take = to_new < dist[:head]
            if take.any():
                got.append(ids[:head][take])
                got_d.append(to_new[take])
                stay = np.concatenate([~take, np.ones(len(ids) - head, bool)])
                have[i] = (p, ids[stay], dist[stay])
        ids, dist = np.concatenate(got), np.concatenate(got_d)
        o = np.argsort(-dist, kind="stable")
        have.append((new, ids[o], dist[o]))
    return [ids for _, ids, _ in have if len(ids)]


def grow(points: np.ndarray, own: np.ndarray) -> Ball:
    """Middle out: anchors first, balls within each, then the anchors' balls joined upwards, the tightest pair first."""
    if len(own) <= LEAF:
        return Ball(points, own)
    dealt = anchors(points, own, max(2, int(np.sqrt(len(own)))))
    if len(dealt) == 1:
        return Ball(points, own)  # all points are alike
    balls: list[Ball | None] = [grow(points, ids) for ids in dealt]
    centre = np.array([b.centre for b in balls])
    radius = np.array([b.radius for b in balls])
    size = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + radius[:, None] + radius[None]
    size[np.diag_indices(len(balls))] = np.inf
    for _ in range(len(balls) - 1):
        i, j = divmod(int(size.argmin()), len(balls))
        a, b = balls[i], balls[j]
        whole = Ball(points, np.concatenate([a.own, b.own]), (a, b))
        balls[i], balls[j] = whole, None
        size[j] = size[:, j] = np.inf
        centre[i], radius[i] = whole.centre, whole.radius
        live = np.isfinite(size[i])
        to = np.sqrt(((centre - whole.centre) ** 2).sum(1)) + radius + whole.radius
        size[i, live] = size[live, i] = to[live]
    return next(b for b in balls if b is not None)


class MetricTree:
    """Nested balls over integer points; each caches the sum and number of its points.

    Points are stored so that every ball is a range `begin`..`end`; `order` has their first places.
    """

    NAMES = ("x", "order", "begin", "end", "left", "right", "centre", "radius", "total")

    def __init__(self, **arrays):
        self.__dict__.update(arrays)

    @classmethod
    def of(cls, x: np.ndarray) -> MetricTree:
        rows, order = [], []

        def lay(ball: Ball) -> int:
            at = len(rows)
            rows.append(None)
            begin, kids = lay.placed, (-1, -1)
            if ball.halves:
                kids = tuple(lay(h) for h in ball.halves)
            else:
                order.append(ball.own)
                lay.placed += len(ball.own)
            rows[at] = (begin, lay.placed, *kids, ball.centre, ball.radius, ball.total)
            return at

        lay.placed = 0
        lay(grow(x, np.arange(len(x))))
        order = np.concatenate(order)
        begin, end, left, right, centre, radius, total = zip(*rows, strict=True)
        return cls(x=x[order], order=order, begin=np.array(begin), end=np.array(end), left=np.array(left), right=np.array(right), centre=np.array(centre), radius=np.array(radius), total=np.array(total))

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{n: getattr(self, n) for n in self.NAMES})
        return out.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> MetricTree:
        with np.load(io.BytesIO(raw)) as z:
            return cls(**{n: z[n] for n in cls.NAMES})

    def owners(self, entries: np.ndarray):
        """Yields (ball or None, first, last, entry or entries of the points): who owns which range.

        A ball passes on only the entries that can be nearest to some of its points: those
        at most twice its radius farther from its centre than the nearest one.  A ball with
        one entry left is owned as a whole.  The bound is loosened by the error of a double,
        and ties are settled at points, to the lower index.
        """
        e = entries.astype(np.float64)
        stack = [(0, np.arange(len(e)))]
        while stack:
            at, some = stack.pop()
            d = np.sqrt(((e[some] - self.centre[at]) ** 2).sum(1))
            some = some[d <= d.min() + 2 * self.radius[at] + 1e-9 * (d.max() + self.radius[at] + 1)]
            a, b = int(self.begin[at]), int(self.end[at])
            if len(some) == 1:
                yield at, a, b, some[0]
            elif self.left[at] < 0:
                yield None, a, b, some[squared(self.x[a:b], entries[some]).argmin(1)]
            else:
                stack += [(int(self.left[at]), some), (int(self.right[at]), some)]


def squared(x: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points (n x p) and entries (m x p)."""
    most = max(np.abs(x).max(initial=0), np.abs(e).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), e.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - v) ** 2).sum(1) for v in e], 1)


def most_component(dim: int) -> int:
    """Components of at most this size keep every distance below 2**60."""
    return int((1 << 29) // max(1, np.ceil(np.sqrt(dim))))


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & ok


def plant(kept: DataFrame, id_col: str, vector_col: str, dim: int, carry: list[str]) -> DataFrame:
    """Blocks of up to `BLOCK` vectors with a tree for each of their parts: one row a block, without a shuffle."""
    types = dict(kept.dtypes)
    schema = ", ".join(f"`{c}` array<{types[c]}>" for c in [id_col, *carry]) + ", trees array<binary>"
    width = dim // PARTS

    def build(batches):
        held: list[pa.RecordBatch] = []

        def block(b: pa.Table) -> pa.RecordBatch:
            x = b.column(vector_col).combine_chunks().flatten().to_numpy(zero_copy_only=False)
            x = np.floor(SCALE * x.astype(np.float64)).astype(np.int64).reshape(-1, dim)
            trees = [MetricTree.of(np.ascontiguousarray(x[:, k * width : (k + 1) * width])).dumps() for k in range(PARTS)]
            lists = [pa.array([b.column(c).to_pylist()], pa.list_(b.schema.field(c).type)) for c in [id_col, *carry]]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], [id_col, *carry, "trees"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                t = pa.Table.from_batches(held)
                while t.num_rows >= BLOCK:
                    yield block(t.slice(0, BLOCK))
                    t = t.slice(BLOCK)
                held = t.to_batches()
        if sum(b.num_rows for b in held):
            yield block(pa.Table.from_batches(held))

    return kept.select(id_col, *carry, vector_col).mapInArrow(build, schema)


def totals(planted: DataFrame, books: np.ndarray) -> DataFrame:
    """(part, entry, place, total, n): the sums of the parts that each entry owns, added up within a task first."""
    shared = planted.sparkSession.sparkContext.broadcast(books)  # at most PARTS x entries x width integers

    def run(batches):
        books = shared.value
        total, n = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for b in batches:
            for trees in b.column("trees").to_pylist():
                for k, raw in enumerate(trees):
                    tree = MetricTree.loads(raw)
                    for ball, a, z, who in tree.owners(books[k]):
                        if ball is None:
                            np.add.at(total[k], who, tree.x[a:z])
                            np.add.at(n[k], who, 1)
                        else:
                            total[k, who] += tree.total[ball]
                            n[k, who] += z - a
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(list(total[part, entry]), pa.list_(pa.int64())), pa.array(n[part, entry])], ["part", "entry", "total", "n"])

    each = planted.select("trees").mapInArrow(run, "part long, entry long, total array<long>, n long")
    each = each.select("part", "entry", "n", F.posexplode("total").alias("place", "total"))
    return each.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def assigned(planted: DataFrame, books: np.ndarray, id_col: str, carry: list[str]) -> DataFrame:
    """(id, carried columns, code, error) of each vector, by the same descent."""
    shared = planted.sparkSession.sparkContext.broadcast(books)
    types = {f.name: f.dataType.elementType.simpleString() for f in planted.schema if f.name != "trees"}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [id_col, *carry]) + ", code string, error long"

    def run(batches):
        books = shared.value
        for b in batches:
            for i in range(b.num_rows):
                code, error = [], 0
                for k, raw in enumerate(b.column("trees")[i].as_py()):
                    tree = MetricTree.loads(raw)
                    owner = np.zeros(len(tree.x), np.int64)
                    for _, a, z, who in tree.owners(books[k]):
                        owner[a:z] = who
                    back = np.empty_like(owner)
                    back[tree.order] = owner
                    away = np.empty_like(owner)
                    away[tree.order] = ((tree.x - books[k][owner]) ** 2).sum(1)
                    code.append(back)
                    error = error + away
                text = [bytes(row).hex() for row in np.stack(code, 1).astype(np.uint8)]
                lists = [b.column(c)[i].values for c in [id_col, *carry]]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(text, pa.string()), pa.array(error)], [id_col, *carry, "code", "error"])

    return planted.mapInArrow(run, schema)


def vector_codes(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", carry: tuple[str, ...] = (), entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """((id, carried columns, code, error), codebooks): each vector as one byte for each of its four parts.

    Components become ``floor(1024 * x)``.  A part's codebook starts as that part of the
    `entries` vectors of the smallest ids (at most 256); each round gives every part to its
    nearest entry (squared distance, ties to the lower index) and moves each entry to the
    floored mean of its parts, unused ones staying.  All sums are of whole numbers, so the
    result does not depend on how rows are dealt out.  `codebooks` is parts x entries x width.

    Vectors are cut into blocks as they are read; each part of a block gets a metric tree
    once, written to the shared folder, and every round descends it.  A round sends
    parts x entries sums to the driver, whatever the number of rows.

    Null vectors and those with a component that is null or not finite are left out.  The
    width is the most frequent length that four divides (the smaller of equals); rows of
    another length, or with a component beyond `most_component` (2**29 over the root of the
    width), stay with a null code and error.  Repeated rows, and rows of one id, are each
    coded; a null id comes last in the start.  An empty table gives no rows and an empty
    codebook.  Other columns are not read; carried ones may have any name but the new ones.
    """
    vector, [v, bad] = F.col(vector_col), free_names(df, 2)
    names = list(dict.fromkeys(c for c in carry if c not in (id_col, vector_col)))
    rows = df.select(id_col, *names, vector.alias(v)).where(finite(F.col(v)))
    widths = rows.groupBy(F.size(v).alias("n")).count().where("n > 0 and n % 4 = 0").orderBy(F.desc("count"), "n").first()
    out = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != v) + ", code string, error long"
    if widths is None:
        kept = rows.drop(v).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
        return kept, np.zeros((PARTS, 0, 0), np.int64)
    dim = widths["n"]
    fits = (F.size(v) == dim) & F.forall(v, lambda x: F.abs(F.floor(x.cast("double") * SCALE)) <= most_component(dim))
    rows = rows.withColumn(bad, ~fits)
    kept = rows.where(~F.col(bad)).drop(bad)
    first = kept.orderBy(F.asc_nulls_last(id_col), v).limit(min(entries, 256)).select(v).collect()
    books = np.floor(SCALE * np.array([r[0] for r in first], np.float64)).astype(np.int64)
    books = np.ascontiguousarray(books.reshape(len(first), PARTS, dim // PARTS).transpose(1, 0, 2))
    planted = materialize(plant(kept, id_col, v, dim, names), "vector-trees")
    for _ in range(rounds):
        books = books.copy()
        for r in totals(planted, books).collect():  # parts x entries x width numbers
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    coded = assigned(planted, books, id_col, names)
    odd = rows.where(bad).drop(v, bad).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")})
    assert coded.columns == odd.columns, out
    return coded.union(odd), books


def decode(codes: DataFrame, books: np.ndarray, code_col: str = "code", out: str = "vector") -> DataFrame:
    """`codes` with the vector that each code stands for (null for a null code)."""
    table = F.lit(np.round(books / SCALE, 12).tolist()) if books.size else F.lit(None)
    if not books.size:
        return codes.withColumn(out, table.cast("array<double>"))
    at = [F.conv(F.substring(code_col, 2 * k + 1, 2), 16, 10).cast("int") for k in range(PARTS)]
    return codes.withColumn(out, F.when(F.col(code_col).isNotNull(), F.concat(*[table[k][a] for k, a in enumerate(at)])))


def books_sha256(books: np.ndarray) -> str:
    """SHA-256 of the entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame, label_col: str, id_col: str, salts: int = 32) -> DataFrame:
    """`codes` with label_error, the error summed over rows of an equal label (nulls are equal); null beyond a long.

    Labels are added up before the shuffle, and a frequent label meets its rows in `salts`
    parts, so that no task gets all of them.
    """
    sums = codes.groupBy(F.col(label_col).alias("_l")).agg(F.try_sum("error").alias("label_error"))
    sums = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = codes.withColumn("_t", F.pmod(F.xxhash64(id_col, "code"), F.lit(salts)).cast("int"))
    return rows.join(sums, F.col(label_col).eqNullSafe(F.col("_l")) & (F.col("_t") == F.col("_s"))).drop("_l", "_s", "_t")
