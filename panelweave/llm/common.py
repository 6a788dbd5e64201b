"""Helpers shared by the text operators: shared storage, ids, connected components."""

from __future__ import annotations

import ctypes
import uuid
import zlib
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset on a single
    machine (tests) a folder beside the warehouse is used and set for ``checkpoint()``.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


_WRITTEN: list[list[str]] = []


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage: write `df` as Parquet in the shared folder and read it back.

    Every executor can read the files, so a lost executor costs no recomputation of
    what lies before, and every later use sees the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/panelweave/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes, at its end, the tables that `materialize` has written within; none of them may be read later."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _WRITTEN.pop():
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, n: int) -> list[str]:
    """`n` column names that `df` does not have."""
    taken, out, k = {c.lower() for c in df.columns}, [], 0
    while len(out) < n:
        if f"_{k}" not in taken:
            out.append(f"_{k}")
        k += 1
    return out


def let(value, body):
    """``body(value)`` with `value` computed once per row (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def give_back() -> None:
    """What Arrow and numpy have freed goes back to the machine, as the worker lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches, rows: int = 512):
    """The same Arrow rows in smaller batches, so that a task holds few texts as Python objects; at the end `give_back`."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
    b = None
    give_back()


BUCKETS = 1 << 20
SLICE = 1 << 14


def bucket_counts(rows: DataFrame, items_of) -> np.ndarray:
    """How many items of all rows have each number modulo `BUCKETS`.

    `items_of`: Arrow batch -> array of unsigned longs.  Tasks send their counts in
    compressed slices and the driver receives one slice of counts for each of
    ``BUCKETS / SLICE``, a fixed size.
    """

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            np.add.at(total, (items_of(b) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        task = TaskContext.get().partitionId()
        for k in range(BUCKETS // SLICE):
            part = total[k * SLICE : (k + 1) * SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())],
                    ["slice", "task", "counts"],
                )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(c), np.int64) for c in pdf["counts"])
        return pd.DataFrame({"slice": pdf["slice"][:1], "task": [0], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = rows.mapInArrow(count, "slice int, task int, counts binary")
    for fan in (4096, 64, 1):  # merged in levels, so that no group grows with the number of tasks
        if fan == 1 or rows.rdd.getNumPartitions() > 64 * fan:
            parts = parts.withColumn("task", F.pmod("task", F.lit(fan)))
            parts = parts.groupBy("slice", "task").applyInPandas(add, "slice int, task int, counts binary")
    total = np.zeros(BUCKETS, np.int64)
    for r in parts.collect():
        total[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return total


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: (node, component).

    `component` is the smallest node of the component.  Nodes are those of `edges`
    (null ends and self loops are ignored; an empty table gives an empty result).

    Each round every node takes the neighbour (or itself) of the lowest hashed rank
    as parent and the edges are redrawn between parents, so that the number of edges
    shrinks geometrically whatever the order of the ids; no neighbour list is ever
    gathered.  Rounds are cut with tables in the shared folder.
    """
    def rank(c):
        return F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("v"))

    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e = materialize(e.union(e.select("y", "x")).toDF("x", "y").distinct(), "cc-edges")
    rounds = []
    while not e.isEmpty():
        up = e.groupBy("x").agg(F.min(rank("y")).alias("m"))
        up = up.select("x", F.least(rank("x"), "m")["v"].alias("p"))
        up = materialize(up, "cc-parents")
        rounds.append(up)
        px = up.select("x", F.col("p").alias("px"))
        py = up.select(F.col("x").alias("y"), F.col("p").alias("py"))
        e = e.join(px, "x").join(py, "y").where("px <> py").select(F.col("px").alias("x"), F.col("py").alias("y"))
        e = materialize(e.distinct(), "cc-edges")
    if not rounds:
        return e.select(F.col("x").alias("node"), F.col("x").alias("component"))
    root = rounds[0].select(F.col("x").alias("node"), "p")
    for up in rounds[1:]:
        up = up.select(F.col("x").alias("q"), F.col("p").alias("pp"))
        root = root.join(up, F.col("p") == F.col("q"), "left").select("node", F.coalesce("pp", "p").alias("p"))
    root = materialize(root, "cc-roots")
    least = root.groupBy("p").agg(F.min("node").alias("component"))
    return root.join(least, "p").select("node", "component")


MOST_BITS = 1 << 26
_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]  # fixed values of XXH64


def xxhash64_longs(v: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of bigints: XXH64 of their eight bytes with seed 42."""
    def turn(x, k):
        return (x << np.uint64(k)) | (x >> np.uint64(64 - k))

    with np.errstate(over="ignore"):
        h = (np.uint64(42) + _P[4] + np.uint64(8)) ^ (turn(np.asarray(v, np.int64).view(np.uint64) * _P[1], 31) * _P[0])
        h = turn(h, 27) * _P[0] + _P[3]
        h = (h ^ (h >> np.uint64(33))) * _P[1]
        h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


class IdFilter:
    """Holds for every id it was made of and for few others: one bit per id, sent to the tasks as a broadcast."""

    def __init__(self, table):
        self.table = table

    def many(self, ids: np.ndarray) -> np.ndarray:
        table = self.table.value
        h = xxhash64_longs(ids)
        word = (h & np.uint64(64 * len(table) - 1)) >> np.uint64(6)
        return (table[word.astype(np.int64)] >> (h >> np.uint64(58)) & np.uint64(1)).astype(bool)


def id_filter(ids: DataFrame, col: str) -> IdFilter:
    """A test of longs that holds for every id of `ids` and for few others.

    It thins rows inside a scan before an exact join.  It takes some sixteen bits an id, at
    most `MOST_BITS` (8 MB); with many more ids than bits it lets all pass, and the join
    alone decides.  The ids are counted and reduced to bits in Spark.
    """
    bits = 1 << 16
    n = ids.count()
    while bits < min(MOST_BITS, 16 * n):
        bits *= 2
    word = F.shiftrightunsigned(F.xxhash64(F.col(col)).bitwiseAND(F.lit(bits - 1)), 6)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{col}`), 58) as int))")
    found = ids.where(F.col(col).isNotNull()).groupBy(word.alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # at most bits / 64 rows
    table = np.zeros(bits // 64, np.uint64)
    table[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return IdFilter(ids.sparkSession.sparkContext.broadcast(table))
