"""Lineage cuts and passes over sorted rows with a carried state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder that all executors share; on one machine a folder beside the warehouse."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if not conf.get("spark.checkpoint.dir", None) and not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return df.checkpoint()


def carried(df: DataFrame, key: str, ts: str, columns: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """One pass over each key's rows in time order: (key, ts, *out).

    ``step(state, *values)`` gives (state, row of out values, or None for no row); `start()` the first
    state of a key.  Keys are dealt out and sorted by Spark; a task holds one batch and one
    state at a time, so a key of any length takes memory for its state alone.  `columns`
    and `out` are doubles or arrays of doubles; `out` is a schema such as "v double".
    """
    rows = df.select(key, ts, *columns).repartition(key).sortWithinPartitions(key, ts)
    kinds = dict(rows.dtypes)
    schema = f"`{key}` {kinds[key]}, `{ts}` {kinds[ts]}, {out}"
    names = [x.split()[0].strip("`") for x in out.split(", ")]

    def run(batches):
        last, state, begun = None, None, False
        for b in batches:
            keys, values = b.column(0).to_pylist(), [c.to_pylist() for c in b.columns[2:]]
            at, rows_ = [], []
            for i, (k, *v) in enumerate(zip(keys, *values, strict=True)):
                if not begun or k != last:
                    last, state, begun = k, start(), True
                state, row = step(state, *v)
                if row is not None:
                    at.append(i)
                    rows_.append(row)
            some = b.take(pa.array(at, pa.int64()))
            columns_ = [pa.array([r[j] for r in rows_], pa.list_(pa.float64()) if "array" in out.split(", ")[j] else pa.float64()) for j in range(len(names))]
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *columns_], [key, ts, *names])

    return rows.mapInArrow(run, schema)


def shared_folder(spark) -> str:
    """A new folder, for one result, where all executors can read and write."""
    saved(spark.range(0))  # sets the checkpoint folder of a single machine
    return f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
