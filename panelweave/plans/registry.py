"""Named queries with their SQL oracles; doubles are rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.plans.fixtures import Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounds: str = "", digits: int = 6):
    """Register a function of `Views`; `rounds` names the columns rounded to `digits` on both sides."""

    def add(build: Callable[[Views], DataFrame]):
        cols = rounds.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = build(Views(spark, sf_dir))
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in cols}) if cols else df

        QUERIES[name] = run
        if sql:
            swap = ", ".join(f"round(CAST({c} AS DOUBLE), {digits}) AS {c}" for c in cols)
            ORACLES[name] = f"SELECT * REPLACE ({swap}) FROM ({sql})" if cols else sql
        return build

    return add
