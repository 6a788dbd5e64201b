"""The flagship query: from trades to the most concentrated sellers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.operators import aggregates as agg
from panelweave.operators import cleaning, windows
from panelweave.plans.fixtures import Views


def concentrated_selling(spark: SparkSession, sf_dir: str, grain: str = "month", top: int = 20) -> DataFrame:
    """Admitted trades -> panel -> sell concentration with coverage gate -> within-date normal score -> top."""
    v = Views(spark, sf_dir, grain)
    trades = cleaning.admit(v.trades, ["A", "N", "R"])
    panel = agg.stockday_panel(trades).join(agg.concentration(trades, 4), ["inst", "d"], "left")
    panel = agg.gate_coverage(panel, "valid_value", "sell_value", ["concentration"])
    panel = panel.withColumn("eligible", F.col("n") >= 3).withColumn("concentration", F.round("concentration", 9))
    scored = windows.probit_rank(panel, "d", "concentration", "score", "eligible")
    return scored.where("score is not null").orderBy(F.desc("score"), "d", "inst").limit(top).select("inst", "d", "n", "sell_value", "concentration", "score")
