"""Views over the driver tables that stand for a trade tape and what derives from it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.operators import aggregates as agg
from panelweave.operators import windows as win
from panelweave.sources.tables import TAPE, read_tape


class Views:
    """Lazily built frames for one data folder; nothing is computed until a query runs.

    trades: lineitem with part; brand is the instrument, the supplier the entity, the week
    (or month) of shipping the date, odd line numbers buys and even ones sells.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, grain: str = "week"):
        self.spark, self.dir, self.grain = spark, sf_dir, grain

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def trades(self) -> DataFrame:
        cols = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]
        line = read_tape(self.spark, f"{self.dir}/lineitem.parquet", cols, TAPE)
        part = self.table("part").select("p_partkey", "p_brand")
        day = F.to_date("l_shipdate")
        return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("inst"), F.trunc("l_shipdate", self.grain).alias("d"), day.alias("day"), F.col("l_suppkey").alias("entity"),
            F.when(F.col("l_linenumber") % 2 == 1, 1).otherwise(4).alias("side"), F.col("l_quantity").alias("quantity"),
            (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("rate"), F.col("l_extendedprice").alias("value"),
            F.date_add(day, F.col("l_linenumber") - 1).alias("rpt"), F.col("l_returnflag").alias("kind"),
        )

    @cached_property
    def panel(self) -> DataFrame:
        return agg.stockday_panel(self.trades)

    @cached_property
    def price(self) -> DataFrame:
        p = self.trades.groupBy("inst", "d").agg((F.sum("value") / F.nullif(F.sum("quantity"), F.lit(0.0))).alias("close"), F.sum("quantity").alias("volume"), F.sum("value").alias("turnover"))
        p = p.withColumn("ret", F.col("close") / F.nullif(F.lag("close").over(Window.partitionBy("inst").orderBy("d")), F.lit(0.0)) - 1)
        w = Window.partitionBy("d")
        market = F.sum(F.col("ret") * F.col("turnover")).over(w) / F.nullif(F.sum(F.when(F.col("ret").isNotNull(), F.col("turnover"))).over(w), F.lit(0.0))
        return p.withColumn("mkt", market).withColumn("adj", F.col("ret") - F.col("mkt"))

    @cached_property
    def calendar(self) -> DataFrame:
        return win.trading_calendar(self.trades, "d", "inst", 10)

    @cached_property
    def states(self) -> DataFrame:
        imb = F.col("net") / F.nullif(F.col("gross"), F.lit(0.0))
        state = F.when(imb > 0.15, "buy").when(imb < -0.15, "sell").otherwise("neutral")
        return self.panel.select("inst", "d", "net", "gross", "n", imb.alias("imb"), state.alias("state"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select("event_id", "user_id", F.to_date("ts").alias("day"), "ts", "event_type", "value", "props")

    @cached_property
    def scores(self) -> DataFrame:
        line = self.table("lineitem")
        return line.select(F.col("l_returnflag").alias("g"), F.to_date("l_shipdate").alias("day"), (F.col("l_returnflag") == "R").alias("y0"), (F.col("l_linenumber") > 4).alias("y"), (F.col("l_discount") * 5 + 0.2).alias("p"), (F.col("l_tax") * 5 + 0.3).alias("p2"))


# The same views as SQL text, for the oracles.
TRADES = """trades AS (SELECT p_brand AS inst, CAST(date_trunc('week', l_shipdate) AS DATE) AS d, CAST(l_shipdate AS DATE) AS day, l_suppkey AS entity,
  CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 4 END AS side, l_quantity AS quantity, l_extendedprice / l_quantity AS rate, l_extendedprice AS value,
  CAST(l_shipdate AS DATE) + (l_linenumber - 1) AS rpt, l_returnflag AS kind FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PANEL = TRADES + """, panel0 AS (SELECT inst, d, sum(CASE WHEN side = 1 THEN value ELSE 0 END) AS buy_value, sum(CASE WHEN side = 4 THEN value ELSE 0 END) AS sell_value,
  count(*) FILTER (side = 1) AS n_buys, count(*) FILTER (side = 4) AS n_sells, sum(quantity) AS total_qty, stddev_samp(value) AS size_sd, count(DISTINCT entity) AS n_entities,
  coalesce(sum(value) FILTER (entity IS NOT NULL), 0) AS valid_gross FROM trades GROUP BY inst, d),
panel AS (SELECT *, buy_value - sell_value AS net, buy_value + sell_value AS gross, n_buys + n_sells AS n, (buy_value + sell_value) / (n_buys + n_sells) AS mean_size, valid_gross / (buy_value + sell_value) AS coverage FROM panel0)"""
PRICE = TRADES + """, price0 AS (SELECT inst, d, sum(value) / sum(quantity) AS close, sum(quantity) AS volume, sum(value) AS turnover FROM trades GROUP BY inst, d),
price1 AS (SELECT *, close / lag(close) OVER (PARTITION BY inst ORDER BY d) - 1 AS ret FROM price0),
price2 AS (SELECT *, sum(ret * turnover) OVER (PARTITION BY d) / sum(CASE WHEN ret IS NOT NULL THEN turnover END) OVER (PARTITION BY d) AS mkt FROM price1),
price AS (SELECT *, ret - mkt AS adj FROM price2)"""
CALENDAR = """calendar AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT d FROM trades GROUP BY d HAVING count(DISTINCT inst) >= 10))"""
STATES = PANEL + """, states AS (SELECT inst, d, net, gross, n, net / gross AS imb, CASE WHEN net / gross > 0.15 THEN 'buy' WHEN net / gross < -0.15 THEN 'sell' ELSE 'neutral' END AS state FROM panel)"""
RUNS = STATES + """, r0 AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY inst ORDER BY d) OR row_number() OVER (PARTITION BY inst ORDER BY d) = 1 THEN 1 ELSE 0 END AS new FROM states),
runs AS (SELECT *, CAST(sum(new) OVER (PARTITION BY inst ORDER BY d) AS BIGINT) AS run FROM r0)"""
EVENTS = "ev AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, ts, event_type, value, props FROM events)"
SCORES = "scores AS (SELECT l_returnflag AS g, CAST(l_shipdate AS DATE) AS day, l_returnflag = 'R' AS y0, l_linenumber > 4 AS y, l_discount * 5 + 0.2 AS p, l_tax * 5 + 0.3 AS p2 FROM lineitem)"


def avg_rank(col: str, by: str) -> str:
    """SQL of the rank with ties averaged, for non-null values."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {col} NULLS LAST) + (count(*) OVER (PARTITION BY {by}, {col}) - 1) / 2.0)"
