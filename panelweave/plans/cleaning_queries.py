"""Queries of sources, cleaning, joins and identity."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.mix import mix_sql
from panelweave.operators import cleaning as cl
from panelweave.operators import identity as idn
from panelweave.operators import joins as jn
from panelweave.plans.fixtures import CALENDAR, EVENTS, PANEL, PRICE, STATES, TRADES, Views
from panelweave.plans.registry import query
from panelweave.sources import tables as tb


@query("A1_tape_scan", "SELECT l_suppkey AS entity, count(*) AS n, sum(l_quantity) AS qty FROM lineitem WHERE l_quantity > 10 AND l_returnflag = 'R' GROUP BY 1")
def a1(v: Views):
    tape = tb.read_tape(v.spark, f"{v.dir}/lineitem.parquet", ["l_suppkey", "l_quantity", "l_returnflag"], tb.TAPE)
    return tape.where("l_quantity > 10 and l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("entity")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("A2_union_scan", "SELECT n_name, r_name FROM (SELECT n_nationkey, n_name, n_regionkey, NULL AS r_regionkey, NULL AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region)")
def a2(v: Views):
    return tb.read_union(v.spark, [f"{v.dir}/nation.parquet", f"{v.dir}/region.parquet"]).select("n_name", "r_name")


@query("A3_dirty_strings", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day, o_totalprice AS amount FROM orders")
def a3(v: Views):
    o = v.table("orders")
    day = F.when(F.col("o_orderkey") % 7 == 0, F.lit(" n/a ")).otherwise(F.concat(F.lit(" "), F.date_format("o_orderdate", "dd-MMM-yyyy")))
    raw = o.select(F.col("o_orderkey").cast("string").alias(" id "), day.alias("day "), F.format_number("o_totalprice", 2).alias(" amount"))
    return tb.clean_strings(raw, {"id": "number", "day": "dd-MMM-yyyy", "amount": "number"}).withColumn("id", F.col("id").cast("long"))


@query("A4_series", f"WITH {EVENTS} SELECT day AS date, avg(value) AS level FROM ev WHERE day <> DATE '2024-01-05' GROUP BY day", "level")
def a4(v: Views):
    daily = v.events.groupBy("day").agg(F.avg("value").alias("x"))
    text = daily.select(F.col("day").cast("string").alias("DATE"), F.when(F.col("day") == "2024-01-05", ".").otherwise(F.col("x").cast("string")).alias("X"))
    return tb.series(text, "DATE", "X")


@query("A8_decode_matrices", f"WITH {EVENTS} SELECT event_id, round(value, 2) AS a01, CAST(user_id AS DOUBLE) AS a10 FROM ev")
def a8(v: Views):
    text = F.concat(F.lit("[[1.0,"), F.round("value", 2).cast("string"), F.lit("],["), F.col("user_id").cast("string"), F.lit(",0.5]]"))
    m = tb.decode_matrices(v.events.select("event_id", text.alias("m")), ["m"])
    return m.select("event_id", F.col("m")[0][1].alias("a01"), F.col("m")[1][0].alias("a10"))


@query("A9_fingerprint", f"SELECT count(*) AS rows, CAST(sum({mix_sql(5, 1000003, 'l_orderkey', 'l_linenumber')}) AS BIGINT) AS key_hash, count(DISTINCT l_returnflag) AS categories FROM lineitem")
def a9(v: Views):
    return tb.fingerprint(v.table("lineitem"), ["l_orderkey", "l_linenumber"], "l_returnflag")


@query("A10_compare_tables", f"WITH {TRADES}, g AS (SELECT inst, sum(value) AS got FROM trades GROUP BY inst), w AS (SELECT inst, sum(value) + CASE WHEN inst < 'Brand#2' THEN 1 ELSE 0 END AS want FROM trades WHERE inst <> 'Brand#7' GROUP BY inst) SELECT inst, CASE WHEN want IS NULL OR got IS NULL THEN 'SKIP' WHEN abs(got - want) <= 0.01 THEN 'PASS' ELSE 'MISMATCH' END AS verdict FROM g FULL JOIN w USING (inst)")
def a10(v: Views):
    got = v.trades.groupBy("inst").agg(F.sum("value").alias("x"))
    want = v.trades.where("inst <> 'Brand#7'").groupBy("inst").agg((F.sum("value") + F.when(F.col("inst") < "Brand#2", 1).otherwise(0)).alias("x"))
    return tb.compare_tables(got, want, ["inst"], "x", 0.01).select("inst", "verdict")


AUDITED = ("customer", "supplier", "orders", "lineitem")
KINDS = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'FLOAT' THEN 'float' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(column_type) END"


@query("A11_schema_audit", f"WITH c AS ({' UNION ALL '.join(f'SELECT column_name, {KINDS} AS type FROM (DESCRIBE {t})' for t in AUDITED)}) SELECT column_name AS column, count(*) AS frames, list_sort(list(DISTINCT type)) AS types, count(*) = 4 AND count(DISTINCT type) = 1 AS agree FROM c GROUP BY 1")
def a11(v: Views):
    return tb.schema_audit(v.spark, {t: v.table(t) for t in AUDITED})


@query("B1_admit", f"WITH {TRADES} SELECT inst, count(*) AS n FROM trades WHERE side IN (1, 4) AND rate > 0 AND kind IN ('A', 'N') AND length(inst) BETWEEN 7 AND 7 GROUP BY inst")
def b1(v: Views):
    return cl.admit(v.trades, ["A", "N"], (7, 7)).groupBy("inst").agg(F.count("*").alias("n"))


@query("B2_mask_interval", f"WITH {TRADES} SELECT inst, count(*) AS n, max(d) AS last FROM trades WHERE NOT day BETWEEN DATE '1995-05-01' AND DATE '1996-06-30' GROUP BY inst")
def b2(v: Views):
    return cl.mask_interval(v.trades, "day", "1995-05-01", "1996-06-30").groupBy("inst").agg(F.count("*").alias("n"), F.max("d").alias("last"))


ENTITY_SQL = "CASE WHEN o_orderkey % 5 = 0 THEN '(null)' WHEN o_orderkey % 5 = 1 THEN 'ENT' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || strftime(o_orderdate, '%y%m%d') ELSE ' E' || CAST(o_custkey AS VARCHAR) END"


@query("B3_entity_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN 'ENT' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'E' || CAST(o_custkey AS VARCHAR) END AS eid FROM orders")
def b3(v: Views):
    raw = F.when(F.col("o_orderkey") % 5 == 0, "(null)").when(
        F.col("o_orderkey") % 5 == 1, F.concat(F.lit("ENT"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.date_format("o_orderdate", "yyMMdd"))
    ).otherwise(F.concat(F.lit(" E"), F.col("o_custkey").cast("string")))
    return v.table("orders").select("o_orderkey", cl.entity_id(raw).alias("eid"))


@query("B4_repair_year", "SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + INTERVAL 100 YEAR ELSE CAST(o_orderdate AS DATE) END AS DATE) AS day FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998 AND NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)")
def b4(v: Views):
    o = v.table("orders").where("year(o_orderdate) between 1995 and 1998 and not (month(o_orderdate) = 2 and day(o_orderdate) = 29)")
    short = F.when(F.col("o_orderkey") % 3 == 0, F.make_date(F.year("o_orderdate") - 1900, F.month("o_orderdate"), F.dayofmonth("o_orderdate"))).otherwise(F.to_date("o_orderdate"))
    return o.select("o_orderkey", cl.repair_year(short).alias("day"))


@query("B5_backfill", f"WITH {PRICE}, x AS (SELECT inst, d, CASE WHEN day(d) > 15 THEN round(close, 2) END AS c FROM price), g AS (SELECT *, count(c) OVER (PARTITION BY inst ORDER BY d DESC) AS k FROM x) SELECT inst, d, max(c) OVER (PARTITION BY inst, k) AS c FROM g QUALIFY max(c) OVER (PARTITION BY inst, k) IS NOT NULL", "c", 2)
def b5(v: Views):
    return cl.backfill(v.price.select("inst", "d", F.when(F.dayofmonth("d") > 15, F.round("close", 2)).alias("c")), "inst", "d", "c")


@query("B6_dedup_priority", f"WITH {TRADES} SELECT inst, d, kind, value FROM trades QUALIFY row_number() OVER (PARTITION BY inst, d ORDER BY CASE kind WHEN 'N' THEN 0 WHEN 'R' THEN 1 ELSE 2 END, value DESC, entity) = 1")
def b6(v: Views):
    rank = F.when(F.col("kind") == "N", 0).when(F.col("kind") == "R", 1).otherwise(2)
    return cl.dedup_priority(v.trades, ["inst", "d"], [rank, F.desc("value"), F.asc("entity")]).select("inst", "d", "kind", "value")


@query("B7_dedup_canonical", f"WITH {TRADES} SELECT entity, day, inst, quantity, value FROM trades QUALIFY row_number() OVER (PARTITION BY entity, day ORDER BY CASE WHEN inst < 'Brand#2' THEN 0 ELSE 1 END, quantity DESC, value DESC) = 1")
def b7(v: Views):
    order = [F.when(F.col("inst") < "Brand#2", 0).otherwise(1), F.desc("quantity"), F.desc("value")]
    return cl.dedup_priority(v.trades, ["entity", "day"], order).select("entity", "day", "inst", "quantity", "value")


@query("B8_repair_shift", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CASE WHEN (SELECT avg(CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 1.0 ELSE 0 END) FROM orders) > 0.05 THEN 1 ELSE 0 END AS day FROM orders")
def b8(v: Views):
    return cl.repair_shift(v.table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day")


SPLIT = "'FACE VALUE SPLIT FROM RS.' || CAST(1 + o_orderkey % 60 AS VARCHAR) || '/- TO RE.' || CAST(1 + o_custkey % 3 AS VARCHAR)"


@query("B9_parse_split", "SELECT * FROM (SELECT o_orderkey, CASE WHEN f > 1.01 AND f <= 50 THEN f END AS factor FROM (SELECT o_orderkey, CAST(1 + o_orderkey % 60 AS DOUBLE) / (1 + o_custkey % 3) AS f FROM orders))", "factor")
def b9(v: Views):
    text = F.concat(F.lit("FACE VALUE SPLIT FROM RS."), (1 + F.col("o_orderkey") % 60).cast("string"), F.lit("/- TO RE."), (1 + F.col("o_custkey") % 3).cast("string"))
    return v.table("orders").select("o_orderkey", cl.parse_split(text).alias("factor"))


@query("B10_parse_bonus", "SELECT o_orderkey, CASE WHEN f > 1.01 AND f <= 20 THEN f END AS factor FROM (SELECT o_orderkey, (o_orderkey % 40 + 1 + o_custkey % 4) / (1.0 + o_custkey % 4) AS f FROM (SELECT *, 1 FROM orders))", "factor")
def b10(v: Views):
    text = F.concat(F.lit("Bonus issue "), (F.col("o_orderkey") % 40).cast("string"), F.lit(" : "), (1 + F.col("o_custkey") % 4).cast("string"))
    return v.table("orders").select("o_orderkey", cl.parse_bonus(text).alias("factor"))


FACTORS = "f AS (SELECT inst, d, exp(sum(ln(1 + quantity / 50))) AS factor, count(*) AS n_events FROM trades WHERE quantity > 45 GROUP BY inst, d)"


def _factors(v: Views):
    return cl.combine_events(v.trades.where("quantity > 45").withColumn("f", 1 + F.col("quantity") / 50), ["inst", "d"], "f")


@query("B11_combine_events", f"WITH {TRADES}, {FACTORS} SELECT inst, d, factor, n_events FROM f", "factor", 4)
def b11(v: Views):
    return _factors(v)


CONFIRMED = PRICE + f", {FACTORS}, c AS (SELECT p.inst, p.d, p.ret, f.factor, CASE WHEN f.factor IS NOT NULL AND p.ret IS NOT NULL THEN abs(ln((1 / (1 + p.ret)) / f.factor)) <= ln(CAST(1.3 AS DOUBLE)) END AS ok FROM price p LEFT JOIN f ON p.inst = f.inst AND p.d = f.d)"


def _confirmed(v: Views):
    j = v.price.select("inst", "d", "ret").join(_factors(v).select("inst", "d", "factor"), ["inst", "d"], "left")
    return j.withColumn("ok", F.when(F.col("factor").isNotNull(), cl.confirm(F.col("factor"), 1 / (1 + F.col("ret")))))


@query("B12_confirm", f"WITH {CONFIRMED} SELECT ok, count(*) AS n FROM c GROUP BY ok")
def b12(v: Views):
    return _confirmed(v).groupBy("ok").agg(F.count("*").alias("n"))


@query("B13_adjust_returns", f"WITH {CONFIRMED} SELECT inst, d, CASE WHEN factor IS NOT NULL AND ok = FALSE THEN NULL WHEN factor IS NOT NULL THEN (1 + ret) * factor - 1 ELSE ret END AS ret_adj FROM c", "ret_adj")
def b13(v: Views):
    return cl.adjust_returns(_confirmed(v), "ret", "factor", "ok").select("inst", "d", "ret_adj")


@query("B14_future_factor", f"WITH {PRICE}, e AS (SELECT inst, d, close, CASE WHEN month(d) = 3 AND day(d) < 8 THEN 1.2 ELSE 1.0 END AS f FROM price) SELECT inst, d, close / exp(coalesce(sum(ln(f)) OVER (PARTITION BY inst ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS adj_close FROM e", "adj_close", 2)
def b14(v: Views):
    e = v.price.withColumn("f", F.when((F.month("d") == 3) & (F.dayofmonth("d") < 8), 1.2).otherwise(1.0))
    return cl.future_factor(e, "inst", "d", "f", "close").select("inst", "d", "adj_close")


@query("B15_guard_returns", f"WITH {PRICE} SELECT inst, d, coalesce(abs(ret) > 0.5, FALSE) AS flagged, CASE WHEN abs(ret) <= 0.5 THEN ret END AS ret FROM price", "ret")
def b15(v: Views):
    return cl.guard_returns(v.price.select("inst", "d", "ret"), "ret").select("inst", "d", "flagged", "ret")


@query("B16_winsorise", f"WITH {PRICE}, q AS (SELECT quantile_cont(ret, 0.01) AS a, quantile_cont(ret, 0.99) AS b FROM price) SELECT inst, d, CASE WHEN ret IS NULL THEN a ELSE least(greatest(ret, a), b) END AS ret FROM price, q WHERE ret IS NOT NULL", "ret")
def b16(v: Views):
    return cl.winsorise(v.price.select("inst", "d", "ret").where("ret is not null"), "ret", 0.01, 0.99)


@query("B17_era", f"WITH {TRADES} SELECT CASE WHEN d <= DATE '1997-06-30' THEN 'TRAIN' WHEN d >= DATE '1998-01-01' THEN 'TEST' ELSE 'MASK' END AS era, count(*) AS n FROM trades GROUP BY 1")
def b17(v: Views):
    return v.trades.groupBy(cl.era(F.col("d"), "1997-06-30", "1998-01-01").alias("era")).agg(F.count("*").alias("n"))


@query("B18_complete_cases", f"WITH {PRICE} SELECT count(*) AS n, min(d) AS first FROM price WHERE ret IS NOT NULL AND adj IS NOT NULL")
def b18(v: Views):
    return v.price.dropna(subset=["ret", "adj"]).agg(F.count("*").alias("n"), F.min("d").alias("first"))


@query("B19_min_sequence", f"WITH {EVENTS} SELECT event_id FROM ev QUALIFY count(*) OVER (PARTITION BY user_id) >= 70")
def b19(v: Views):
    return cl.min_sequence(v.events, "user_id", "ts", 70).select("event_id")


@query("B19_min_sequence_causal", f"WITH {EVENTS} SELECT event_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts) >= 50")
def b19c(v: Views):
    return cl.min_sequence(v.events, "user_id", "ts", 50, causal=True).select("event_id")


@query("B20_last_rows", f"WITH {EVENTS} SELECT event_id, user_id FROM ev QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5")
def b20(v: Views):
    return cl.last_rows(v.events, "user_id", "ts", 5).select("event_id", "user_id")


@query("B21_random_block", f"WITH {EVENTS}, n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM ev), s AS (SELECT *, {mix_sql(7, '(greatest(m - 20, 0) + 1)', 'user_id')} AS a FROM n) SELECT event_id, user_id FROM s WHERE k > a AND k <= a + 20")
def b21(v: Views):
    return cl.random_block(v.events, "user_id", "ts", 20, seed=7).select("event_id", "user_id")


@query("B22_check_extract", f"WITH {TRADES} SELECT 'null' AS rule, 'entity' AS \"column\", count(*) FILTER (entity IS NULL) AS violations FROM trades UNION ALL SELECT 'range', 'quantity', count(*) FILTER (NOT quantity BETWEEN 2 AND 40) FROM trades")
def b22(v: Views):
    return cl.check_extract(v.trades, ["entity"], {"quantity": (2.0, 40.0)})


@query("B23_null_months", "WITH o AS (SELECT o_orderdate, CASE WHEN month(o_orderdate) = 4 OR o_orderkey % 9 = 0 THEN NULL ELSE 1 END AS side FROM orders) SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, avg(CASE WHEN side IS NULL THEN 1.0 ELSE 0 END) AS null_share, bool_and(side IS NULL) AS all_null FROM o GROUP BY 1", "null_share")
def b23(v: Views):
    o = v.table("orders").withColumn("side", F.when((F.month("o_orderdate") == 4) | (F.col("o_orderkey") % 9 == 0), None).otherwise(1))
    return cl.null_months(o, "o_orderdate", "side")


@query("B24_malformed_ids", "SELECT p_type AS id, count(*) AS records, count(DISTINCT p_name) AS names FROM part WHERE NOT regexp_matches(p_type, '^[A-M]') GROUP BY p_type")
def b24(v: Views):
    return cl.malformed_ids(v.table("part"), "p_type", "^[A-M]", "p_name")


@query("B25_on_calendar", f"WITH {TRADES}, {CALENDAR} SELECT count(*) AS n FROM trades WHERE d IN (SELECT d FROM calendar)")
def b25(v: Views):
    return cl.on_calendar(v.trades, v.calendar, "d").agg(F.count("*").alias("n"))


@query("C1_equi_join", f"WITH {PRICE}, {PANEL.replace(TRADES + ', ', '')} SELECT p.inst, p.d, p.net, q.ret FROM panel p LEFT JOIN price q ON p.inst = q.inst AND p.d = q.d", "net ret")
def c1(v: Views):
    return v.panel.select("inst", "d", "net").join(v.price.select("inst", "d", "ret"), ["inst", "d"], "left")


@query("C2_anti_join", f"WITH {TRADES} SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT entity FROM trades WHERE quantity >= 50 AND kind = 'R')")
def c2(v: Views):
    return v.table("supplier").join(v.trades.where("quantity >= 50 and kind = 'R'"), F.col("s_suppkey") == F.col("entity"), "left_anti").select("s_suppkey")


@query("C3_semi_join", f"WITH {TRADES} SELECT count(*) AS n FROM trades WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def c3(v: Views):
    return v.trades.join(v.table("supplier").where("s_acctbal > 5000"), F.col("entity") == F.col("s_suppkey"), "left_semi").agg(F.count("*").alias("n"))


VINTAGES = "vint AS (SELECT user_id, day AS asof_day, max(value) AS level FROM ev WHERE event_type = 'purchase' GROUP BY user_id, day)"


def _vintages(v: Views):
    return v.events.where("event_type = 'purchase'").groupBy("user_id", F.col("day").alias("asof_day")).agg(F.max("value").alias("level"))


@query("C4_asof_backward", f"WITH {EVENTS}, {VINTAGES} SELECT e.event_id, v.level, v.asof_day AS asof_day_matched FROM ev e ASOF LEFT JOIN vint v ON e.user_id = v.user_id AND e.day >= v.asof_day")
def c4(v: Views):
    return jn.asof_join(v.events.select("event_id", "user_id", "day"), _vintages(v), ["user_id"], "day", "asof_day", ["level"]).select("event_id", "level", "asof_day_matched")


@query("C5_asof_forward", f"WITH {EVENTS}, {VINTAGES} SELECT e.event_id, v.level, v.asof_day AS asof_day_matched FROM ev e ASOF LEFT JOIN vint v ON e.user_id = v.user_id AND e.day <= v.asof_day")
def c5(v: Views):
    return jn.asof_join(v.events.select("event_id", "user_id", "day"), _vintages(v), ["user_id"], "day", "asof_day", ["level"], "forward").select("event_id", "level", "asof_day_matched")


@query("C6_asof_keyless", f"WITH {EVENTS}, m AS (SELECT day + 3 AS avail, avg(value) AS level FROM ev GROUP BY day) SELECT e.event_id, m.level FROM ev e ASOF LEFT JOIN m ON e.day >= m.avail", "level")
def c6(v: Views):
    macro = v.events.groupBy(F.date_add("day", 3).alias("avail")).agg(F.avg("value").alias("level"))
    # One row a day: match the few days first, then meet the many rows on the day itself.
    days = v.events.select("day").distinct().withColumn("k", F.lit(1))
    found = jn.asof_join(days, macro.withColumn("k", F.lit(1)), ["k"], "day", "avail", ["level"]).select("day", "level")
    return v.events.join(found, "day").select("event_id", "level")


INTERVALS = "iv AS (SELECT user_id, asof_day AS a, lead(asof_day) OVER (PARTITION BY user_id ORDER BY asof_day) AS b, level FROM vint)"


def _intervals(v: Views):
    from pyspark.sql import Window

    return _vintages(v).select("user_id", F.col("asof_day").alias("a"), F.lead("asof_day").over(Window.partitionBy("user_id").orderBy("asof_day")).alias("b"), "level")


@query("C7_point_in_interval", f"WITH {EVENTS}, {VINTAGES}, {INTERVALS} SELECT e.event_id, i.level FROM ev e LEFT JOIN iv i ON e.user_id = i.user_id AND e.day >= i.a AND (i.b IS NULL OR e.day < i.b)")
def c7(v: Views):
    return jn.resolve(v.events.select("event_id", "user_id", "day"), _intervals(v), "user_id", "day", "a", "b", "level").select("event_id", "level")


@query("C8_vintage_strict", f"WITH {EVENTS}, {VINTAGES} SELECT e.event_id, v.level, CAST(date_diff('day', v.asof_day, e.day) AS INTEGER) AS age FROM ev e ASOF LEFT JOIN vint v ON e.user_id = v.user_id AND e.day > v.asof_day")
def c8(v: Views):
    j = jn.asof_join(v.events.select("event_id", "user_id", "day"), _vintages(v), ["user_id"], "day", "asof_day", ["level"], strict=True)
    return j.select("event_id", "level", F.datediff("day", "asof_day_matched").alias("age"))


@query("C9_in_vintage_window", f"WITH {EVENTS}, {VINTAGES} SELECT v.user_id, v.asof_day, count(e.event_id) > 0 AS seen FROM vint v LEFT JOIN ev e ON e.user_id = v.user_id AND e.event_type = 'error' AND e.day <= v.asof_day AND e.day > v.asof_day - 4 GROUP BY 1, 2")
def c9(v: Views):
    e = v.events.where("event_type = 'error'").select("user_id", "day").distinct().withColumn("x", F.col("day"))
    last = jn.asof_join(_vintages(v), e, ["user_id"], "asof_day", "day", ["x"])
    return last.select("user_id", "asof_day", F.coalesce(F.col("x") > F.date_sub("asof_day", 4), F.lit(False)).alias("seen"))


@query("C10_nearest_event", f"WITH {EVENTS}, {VINTAGES}, b AS (SELECT e.event_id, e.user_id, e.day, date_diff('day', v.asof_day, e.day) AS x FROM ev e ASOF LEFT JOIN vint v ON e.user_id = v.user_id AND e.day >= v.asof_day) SELECT b.event_id, CAST(least(b.x, date_diff('day', b.day, v.asof_day)) AS INTEGER) AS days FROM b ASOF LEFT JOIN vint v ON b.user_id = v.user_id AND b.day <= v.asof_day")
def c10(v: Views):
    return jn.nearest_event_days(v.events.select("event_id", "user_id", "day"), _vintages(v), ["user_id"], "day", "asof_day").select("event_id", "days")


@query("C11_in_any_window", f"WITH {TRADES} SELECT CASE WHEN day BETWEEN DATE '1994-01-01' AND DATE '1994-03-31' THEN 'w1' WHEN day BETWEEN DATE '1997-08-01' AND DATE '1997-12-31' THEN 'w2' END AS w, count(*) AS n FROM trades GROUP BY 1")
def c11(v: Views):
    label = jn.in_any_window(v.trades, "day", [("w1", "1994-01-01", "1994-03-31"), ("w2", "1997-08-01", "1997-12-31")])
    return v.trades.groupBy(label.alias("w")).agg(F.count("*").alias("n"))


@query("C12_bridge_flags", f"WITH {STATES} SELECT s.inst, s.d, s.state, t.inst IS NOT NULL AS deal FROM states s LEFT JOIN (SELECT DISTINCT inst, d FROM trades WHERE quantity >= 49) t ON s.inst = t.inst AND s.d = t.d")
def c12(v: Views):
    deal = v.trades.where("quantity >= 49").select("inst", "d", F.lit(True).alias("deal")).distinct()
    return v.states.select("inst", "d", "state").join(deal, ["inst", "d"], "left").na.fill(False, ["deal"])


@query("C13_frame_diff", f"WITH {PANEL}, b AS (SELECT inst, d, gross + CASE WHEN month(d) = 2 THEN 0.5 ELSE 0 END AS g FROM panel WHERE d < DATE '1998-01-01') SELECT round(max(abs(p.gross - b.g)), 4) AS worst, count(*) FILTER (p.gross IS NOT NULL AND b.g IS NOT NULL AND abs(p.gross - b.g) > 0.1) AS differing, count(*) FILTER (b.g IS NULL) AS full_only, count(*) FILTER (p.gross IS NULL) AS part_only FROM panel p FULL JOIN b ON p.inst = b.inst AND p.d = b.d")
def c13(v: Views):
    full = v.panel.select("inst", "d", "gross")  # not rounded: two sums of the same rows may fall on either side of a half
    part = full.where("d < '1998-01-01'").withColumn("gross", F.col("gross") + F.when(F.month("d") == 2, 0.5).otherwise(0.0))
    out = jn.frame_diff(full, part, ["inst", "d"], "gross", 0.1)
    return out.withColumn("worst", F.round("worst", 4))


@query("C14_lookup_map", f"WITH {TRADES}, m AS (SELECT kind, avg(value) AS mean_value FROM trades GROUP BY kind) SELECT inst, avg(value - mean_value) AS excess FROM trades JOIN m USING (kind) GROUP BY inst", "excess", 4)
def c14(v: Views):
    m = v.trades.groupBy("kind").agg(F.avg("value").alias("mean_value"))
    return v.trades.join(m, "kind").groupBy("inst").agg(F.avg(F.col("value") - F.col("mean_value")).alias("excess"))


EDGES = "edges AS (SELECT 'I' || CAST(o.o_custkey AS VARCHAR) AS old_id, 'I' || CAST(n.o_custkey AS VARCHAR) AS new_id, CAST(o.o_orderdate AS DATE) AS ca_date, left(o.o_orderpriority, 1) AS tier FROM orders o LEFT JOIN orders n ON n.o_orderkey = o.o_orderkey + 1)"
ADMITTED = EDGES + ", adm AS (SELECT * FROM edges WHERE old_id <> new_id AND tier IN ('1', '2', '3') QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY ca_date, new_id) = 1)"


def _edges(v: Views):
    """An edge per order: from its customer to that of the order with the next number."""
    o = v.table("orders")
    n = o.select((F.col("o_orderkey") - 1).alias("k"), F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("new_id"))
    j = o.join(n, F.col("o_orderkey") == F.col("k"), "left")
    return j.select(F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("old_id"), "new_id", F.to_date("o_orderdate").alias("ca_date"), F.substring("o_orderpriority", 1, 1).alias("tier"))


def _admitted(v: Views):
    return idn.admit_edges(_edges(v), ["1", "2", "3"])


@query("D1_admit_edges", f"WITH {ADMITTED} SELECT old_id, new_id, ca_date FROM adm")
def d1(v: Views):
    return _admitted(v).select("old_id", "new_id", "ca_date")


@query("D2_break_reciprocal", f"WITH {ADMITTED} SELECT a.old_id, a.new_id FROM adm a LEFT JOIN adm b ON a.old_id = b.new_id AND a.new_id = b.old_id WHERE b.old_id IS NULL OR (substr(a.new_id, 2, 1) < '5' AND NOT substr(a.old_id, 2, 1) < '5')")
def d2(v: Views):
    return idn.break_reciprocal(_admitted(v), "substr(id, 2, 1) < '5'").select("old_id", "new_id")


def _chains(edges: str, name: str) -> str:
    return f"""{name} AS (WITH RECURSIVE c AS (SELECT old_id, new_id AS canonical_id, ca_date AS effective_from, 1 AS depth, tier, [old_id, new_id] AS seen FROM {edges}
 UNION ALL SELECT c.old_id, a.new_id, a.ca_date, c.depth + 1, greatest(c.tier, a.tier), list_append(c.seen, a.new_id) FROM c JOIN {edges} a ON c.canonical_id = a.old_id WHERE NOT list_contains(c.seen, a.new_id) AND a.ca_date >= c.effective_from)
 SELECT old_id, canonical_id, effective_from, depth, tier FROM c UNION ALL SELECT old_id, old_id, NULL, 0, tier FROM {edges})"""


CHAINS = f"{ADMITTED}, {_chains('adm', 'ch')}, iv AS (SELECT old_id, canonical_id, effective_from, depth, CASE WHEN depth = 0 THEN 'SELF' ELSE max(tier) OVER (PARTITION BY old_id) END AS confidence, lead(effective_from) OVER (PARTITION BY old_id ORDER BY depth) AS effective_to FROM ch)"


@query("D3_chain_intervals", f"WITH {CHAINS} SELECT old_id, canonical_id, effective_from, effective_to, depth, confidence FROM iv")
def d3(v: Views):
    return idn.chain_intervals(_admitted(v)).select("old_id", "canonical_id", "effective_from", "effective_to", "depth", "confidence")


@query("D4_interval_gates", f"WITH {CHAINS}, g AS (SELECT *, lag(effective_to) OVER (PARTITION BY old_id ORDER BY depth) AS p FROM iv) SELECT count(*) AS n, count(*) FILTER (effective_to < effective_from) AS not_monotone, count(*) FILTER (canonical_id = old_id AND depth > 0) AS self, count(*) FILTER (depth > 0 AND p IS DISTINCT FROM effective_from) AS holes FROM g")
def d4(v: Views):
    return idn.interval_gates(idn.chain_intervals(_admitted(v)))


CUT = "1996-06-30"


@query("D4_hindsight_gate", f"WITH {CHAINS}, early AS (SELECT * FROM adm WHERE ca_date <= DATE '{CUT}'), {_chains('early', 'ch2')}, f AS (SELECT old_id, canonical_id, effective_from, depth FROM ch WHERE depth > 0 AND effective_from <= DATE '{CUT}'), p AS (SELECT old_id, canonical_id, effective_from, depth FROM ch2 WHERE depth > 0), x AS ((SELECT * FROM f EXCEPT SELECT * FROM p) UNION (SELECT * FROM p EXCEPT SELECT * FROM f)) SELECT (SELECT count(*) FROM x) AS hindsight, (SELECT count(*) FROM (SELECT * FROM f UNION SELECT * FROM p)) AS intervals")
def d4h(v: Views):
    return idn.hindsight_gate(_admitted(v), CUT)


@query("D5_overlaps", f"WITH {TRADES}, l AS (SELECT inst, entity, min(day) AS a, max(day) AS b FROM trades GROUP BY 1, 2), x AS (SELECT *, max(b) OVER (PARTITION BY inst ORDER BY a, b, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM l) SELECT inst, entity, a, b, prev_end FROM x WHERE prev_end > a")
def d5(v: Views):
    life = v.trades.groupBy("inst", "entity").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    return idn.overlaps(life, "inst", "a", "b", "entity")


@query("D6_issuer_terminal", f"WITH {TRADES} SELECT left(inst, 7) AS issuer, count(DISTINCT inst) AS ids, arg_max(inst, (day, inst)) AS terminal, CAST(date_diff('day', min(day), max(day)) AS INTEGER) AS span FROM trades GROUP BY 1")
def d6(v: Views):
    return v.trades.groupBy(F.substring("inst", 1, 7).alias("issuer")).agg(F.countDistinct("inst").alias("ids"), F.max_by("inst", F.struct("day", "inst")).alias("terminal"), F.datediff(F.max("day"), F.min("day")).alias("span"))


@query("D7_issuer_fill", f"WITH {EVENTS}, x AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS c FROM ev) SELECT event_id, last_value(c IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM x")
def d7(v: Views):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return v.events.select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("value")), ignorenulls=True).over(w).alias("c"))


@query("D8_lifetimes", f"WITH {EVENTS}, l AS (SELECT user_id, event_type, min(day) AS a, max(day) AS b FROM ev GROUP BY 1, 2), n AS (SELECT *, lead(a) OVER (PARTITION BY user_id ORDER BY a, b, event_type) AS nx FROM l) SELECT user_id, count(*) AS keys, CASE WHEN bool_and(coalesce(nx > b, TRUE)) THEN 'fragment' ELSE 'coexist' END AS kind FROM n GROUP BY user_id")
def d8(v: Views):
    return idn.lifetimes(v.events, "user_id", "event_type", "day")


@query("D9_name_similarity", "SELECT a.p_partkey AS a, b.p_partkey AS b, len(list_intersect(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' '))) / CAST(len(list_distinct(list_concat(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' ')))) AS DOUBLE) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1", "similarity")
def d9(v: Views):
    p = v.table("part")
    b = p.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("b"), F.col("p_name").alias("nb"))
    j = p.join(b, F.col("p_partkey") == F.col("k"))
    return idn.name_similarity(j, "p_name", "nb").select(F.col("p_partkey").alias("a"), "b", "similarity")


@query("D10_coverage", f"WITH {EVENTS}, {VINTAGES} SELECT e.event_type, count(*) AS n, count(v.user_id) AS matched, avg(CASE WHEN v.user_id IS NULL THEN 0.0 ELSE 1 END) AS rate FROM ev e LEFT JOIN vint v ON e.user_id = v.user_id AND e.day = v.asof_day GROUP BY 1", "rate")
def d10(v: Views):
    vint = _vintages(v).select(F.col("user_id").alias("u"), "asof_day")
    j = v.events.join(vint, (F.col("user_id") == F.col("u")) & (F.col("day") == F.col("asof_day")), "left")
    return j.groupBy("event_type").agg(F.count("*").alias("n"), F.count("u").alias("matched"), F.avg(F.col("u").isNotNull().cast("double")).alias("rate"))


@query("D11_link_confirmed", f"WITH {ADMITTED}, s AS (SELECT 'I' || CAST(o_custkey AS VARCHAR) AS id, list(DISTINCT o_orderpriority) AS syms FROM orders GROUP BY 1) SELECT a.old_id, a.new_id, list_has_any(x.syms, y.syms) AS shared FROM adm a JOIN s x ON x.id = a.old_id JOIN s y ON y.id = a.new_id")
def d11(v: Views):
    s = v.table("orders").groupBy(F.concat(F.lit("I"), F.col("o_custkey").cast("string")).alias("id")).agg(F.collect_set("o_orderpriority").alias("syms"))
    a = _admitted(v)
    x, y = s.select(F.col("id").alias("old_id"), F.col("syms").alias("sx")), s.select(F.col("id").alias("new_id"), F.col("syms").alias("sy"))
    return a.join(x, "old_id").join(y, "new_id").select("old_id", "new_id", F.arrays_overlap("sx", "sy").alias("shared"))
