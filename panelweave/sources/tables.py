"""Readers, writers and table audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelweave.functions.mix import mix

TAPE = T.StructType([
    T.StructField("l_orderkey", T.LongType()), T.StructField("l_partkey", T.LongType()), T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_quantity", T.DoubleType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_discount", T.DoubleType()), T.StructField("l_tax", T.DoubleType()), T.StructField("l_returnflag", T.StringType()),
    T.StructField("l_linestatus", T.StringType()), T.StructField("l_shipdate", T.TimestampType()),
])


def read_tape(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet tape (a glob may name many files), with a declared schema and only the asked columns."""
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def read_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Several Parquet tables stacked by column name; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def clean_strings(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """All-string columns to types, leniently: headers and cells trimmed, unparseable cells null.

    spec: column (without padding) -> 'number' (thousands separators allowed), 'string' or
    a date pattern such as 'dd-MMM-yyyy'.
    """
    trimmed = df.toDF(*[c.strip() for c in df.columns])

    def cell(c: str, kind: str):
        text = F.trim(F.col(f"`{c}`"))
        if kind == "number":
            return F.regexp_replace(text, ",", "").try_cast("double")
        return text if kind == "string" else F.try_to_timestamp(text, F.lit(kind)).cast("date")

    return trimmed.select(*[cell(c, k).alias(c) for c, k in spec.items()])


def read_dirty_csv(spark: SparkSession, path: str, spec: dict[str, str]) -> DataFrame:
    """A CSV file read as strings and cleaned by `clean_strings`."""
    return clean_strings(spark.read.option("header", True).csv(path), spec)


def series(df: DataFrame, date_col: str, value_col: str) -> DataFrame:
    """(date, level) of a string series; cells that are no number, and their dates, are dropped."""
    out = df.select(F.col(date_col).try_cast("date").alias("date"), F.trim(F.col(value_col)).try_cast("double").alias("level"))
    return out.dropna()


def read_series_csv(spark: SparkSession, path: str, date_col: str, value_col: str) -> DataFrame:
    return series(spark.read.option("header", True).csv(path), date_col, value_col)


def write_with_lineage(df: DataFrame, path: str, name: str, inputs: list[str], lineage_path: str, extras: dict[str, str] | None = None) -> None:
    """Write Parquet and append one provenance row (name, inputs, extras, rows, time)."""
    df.write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path).agg(F.count("*").alias("rows"))
    pairs = [F.lit(x) for kv in (extras or {}).items() for x in kv]
    rows.select(
        F.lit(name).alias("name"), F.array(*map(F.lit, inputs)).cast("array<string>").alias("inputs"),
        (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>").alias("extras"), "rows", F.current_timestamp().alias("written"),
    ).write.mode("append").parquet(lineage_path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_densities(df: DataFrame, path: str) -> None:
    """Density rows (horizon, weighting, window, ..., arrays) partitioned for pruned reads."""
    df.write.mode("overwrite").partitionBy("h", "weighting", "window").parquet(path)


def decode_matrices(df: DataFrame, columns: list[str]) -> DataFrame:
    """JSON text of matrices to array<array<double>>; unparseable text becomes null."""
    return df.withColumns({c: F.from_json(c, "array<array<double>>") for c in columns})


def fingerprint(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Rows, an order-free hash of the keys (whole numbers), and the number of different categories."""
    part = mix(5, 1_000_003, *map(F.col, keys))
    return df.agg(F.count("*").alias("rows"), F.sum(part).alias("key_hash"), F.countDistinct(category).alias("categories"))


def compare_tables(got: DataFrame, want: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """Per key PASS, MISMATCH, or SKIP where either side has no value."""
    j = got.select(*keys, F.col(value).alias("got")).join(want.select(*keys, F.col(value).alias("want")), keys, "full")
    verdict = F.when(F.col("got").isNull() | F.col("want").isNull(), "SKIP").when(F.abs(F.col("got") - F.col("want")) <= tol, "PASS").otherwise("MISMATCH")
    return j.withColumn("verdict", verdict)


def schema_audit(spark: SparkSession, frames: dict[str, DataFrame]) -> DataFrame:
    """One row per column of any frame: its types, and whether all frames agree."""
    rows = [(n, f.name, f.dataType.simpleString()) for n, df in frames.items() for f in df.schema]
    table = spark.createDataFrame(rows, "frame string, column string, type string")
    return table.groupBy("column").agg(
        F.count("*").alias("frames"), F.array_sort(F.collect_set("type")).alias("types"),
        ((F.count("*") == len(frames)) & (F.countDistinct("type") == 1)).alias("agree"),
    )
