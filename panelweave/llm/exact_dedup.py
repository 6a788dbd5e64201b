"""Exact dedup by a tree-merge of sorted digest runs (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import free_names, materialize

SPACE = r"[\x20\x09-\x0D]+"


def normalised(text):
    """The text without any character of ``[\\x20\\x09-\\x0D]``; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = normalised(F.col(text_col))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(F.coalesce(text_col, F.lit(""))).cast("long").alias("n_chars"),
        F.sha2(norm, 256).alias("text_sha256"),
        # A second, unrelated hash and the length verify that equal digests are equal texts.
        F.xxhash64(norm).alias("check"),
        F.length(norm).alias("norm_chars"),
    )


KEY = ["text_sha256", "check", "norm_chars"]


def merge_runs(digests: DataFrame, runs: int, bits: int = 4, slices: int = 256) -> DataFrame:
    """One row per digest: `best` (the row that stays) and `group_size`.

    The digests of run r (rows with that `run`) are one sorted run in `slices` slices by
    the digest.  In each round the runs exchange along `bits` levels of a binomial tree: a run
    goes to the run whose number lacks its lowest `bits` bits, slice by slice, where the
    runs that arrive are merged in order of the digest, and of every verified digest
    the first row (the best) and the number of rows are kept.  A group of copies has at
    most one row per run and round, so no task ever holds the copies of one text.
    """
    level = digests.select(
        (F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long") % slices).cast("int").alias("slice"), "run", *KEY,
        (-F.col("n_chars")).alias("neg_chars"), "doc_id", "row", F.lit(1).cast("long").alias("group_size"),
    )
    best = ["neg_chars", "doc_id", "row"]
    group = Window.partitionBy("slice", "run", *KEY)

    def merged(level: DataFrame) -> DataFrame:
        """Rows of one (slice, run) meet in one task and are sorted once; both windows go by that order."""
        level = level.repartition("slice", "run").sortWithinPartitions("slice", "run", *KEY, *best)
        first = F.row_number().over(group.orderBy(*best))
        return level.withColumn("first", first).withColumn("group_size", F.sum("group_size").over(group)).where("first = 1").drop("first")

    while True:
        level = merged(level.withColumn("run", F.shiftright("run", bits)))
        runs = (runs - 1 >> bits) + 1
        if runs <= 1:
            break
    return level.select(*KEY, F.struct(*best).alias("best"), "group_size")


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 4) -> DataFrame:
    """The verdict on every row of `docs`: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after deleting every ``[\\x20\\x09-\\x0D]``.  Of equal
    texts the row with the most code points stays, then the smallest id (a null id is
    the smallest).  Null and empty texts are one group.  Of rows that repeat an id with
    the same text exactly one is kept.  Extra columns are not read.  An empty table
    gives an empty result.
    """
    digests = _digests(docs, id_col, text_col)
    digests = digests.withColumn("run", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id())
    digests = materialize(digests, "digests")
    runs = digests.agg(F.max("run")).first()[0]
    winners = merge_runs(digests, (runs or 0) + 1, bits)
    winners = winners.select(
        *KEY, "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")
    )
    return digests.join(winners, KEY).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_chars"
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, all its columns, without exact copies (see `exact_copies`).

    Rows that repeat both id and text are one document: any one of them stays.  Null and
    empty texts are one group, of which one row stays; a null id is the smallest; an empty
    table gives an empty result.
    """
    keep = exact_copies(docs, id_col, text_col).where("kept").select("doc_id", "text_sha256", "n_chars")
    own_id, own_sha, own_n, keep_id, keep_sha, keep_n = free_names(docs, 6)
    keep = keep.toDF(keep_id, keep_sha, keep_n)
    text = F.col(f"`{text_col}`")
    marked = docs.withColumns({own_id: F.col(f"`{id_col}`"), own_sha: F.sha2(normalised(text), 256), own_n: F.length(F.coalesce(text, F.lit(""))).cast("long")})
    same = F.col(own_id).eqNullSafe(F.col(keep_id)) & (F.col(own_sha) == F.col(keep_sha)) & (F.col(own_n) == F.col(keep_n))
    kept = marked.join(keep, same, "left_semi")
    return kept.dropDuplicates([own_id, own_sha]).select(*[F.col(f"`{c}`") for c in docs.columns])
