"""Line dedup over windows of three consecutive lines (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import free_names, let, materialize

WIDTH = 3


def _windows(text):
    """array of struct(pos, a, b): two 64-bit hashes of each run of three lines.

    A run of blank lines only is no window.
    """
    lines = F.split(text, "\n")
    hashed = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), (F.trim(x) != "").alias("full")))

    def runs(h):
        def one(x, i):
            y, z = F.get(h, i + 1), F.get(h, i + 2)
            return F.struct(
                i.alias("pos"), F.xxhash64(x["a"], y["a"], z["a"]).alias("a"), F.xxhash64(x["b"], y["b"], z["b"]).alias("b"),
                (z.isNotNull() & (x["full"] | y["full"] | z["full"])).alias("use"),
            )

        return F.filter(F.transform(h, one), lambda w: F.coalesce(w["use"], F.lit(False)))

    return let(hashed, runs)


def later_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every window that repeats an earlier one: doc_id, text_hash, pos (of its first line).

    Earlier means a smaller id (null first), then a smaller position.  A window's copies
    are reduced to the first and last place before the shuffle; windows meet the repeated
    ones in a join that Spark can split, so a common window needs no task of its own.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.explode(_windows(F.col(text_col))).alias("w"))
    rows = materialize(rows.select("doc_id", "text_hash", "w.pos", "w.a", "w.b"), "windows")
    place = F.struct("doc_id", "text_hash", "pos")
    again = rows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("a", "b", "first")
    return rows.join(again, ["a", "b"]).where(place != F.col("first")).select("doc_id", "text_hash", "pos").distinct()


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", detail: tuple[str, str] | None = None) -> DataFrame:
    """`docs`, all columns and rows, without the lines that later copies of windows cover.

    Lines are what stands between newlines.  A line goes if any window of three lines
    over it stands earlier, in this or another document; covered positions of
    overlapping windows are merged.  The first occurrence of every different line stays
    somewhere in the corpus.  Windows of blank lines only do not count.  Texts of fewer
    than three lines are left alone, null texts
    stay null; a text may become empty.  Rows that repeat id and text are one document.
    An empty table gives an empty result.  With `detail` two columns of these names are
    added: the numbers of lines and of removed lines.

    Windows are told apart by two 64-bit hashes, not by their lines: of n different windows
    any two fall together with a probability of about n^2 / 2^129.
    """
    own_id, own_hash, gone_id, gone_hash, at, left_lines = free_names(docs, 6)
    found = later_windows(docs, id_col, text_col).groupBy(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).agg(F.array_sort(F.collect_list("pos")).alias(at))
    text = F.col(f"`{text_col}`")
    marked = docs.withColumns({own_id: F.col(f"`{id_col}`"), own_hash: F.xxhash64(text)})
    joined = marked.join(found, F.col(own_id).eqNullSafe(F.col(gone_id)) & (F.col(own_hash) == F.col(gone_hash)), "left")
    # One character per line up to the last window: does a later window begin here?
    begins = F.array_join(F.transform(at, lambda p, k: F.concat(F.repeat(F.lit("0"), p - F.coalesce(F.get(at, k - 1), F.lit(-1)) - 1), F.lit("1"))), "")
    lines = F.split(text, "\n")

    def kept(flags):
        def begun(i):
            return F.coalesce(F.get(flags, i) == "1", F.lit(False))

        return F.filter(lines, lambda _, i: ~(begun(i) | begun(i - 1) | begun(i - 2)))

    left = F.when(F.col(at).isNull(), lines).otherwise(let(F.split(begins, ""), kept))
    joined = joined.withColumn(left_lines, left)
    n, k = F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(left_lines), F.lit(0))
    cols = [(F.array_join(left_lines, "\n") if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns]
    if detail:
        cols += [F.when(text.isNull(), 0).otherwise(x).cast("long").alias(c) for x, c in zip((n, n - k), detail, strict=True)]
    return joined.select(*cols)
