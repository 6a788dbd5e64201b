"""N-gram Jaccard join: a prefix-filtered, prefix-tree set join over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import BUCKETS, bucket_counts, components, free_names, id_filter, materialize, slices
from panelweave.llm.trie_join import linked_components
from panelweave.llm.words import _WordHash, binaries, distinct, parity_sketches, set_hashes, shingles


_HASH = _WordHash()


def _ordered(column: pa.Array, n: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the texts in the global order: rare n-grams first, each part by hash; and their sizes."""
    s, count = shingles(column, n)
    s >>= np.uint64(1)
    b = (s & np.uint64(BUCKETS - 1)).astype(np.int64)
    often = (common[b >> 3] >> (b & 7).astype(np.uint8)) & 1
    return distinct(s | (often.astype(np.uint64) << np.uint64(63)), count)


def common_buckets(docs: DataFrame, n: int) -> np.ndarray:
    """One bit per hash bucket (of `BUCKETS`): do its n-grams occur far above the mean?

    Counted over all documents (`bucket_counts`).
    Any outcome gives a valid global order; the better it is, the fewer candidates.
    """
    total = bucket_counts(docs, lambda b: shingles(b.column(0), n)[0] >> np.uint64(1))
    return np.packbits(total > 32 + 4 * total.mean(), bitorder="little")


def _classes(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, links, components): what both uses need.

    rows: (doc_id, text_hash, size, node), one per row of `docs`; a node is a 64-bit hash of a set,
    null for an empty set or a null id.  links: (a, b) and components: (node, component) of nodes.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    common = common_buckets(source.select("text"), n)

    def sign(batches):
        for b in slices(batches):
            items, size = _ordered(b.column(2), n, common)
            full = (size > 0) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            none = ~full
            lead = np.where(full, size + (-num * size) // den + 1, 0)
            begin = np.cumsum(size) - size
            keys = items[np.arange(len(items)) - np.repeat(begin, size) < np.repeat(lead, size)].view(np.int64)
            ends = pa.array(np.concatenate([[0], np.cumsum(lead)]), pa.int32(), mask=np.concatenate([none, [False]]))
            columns = [
                b.column(0), b.column(1), pa.array(size, pa.int64()), pa.array(set_hashes(items, size), mask=none),
                pa.ListArray.from_arrays(ends, pa.array(keys)), pa.array(np.array(parity_sketches(items, size), object), pa.binary(), mask=none),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "size", "node", "prefix", "sketch"])

    signed = materialize(source.mapInArrow(sign, "doc_id long, text_hash long, size long, node long, prefix array<long>, sketch binary"), "signed")
    classes = signed.where("node is not null").groupBy("node").agg(
        F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("text_hash").alias("text_hash")
    )
    classes = materialize(classes, "classes")
    keys = classes.select(F.explode("prefix").alias("key"), "node", "size")

    def sets_of(nodes: DataFrame) -> DataFrame:
        texts = id_filter(classes.join(nodes, "node", "left_semi").select("text_hash"), "text_hash")

        def whole(batches):
            for b in slices(batches):
                b = b.filter(pa.array(texts.many(b.column("text_hash").to_numpy())))
                items, size = _ordered(b.column("text"), n, common)
                yield pa.RecordBatch.from_arrays([pa.array(set_hashes(items, size)), binaries(items, size)], ["node", "items"])

        found = source.select("text_hash", "text").mapInArrow(whole, "node long, items binary")
        return found.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("items").alias("items"))

    links, comp = linked_components(classes.select("node", "size", "sketch"), keys, sets_of, num, den)
    return signed.select("doc_id", "text_hash", "size", "node"), links, comp


def ngram_components(
    docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents, links): one row per row of `docs` (doc_id, n_shingles, component_id), and verified links.

    Two documents link when den * |A n B| >= num * |A u B| for their sets of distinct word
    n-grams.  Equal sets are one class; its smallest id stands for it.  In the global
    order (rare first) two linked sets share an n-gram within their first
    |A| - ceil(num |A| / den) + 1, which serve as candidate keys; candidates are verified
    on their whole sets by `linked_components`.  Links are between representatives and
    form a spanning forest of each component.

    Null, empty and wordless texts have size 0 and are linked with nothing; their
    component is their own id.  A null id is never linked (its component is null).
    Rows that repeat an id count as one document: what any of its texts is linked with is
    one component.  Extra columns are not read; an empty table gives empty results.
    Shingles are 63-bit hashes and sets 64-bit ones.
    """
    rows, links, comp = _classes(docs, n, num, den, id_col, text_col)
    of_class = rows.where("node is not null").select("doc_id", "node").distinct().join(comp, "node", "left").select("doc_id", "node", F.coalesce("component", "node").alias("c"))
    of_class = materialize(of_class, "of-class")
    # An id with texts of several components joins these.
    several = of_class.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z").select("doc_id", "a")
    joined = components(several.join(of_class, "doc_id").select("a", F.col("c").alias("b")))
    of_class = of_class.join(joined, F.col("c") == joined["node"], "left").select("doc_id", of_class["node"], F.coalesce("component", "c").alias("c"))
    of_class = materialize(of_class, "of-document")
    least = of_class.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_doc = of_class.groupBy("doc_id").agg(F.min("c").alias("c")).join(least, "c").select("doc_id", "component_id")
    out = rows.select("doc_id", F.col("size").alias("n_shingles")).join(of_doc, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    first = of_class.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    links = links.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    return out, links


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """`docs`, all its columns, with one document of each component of texts (see `ngram_components`).

    Unless told otherwise sets are of five words and link at a similarity of 0.8.  The
    smallest id stays, of equal ids the smallest hash of the text.  Rows are told apart by id and text: rows that
    repeat both stay or go together, and a text of its own stays whatever else has its id.
    Rows with a null id or a text without words stay; an empty table gives an empty result.
    """
    rows, _, comp = _classes(docs, **({"n": 5, "num": 80, "den": 100} | how), id_col=id_col, text_col=text_col)
    member = rows.where("node is not null").join(comp, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("c"))
    member = materialize(member, "members")
    keep = member.groupBy("c").agg(F.min(F.struct("doc_id", "text_hash")).alias("keep"))
    gone = member.join(keep, "c").where(F.struct("doc_id", "text_hash") != F.col("keep")).select("doc_id", "text_hash").distinct()
    own_id, own_hash = free_names(docs, 2)
    gone = gone.toDF(own_id, own_hash)
    same = (docs[id_col].cast("long") == gone[own_id]) & (F.xxhash64(docs[text_col]) == gone[own_hash])
    return docs.join(gone, same, "left_anti")
