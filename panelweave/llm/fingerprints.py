"""Document fingerprints by consistent weighted sampling (DataFrame operations only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import let

SAMPLES = 32


def word_shingles(text: Column, n: int = 5) -> Column:
    """64-bit hashes of the word n-grams of a text, repeats included.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  With fewer than `n` words the
    whole sequence is one n-gram; without words the array is empty.
    """
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def grams(h):
        whole = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]))
        return F.when(F.size(h) == 0, F.slice(h, 1, 0)).otherwise(F.slice(whole, 1, F.greatest(F.size(h) - (n - 1), F.lit(1))))

    return let(hashes, grams)


def weighted(terms: Column) -> Column:
    """Distinct terms with their counts: array of struct(term, weight)."""

    def runs(s):
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(F.size(s) > 0, let(
            starts,
            lambda at: F.transform(at, lambda i, k: F.struct(
                F.get(s, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(s)) - i).alias("weight")
            )),
        ))

    return let(F.sort_array(terms), runs)


def _uniform(h: Column, shift: int) -> Column:
    """Bits shift..shift+15 of a hash as a number in (0, 1)."""
    bits = F.shiftright(h, shift).bitwiseAND(F.lit(0xFFFF))
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0**-16)


def _sample(term: Column, log_weight: Column, i: int) -> Column:
    """The i-th sampling value of a weighted term: ln a of consistent weighted sampling.

    With r and c from Gamma(2, 1) (each minus the log of a product of two uniforms) and b
    uniform, all drawn from hashes of (term, i): t = floor(ln w / r + b) and
    ln a = ln c - r (t - b + 1).  The term of least a is the sample.  ln a depends on the
    term, i and t alone, so two texts have the same least value just if they have the
    same sample, which happens with the probability of their generalised Jaccard
    similarity.
    """
    h = F.xxhash64(term, F.lit(i))
    b = F.shiftrightunsigned(F.xxhash64(h), 11).cast("double") * F.lit(2.0**-53)
    r = -F.log(_uniform(h, 0) * _uniform(h, 16))
    log_c = F.log(-F.log(_uniform(h, 32) * _uniform(h, 48)))
    # b < 1, so a weight of one, as most have, gives t = 0 without the division.
    t = F.when(log_weight == 0.0, F.lit(0.0)).otherwise(F.floor(log_weight / r + b).cast("double"))
    return log_c - r * (t - b + F.lit(1.0))


def sampled(terms: DataFrame, by: list[str], samples: int = SAMPLES) -> DataFrame:
    """terms: rows (*by, term, log_weight), a null term where there is none.  The signature per group.

    `signature` is an array of `samples` doubles; a group without terms has infinities.
    Rows are reduced before any shuffle, so that a text never is gathered.
    """
    values = [F.min(F.when(F.col("term").isNotNull(), _sample(F.col("term"), F.col("log_weight"), i))).alias(f"s{i}") for i in range(samples)]
    low = terms.groupBy(*by).agg(*values)
    return low.select(*by, F.array(*[F.coalesce(f"s{i}", F.lit(float("inf"))) for i in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples: an estimate of generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) / samples


def text_of(signature: Column) -> Column:
    """The fingerprint as a string: eight hex digits per sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.xxhash64(x), 32))), 8, "0")), "")


def fingerprint(docs: DataFrame, text_col: str = "text", samples: int = SAMPLES, out: str = "fingerprint") -> DataFrame:
    """`docs`, all columns, with `out` (replaced, if there): equal texts have equal ones.  Null text: empty.

    A row number added in the scan tells repeated rows apart; an empty table gives an empty result.
    """
    docs = docs.drop(out)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("t", weighted(word_shingles(F.coalesce(F.col("d")[text_col], F.lit("")))))
    rows = rows.select("row", "d", F.explode_outer("t").alias("t"))
    rows = rows.select("row", "d", F.col("t.term").alias("term"), F.log(F.col("t.weight").cast("double")).alias("log_weight"))
    done = sampled(rows, ["row", "d"], samples)
    return done.select("d.*", text_of(F.col("signature")).alias(out))


def in_order(docs: DataFrame, id_col: str, text_col: str, most: int = 65_536) -> DataFrame:
    """doc_id, text and a `bucket` of neighbours by id, with an edge row at each bucket's end.

    Buckets, eight for each shuffle partition, begin at approximate quantiles of the ids (at most `most`, a bounded list), so
    they are even whatever ids there are.  The first row of each bucket is repeated as
    `edge` row of the bucket before (the last bucket gets the very first row), so that a
    window over one bucket sees the next document of every row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("k"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = min(most, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx("k", [i / n for i in range(n)], 100_000)).first()[0]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return rows.withColumn("bucket", F.lit(0)).withColumn("edge", F.lit(False))
    side = max(1, math.isqrt(len(cuts)))
    pages = F.lit([cuts[a] for a in range(0, len(cuts), side)])
    all_cuts = F.lit(cuts)
    page = F.greatest(F.size(F.filter(pages, lambda c: c <= F.col("k"))) - 1, F.lit(0))
    bucket = page * side + F.size(F.filter(F.slice(all_cuts, page * side + 1, side), lambda c: c <= F.col("k"))) - 1
    firsts = rows.where(F.col("k").isin(cuts)).groupBy("k", "doc_id").agg(F.min("text").alias("text"))
    before = firsts.withColumn("bucket", (F.array_position(all_cuts, F.col("k")).cast("int") - 2 + len(cuts)) % len(cuts))
    return rows.withColumn("bucket", bucket).withColumn("edge", F.lit(False)).unionByName(before.withColumn("edge", F.lit(True)))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last floor(n / 2)
    code points give way to the first as many (or all) of the next document.

    One row per row of `docs`: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.  The next document is the next by id,
    then text (a null id first), after the last the first; the only document is its own
    next.  Null and empty texts have no shingle; two such texts are alike (1), such a text
    and another are not (0).  Extra columns are not read; an empty table gives an empty
    result.  One shuffle deals the texts to buckets of neighbours; all else runs in place.
    """
    rows = in_order(docs, id_col, text_col)
    order = Window.partitionBy("bucket").orderBy("edge", "k", "text")
    rows = rows.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.when(~F.col("edge"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    both = rows.withColumn("edited", edited).select(
        "bucket", "place", "edge", "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(False).alias("is_edit"), F.col("text")), F.struct(F.lit(True).alias("is_edit"), F.col("edited").alias("text")))).alias("v"),
    ).where("v.text is not null")
    key = ["bucket", "place", "edge", "doc_id", "n_chars", "edited_sha256", "is_edit"]
    # The terms are a column first: rows are then dealt out and reduced in one piece of compiled code.
    terms = both.select(*key[:-1], F.col("v.is_edit").alias("is_edit"), weighted(word_shingles(F.col("v.text"))).alias("t"))
    terms = terms.select(*key, F.explode_outer("t").alias("t")).select(*key, F.col("t.term").alias("term"), F.log(F.col("t.weight").cast("double")).alias("log_weight"))
    signed = sampled(terms, key, samples)
    own = signed.groupBy(*key[:-1]).agg(
        F.max(F.when(~F.col("is_edit"), F.col("signature"))).alias("own"), F.max(F.when(F.col("is_edit"), F.col("signature"))).alias("edited")
    )
    own = own.withColumn("next", F.lead("own").over(Window.partitionBy("bucket").orderBy("place")))
    return own.where("not edge").select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("own")).alias("fingerprint"), text_of(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited"), samples).alias("near_edited"), likeness(F.col("own"), F.col("next"), samples).alias("near_next"),
    )
