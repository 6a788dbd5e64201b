"""Registered queries over the text tables, each a thin use of its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.fingerprints import edited_pairs

    return edited_pairs(_documents(spark, sf_dir))


def op2_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.gru_lm import score
    from panelweave.llm.language_id import crc32_of_id

    return score(_documents(spark, sf_dir), F.pmod(crc32_of_id(), F.lit(5)) == 1)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of lines, of removed lines, and the text that is left."""
    from panelweave.llm.line_dedup import dedup_lines

    found = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), detail=("n_lines", "n_removed"))
    return found.select("doc_id", "n_lines", "n_removed", "text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its removed paragraphs and passages and the text that is left."""
    from panelweave.llm.substring_dedup import dedup_substrings

    found = dedup_substrings(_documents(spark, sf_dir).select("doc_id", "text"), detail="removed")
    removed = F.coalesce("removed", F.array().cast(found.schema["removed"].dataType))
    keeps = F.array_sort(F.array_distinct(F.transform(removed, lambda r: r["keep_doc_id"])))
    return found.select("doc_id", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"), keeps.alias("keep_doc_ids"), "text")


def op5_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's pieces with a tenth of the merges dropped."""
    from panelweave.llm.piece_codec import encode_pieces

    return encode_pieces(_documents(spark, sf_dir), dropout=0.1, seed=7)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.packing import pack

    return pack(_documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.exact_dedup import exact_copies

    return exact_copies(_documents(spark, sf_dir)).drop("n_chars")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.language_id import crc32_of_id, identify

    docs = _documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.pmod(crc32_of_id(), F.lit(3)) == 1
    found = identify(docs.withColumn("held_out", held_out), ~F.col("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.license_scan import scan_licenses

    return scan_licenses(_documents(spark, sf_dir))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.ngram_join import ngram_components

    return ngram_components(_documents(spark, sf_dir), n=4, num=85, den=100)[0]


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.vector_codes import books_sha256, vector_codes, with_label_error

    codes, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), carry=("label",))
    found = with_label_error(codes, "label", "vec_id")
    return found.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.filter_audit import filter_audit

    return filter_audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from panelweave.llm.language_id import crc32_of_id
    from panelweave.llm.toxicity import score_toxicity

    docs = _documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.pmod(crc32_of_id(), F.lit(4)) == 2)
    found = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~F.col("held_out"))
    return found.select("doc_id", "held_out", "score", "predicted")


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_gru_lm": op2_gru_lm,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_piece_codec": op5_piece_codec,
    "op6_packing": op6_packing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_license_scan": op9_license_scan,
    "op10_ngram_join": op10_ngram_join,
    "op11_vector_codes": op11_vector_codes,
    "op12_filter_audit": op12_filter_audit,
    "op13_toxicity": op13_toxicity,
}


def vector_codes_sql(rounds: int = 4, entries: int = 256) -> str:
    """The four rounds of codebooks as a chain of common table expressions; all numbers are whole and exact as doubles."""
    near = """SELECT p.vec_id, p.part, min((list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x)) * 256 + c.entry) AS m
              FROM p JOIN c{0} c ON p.part = c.part GROUP BY p.vec_id, p.part"""
    own = """o{0} AS MATERIALIZED (SELECT vec_id, part, CAST(m AS BIGINT) % 256 AS entry, CAST(m AS BIGINT) // 256 AS error FROM (""" + near + "))"
    move = """n{0} AS (SELECT part, entry, list(floor(s / n) ORDER BY place) AS x FROM (
                 SELECT o.part, o.entry, i AS place, sum(p.x[i]) AS s, count(*) AS n FROM o{0} o JOIN p ON o.vec_id = p.vec_id AND o.part = p.part, range(1, (SELECT max(len(x)) FROM p) + 1) r(i)
                 GROUP BY ALL) GROUP BY part, entry),
              c{1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(n.x, c.x) AS x FROM c{0} c LEFT JOIN n{0} n ON c.part = n.part AND c.entry = n.entry)"""
    steps = [t.format(k, k + 1) for k in range(rounds) for t in (own, move)] + [own.format(rounds)]
    return f"""
        WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
        p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM k, range(4) r(part)),
        c0 AS MATERIALIZED (SELECT part, entry, x FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM p) WHERE entry < {entries}),
        {", ".join(steps)},
        f AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM o{rounds} GROUP BY vec_id),
        b AS (SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS sha FROM (
                SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM c{rounds}))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256 FROM f JOIN k USING (vec_id), b
    """


def filter_audit_sql() -> str:
    """Documents by the set of filters they fail, counted for each of the 120 orders' steps."""
    from itertools import permutations

    steps = [(sum(1 << i for i in p[:s]), p[s], "".join("ABCDE"[i] for i in p), s + 1) for p in permutations(range(5)) for s in range(5)]
    table = ", ".join(f"({m}, {1 << i}, '{o}', {s})" for m, i, o, s in steps)
    return f"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
        b AS (SELECT doc_id, part,
                CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN min(doc_id) OVER (PARTITION BY t) < doc_id THEN 16 ELSE 0 END AS fails,
                doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM d),
        g AS (SELECT part, fails, good, toxic, count(*) AS n FROM b GROUP BY ALL),
        s(mask, bit, filter_order, step) AS (VALUES {table}),
        r AS (SELECT part, filter_order, step, bit,
                sum(CASE WHEN fails & (mask | bit) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN fails & mask = 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN fails & mask <> 0 AND fails & bit <> 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN fails = bit THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN fails & mask = 0 AND fails & bit <> 0 AND good THEN n ELSE 0 END) AS good_lost,
                sum(CASE WHEN fails & mask = 0 AND fails & bit <> 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
              FROM g, s GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
               CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
    """


ORACLES = {
    "op3_line_dedup": """
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        w AS (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS pos FROM d),
        k AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM w
              WHERE trim(ls[pos + 1]) <> '' OR trim(ls[pos + 2]) <> '' OR trim(ls[pos + 3]) <> ''),
        r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS rn FROM k),
        c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM r WHERE rn > 1),
        l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM d),
        s AS (SELECT l.doc_id, l.pos, l.line, c.pos IS NOT NULL AS gone FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
        FROM s GROUP BY doc_id
    """,
    "op7_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS sha
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY sha) AS group_size,
               row_number() OVER (PARTITION BY sha ORDER BY n DESC, doc_id) = 1 AS kept,
               sha AS text_sha256
        FROM d
    """,
    "op11_vector_codes": vector_codes_sql(),
    "op12_filter_audit": filter_audit_sql(),
}
