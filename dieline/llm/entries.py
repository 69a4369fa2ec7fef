"""The queries of the ten operators over the driver's tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytelevel, licences, lines, naming, near, packing, pages, quality, scoring, search
from .scratch import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines removed of each document, with a digest of the rest."""
    found = lines.line_dedup(_table(spark, sf_dir, "documents"), Scratch(spark))
    return found.select(
        "doc_id", "n_lines", "n_removed",
        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), Scratch(spark))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytelevel.round_trip(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.exact_dedup(_table(spark, sf_dir, "documents"), Scratch(spark))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_table(spark, sf_dir, "embeddings"), Scratch(spark))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), Scratch(spark))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: fifty ids are a folder below source and language, and its first id is its licence file, which others inherit from."""
    docs = _table(spark, sf_dir, "documents")
    folder = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 50).cast("string"))
    name = F.when(F.col("doc_id") % 50 == 0, F.lit("LICENSE")).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licences.licence_scan(docs.select("doc_id", "text", F.concat_ws("/", folder, name).alias("path")), Scratch(spark))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.lm_score(_table(spark, sf_dir, "documents"), Scratch(spark))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_dedup(_table(spark, sf_dir, "documents"), Scratch(spark), shingle=2)


ORACLE = {
    "op1_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
            FROM documents
        ), sets AS (
            SELECT doc_id, pos, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s
            FROM lines
        ), classes AS (
            SELECT row_number() OVER (ORDER BY f.doc_id, f.pos) AS cid, s, len(s) AS n, f.doc_id AS first_doc, f.pos AS first_pos
            FROM (SELECT s, min(struct_pack(doc_id := doc_id, pos := pos)) AS f FROM sets WHERE len(s) > 0 GROUP BY s)
        ), items AS (
            SELECT cid, n, unnest(s) AS item FROM classes
        ), shared AS (
            SELECT a.cid AS early, b.cid AS late, any_value(a.n) AS ne, any_value(b.n) AS nl, count(*) AS common
            FROM items a JOIN items b ON a.item = b.item AND a.cid < b.cid AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.cid, b.cid
        ), matched AS (
            SELECT DISTINCT late FROM shared WHERE 100 * common >= 80 * (ne + nl - common)
        ), gone AS (
            SELECT x.doc_id, x.pos
            FROM sets x JOIN classes c ON c.s = x.s LEFT JOIN matched m ON m.late = c.cid
            WHERE m.late IS NOT NULL OR x.doc_id <> c.first_doc OR x.pos <> c.first_pos
        )
        SELECT l.doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(g.pos) AS INTEGER) AS n_removed,
               coalesce(string_agg(CAST(g.pos AS VARCHAR), ',' ORDER BY l.pos), '') AS removed_lines,
               sha256(coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS text_sha256
        FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
        GROUP BY l.doc_id
    """,
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), flat AS (
            SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v
        ), scores AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM flat q JOIN flat c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM scores
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 5
    """,
    "op9_near_dedup": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                                WHEN len(w) = 1 THEN [w[1]]
                                ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
            FROM words
        ), items AS (
            SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS common
            FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
                 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT x, y FROM shared WHERE 100 * common >= 80 * (nx + ny - common)
        ), ways AS (
            SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach AS (
            SELECT doc_id AS origin, doc_id AS node FROM documents
            UNION
            SELECT r.origin, w.y FROM reach r JOIN ways w ON r.node = w.x
        )
        SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
        FROM sets s JOIN (SELECT origin, min(node) AS component_id FROM reach GROUP BY origin) m ON m.origin = s.doc_id
    """,
}


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality": op2_quality,
        "op3_byte_bpe": op3_byte_bpe,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_top_k": op5_top_k,
        "op7_main_text": op7_main_text,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op8_licences": op8_licences,
        "op10_lm_score": op10_lm_score,
        "op9_near_dedup": op9_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
