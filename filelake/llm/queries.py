"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .decontam import decontaminate
from .langid import identify
from .lemp import hard_negatives
from .licenses import scan
from .line_dedup import drop_repeated_lines
from .log_bloom import score_texts
from .mixing import mix
from .near_dup import near_duplicates
from .pii import personal_data
from .prefix_trie import pack_tries, paths, trie_nodes, turn_items
from .topk import top_k
from .warc import captures
from .wavelet import token_documents


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files of projects: 97 consecutive doc_ids make a project; its first is its LICENSE, its
    second the COPYING of its source's folder, the others lie two folders down."""
    project = F.concat(F.lit("p"), F.floor(F.col("doc_id") / 97).cast("string"))
    path = (
        F.when(F.col("doc_id") % 97 == 0, F.concat_ws("/", project, F.lit("LICENSE")))
        .when(F.col("doc_id") % 97 == 1, F.concat_ws("/", project, F.col("source"), F.lit("COPYING")))
        .otherwise(F.concat_ws("/", project, F.col("source"), F.col("lang"), F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit(".txt"))))
    )
    return docs.select("doc_id", F.when(F.col("doc_id").isNotNull(), path).alias("path"), "text")


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(as_files(table(spark, sf_dir, "documents")), "doc_id")


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(table(spark, sf_dir, "pages"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Paths of the rebuilt conversations: conversation c has the first h turns of conversation c - c % 20, then its
    own after its first h; h is crc32 of c's digits modulo 4. At most 3 turns of a conversation are lent, to 19 others."""
    own = written(turn_items(conversations), "turns")
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("long")
    known = own.select("conv_id").distinct()
    lent = own.where("pos <= 3").select(F.col("conv_id").alias("lender"), "pos", "item")
    taken = known.withColumn("lender", F.col("conv_id") - F.col("conv_id") % 20).join(lent, "lender").where(F.col("pos") <= h)
    none = known.select("conv_id", F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("item"))
    kept = own.where(F.col("pos") > h)
    return paths(none.unionByName(taken.select("conv_id", "pos", "item")).unionByName(kept.select("conv_id", "pos", "item")))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(pack_tries(rebuilt(table(spark, sf_dir, "conversations"))))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hard_negatives(vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wavelet_tokens": _op1,
    "op2_exact_top_k": _op2,
    "op3_personal_data": _op3,
    "op4_line_dedup": _op4,
    "op5_decontamination": _op5,
    "op6_source_mixing": _op6,
    "op7_language_id": _op7,
    "op8_license_scan": _op8,
    "op9_near_duplicates": _op9,
    "op10_warc_transactions": _op10,
    "op11_prefix_trie": _op11,
    "op12_lm_scores": _op12,
    "op13_hard_negatives": _op13,
}

ORACLE_SQL: dict[str, str] = {
    "op11_prefix_trie": r"""
        WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL),
        k AS (SELECT DISTINCT conv_id FROM t),
        h AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''),
                lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 4 AS h FROM k),
        r AS (SELECT h.conv_id, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 20 AND t.pos <= h.h
            UNION ALL SELECT h.conv_id, t.pos, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.pos > h.h),
        q AS (SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY pos) AS p FROM r GROUP BY conv_id),
        p AS (SELECT k.conv_id, coalesce(q.p, []) AS p FROM k LEFT JOIN q USING (conv_id)),
        m AS (SELECT conv_id, d, p[1:d] AS n, len(p) = d AS ends FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM p)),
        g AS (SELECT n, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS e
            FROM m GROUP BY n, d),
        c AS (SELECT n[1:d - 1] AS n, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
        f AS (SELECT g.*, coalesce(c.n_children, 0) AS n_children,
                CASE WHEN g.d = 0 THEN 0 ELSE (g.n_convs - 1) * len(regexp_extract_all(g.n[g.d].t, '[^\x20\x09-\x0D]+')) END AS own
            FROM g LEFT JOIN c ON c.n = g.n),
        a AS (SELECT n[1:u] AS n, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved_tokens
            FROM (SELECT n, n_children, own, unnest(range(0, d + 1)) AS u FROM f) GROUP BY ALL)
        SELECT f.conv_id, f.d AS depth, o.conv_id AS parent_conv_id, f.n_convs, f.n_children, a.n_leaves::BIGINT AS n_leaves,
            a.saved_tokens::BIGINT AS saved_tokens, sha256(f.e) AS ends_sha256
        FROM f JOIN a ON a.n = f.n LEFT JOIN g o ON f.d > 0 AND o.d = f.d - 1 AND o.n = f.n[1:f.d - 1]""",
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_dot_product(a.e, o.e)::BIGINT AS score
            FROM v a JOIN v o ON a.vec_id % 50 = 0 AND a.vec_id <> o.vec_id),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
                row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
            FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op2_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op9_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
        u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
              GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
        r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, m.component_id, g.doc_id = m.component_id AS kept
        FROM g JOIN m USING (doc_id)""",
}
