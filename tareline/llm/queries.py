"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tareline.llm import alignment, bpe, chosen_path, decontaminate, html_text, jaccard, licenses, negatives, quality, sharding, toxicity, warc, winnowing

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = "word_bpe_49k.json"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Every document encoded and decoded again, as digests of both."""
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(docs, path, keep=["doc_id"]).select(
        "doc_id", "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op3_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(table(spark, sf, "documents"))


def op4_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the documents that share four fifths of their runs of five words."""
    return jaccard.similar(table(spark, sf, "documents"))


def op5_html(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return html_text.page_texts(table(spark, sf, "pages"))


def op6_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    return winnowing.fingerprints(table(spark, sf, "documents"))


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in one of 24 shards of near equal bytes."""
    placed = sharding.shard(table(spark, sf, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages in every document."""
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op9_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document."""
    return quality.quality(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Fixity of every page's record against a replica in which about one record in fifty was damaged."""
    stored = warc.stored_records(table(spark, sf, "pages"))
    return warc.audit(stored, warc.damaged(stored, 50))


def op11_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's tokens of two vocabularies linked, with the counts of the linked pairs."""
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align(table(spark, sf, "documents"), *paths, keep=["doc_id"])


def op12_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the documents that share four fifths of their runs of four words, and the one that is kept."""
    return chosen_path.near_duplicates(table(spark, sf, "documents"))


def components_sql(words: int, more: str = "") -> str:
    """Every pair that shares a run, counted, and the links followed to their ends."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'),
                                                           '[^\x20\x09-\x0D]+') AS ws FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')]
                              ELSE list_distinct(list_transform(range(1, len(ws) - {words - 2}),
                                                                lambda i: array_to_string(ws[i:i + {words - 1}], ' '))) END AS runs
          FROM w),
    e AS (SELECT doc_id, len(runs) AS n, unnest(runs) AS run FROM s),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (run) WHERE a.doc_id <> b.doc_id
              GROUP BY a.doc_id, b.doc_id HAVING 180 * count(*) >= 80 * (any_value(a.n) + any_value(b.n))),
    reach AS (SELECT doc_id, doc_id AS other FROM documents
              UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
    SELECT doc_id, CAST(len(runs) AS BIGINT) AS n_shingles, component_id{more}
    FROM s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


def op13_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth embedding, some labels changed first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


NEGATIVES_SQL = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                 CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score,
           score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_bpe, op2_toxicity, op3_licenses, op4_jaccard, op5_html, op6_winnowing, op7_sharding,
              op8_decontamination, op9_quality, op10_warc, op11_alignment, op12_near_dedup, op13_negatives)
}
SQL: dict[str, str] = {
    "op3_licenses": licenses.scan_sql(),
    "op4_jaccard": components_sql(jaccard.WORDS),
    "op12_near_dedup": components_sql(chosen_path.WORDS, ", doc_id = component_id AS kept"),
    "op13_negatives": NEGATIVES_SQL,
}
