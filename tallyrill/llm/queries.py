"""The opN queries over the tables of a folder, their SQL, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, license_scan, media_columns, mixing, ngram_join, quality, suffix_dedup, toxicity, warc_zip
from .common import shared_folder, table


def tokenizer_path() -> str:
    """The byte-level BPE file that op3 and the pipeline use, beside the installed tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_substrings(table(spark, sf_dir, "documents")).drop("spans")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_sets(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.media_columns(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).drop("copies")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "archives")
    warc_zip.write_archives(table(spark, sf_dir, "pages"), path)
    return warc_zip.read_archives(spark.read.parquet(path))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_suffix_dedup, op2_ngram_join, op3_byte_bpe, op4_media_columns, op5_license_scan, op6_toxicity, op7_mixing, op8_exact_dedup, op9_quality, op10_warc_zip)
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INTEGER
           % (16 * greatest(1, ceil(sqrt((SELECT count(*) FROM documents)) / 1000)))::INTEGER AS salt
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS weight,
         2.0::DOUBLE * source_size AS most
  FROM sizes
), levels AS (
  SELECT *, row_number() OVER w AS place, most / weight AS ratio,
         (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW w AS (ORDER BY most / weight, source NULLS LAST)
), free AS (
  SELECT min(place) AS place, arg_min(level, place) AS level FROM levels WHERE level <= ratio
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.place IS NULL OR l.place < f.place THEN l.most ELSE f.level * l.weight END AS target
  FROM levels l CROSS JOIN free f
), ranked AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
         (('0x' || substr(md5('mix:' || coalesce(r.source, chr(0))), 1, 4))::INTEGER + 0.5::DOUBLE) / 65536.0::DOUBLE AS shift,
         row_number() OVER (PARTITION BY r.source ORDER BY floor(sqrt(r.size)), r.salt, r.size, r.doc_id NULLS FIRST) AS place
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (least(floor(place * each + shift) - floor((place - 1) * each + shift), 2) * size)::BIGINT AS taken
FROM ranked
""",
    "op8_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
}
