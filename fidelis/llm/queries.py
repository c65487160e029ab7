"""Queries of the training-data operators over the whole driver tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import alignment, filter_audit, fingerprints, html_extract, line_chunks, mixing, near_dedup, packing, quality, repetition, substrings, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's labels are kept from training (a null id: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@query("op1_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, unhex(sha1(html))::BIT::VARCHAR AS b, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
    16 * (substr(b, (5*i+1)::INT, 1) = '1')::INT + 8 * (substr(b, (5*i+2)::INT, 1) = '1')::INT + 4 * (substr(b, (5*i+3)::INT, 1) = '1')::INT
    + 2 * (substr(b, (5*i+4)::INT, 1) = '1')::INT + (substr(b, (5*i+5)::INT, 1) = '1')::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_mixing", mixing.ORACLE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op3_fingerprints")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents"))


@query("op4_repetition", repetition.ORACLE_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf_dir, "documents"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain junk -> toxic -> both, learnt from the labels that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    junk, toxic = F.col("quality") == 0, F.col("toxic") == 1
    chain = toxicity.fit(docs, labels.where(~held_out()), {"junk": junk, "toxic": toxic, "toxic_junk": toxic & junk})
    return toxicity.score(docs, chain).withColumn("held_out", held_out())


@query("op6_line_chunks", line_chunks.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_chunks.dedup_lines(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_near_dedup", near_dedup.ORACLE_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op8_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out()).select("doc_id", "quality"))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op10_substrings", substrings.ORACLE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_filter_audit", filter_audit.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_html_text")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


@query("op13_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    return rows.select(F.col("doc_id").cast("bigint"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
