"""Corpus pipeline: raw documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the stage before it kept and
returns a DataFrame; all but the last return the columns of ``documents``.  ``run`` writes each
stage's result as Parquet into the shared folder and reads it again for the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import line_chunks, mixing, near_dedup, packing, quality
from fidelis.llm.queries import held_out, table, tokenizer_path
from fidelis.session import checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the compression classifier scores 0.3 or more (labels that are held out stay unseen)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(~held_out()).select("doc_id", "quality"))
    return quality.keep_good(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove repeated multi-line chunks from the texts; ``n_chars`` follows the new text."""
    clean = line_chunks.clean_documents(docs)
    return clean.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similarity 0.8; of rows that share an id one stays.

    Rows without an id stay unless such a row equals another row's text.
    """
    kept = near_dedup.near_duplicates(docs.select("doc_id", "text"), percent=80).where("kept")
    # one key for the semi join and for the row that stays of an id, so the texts are shuffled once
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id")
    stay = docs.select("*", key, F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)).alias("__text")).join(kept.select(key).distinct(), "__id", "left_semi")
    return stay.dropDuplicates(["__id", "__text"]).select(*[f"`{c}`" for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the Pfair schedule of their sources (square-root weights)."""
    places = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("__place")).agg(F.min(F.struct("slot", "chars_before")).alias("__at"))
    placed = docs.join(places, F.col("doc_id").eqNullSafe(F.col("__place")))
    return placed.orderBy("__at.slot", "__at.chars_before", "source", "doc_id").select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed among neighbours of the mixed order (as the files hold it) into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(), order=packing.file_order())


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", line_dedup), ("near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: The quality classifier cannot be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
