"""A training-data pipeline over the documents table.

Five stages, each an operator of ``hindcast.llm``: documents of low quality go, recurring
lines go, one document of each near-duplicate group stays, sources are mixed to their
weights, and the mix is encoded.  A stage reads what the stage before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.llm import bpe, mixing, neardup, quality, templates
from hindcast.llm.scratch import kept
from hindcast.llm.shipping import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose preference score is not below the cutoff; the ranking is learned from the marks."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = kept(quality.scores(_documents(docs), quality.learn(docs, labels)), "scored")
    return _documents(scored.where(F.col("score") >= quality.cutoff(scored, labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; those of which nothing is left go."""
    ship(spark)
    out = templates.dedup(_documents(docs))
    out = out.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return _documents(out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    found = neardup.near_duplicates(docs, 5, 80).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("__kept"))
    known = docs.where("doc_id is not null").join(found.hint("merge"), "doc_id").where("__kept")
    # Rows of one doc_id are one document.  The join has them together already.
    known = known.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("__row = 1")
    return _documents(known).unionByName(_documents(docs.where("doc_id is null")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; sources near their target weights.

    Rows that share a doc_id are taken as often as the most taken one of them.
    """
    ship(spark)
    copies = mixing.mix(docs).where("copies > 0").groupBy(F.col("doc_id").alias("__of")).agg(F.max("copies").alias("__copies"))
    taken = docs.join(copies.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__of")))
    return _documents(taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, checked by their round trip."""
    import public_tokenizers

    ship(spark)
    out = bpe.encode(_documents(docs), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("byte-level BPE encoding and decoding", encoding),
]

#: Learned scores and draws have no SQL form; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = kept(docs, "stage")
    return docs
