"""Registered queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import bpe, conversations, labelled, lattice, media, mixing, neardup, negatives, ngrams, oracles, pseudonyms, quality, templates, toxicity, urls
from hindcast.llm.shipping import ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube-method mix of all documents."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op2_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginal probabilities of all documents over the segmentations into existing pieces."""
    import public_tokenizers

    return lattice.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the recurring lines that others had before them."""
    return templates.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of all texts under the vocabulary for many languages."""
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def _predicted(scored: DataFrame, folds: int, held: int, least: float) -> DataFrame:
    return scored.select("doc_id", labelled.held_out(folds, held).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bradley-Terry quality scores of all documents."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = quality.learn(docs, _table(spark, sf_dir, "labels"))
    return _predicted(quality.scores(docs, model).drop("text"), quality.FOLDS, quality.HELD, quality.GOOD)


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain rules and trusted-to-raw n-gram ratio of all documents."""
    trusted = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return ngrams.judge(_table(spark, sf_dir, "documents"), trusted)


def op7_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of copies among pictures of all vectors and edited versions of some of them."""
    return media.copies(media.pictures(_table(spark, sf_dir, "embeddings")))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms for what identifies people; a real run brings a secret key."""
    return pseudonyms.pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), b"hindcast-demonstration-key")


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: three-word shingles, similarity 0.85 or more."""
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), 3, 85)


def op10_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive-unlabelled toxicity scores of all documents."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return _predicted(toxicity.scores(docs, model).drop("text"), toxicity.FOLDS, toxicity.HELD, toxicity.TOXIC)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of all conversations, after planted damage."""
    return conversations.repair(conversations.damage(_table(spark, sf_dir, "conversations")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the positives of every hundredth vector, among all vectors."""
    return negatives.mine(_table(spark, sf_dir, "embeddings"))


def op13_url_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages by rules and by their host's trust and distrust."""
    return urls.judge(_table(spark, sf_dir, "pages"), urls.RULES)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_source_mixing, op2_subword_lattice, op3_line_templates, op4_byte_bpe, op5_quality_ranking, op6_ngram_ratio, op7_image_copies,
        op8_feistel_pseudonyms, op9_hyperminhash, op10_toxicity_pu, op11_conversation_repair, op12_hard_negatives, op13_url_link_graph,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE: dict[str, str] = {
    "op9_hyperminhash": f"""with recursive
        told as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
        sh as (select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 3 then [array_to_string(w, ' ')]
            else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from told),
        size as (select doc_id, count(*) as n from sh group by doc_id),
        met as (select a.doc_id as x, b.doc_id as y, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
        link as (select x, y from met join size a on a.doc_id = x join size b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
        ends as (select x, y from link union all select y, x from link),
        reach as (select doc_id, doc_id as r from documents union select reach.doc_id, ends.y from reach join ends on ends.x = reach.r)
        select d.doc_id, coalesce(any_value(n), 0) as n_shingles, min(r) as component_id, d.doc_id = min(r) as kept
        from documents d join reach using (doc_id) left join size using (doc_id) group by d.doc_id""",
    "op11_conversation_repair": oracles.conversations(),
    "op12_hard_negatives": oracles.negatives(),
    "op13_url_link_graph": oracles.urls(),
}


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """Name to query, and name to SQL."""

    def shipped(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        return run

    return {name: shipped(query) for name, query in QUERIES.items()}, dict(ORACLE)
