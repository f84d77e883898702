"""From documents to tokens: good texts, without exact and near copies, mixed to weights and encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carewatch.llm.bpe import default_tokenizer
from carewatch.llm.common import Scratch, table
from carewatch.llm.exact import exact_dedup
from carewatch.llm.mixing import mixed_documents
from carewatch.llm.near import near_dedup
from carewatch.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all of `labels`, doesn't reject.

    Null texts count as empty and are scored like any other; repeated rows share a score.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of equal texts, whatever its doc_id; null texts equal empty ones. Very long texts are compared chunk by chunk."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts whose sets of five-word shingles have a similarity of 0.8 or more.

    SimHash fingerprints find the pairs, the sets decide them. Texts without words are one
    component; a null doc_id is the last to stay; very long texts are hashed whole.
    """
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; null sources are one source, texts without words aren't taken.

    Repeated rows are taken alike, each as often as the other; very long texts only by whole documents.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text (little-endian unsigned 32-bit), their number, and whether they decode to the text; one row per row.

    Null texts count as empty, very long texts are encoded whole, repeated rows alike.
    """
    tokenizer, scratch = default_tokenizer(spark), Scratch(spark)
    rows = docs.select("doc_id", "source", "lang", "text", tokenizer.round_trip(F.col("text")).alias("b"))
    same = F.col("b.text") == F.coalesce("text", F.lit(""))
    count = (F.octet_length("b.ids") / 4).cast("long").alias("n_tokens")
    with scratch.small_batches():
        return scratch.stored(rows.select("doc_id", "source", "lang", count, "b.ids", same.alias("decodes")), "tokens")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mixing), ("byte-level BPE", tokens)]
#: The classifier, fingerprints and tokens aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each stored in the shared folder before the next reads it.

    Columns beyond those of documents pass through to the last stage, which leaves them
    out; empty tables give an empty result.
    """
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
