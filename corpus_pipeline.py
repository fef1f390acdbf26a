"""From raw documents to an encoded training mix: five stages, each written as Parquet and read by the next.

Every stage works on all rows of the one before.  Null texts count as empty,
texts of any length are worked on whole, rows with null ids or sources are
rows like others, and an empty table stays empty.  Further columns pass through
the first four stages; names that a stage uses for itself are listed with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barloom.llm import bpe, mixing, nbsvm, pii, prob_minhash
from barloom.llm.common import new_folder, table
from barloom.llm.queries import SURROGATE_KEY, tokenizer_file

#: Some stages have no SQL form (a learned model, signatures, a knapsack, a tokenizer); tests compare with brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, all columns.

    A score at the threshold is accepted.  Repeated rows get equal scores, so
    all of them stay or go.  Without labels of both classes every document has
    the same score.  A column ``_quality`` of the input is dropped.
    """
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    scored = nbsvm.score(docs, model, "_quality")
    return scored.where(F.col("_quality") >= nbsvm.THRESHOLD).drop("_quality")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id, and one of repeated rows.

    Rows without an id are kept.  Columns beginning with ``_dup_`` are dropped.
    """
    return prob_minhash.deduplicated(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; ``n_chars`` follows the new text, null texts keep theirs.

    Equal texts get equal results.  Columns ``n_entities`` and those beginning
    with ``_pii_`` are dropped.
    """
    clean = pii.replace(docs, SURROGATE_KEY).drop("n_entities")
    length = F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "long"))
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), length).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target mix takes them, up to three times each; repeated rows are documents of their own.

    A text without a word takes no part.  Columns beginning with ``_mix_`` are dropped.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with their number and digests; all other columns end here."""
    return bpe.encode(docs, tokenizer_file("word_bpe_49k.json"), with_ids=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", private), ("mixing", mix), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
