"""A corpus pipeline of five stages, each a call of one training-data operator on all that its predecessor kept.

Rows without doc_id, source or text, empty and very long texts, and repeated rows go through all stages; what becomes of them is said
at each.  Rows are told apart by doc_id and text.  An empty table gives an empty table at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import pii, toxicity
from tessera.llm.common import materialise
from tessera.llm.mixing import mixed
from tessera.llm.packing import packed
from tessera.llm.queries import vocabulary
from tessera.llm.similar import one_of_similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic.

    A null or empty text has no features and stays; repeated rows stay or go together.  Without a toxic label all stay.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.scored(docs, model).where("predicted = 0").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    Texts without words, null ones too, are copies of each other, and one of them stays; a text of fewer words is one shingle.  Of
    repeated rows one stays.  A null doc_id counts as larger than any.
    """
    return one_of_similar(docs).select(COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind, n_chars counted anew; a null text stays null, with n_chars null."""
    masked = pii.redacted(docs.drop("n_chars"), pii.train(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken.

    Documents without words add nothing to a source and are left out or taken like others; null sources are one source.
    """
    return mixed(docs).where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(1, copies)"))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens; a null or empty text is its end token."""
    return packed(docs, *vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Classifier, fingerprints and token ids are beyond SQL; the tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
