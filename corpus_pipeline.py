"""A corpus pipeline over `documents`: each stage works on all rows that the one before kept.

Each stage takes (spark, docs, folder of the tables) and returns a DataFrame that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of documents.

Null and empty texts have no language and go in the first stage; repeated rows and ties are settled by exact dedup (largest id,
then the order of the whole row), null ids count as one id; empty tables stay empty through all stages.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskloom.llm import bpe, exact_dedup, language_id, mixing, signature_join
from riskloom.llm.common import documents, stage_table

#: A text whose main language has less than this share of its letters is rejected, as is one without letters.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a main language; the model is fitted on labelled rows of docs."""
    model = language_id.fit(language_id.learned_rows(docs))
    return language_id.with_language(docs, model, lambda lang, share: lang != "und" and share >= LEAST_SHARE)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the one with the largest id."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates (five words, Jaccard 0.8): the one with the smallest id."""
    return signature_join.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source: rows are left out, kept or repeated."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the packed ids of the whole text, their number, and the digest of what they decode to."""
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), bpe.default_codec(spark))
    return coded.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_duplicates", near), ("mixture", mixture), ("byte_bpe", encode)]
#: Fitted languages, components and ids are beyond SQL; tests compare `run` with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
