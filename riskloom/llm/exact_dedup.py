"""Exact de-duplication with skew-safe combining.

Three combining steps, each grouping by digest AND full content, so equal digests of different texts never merge: inside
each map task, over (digest, salt of the task), and over the salts' winners. However large a group of copies is, a task of the
last step reads at most one row per salt of it. Per-row results then come from a narrow join on (digest, salt).

Null text counts as empty. Texts are equal when identical after lower-casing A-Z. The row with the largest id stays (null
ids are below all others); among rows that also share that id, one stays.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import SALTS, documents, keep_rows, salt_of, salted, stage_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Lower-case A-Z only; plain ASCII texts take the faster function."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest_of(text: Column) -> Column:
    return F.sha2(normalised(text).cast("binary"), 256)


def winners(df: DataFrame, id_col="doc_id", text_col="text", salts: int = SALTS) -> DataFrame:
    """Per distinct normalised text: (digest, content, keep_id, group_size)."""
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content"))
    rows = rows.select("doc_id", "content", F.sha2(F.col("content").cast("binary"), 256).alias("digest"),
                       (F.spark_partition_id() % salts).alias("salt"))
    by_salt = rows.groupBy("digest", "salt", "content").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return by_salt.groupBy("digest", "content").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))


def exact_duplicates(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of df."""
    groups = stage_table(winners(df, id_col, text_col).groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("contents")), "digests")
    rows = df.select(F.col(id_col).alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
    several = groups.filter((F.col("group_size") > 1) & (F.col("contents") == 1)).drop("contents")
    joined = rows.withColumn("salt", salt_of("doc_id")).join(salted(several), ["digest", "salt"], "left").drop("salt")
    clashing = groups.filter("contents > 1").select("digest")
    if not clashing.isEmpty():  # one digest, several texts: decided by content
        joined = joined.join(clashing, "digest", "left_anti").unionByName(
            rows_by_content(df, clashing, id_col, text_col))
    size = F.coalesce("group_size", F.lit(1)).cast("long")
    keep = F.when(size > 1, F.col("keep_id")).otherwise(F.col("doc_id"))
    top = Window.partitionBy("digest", "keep_id", "doc_id").orderBy(F.lit(1))
    found = joined.select("doc_id", "digest", keep.alias("keep_id"), size.alias("group_size"))
    return found.select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(top) == 1)).alias("kept"),
                        F.col("digest").alias("text_sha256"))


def rows_by_content(df: DataFrame, digests: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(digest, doc_id, keep_id, group_size) of the rows with these digests, joined on their whole texts."""
    some = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content"), digest_of(F.col(text_col)).alias("digest"))
    some = some.join(digests, "digest", "left_semi")
    groups = winners(some, "doc_id", "content")
    return some.withColumn("salt", salt_of("doc_id")).join(salted(groups), ["digest", "content", "salt"]).select(
        "digest", "doc_id", "keep_id", "group_size")


def keep_one(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of df that stay, with all their columns."""
    found = exact_duplicates(df, id_col, text_col).filter("group_size > 1").select("doc_id", F.col("text_sha256").alias("mark"), "kept")
    return keep_rows(df, found, id_col, digest_of(F.col(f"row.`{text_col}`")))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op5."""
    return exact_duplicates(documents(spark, sf_dir))


EXACT_DEDUP_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS content FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
  sha256(content) AS text_sha256
FROM d WINDOW g AS (PARTITION BY content)
"""
