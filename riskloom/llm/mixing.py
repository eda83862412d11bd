"""Mixing sources to target weights.

Words are aggregated per source; targets share a multiple of all words by weight, stop at a multiple of the
source's own words, and the excess is reshared by weight until no source is above its cap. A document is then taken
floor(rate) times plus one copy with probability equal to the fraction, decided by a hash of its id.

A null text has no words; a null source is a source, the last one; a null id hashes like the text `null`; repeated rows
are separate documents that share their id's decision. Sources are small rows, handled without ever meeting in one task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import documents, salt_of, salted, stage_table, table_bytes, BROADCAST_BYTES

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed by the contract: weights of the sources in order, share of all words, cap as a multiple of the source.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id alone, so that reruns and other partitionings agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources are numbered in code-point order (null last) by a range partitioning plus the counts of its partitions, and
    the level that all uncapped targets share (target = level x weight) is found with aggregates.
    """
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    ordered = stage_table(ordered, "sources")
    before = ordered.groupBy("part").count().withColumn(
        "before", F.sum("count").over(Window.orderBy("part")) - F.col("count")).drop("count")  # one row per partition
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    place = (F.col("before") + F.col("inside") - 1) % len(weights)
    weight = reduce(lambda e, i: e.when(place == i, weights[i]), range(1, len(weights)), F.when(place == 0, weights[0]))
    numbered = stage_table(
        ordered.withColumn("inside", inside).join(F.broadcast(before), "part")
        .select("source", "source_size", weight.cast("long").alias("weight")), "weights")
    most = F.col("source_size") * F.lit(float(cap))
    total, every = numbered.agg(F.sum("source_size"), F.sum("weight")).collect()[0]
    goal = share * (total or 0)
    level = goal / every if every else 0.0
    while True:
        above = F.lit(level) * F.col("weight") > most
        full, rest = numbered.agg(F.sum(F.when(above, most)), F.sum(F.when(~above, F.col("weight")))).collect()[0]
        new = (goal - (full or 0.0)) / rest if rest else level
        if new <= level:
            break
        level = new
    return numbered.select("source", "source_size", F.least(F.lit(level) * F.col("weight"), most).alias("target"))


def plan_mix(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, copies) for every row."""
    sized = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"))
    return with_copies(sized, source_targets(sized.select("source", "size"), **options))


def with_copies(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows with `source_size`, `target` and `copies`; `sized` has doc_id, source and size, besides others.

    The targets have one row per source: broadcast when measured small, else joined on (source, salt), so that a source
    with a third of all rows is dealt to many tasks.
    """
    targets = stage_table(targets.withColumnRenamed("source", "target_source"), "targets")
    same = F.col("source").eqNullSafe(F.col("target_source"))
    if table_bytes(targets) <= BROADCAST_BYTES:
        joined = sized.join(F.broadcast(targets), same)
    else:
        joined = sized.withColumn("own_salt", salt_of("doc_id")).join(salted(targets), same & (F.col("own_salt") == F.col("salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate) + F.when(uniform(F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).drop("target_source", "own_salt", "salt")


def mix_documents(df: DataFrame, id_col="doc_id", text_col="text", source_col="source", **options) -> DataFrame:
    """The mixed corpus: every row of df `copies` times, with the columns of df."""
    row = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"),
                    F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    targets = source_targets(row.select("source", "size"), **options)
    taken = with_copies(row, targets).filter(F.col("copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op2."""
    planned = plan_mix(documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


MIXTURE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM n),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM n) * 1.5::DOUBLE
    - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o),
f AS (SELECT arg_min(level, k) AS level FROM l WHERE level * weight <= 2 * source_size),
t AS (SELECT source, source_size, least(weight * level, 2.0::DOUBLE * source_size) AS target FROM n, f),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT::DOUBLE / 281474976710656::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
"""
