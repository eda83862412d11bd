"""Exact, reproducible sampling and splitting.

Every row gets a sort key: the MD5 of seed and key, then the key itself. A sample or a
training part is "the first q rows of each class by that key", which does not depend on
partitioning. No window ever runs over a whole class. A cutoff key per class is found
first - by counting rows per 4-digit slice of the hash where a class is large, and ranking
only inside the one slice that holds the cutoff - and then applied as a plain filter.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import RANDOM_SEED, TEST_FRACTION
from ..sources.staging import checkpoint
from .joins import lookup_join

RANK_ROWS = 1_000_000
SLICE = 4


def hash_key(key: Column, seed: int = RANDOM_SEED) -> Column:
    text = key.cast("string")
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), text)), text)


def cutoff_keys(keyed: DataFrame, quotas: DataFrame, rank_rows: int = RANK_ROWS) -> DataFrame:
    """For each stratum, the key that the last selected row has.

    `keyed` has (stratum, key) with unique keys whose leading digits are spread evenly;
    `quotas` has (stratum, n, quota) with quota <= n. Result: (stratum, cutoff), without
    the strata whose quota is 0. Select the rows with key <= cutoff.
    """
    state = checkpoint(
        quotas.filter("quota > 0").select("stratum", "n", F.col("quota").alias("need"), F.lit("").alias("found"))
    )
    depth = 0
    while (state.agg(F.max("n")).first()[0] or 0) > rank_rows and depth < 32:
        inside = keyed if depth == 0 else lookup_join(keyed, state.select("stratum", "found"), "stratum").filter(
            F.col("key").startswith(F.col("found"))
        )
        digits = F.substring("key", depth + 1, SLICE)
        # At most 16**SLICE rows per stratum from here on, whatever the size of the data.
        slices = inside.groupBy("stratum", digits.alias("digits")).agg(F.count("*").alias("rows"))
        running = F.sum("rows").over(Window.partitionBy("stratum").orderBy("digits"))
        slices = slices.withColumn("before", running - F.col("rows"))
        state = slices.join(state, "stratum").filter(
            (F.col("before") < F.col("need")) & (F.col("need") <= F.col("before") + F.col("rows"))
        )
        state = checkpoint(state.select(
            "stratum", F.col("rows").alias("n"), (F.col("need") - F.col("before")).alias("need"),
            F.concat("found", "digits").alias("found"),
        ))
        depth += SLICE
    rest = lookup_join(keyed, state, "stratum").filter(F.col("key").startswith(F.col("found")))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy("key"))
    ranked = rest.withColumn("rank", rank).filter(F.col("rank") == F.col("need"))
    return checkpoint(ranked.select("stratum", F.col("key").alias("cutoff")))


def class_quotas(counts: DataFrame, size: int) -> DataFrame:
    """Share `size` among classes in proportion to n, by largest remainder (ties by class name).

    `counts` has one row per class (stratum, n).
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    if total == 0:
        return counts.withColumn("quota", F.lit(0).cast("bigint"))
    share = F.lit(size).cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    parts = counts.withColumn("whole", F.floor(share / F.lit(total).cast("decimal(19,0)")).cast("bigint"))
    parts = parts.withColumn("left", (share - F.col("whole").cast("decimal(19,0)") * F.lit(total).cast("decimal(19,0)")))
    missing = size - (parts.agg(F.sum("whole")).first()[0] or 0)
    # One row per class, so this ranking is as small as the label set.
    order = F.row_number().over(Window.orderBy(F.desc("left"), "stratum"))
    extra = F.when(order <= missing, 1).otherwise(0)
    return parts.select("stratum", "n", (F.col("whole") + extra).cast("bigint").alias("quota"))


def _keyed(df: DataFrame, stratum: Column, key: str, seed: int) -> DataFrame:
    return df.select(stratum.alias("stratum"), hash_key(F.col(key), seed).alias("key"))


def _class_counts(df: DataFrame, label: str) -> DataFrame:
    return checkpoint(df.groupBy(F.col(label).alias("stratum")).agg(F.count("*").alias("n")))


def uniform_sample(df: DataFrame, n, key: str = "url", seed: int = RANDOM_SEED, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Exactly n rows; all rows if n is None or not below the row count.

    `key` is unique: copies of it around the cutoff would be taken or left together, so they raise ValueError.
    """
    if n is None:
        return df
    total = df.count()
    if n >= total:
        return df
    if n <= 0:
        return df.filter(F.lit(False))
    quota = df.sparkSession.createDataFrame([("", total, n)], "stratum string, n bigint, quota bigint")
    cutoff = cutoff_keys(_keyed(df, F.lit(""), key, seed), quota, rank_rows).first()["cutoff"]
    chosen = df.filter(hash_key(F.col(key), seed) <= F.lit(cutoff))
    if chosen.select(key).count() != n:
        raise ValueError(f"{key} is not unique")
    return chosen


def _mark(df, label, key, quotas, seed, rank_rows, selected):
    cutoffs = cutoff_keys(_keyed(df, F.col(label), key, seed), quotas, rank_rows)
    cutoffs = cutoffs.withColumnRenamed("stratum", label)
    reached = lookup_join(_keyed(df, F.col(label), key, seed).withColumnRenamed("stratum", label), cutoffs, label, "inner")
    reached = reached.filter(F.col("key") <= F.col("cutoff")).groupBy(F.col(label).alias("stratum")).agg(F.count("*").alias("taken"))
    if not reached.join(quotas, "stratum").filter("taken != quota").isEmpty():  # a row per class
        raise ValueError(f"{key} is not unique")
    joined = lookup_join(df, cutoffs, label, "left")
    inside = F.coalesce(hash_key(F.col(key), seed) <= F.col("cutoff"), F.lit(False))
    return joined.withColumn(selected, inside).select(*df.columns, selected)


def stratified_sample(df: DataFrame, n, label: str = "type", key: str = "url", seed: int = RANDOM_SEED,
                      rank_rows: int = RANK_ROWS) -> DataFrame:
    """Exactly n rows with the class proportions of `df`; all rows if n is None or too large."""
    if n is None:
        return df
    counts = _class_counts(df, label)
    if n >= (counts.agg(F.sum("n")).first()[0] or 0):
        return df
    marked = _mark(df, label, key, class_quotas(counts, n), seed, rank_rows, "__in")
    return marked.filter("__in").drop("__in")


def stratified_split(df: DataFrame, label: str = "type", key: str = "url", test_fraction: float = TEST_FRACTION,
                     seed: int = RANDOM_SEED, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Add `split` ('train' or 'test') with exact class quotas.

    The test part has ceil(fraction * rows) rows. Like the usual splitters it refuses
    classes of one row and parts smaller than the number of classes.
    """
    counts = _class_counts(df, label)
    stats = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("k"), F.min("n").alias("least")
    ).first()
    n_test = -int(-(stats["n"] * test_fraction) // 1)
    n_train = stats["n"] - n_test
    if stats["k"] == 0 or stats["least"] < 2:
        raise ValueError("every class needs at least 2 rows to be split")
    if min(n_test, n_train) < stats["k"]:
        raise ValueError("both parts need at least as many rows as there are classes")
    marked = _mark(df, label, key, class_quotas(counts, n_train), seed, rank_rows, "__in")
    return marked.withColumn("split", F.when(F.col("__in"), "train").otherwise("test")).drop("__in")
