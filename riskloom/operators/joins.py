"""Joining a large table to a lookup table with one row per key."""

from pyspark.sql import DataFrame, functions as F

from ..sources.staging import checkpoint

BROADCAST_BYTES = 128 << 20
ROW_OVERHEAD = 64
HOT_KEYS = 1000


def lookup_bytes(table: DataFrame, key: str) -> int:
    """Measured size of a lookup table: key text plus a fixed allowance per row."""
    row = table.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col(key).cast("string"))), F.lit(0)).alias("b")
    ).first()
    return row["n"] * ROW_OVERHEAD + row["b"]


def lookup_join(left: DataFrame, table: DataFrame, key: str, how: str = "inner",
                weight: str = None, size: int = None, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join `left` to `table` (unique `key`, narrow rows), inner or left.

    A table measured to be small is broadcast: `left` is not shuffled, so hot keys do no
    harm. A larger one is joined by shuffle, after taking out the hot keys: those holding
    more than 1/HOT_KEYS of all rows. There can be at most HOT_KEYS of them, so their part
    of the table is broadcast safely, and what is left to shuffle has no hot key.
    `weight` names a column of `table` with the row count per key, if it is known;
    `size` is the result of `lookup_bytes`, if it was measured before.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if left.isStreaming:
        return left.join(table, key, how)  # a count of the stream's keys can't be had; the planner sizes the table
    if (lookup_bytes(table, key) if size is None else size) <= max_bytes:
        return left.join(F.broadcast(table), key, how)

    if weight:
        source = table.select(key, F.col(weight).alias("__n"))
    else:
        source = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__n"))
    total = source.agg(F.sum("__n")).first()[0] or 0
    hot = F.broadcast(checkpoint(source.filter(F.col("__n") * HOT_KEYS > total).select(key)))
    hot_part = left.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key, how)
    # Rows without a key match nothing; they must not meet in one shuffle partition.
    cold_part = left.filter(F.col(key).isNotNull()).join(hot, key, "left_anti").join(table, key, how)
    result = hot_part.unionByName(cold_part)
    if how == "left":
        result = result.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
    return result
