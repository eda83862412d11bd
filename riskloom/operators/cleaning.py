"""Cleaning and de-duplication of raw URL tables."""

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import NA_TOKENS
from ..functions.text import strip
from ..functions.urls import normalize_url
from ..sources.tables import null_tokens, require_columns


def drop_missing(df: DataFrame, columns=("url", "type")) -> DataFrame:
    return df.na.drop(subset=list(columns))


def normalize_rows(df: DataFrame, na_tokens=NA_TOKENS, case_insensitive_scheme: bool = False, keep=()) -> DataFrame:
    """Project to (row_id, url, type) and the columns in `keep`, drop missing values, normalise both, drop empty URLs."""
    require_columns(df, ["row_id", "url", "type", *keep])
    df = df.select("row_id", F.col("url").cast("string"), F.col("type").cast("string"), *keep)
    df = drop_missing(null_tokens(df, tokens=na_tokens))
    df = df.select(
        "row_id",
        normalize_url(F.col("url"), case_insensitive_scheme).alias("url"),
        strip(F.lower("type")).alias("type"),
        *keep,
    )
    return df.filter(F.length("url") > 0)


def keep_first(df: DataFrame, key: str = "url", order_by: str = "row_id") -> DataFrame:
    """One row per key: the one with the least `order_by`.

    An aggregate, not a window: copies are combined before the shuffle, so a URL with
    very many copies costs one row per map task.
    """
    rest = [c for c in df.columns if c not in (key, order_by)]
    first = F.min(F.struct(order_by, *rest)).alias("__first")
    return df.groupBy(key).agg(first).select(
        F.col(f"__first.{order_by}"), key, *[F.col(f"__first.{c}") for c in rest]
    )


def clean_urls(df: DataFrame, **options) -> DataFrame:
    """(row_id, url, type) with unique normalised URLs; the first label of a URL wins."""
    return keep_first(normalize_rows(df, **options)).select("row_id", "url", "type")


def duplicates_removed(df: DataFrame, **options) -> DataFrame:
    """Rows before and after de-duplication and their difference, in one aggregate."""
    rows = normalize_rows(df, **options)
    counts = rows.agg(F.count("*").alias("rows_before"), F.count_distinct("url").alias("rows_after"))
    return counts.withColumn("removed", F.col("rows_before") - F.col("rows_after"))
