"""Reading URL tables, and their profile."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.constants import NA_TOKENS
from .csv_blocks import PLACE, read_split_csv, spans_lines

FORMATS = ("parquet", "orc", "json", "csv")


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Raise ValueError, before any job runs, if a column is missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"the table lacks {', '.join(missing)}; it has {', '.join(df.columns) or 'no columns'}")
    return df


def read_csv(spark: SparkSession, path, multi_line=None, **options) -> DataFrame:
    """Headered CSV file, folder or glob; every column is read as a string.

    Columns are matched by header name. A missing path raises AnalysisException.
    `multi_line=None` looks for lines with an odd number of quotes: only if there are some can a record span lines. With none, files are split at
    line ends; with some, they are split by `csv_blocks`, which follows quotes across lines and blocks. `multi_line=True`, or other options
    together with such lines, read each file unsplit.
    """
    if multi_line is None and spans_lines(spark, path):
        if not options:
            return read_split_csv(spark, path).drop(PLACE)
        multi_line = True
    return spark.read.options(**csv_options(bool(multi_line))).options(**options).csv(path)


def csv_options(multi_line: bool) -> dict:
    """How a headered CSV file is read, in batch and as a stream."""
    return {"header": True, "escape": '"', "enforceSchema": False, "multiLine": multi_line}


def read_urls(spark: SparkSession, path, fmt: str = "csv", **options) -> DataFrame:
    """A raw URL table with at least `url` and `type`, plus `row_id` in input order.

    An existing `row_id` column is kept. Otherwise it is (file, block, position in the
    scan): rows of one file keep their order in the file however Spark packs splits into tasks.
    """
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if fmt == "csv" and not options:
        split = spans_lines(spark, path)
        df = read_split_csv(spark, path) if split else read_csv(spark, path, multi_line=False)
    else:
        df = read_csv(spark, path, **options) if fmt == "csv" else spark.read.options(**options).format(fmt).load(path)
    require_columns(df, ["url", "type"])
    if "row_id" in df.columns:
        return df.select("row_id", "url", "type")
    if PLACE in df.columns:
        return df.select(F.col(PLACE).alias("row_id"), "url", "type")
    order = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position"),
    )
    return df.select(order.alias("row_id"), "url", "type")


def null_tokens(df: DataFrame, columns=("url", "type"), tokens=NA_TOKENS) -> DataFrame:
    """Turn missing-value tokens into NULL."""
    return df.withColumns({
        c: F.when(F.col(c).isin(list(tokens)), F.lit(None)).otherwise(F.col(c)) for c in columns
    })


def preview(df: DataFrame, order_by="row_id", rows: int = 5) -> DataFrame:
    """The first rows in the order of a key."""
    return df.orderBy(order_by).limit(rows)


def profile(df: DataFrame, label: str = "type") -> DataFrame:
    """Row count, column count and the count of each label, as (metric, item, n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    per_label = counts.select(F.lit("label").alias("metric"), F.col(label).alias("item"), "n")
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.lit("rows").alias("metric"), F.lit("all").alias("item"), "n"
    )
    columns = df.sparkSession.range(1).select(
        F.lit("columns").alias("metric"), F.lit("all").alias("item"), F.lit(len(df.columns)).cast("bigint").alias("n")
    )
    return rows.unionByName(columns).unionByName(per_label)
