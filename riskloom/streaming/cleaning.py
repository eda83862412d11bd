"""Cleaning and de-duplication of a stream of raw URLs.

The batch form keeps the row of a URL with the least `row_id`. A stream can't wait for that row: here a URL's first micro-batch decides, and of
that batch's rows the one with the least `row_id`. Later copies are left out, also after a restart from the checkpoint.
"""

from pyspark.sql import DataFrame, functions as F

from ..operators.cleaning import normalize_rows
from .batches import write_batches


def first_labels(stream: DataFrame, event_time: str = None, period: str = None, delay: str = "1 hour", **options) -> DataFrame:
    """(row_id, url, type) of each URL's first row, as a stream to be written in update mode (`write_first_labels`).

    The state is one narrow row per URL, kept by a streaming aggregate: copies within a batch are combined before the shuffle, so a URL with very many
    copies costs one row per task. Without `period` a URL is let through once for ever and the state grows with the distinct URLs. With `period`
    (and `event_time`, a timestamp column) it is let through once per period of event time, and a period's state goes when the watermark, `delay`
    behind the latest time seen, has passed its end; rows that come after that are late and left out, as are rows without a time or with one before 1970.

    Rows with a null URL or label, and URLs that are blank, are left out as in a batch.
    """
    if (period is None) != (event_time is None):
        raise ValueError("period and event_time go together")
    rows = normalize_rows(stream, keep=[event_time] if event_time else [], **options)
    keys = ["url"]
    if period:
        rows = rows.filter(F.col(event_time).isNotNull()).withWatermark(event_time, delay)
        keys.append(F.window(event_time, period).alias("__period"))
    # one time for all rows of a micro-batch, which a repeated batch has again
    rows = rows.withColumn("__batch", F.current_timestamp())
    seen = rows.groupBy(*keys).agg(F.min(F.struct("__batch", "row_id", "type")).alias("__first"), F.max("__batch").alias("__last"))
    new = seen.filter(F.col("__first.__batch") == F.col("__last"))  # no row of an earlier batch
    return new.select("__first.row_id", "url", "__first.type")


def write_first_labels(labels: DataFrame, path: str, checkpoint: str, **options):
    """Write what `first_labels` gives; see `write_batches` for the options."""
    return write_batches(labels, path, checkpoint, mode="update", **options)
