"""Evaluation of predictions whose labels arrive later, as another stream."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.metrics import pair_counts
from .batches import write_batches


def match_labels(predictions: DataFrame, labels: DataFrame, key: str = "row_id", predicted_at: str = "predicted_at",
                 labelled_at: str = "labelled_at", wait: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """(actual, predicted) of each prediction and each label of its key given at most `wait` after it, in whichever order they arrive.

    `predictions` has the columns key, `predicted` and a time, `labels` key, `actual` and a time. Rows are kept in state until a match is no longer possible:
    the watermark, `delay` behind the slower stream's latest time, bounds the state. Rows later than that are left out, as are rows without key or time, or with a time before 1970.
    A key with several predictions or labels gives every pair of them: remove copies before.
    """
    left = predictions.select(F.col(key).alias("__key"), "predicted", F.col(predicted_at).alias("__predicted_at")).withWatermark("__predicted_at", delay)
    right = labels.select(F.col(key).alias("__label_key"), "actual", F.col(labelled_at).alias("__labelled_at")).withWatermark("__labelled_at", delay)
    in_time = F.col("__labelled_at").between(F.col("__predicted_at"), F.col("__predicted_at") + F.expr(f"INTERVAL {wait}"))
    return left.join(right, (F.col("__key") == F.col("__label_key")) & in_time).select("actual", "predicted")


def write_pair_counts(matched: DataFrame, path: str, checkpoint: str, **options):
    """Per micro-batch, how often each (actual, predicted) occurs: at most classes x classes rows. A repeated batch replaces its counts."""
    return write_batches(matched, path, checkpoint, prepare=pair_counts, **options)


def pairs_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(actual, predicted, n) over all batches written: what the metrics take."""
    return spark.read.parquet(path).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))
