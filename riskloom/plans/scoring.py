"""Scoring tables of URLs with a fitted pipeline."""

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..functions.text import strip


def score(model: PipelineModel, df: DataFrame, url: str = "url") -> DataFrame:
    """Add `prediction` and `probabilities`; the model normalises the URL itself. Blank input is skipped."""
    return model.transform(df.filter(F.length(strip(F.coalesce(F.col(url), F.lit("")))) > 0))


def ranked_probabilities(scored: DataFrame, keep=("url",)) -> DataFrame:
    """One row per class, with `rank` 1 for the most probable; ties by class name."""
    entries = F.transform(
        F.map_entries("probabilities"), lambda e: F.struct((-e["value"]).alias("minus_p"), e["key"].alias("class"))
    )
    rows = scored.select(*keep, F.posexplode(F.array_sort(entries)).alias("place", "entry"))
    return rows.select(*keep, (F.col("place") + 1).alias("rank"), F.col("entry.class").alias("class"),
                       (-F.col("entry.minus_p")).alias("probability"))
