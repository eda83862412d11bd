"""Standardised columns and balanced class weights."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .joins import lookup_join


@dataclass
class Standardizer:
    """Means and population deviations of fixed columns; a few numbers per column."""

    columns: list
    means: list
    deviations: list

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """(x - mean) / deviation as DOUBLE; 0 for a constant column."""
        scaled = {}
        for name, mean, deviation in zip(self.columns, self.means, self.deviations):
            centred = F.col(name).cast("double") - F.lit(mean)
            scaled[prefix + name] = centred / F.lit(deviation) if deviation else F.col(name).cast("double") * 0.0
        return df.withColumns(scaled)


def fit_standardizer(df: DataFrame, columns) -> Standardizer:
    """One aggregate over the training rows."""
    columns = list(columns)
    row = df.agg(
        *[F.avg(F.col(c).cast("double")) for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")) for c in columns],
    ).first()
    if row[0] is None:
        raise ValueError("cannot fit a scaler on no rows")
    return Standardizer(columns, list(row[: len(columns)]), list(row[len(columns):]))


def class_weights(df: DataFrame, label: str = "type") -> DataFrame:
    """(label, n, weight) with weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("classes")).first()
    weight = F.lit(float(total["rows"] or 0)) / (F.lit(total["classes"]) * F.col("n"))
    return counts.withColumn("weight", weight)


def with_class_weights(df: DataFrame, label: str = "type", weight_col: str = "weight") -> DataFrame:
    weights = class_weights(df, label).select(label, "n", F.col("weight").alias(weight_col))
    return lookup_join(df, weights, label, "inner", weight="n").drop("n")
