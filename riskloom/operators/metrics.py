"""Class distributions and classification metrics.

All metrics come from one pass that counts (actual, predicted) pairs; everything after
it works on at most classes x classes rows.
"""

from pyspark.sql import DataFrame, Window, functions as F


def class_distribution(df: DataFrame, label: str = "type") -> DataFrame:
    """(label, n), most frequent first."""
    return df.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def class_percentages(df: DataFrame, label: str = "type") -> DataFrame:
    """(label, n, percent) with two decimals."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # A window over one row per class.
    share = F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.round(share, 2)).orderBy(F.desc("n"), label)


def distinct_labels(df: DataFrame, label: str = "type") -> DataFrame:
    return df.select(label).distinct().orderBy(label)


def pair_counts(df: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(actual, predicted, n): what every metric below takes."""
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(pairs: DataFrame) -> DataFrame:
    """Long form (actual, predicted, n) over all labels that occur as actual, zeros filled."""
    labels = pairs.agg(F.sort_array(F.collect_set("actual")).alias("labels"))
    grid = labels.select("labels", F.explode("labels").alias("actual"))
    grid = grid.select("actual", F.explode("labels").alias("predicted"))
    joined = grid.join(pairs, ["actual", "predicted"], "left")
    return joined.select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n")).orderBy("actual", "predicted")


def confusion_table(pairs: DataFrame, labels=None) -> DataFrame:
    """Wide form: one row per actual label, one column per predicted label."""
    if labels is None:
        labels = [r[0] for r in pairs.select("actual").distinct().orderBy("actual").collect()]
    wide = pairs.groupBy("actual").pivot("predicted", labels).agg(F.sum("n"))
    return wide.na.fill(0, subset=labels).orderBy("actual")


def class_report(pairs: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) per class; undefined values are 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    as_actual = pairs.select(F.col("actual").alias("label"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("guessed"))
    as_guess = pairs.select(F.col("predicted").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("guessed"))
    sums = as_actual.unionByName(as_guess).groupBy("label").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("guessed").alias("guessed")
    )

    def ratio(top, bottom):
        return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))

    return sums.select(
        "label",
        ratio(F.col("tp"), F.col("guessed")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"),
        F.col("support").cast("bigint").alias("support"),
    )


def summary_metrics(pairs: DataFrame) -> DataFrame:
    """One row (accuracy, macro_f1, weighted_f1)."""
    weighted = F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support"))
    return class_report(pairs).agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        weighted.alias("weighted_f1"),
    )


def classification_report(pairs: DataFrame, digits: int = 4) -> DataFrame:
    """Class rows, then accuracy, macro avg and weighted avg, as (position, label, ...)."""
    classes = class_report(pairs)
    total = F.sum("support")

    def weighted(name):
        return F.coalesce(F.try_divide(F.sum(F.col(name) * F.col("support")), total), F.lit(0.0)).alias(name)

    names = ["precision", "recall", "f1"]
    accuracy = F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), total), F.lit(0.0))
    rows = [
        classes.select(F.lit(0).alias("position"), "label", *names, "support"),
        classes.agg(accuracy.alias("f1"), total.alias("support")).select(
            F.lit(1).alias("position"), F.lit("accuracy").alias("label"),
            F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1", "support",
        ),
        classes.agg(*[F.avg(n).alias(n) for n in names], total.alias("support")).select(
            F.lit(2).alias("position"), F.lit("macro avg").alias("label"), *names, "support"
        ),
        classes.agg(*[weighted(n) for n in names], total.alias("support")).select(
            F.lit(3).alias("position"), F.lit("weighted avg").alias("label"), *names, "support"
        ),
    ]
    report = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return report.withColumns({n: F.round(n, digits) for n in names}).orderBy("position", "label")


def best_experiment(results: DataFrame, exclude=()) -> DataFrame:
    """The row with the largest macro F1, the first by `position` on ties."""
    return results.filter(~F.col("experiment").isin(list(exclude))).orderBy(F.desc("macro_f1"), "position").limit(1)
