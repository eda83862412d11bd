"""Ablations that go on where they were stopped.

An experiment that is evaluated and saved is entered in a ledger beside the models: its pair counts, its training time and the version of its model, in
a folder named after the experiment and a digest of the data, the rules and all settings. Spark's marker of a finished write commits the entry, so a driver
lost at any time costs the experiment it was at. Other data, settings or features have another digest and are fitted anew.
"""

import hashlib
import json
from dataclasses import asdict

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from ..operators.metrics import summary_metrics
from ..sources.sinks import current_version, is_complete, load_model, write_table
from ..sources.staging import stage_table
from .training import run_ablation


def table_digest(df: DataFrame) -> list:
    """Number of rows and two sums of 64-bit row hashes as text: the same in any order and partitioning. One aggregate without a shuffle of rows."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    sums = [F.coalesce(F.sum(F.xxhash64(row, F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string") for seed in (1, 2)]
    return list(df.agg(F.count("*").cast("string"), *sums).first())


class Ledger:
    """The entries of one table, rule set and choice of settings under `root`, the folder of the models."""

    def __init__(self, spark, root: str, digest: str):
        self.spark, self.root, self.digest = spark, root.rstrip("/"), digest

    def path(self, experiment) -> str:
        own = hashlib.sha256(json.dumps([self.digest, asdict(experiment)], sort_keys=True).encode()).hexdigest()[:32]
        return f"{self.root}/_ledger/{experiment.name}-{own}"

    def has(self, experiment) -> bool:
        return is_complete(self.spark, self.path(experiment))

    def enter(self, experiment, result) -> None:
        if result.pairs.isEmpty():
            return
        version = current_version(self.spark, self.root, experiment.name)
        entry = result.pairs.withColumns({"training_time": F.lit(float(result.training_time)), "version": F.lit(version).cast("long")})
        write_table(entry.coalesce(1), self.path(experiment), "parquet")

    def pairs(self, experiment) -> DataFrame:
        """(actual, predicted, n, training_time, version)."""
        return self.spark.read.parquet(self.path(experiment))

    def model(self, experiment) -> PipelineModel:
        """The model that was entered, whatever became of the variant since."""
        return load_model(self.root, experiment.name, self.pairs(experiment).first()["version"])

    def table(self, experiments) -> DataFrame:
        """(position, experiment, accuracy, macro_f1, weighted_f1, training_time) of the experiments entered, in the order given."""
        rows = None
        for position, experiment in enumerate(experiments):
            if self.has(experiment):
                pairs = self.pairs(experiment)
                row = summary_metrics(pairs).select(
                    F.lit(position).alias("position"), F.lit(experiment.name).alias("experiment"), "accuracy", "macro_f1", "weighted_f1",
                    F.lit(pairs.first()["training_time"]).alias("training_time"))
                rows = row if rows is None else rows.unionByName(row)
        return rows


def resume_ablation(df: DataFrame, experiments, root: str, label: str = "type", url: str = "url", key: str = None, rules: DataFrame = None,
                    **settings) -> Ledger:
    """`run_ablation` with its models saved under `root`, without the experiments that the ledger there has for the same data and settings.

    The split and the vocabulary don't depend on which experiments are left, so the table is the one of an unbroken run. An experiment without test
    rows is not entered, and is fitted again.
    """
    spark, experiments = df.sparkSession, list(experiments)
    rows = stage_table(df.select(*dict.fromkeys([key or url, url, label])), "ablation")
    parts = [table_digest(rows), table_digest(rules) if rules is not None else None, label, url, key, sorted(settings.items())]
    digest = hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:32]
    ledger = Ledger(spark, root, digest)
    left = [e for e in experiments if not ledger.has(e)]
    if left:
        if rules is not None:
            path = f"{ledger.root}/rules-{digest}"  # saved models read it: written once
            if not is_complete(spark, path):
                write_table(rules, path, "parquet")
            settings["rules_path"] = path
        run_ablation(rows, left, label, url, key, save_to=ledger.root, on_result=ledger.enter, **settings)
    return ledger
