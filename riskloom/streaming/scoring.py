"""Continuous feature extraction and scoring of URL files.

Features are row-wise - the suffix rules are joined as a static table - so a stream of them
needs no state and no watermark, and gives the rows that a batch run gives. Models of texts join and sum terms: they score
each micro-batch as a table, and a micro-batch that is repeated after a failure replaces its own folder.
"""

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..plans.scoring import score
from ..plans.stages import _Terms
from ..sources.tables import csv_options


def read_url_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files_per_trigger=None) -> DataFrame:
    """Files arriving in a folder (or matching a glob), as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**csv_options(multi_line=True))  # records may span lines; a stream can't look ahead
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


@dataclass
class ScoredStream:
    """A stream, and the model that scores its micro-batches when it is written."""

    model: PipelineModel
    stream: DataFrame
    url: str = "url"


def score_stream(model: PipelineModel, stream: DataFrame, url: str = "url"):
    """The batch scoring code on a stream: a stream where the model allows it, else what `write_stream` scores batch by batch."""
    if any(isinstance(stage, _Terms) for stage in model.stages):
        return ScoredStream(model, stream, url)
    return score(model, stream, url)


def write_stream(stream, path: str, checkpoint: str, fmt: str = "parquet", available_now: bool = False,
                 interval: str = "10 seconds"):
    """Append to files exactly once; `available_now` stops after the input that is there.

    The batches of a `ScoredStream` are written to `path`/batch=<number>.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    if isinstance(stream, ScoredStream):
        def write(batch, number):
            score(stream.model, batch, stream.url).write.format(fmt).mode("overwrite").save(f"{path}/batch={number}")

        return stream.stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()
    writer = stream.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start(path)
