"""Writing what a stream updates, one folder per micro-batch."""

from pyspark.sql import DataFrame


def write_batches(stream: DataFrame, path: str, checkpoint: str, prepare=None, mode: str = "append", fmt: str = "parquet",
                  available_now: bool = False, interval: str = "10 seconds"):
    """Each micro-batch to `path`/batch=<number>, after `prepare(batch)`; a batch that is repeated after a failure replaces its own folder."""
    def write(batch, number):
        replace_batch(prepare(batch) if prepare else batch, number, path, fmt)

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()


def replace_batch(batch: DataFrame, number: int, path: str, fmt: str = "parquet") -> None:
    batch.write.format(fmt).mode("overwrite").save(f"{path}/batch={number}")
