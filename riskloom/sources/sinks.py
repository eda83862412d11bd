"""Writing result tables and models."""

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


#: Seconds after which an unfinished pointer is taken for that of a writer that has died.
ABANDONED = 3600.0


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite", partition_by=None) -> str:
    """Write a result table (metrics, features, scores) as CSV with header, Parquet, ORC or JSON."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        # quotes are doubled and blanks kept, as the CSV source expects
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)
    return path


def variant_path(root: str, variant: str = "default") -> str:
    """Folder of one model variant."""
    return f"{root.rstrip('/')}/variant={variant}"


class PromotionConflict(Exception):
    """Another writer has committed a version of the variant since the one that was expected."""


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether Spark has finished writing a table at `path`."""
    fs, marker = _folder(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def _pointers(spark: SparkSession, root: str, variant: str) -> dict:
    """{number: (target, age in seconds)}; the target of a pointer that is still being written is None."""
    fs, folder = _folder(spark, f"{variant_path(root, variant)}/_versions")
    found = {}
    if fs.exists(folder):
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.isdigit():
                stream = fs.open(status.getPath())
                try:
                    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                found[int(name)] = (text[:-1] if text.endswith("\n") else None, time.time() - status.getModificationTime() / 1000)
    return found


def _committed(spark: SparkSession, root: str, variant: str) -> dict:
    return {number: target for number, (target, _) in _pointers(spark, root, variant).items() if target}


def current_version(spark: SparkSession, root: str, variant: str = "default") -> int:
    """Number of the version that readers get now; 0 if there is none."""
    return max(_committed(spark, root, variant), default=0)


def commit_version(spark: SparkSession, root: str, variant: str, target: str, expected: int, abandoned: float = ABANDONED) -> int:
    """Make the finished folder `target` the version after `expected`, which must still be the current one.

    Readers follow the largest number with a whole pointer. The file system creates the next pointer file for one writer only; others
    get a PromotionConflict, as they do while it is being written. A pointer left unfinished for `abandoned` seconds no longer counts.
    """
    found = _pointers(spark, root, variant)
    current = max((n for n, (t, _) in found.items() if t), default=0)
    if current != expected or any(n > current and age < abandoned for n, (_, age) in found.items()):
        raise PromotionConflict(f"variant {variant} has moved on from version {expected}")
    number = max(found, default=0) + 1
    fs, pointer = _folder(spark, f"{variant_path(root, variant)}/_versions/{number}")
    fs.mkdirs(pointer.getParent())
    try:
        stream = fs.create(pointer, False)
    except Py4JJavaError as error:
        if not fs.exists(pointer):
            raise
        raise PromotionConflict(f"version {number} of variant {variant} was taken by another writer") from error
    stream.write(bytearray(f"{target}\n".encode()))
    stream.close()
    return number


def save_model(model: PipelineModel, root: str, variant: str = "default", expected: int = None) -> str:
    """Save as the next version of the variant; its folder.

    Vectoriser, scaler and classifier are stages of one pipeline, so they cannot drift apart. The folder is new and complete before
    a pointer names it, and older versions stay: whoever scores meanwhile reads the old or the new model, never none.
    With `expected` (see `current_version`) the save fails if another version was committed since.
    """
    spark = SparkSession.active()
    expected = current_version(spark, root, variant) if expected is None else expected
    target = f"model-{uuid.uuid4().hex}"
    path = f"{variant_path(root, variant)}/{target}"
    model.write().save(path)
    commit_version(spark, root, variant, target, expected)
    return path


def load_model(root: str, variant: str = "default", version: int = None) -> PipelineModel:
    """The current version of a variant, or the one asked for."""
    spark = SparkSession.active()
    found = _committed(spark, root, variant)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no version {version or ''} of variant {variant} under {root}")
    target = found[max(found) if version is None else version]
    return PipelineModel.load(f"{root.rstrip('/')}/{target.replace('@', '/')}" if "@" in target else f"{variant_path(root, variant)}/{target}")


def promote(spark: SparkSession, root: str, variant: str, to: str = "default", expected: int = None) -> int:
    """Let `to` name the current model of `variant`, without copying it; the new version number of `to`."""
    found = _committed(spark, root, variant)
    if not found:
        raise FileNotFoundError(f"no version of variant {variant} under {root}")
    expected = current_version(spark, root, to) if expected is None else expected
    target = found[max(found)]
    return commit_version(spark, root, to, target if "@" in target else f"variant={variant}@{target}", expected)
