"""Where intermediate tables go.

Lineage is cut only with tables or checkpoints on the shared folder that the cluster
names in `spark.checkpoint.dir`, so the loss of an executor costs a re-read at most.
Where that is unset, a session on one machine (tests) uses a folder beside the warehouse tables; on a cluster that is
done only if the warehouse folder was named too, because its default lies on the driver's own disk.
"""

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, else `_staged` in the warehouse, which executors share as well."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") and not sc.getConf().contains("spark.sql.warehouse.dir"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
        sc.setCheckpointDir(folder)
        folder = sc.getCheckpointDir()
    return folder


@contextmanager
def staged(spark: SparkSession):
    """Tables staged inside this block are removed at its end: write the result before that.

    Blocks may be nested; a path belongs to the innermost one. Checkpoints of small tables are left to Spark's own cleaner.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise a small table (statistics, quotas) reliably."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    For tables that several jobs scan: later scans prune columns, and the planner
    knows the real size of the files.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
