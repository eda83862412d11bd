"""Helpers shared by the operators of this package."""

import atexit
import os
import shutil
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..sources.staging import new_path, shared_dir, stage_table  # noqa: F401  (re-exported)

#: Arrow batches handed to Python hold at most this many bytes, so long texts don't pile up in a worker.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000
#: A measured table up to this size is broadcast; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20
SALTS = 16


_SHIPPED: set[str] = set()


def prepare_python(spark: SparkSession) -> None:
    """Ship this package to the executors, once per application, and bound the session's Arrow batches by rows and bytes.

    A smaller setting of the user stays. The archive is handed to Spark, which serves it to executors that join later too.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        name = os.path.basename(package)
        folder = tempfile.mkdtemp(prefix=f"{name}-")  # the driver's own: Spark serves the archive from there
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shutil.copytree(package, f"{folder}/tree/{name}", ignore=shutil.ignore_patterns("__pycache__"))
        sc.addPyFile(shutil.make_archive(f"{folder}/{name}", "zip", f"{folder}/tree"))
        _SHIPPED.add(sc.applicationId)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


_MEMOS: dict[str, object] = {}


def claim(owner: str, clear) -> None:
    """In a task: from now on only `owner` keeps memos in this Python worker, which may have worked for other operators before."""
    for other in [name for name in _MEMOS if name != owner]:
        _MEMOS.pop(other)()
    _MEMOS[owner] = clear


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just (doc_id, text) with these names: what other columns are called doesn't matter then."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def map_batches(df: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow with bounded batches. `work` maps one RecordBatch to a dict of columns, or to None."""
    prepare_python(df.sparkSession)
    wanted = schema

    def run(batches):
        fields = None
        for batch in batches:
            if batch.num_rows:
                out = work(batch)
                if out is not None:
                    fields = fields or arrow_schema(wanted)
                    yield pa.RecordBatch.from_arrays(
                        [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type)
                         for f, x in zip(fields, (out[f.name] for f in fields))], schema=fields)

    return df.mapInArrow(run, schema)


#: Arrow types of the DDL names used for results of `map_batches`.
ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
         "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
         "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32())}


def arrow_schema(ddl: str) -> pa.Schema:
    return pa.schema([pa.field(name, ARROW[kind]) for name, kind in (part.split() for part in ddl.split(","))])


def table_bytes(df: DataFrame) -> int:
    """Size of a staged table in memory, estimated from an aggregate over all its rows."""
    width = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) if kind in ("string", "binary")
                 else F.coalesce(F.octet_length(F.to_json(F.col(c))), F.lit(0)) if kind.startswith("array") else F.lit(8))
                + F.lit(16) for c, kind in df.dtypes)
    return df.agg(F.sum(width)).collect()[0][0] or 0


def sized_join(left: DataFrame, right: DataFrame, on, how: str, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a staged `right`: broadcast if its measured size is within `limit`, shuffled otherwise."""
    return left.join(F.broadcast(right) if table_bytes(right) <= limit else right, on, how)


def run_before(text: str, end: int, least: int, pattern) -> int:
    """Start of the run of characters before `end` that `pattern`, a class repeated, takes; not before `least`.

    The window doubles, so a run costs as much as it is long, whatever precedes it.
    """
    width = 64
    while True:
        start = max(least, end - width)
        n = pattern.match(text[start:end][::-1]).end()
        if n < end - start or start == least:
            return end - n
        width *= 2


def salt_of(*cols, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted(df: DataFrame, salts: int = SALTS) -> DataFrame:
    """Each row once per salt: the other side of a join on (key, salt)."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def keep_rows(df: DataFrame, found: DataFrame, id_col: str, mark: Column) -> DataFrame:
    """The rows of df that stay, with all their columns, from decisions (doc_id, mark, kept) for every row.

    `mark` recomputes a row's mark from the struct `row`. Only the keys of rows that go are joined back (broadcast when measured
    small). A key that both stays and goes (repeated rows) is settled by numbering its few rows.
    """
    keys = stage_table(found.groupBy("doc_id", "mark").agg(F.max("kept").alias("some"), F.min("kept").alias("every"))
                       .filter(~F.col("every")), "dropped")
    keys = keys.select(F.col("doc_id").alias("key_id"), F.col("mark").alias("key_mark"), "some")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").alias("own_id"), mark.alias("own_mark"))
    same = F.col("own_id").eqNullSafe(F.col("key_id")) & F.col("own_mark").eqNullSafe(F.col("key_mark"))
    out = sized_join(rows, keys.drop("some"), same, "left_anti").select("row")
    mixed = keys.filter("some").drop("some")
    if not mixed.isEmpty():
        one = F.row_number().over(Window.partitionBy("key_id", "key_mark").orderBy(F.to_json("row")))  # ties: the whole row
        again = sized_join(rows, stage_table(mixed, "mixed"), same, "inner")
        out = out.unionByName(again.withColumn("number", one).filter("number = 1").select("row"))
    return out.select("row.*")
