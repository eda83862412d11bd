"""Approximate nearest neighbours with a permutation index.

A vector is represented by its `LENGTH` nearest pivots in order. The rows are dealt by a hash of their id into segments of about
`BLOCK` rows, each with its own inverted files: pivot -> the segment's vectors that have it, with its place. A query reads the
files of its own pivots in every segment and ranks by the footrule distance of the ordered pivots, a missing pivot
counting as just behind the last. The nearest `RANKED` share (at least `LEAST`) is reranked by the exact measure: cosine, in
double precision, on the original vectors.

With places i and j, footrule counts |i - j| for a shared pivot and (LENGTH - i) + (LENGTH - j) otherwise, so
ranking by it is ranking by the sum of LENGTH - max(i, j) over shared pivots, which the inverted files give directly.

Pivots come from a bounded sample of rows (chosen by a hash of the id), in two sets of at most `PIVOTS` vectors: `spread`, each as far
from those before as can be, and `common`, in the order of the hash. Vectors in a large group of near copies differ only by pivots
of that group, which `common` has and `spread` has not; all others differ more by `spread`. Each set has its own
codes and ranking, and what either ranks first is reranked. Every vector is indexed, and a hash of ids deals
them evenly however common a vector is. Queries go to all segments, in blocks of about `BLOCK`. Vectors that are null, zero, of another length
than most pivots, or that hold a null or non-finite component take no part. Rows with the query's id are its own; of
repeated ids one counts.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from .common import prepare_python, stage_table

PIVOTS, LENGTH = 512, 64
RANKED, LEAST = 0.1, 256
BLOCK = 8192


def usable(column, dim: int | None = None):
    """(row numbers, matrix of doubles) of the vectors that take part; `dim` None: lists of any length."""
    rows, out = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and (dim is None or len(v) == dim) and None not in v:
            a = np.array(v, np.float64)
            if np.isfinite(a).all() and a.any():
                rows.append(i)
                out.append(a)
    return rows, np.array(out) if dim is not None else out


def directions(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no norm overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def choose_pivots(vectors: DataFrame, most: int = PIVOTS) -> np.ndarray:
    """Two sets of unit pivots (set, pivot, component) from a sample of at most 4 x `most` rows, without repeated vectors."""
    some = vectors.filter(F.col("v").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * most).toArrow()
    _, found = usable(some.column("v"))
    if not found:
        return np.zeros((2, 0, 0))
    sizes = [len(a) for a in found]
    dim = max(sorted(set(sizes)), key=sizes.count)
    unit = directions(np.array([a for a in found if len(a) == dim]))
    _, first = np.unique(unit, axis=0, return_index=True)
    unit = unit[np.sort(first)]
    return np.stack([unit[spread(unit, most)], unit[:most]])


def spread(unit: np.ndarray, most: int) -> list[int]:
    """At most `most` rows, each the one least like its nearest among those before; ties to the first."""
    chosen, near = [0], np.full(len(unit), -np.inf)
    while len(chosen) < min(most, len(unit)):
        near = np.maximum(near, unit @ unit[chosen[-1]])
        near[chosen[-1]] = np.inf
        chosen.append(int(near.argmin()))
    return chosen


def represent(vectors: DataFrame, pivots) -> DataFrame:
    """(vec_id, code, raw): the ordered pivots of both sets and the components of every vector that takes part."""
    prepare_python(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            rows, found = usable(batch.column(1), pivots.value.shape[2])
            if rows:
                unit = directions(found)
                order = np.concatenate([np.argsort(-(unit @ own.T), axis=1, kind="stable")[:, :LENGTH] + i * len(own)
                                        for i, own in enumerate(pivots.value)], axis=1).astype("<u2")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(rows)), pa.array([x.tobytes() for x in order], pa.binary()),
                    pa.array([x.astype("<f8").tobytes() for x in found], pa.binary())], names=["vec_id", "code", "raw"])

    return vectors.mapInArrow(run, "vec_id long, code binary, raw binary")


class Segment:
    """Inverted files of a block of vectors, sorted by id; of repeated ids the first is kept. A code has `sets` parts of equal length."""

    def __init__(self, ids, codes, raws, pivots: int, sets: int = 1):
        self.ids, first = np.unique(ids, return_index=True)
        order = np.frombuffer(b"".join(codes), "<u2").reshape(len(ids), -1)[first]
        self.unit = directions(np.frombuffer(b"".join(raws), "<f8").reshape(len(ids), -1)[first])
        self.sets, self.length = sets, order.shape[1] // sets
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.rows, self.places = by_pivot // order.shape[1], by_pivot % self.length
        self.cuts = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))

    def nearest(self, query: int, code: np.ndarray, vector: np.ndarray, top: int):
        """Ids and cosines of the best, found by the footrule of each set and reranked."""
        near = np.unique(np.concatenate([self.ranked(query, own) for own in np.split(code, self.sets)]))
        scores = (self.unit[near] * vector).sum(axis=1)
        best = np.lexsort((self.ids[near], -scores))[:top]
        return self.ids[near[best]].tolist(), scores[best].tolist()

    def ranked(self, query: int, code: np.ndarray):
        """Rows of the nearest share by the footrule of one set."""
        files = [slice(self.cuts[p], self.cuts[p + 1]) for p in code]
        rows = np.concatenate([self.rows[f] for f in files])
        shared = np.concatenate([self.length - np.maximum(self.places[f], i) for i, f in enumerate(files)])
        n = len(self.ids)
        rank = np.bincount(rows, shared, n).astype(np.int64) * n + np.arange(n - 1, -1, -1)  # ties to the smaller id
        rank[self.ids == query] = -1
        ranked = max(LEAST, int(RANKED * n))
        near = np.argpartition(-rank, ranked)[:ranked] if n > ranked else np.arange(n)
        return near[rank[near] >= 0]


def search(rows: DataFrame, queries: DataFrame, pivots, top: int) -> DataFrame:
    """(query_id, vec_id, score): the best of every segment for each query."""
    rows, queries = (stage_table(represent(x, pivots), name) for x, name in ((rows, "vectors"), (queries, "queries")))
    parts, query_parts = (-(-x.count() // BLOCK) or 1 for x in (rows, queries))

    def own(n):
        return F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    both = rows.withColumn("part", own(parts)).withColumn("query_part", every(query_parts)).withColumn("asks", F.lit(False)).unionByName(
        queries.withColumn("query_part", own(query_parts)).withColumn("part", every(parts)).withColumn("asks", F.lit(True)))
    sets, count = pivots.value.shape[:2]

    def work(table: pa.Table) -> pa.Table:
        asks = table.column("asks")
        mine, theirs = table.filter(asks), table.filter(pa.compute.invert(asks))
        found = []
        if mine.num_rows and theirs.num_rows:
            segment = Segment(theirs.column("vec_id").to_numpy(), theirs.column("code").to_pylist(), theirs.column("raw").to_pylist(), sets * count, sets)
            vectors = directions(np.frombuffer(b"".join(mine.column("raw").to_pylist()), "<f8").reshape(mine.num_rows, -1))
            for query, code, vector in zip(mine.column("vec_id").to_pylist(), mine.column("code").to_pylist(), vectors):
                ids, scores = segment.nearest(query, np.frombuffer(code, "<u2"), vector, top)
                found += zip([query] * len(ids), ids, scores)
        return pa.table([pa.array([r[i] for r in found], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.float64()))],
                        names=["query_id", "vec_id", "score"])

    return both.groupBy("part", "query_part").applyInArrow(work, "query_id long, vec_id long, score double")


def nearest(df: DataFrame, is_query, top: int = 5, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the `top` nearest found for each row of df that `is_query` (a Column) chooses."""
    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    vectors = vectors.filter(F.col("vec_id").isNotNull())
    spark = df.sparkSession
    pivots = choose_pivots(vectors)
    if not pivots.size:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = vectors.filter("asks").select("vec_id", "v").dropDuplicates(["vec_id"])
    found = search(vectors.select("vec_id", "v"), queries, spark.sparkContext.broadcast(pivots), top)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query op10."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
