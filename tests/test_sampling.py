import pytest
from pyspark.sql import functions as F

from riskloom.operators.sampling import class_quotas, stratified_sample, stratified_split, uniform_sample


@pytest.fixture(scope="module")
def rows(spark):
    kind = F.when(F.col("id") < 700, "a").when(F.col("id") < 950, "b").otherwise("c")
    return spark.range(1003).select(F.concat(F.lit("u"), "id").alias("url"), kind.alias("type"))


def test_split_has_exact_quotas(rows):
    df = stratified_split(rows)
    counts = {(r["type"], r["split"]): r["count"] for r in df.groupBy("type", "split").count().collect()}
    assert sum(n for (_, s), n in counts.items() if s == "test") == 201
    assert counts == {("a", "train"): 560, ("a", "test"): 140, ("b", "train"): 200, ("b", "test"): 50,
                      ("c", "train"): 42, ("c", "test"): 11}
    assert df.select("url").distinct().count() == 1003


def test_same_split_for_any_partitioning_and_any_slice_depth(rows):
    def train(df, **options):
        return {r["url"] for r in stratified_split(df, **options).filter("split = 'train'").collect()}

    want = train(rows)
    assert train(rows.repartition(13)) == want
    assert train(rows, rank_rows=3) == want
    assert train(rows, seed=7) != want


def test_uniform_sample(rows):
    small = uniform_sample(rows, 100)
    assert small.count() == 100
    assert {r["url"] for r in small.collect()} == {r["url"] for r in uniform_sample(rows.repartition(5), 100, rank_rows=2).collect()}
    assert uniform_sample(rows, None) is rows and uniform_sample(rows, 5000) is rows
    assert uniform_sample(rows, 0).count() == 0


def test_stratified_sample(rows):
    counts = {r["type"]: r["count"] for r in stratified_sample(rows, 100).groupBy("type").count().collect()}
    assert counts == {"a": 70, "b": 25, "c": 5}
    assert stratified_sample(rows, None) is rows


def test_largest_remainder_ties_by_name(spark):
    counts = spark.createDataFrame([("b", 1), ("a", 1), ("c", 1)], "stratum string, n long")
    assert {r["stratum"]: r["quota"] for r in class_quotas(counts, 2).collect()} == {"a": 1, "b": 1, "c": 0}


def test_classes_of_one_row_are_refused(spark):
    df = spark.createDataFrame([("u1", "a"), ("u2", "a"), ("u3", "b")], "url string, type string")
    with pytest.raises(ValueError):
        stratified_split(df)
