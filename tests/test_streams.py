"""Streams that remember: first labels, and labels that come later."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators.cleaning import clean_urls
from riskloom.operators.metrics import classification_report, pair_counts
from riskloom.streaming.batches import replace_batch
from riskloom.streaming.cleaning import first_labels, write_first_labels
from riskloom.streaming.evaluation import match_labels, pairs_so_far, write_pair_counts
from riskloom.streaming.scoring import read_url_stream

URLS = "row_id long, url string, type string"


def _run_first(spark, base, rows):
    spark.createDataFrame(rows, URLS).write.mode("append").parquet(f"{base}/in")
    stream = first_labels(read_url_stream(spark, f"{base}/in", URLS))
    write_first_labels(stream, f"{base}/out", f"{base}/cp", available_now=True).awaitTermination()
    return sorted(map(tuple, spark.read.parquet(f"{base}/out").drop("batch").collect()))


def test_first_label_wins_over_batches_and_restarts(spark, tmp_path):
    first = [(3, "http://a.com", "late"), (1, " a.com ", "Spam"), (2, "b.com", None), (4, None, "x"), (5, "   ", "x"), (1, "a.com", "spam")]
    second = [(6, "http://a.com", "ham"), (7, "b.com", "ham"), (8, "b.com", "spam"), (9, "c.com", "x")]
    third = [(10 + i, "http://a.com", f"t{i}") for i in range(3000)] + [(5000, "c.com", "y"), (5001, "d.com", "z")]
    everything = []
    for rows in (first, [], second, third, []):
        everything += rows
        got = _run_first(spark, tmp_path, rows)
        want = sorted(map(tuple, clean_urls(spark.createDataFrame(everything, URLS)).collect()))
        assert got == want


def test_labels_pass_once_per_period_and_state_goes(spark, tmp_path):
    schema = URLS + ", at timestamp"

    def run(rows):
        df = spark.createDataFrame(rows, "row_id long, url string, type string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s")
        df.write.mode("append").parquet(f"{tmp_path}/in")
        stream = first_labels(read_url_stream(spark, f"{tmp_path}/in", schema), event_time="at", period="1 hour", delay="10 minutes")
        query = write_first_labels(stream, f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True)
        query.awaitTermination()
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return sorted(r["row_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()), kept[-1]

    assert run([(1, "a.com", "x", 100), (2, "a.com", "y", 3599), (3, "b.com", "x", 200), (4, "c.com", "x", None)]) == ([1, 3], 2)
    assert run([(5, "a.com", "y", 3000), (6, "a.com", "y", 3700)])[0] == [1, 3, 6]
    got, left = run([(7, "b.com", "y", 90_000)])
    assert got == [1, 3, 6, 7] and left == 1
    assert run([(8, "b.com", "y", 50)])[0] == [1, 3, 6, 7]  # late
    with pytest.raises(ValueError, match="together"):
        first_labels(spark.createDataFrame([], URLS), period="1 hour")


def test_late_labels_give_the_batch_report(spark, tmp_path):
    rows = spark.range(600).select(
        F.col("id").alias("row_id"), F.concat(F.lit("c"), F.col("id") % 3).alias("actual"), F.concat(F.lit("c"), F.col("id") * 7 % 4).alias("predicted"),
        F.timestamp_seconds(1_000_000 + F.col("id") * 10).alias("predicted_at"), F.timestamp_seconds(1_000_000 + F.col("id") * 10 + F.col("id") % 50 * 60).alias("labelled_at"))
    rows = rows.unionByName(spark.createDataFrame([(None, "c0", "c0", None, None)], "row_id long, actual string, predicted string, predicted_at timestamp, labelled_at timestamp"))
    for k in range(4):
        rows.filter((F.col("row_id").isNull() & F.lit(k == 0)) | (F.col("row_id") % 3 == k)).select("row_id", "predicted", "predicted_at").write.mode("append").parquet(f"{tmp_path}/p")
        rows.filter((F.col("row_id").isNull() & F.lit(k == 0)) | (F.col("row_id") % 3 == k - 1)).select("row_id", "actual", "labelled_at").write.mode("append").parquet(f"{tmp_path}/l")
        streams = [read_url_stream(spark, f"{tmp_path}/{n}", spark.read.parquet(f"{tmp_path}/{n}").schema) for n in "pl"]
        write_pair_counts(match_labels(*streams, wait="30 minutes", delay="2 hours"), f"{tmp_path}/out", f"{tmp_path}/cp", available_now=True).awaitTermination()
    matched = rows.filter("row_id % 50 <= 30")
    want = classification_report(pair_counts(matched)).collect()
    assert classification_report(pairs_so_far(spark, f"{tmp_path}/out")).collect() == want and matched.count() == 372
    # a batch that is repeated after a failure replaces its counts
    number, *_ = [r["batch"] for r in spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().collect()]
    again = spark.createDataFrame(spark.read.parquet(f"{tmp_path}/out").filter(F.col("batch") == number).drop("batch").collect(), "actual string, predicted string, n long")
    replace_batch(again, number, f"{tmp_path}/out")
    assert classification_report(pairs_so_far(spark, f"{tmp_path}/out")).collect() == want
