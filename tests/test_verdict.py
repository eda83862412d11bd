"""Cases that an earlier review found wrong."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import joins, sampling
from riskloom.operators.domains import parse_rules, with_domain_split
from riskloom.operators.tfidf import fit_tfidf
from riskloom.sources.tables import read_csv
from riskloom.streaming.scoring import read_url_stream, write_stream

LIST = """// ===BEGIN ICANN DOMAINS===
io
com
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
// ===END PRIVATE DOMAINS==="""


@pytest.mark.parametrize("private, expected", [(False, ("github", "io")), (True, ("evil", "github.io"))])
def test_private_section(spark, tmp_path, private, expected):
    (tmp_path / "rules.dat").write_text(LIST)
    rules = parse_rules(spark.read.text(str(tmp_path / "rules.dat")), include_private=private)
    host = spark.createDataFrame([("evil.github.io",)], "host string")
    row = with_domain_split(host, rules).first()
    assert (row["domain"], row["suffix"]) == expected


def test_vocabulary_has_no_hidden_cap(spark, monkeypatch):
    monkeypatch.setattr("riskloom.functions.constants.MAX_FEATURES", 3)
    docs = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgh"), (3, "stuvwxyz")], "id long, s string")
    assert fit_tfidf(docs, "id", "s", min_df=1).vocabulary.count() == 30


def test_csv_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.csv").write_text('url,type\n"http://a.com/x\ny",spam\nhttp://b.com,ham\n')
    batch = read_csv(spark, str(source))
    out = str(tmp_path / "out")
    stream = read_url_stream(spark, str(source), batch.schema, "csv")
    write_stream(stream, out, str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect())) and batch.count() == 2


def test_lookup_join_on_a_stream(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("string").alias("k")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string").parquet(str(tmp_path / "in"))
    lookup = spark.createDataFrame([("3", 30), ("4", 40)], "k string, v int")
    joined = joins.lookup_join(stream, lookup, "k", max_bytes=0)
    write_stream(joined, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("3", 30), ("4", 40)]


def test_samples_refuse_repeated_keys(spark):
    df = spark.createDataFrame([(f"u{i % 5}", "a") for i in range(10)], "url string, type string")
    with pytest.raises(ValueError, match="not unique"):
        sampling.uniform_sample(df, 5)
    with pytest.raises(ValueError, match="not unique"):
        sampling.stratified_sample(df, 5)
