import pytest
from pyspark.errors import AnalysisException

from riskloom.operators.cleaning import clean_urls, duplicates_removed
from riskloom.operators.metrics import class_distribution
from riskloom.sources.sinks import write_table
from riskloom.sources.tables import read_csv, read_urls, require_columns

ROWS = [
    (0, " example.com ", " Spam "), (1, "http://example.com", "benign"), (2, "https://example.com", "benign"),
    (3, "   ", "benign"), (4, None, "spam"), (5, "a.example.org", None), (6, "HTTP://b.com", "spam"),
]
KEPT = [(0, "http://example.com", "spam"), (2, "https://example.com", "benign"), (6, "http://HTTP://b.com", "spam")]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(ROWS, "row_id long, url string, type string")


def test_cleaning_case(raw):
    assert sorted(tuple(r) for r in clean_urls(raw).collect()) == KEPT
    assert tuple(duplicates_removed(raw).first()) == (4, 3, 1)
    assert [tuple(r) for r in class_distribution(clean_urls(raw)).collect()] == [("spam", 2), ("benign", 1)]


def test_cleaning_does_not_depend_on_partitions(raw):
    assert sorted(tuple(r) for r in clean_urls(raw.repartition(7)).collect()) == KEPT


def test_missing_column(spark):
    with pytest.raises(ValueError, match="type"):
        require_columns(spark.createDataFrame([("a",)], "url string"), ["url", "type"])


def test_csv_with_quotes_newlines_and_other_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id,type,url\n1,spam,"http://a.com/x,""y"""\n2,benign,"line\nbreak.com"\n3,N/A,b.com\n4,good,NaN\n5,Bad,a.com\n'
    )
    df = read_urls(spark, str(tmp_path))
    assert df.columns == ["row_id", "url", "type"] and df.count() == 5
    urls = sorted(r["url"] for r in clean_urls(df).collect())
    assert urls == ["http://a.com", 'http://a.com/x,"y"', "http://line\nbreak.com"]


def test_csv_first_row_of_a_file_wins(spark, tmp_path):
    lines = [f"u{i % 50}.com,{'first' if i < 50 else 'later'}" for i in range(5000)]
    (tmp_path / "a.csv").write_text("url,type\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = clean_urls(read_urls(spark, str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 50 and {r["type"] for r in rows} == {"first"}


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        read_csv(spark, str(tmp_path / "none")).count()


@pytest.mark.parametrize("fmt", ["csv", "parquet", "orc", "json"])
def test_formats(spark, raw, tmp_path, fmt):
    path = write_table(raw.select("url", "type"), str(tmp_path / fmt), fmt)
    assert read_urls(spark, path, fmt).count() == 7
    assert {r["url"] for r in clean_urls(read_urls(spark, path, fmt)).collect()} == {k[1] for k in KEPT}
