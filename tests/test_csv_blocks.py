"""CSV files split inside quoted records, against Spark's unsplit read."""

import os
import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators.cleaning import clean_urls
from riskloom.sources.csv_blocks import PLACE, read_split_csv
from riskloom.sources.tables import read_csv, read_urls


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few dozen bytes, so most records with line breaks cross one."""
    values = {"spark.sql.files.maxPartitionBytes": "37b", "spark.sql.files.openCostInBytes": "1b"}
    for key, value in values.items():
        spark.conf.set(key, value)
    yield
    for key in values:
        spark.conf.unset(key)


def _quoted(rnd):
    text = "".join(rnd.choice('ab,"\n ') for _ in range(rnd.randrange(9)))
    if rnd.random() < 0.5 or any(c in text for c in ',"\n'):
        return '"' + text.replace('"', '""') + '"'
    return text


def _raw(rnd):
    return "".join(rnd.choice('aab,"\n ') for _ in range(rnd.randrange(7)))


def _split(spark, folder):
    rows = [(os.path.basename(r[PLACE].file), r[PLACE].block, r[PLACE].position, r.url, r.type) for r in read_split_csv(spark, folder).collect()]
    return [(r[0], *r[3:]) for r in sorted(rows, key=lambda r: r[:3])]


def _unsplit(spark, folder):
    df = spark.read.options(header=True, escape='"', multiLine=True, enforceSchema=False).csv(folder)
    rows = df.select(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("m"), "url", "type").collect()
    return [(os.path.basename(r.f), r.url, r.type) for r in sorted(rows, key=lambda r: (os.path.basename(r.f), r.m))]


@pytest.mark.parametrize("cell, seed", [(_quoted, 1), (_quoted, 2), (_raw, 3), (_raw, 4)])
def test_split_read_equals_unsplit_read(spark, tmp_path, small_blocks, cell, seed):
    rnd = random.Random(seed)
    for i in range(12):
        lines = "".join(cell(rnd) + "," + cell(rnd) + rnd.choice(["\n"] * 9 + ["\n\n"]) for _ in range(rnd.randrange(14)))
        (tmp_path / f"f{i:02d}.csv").write_text("url,type\n" + lines)
    got = _split(spark, str(tmp_path))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = _unsplit(spark, str(tmp_path))
    assert got == want and want


def test_windows_line_ends_and_no_last_line_end(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_bytes(b'url,type\r\n"http://a.com/\r\nx, y","s""p"\r\nhttp://b.com,ham\r\n\r\n"c\r\n\r\nd",e')
    assert [r[1:] for r in _split(spark, str(tmp_path))] == [("http://a.com/\r\nx, y", 's"p'), ("http://b.com", "ham"), ("c\r\n\r\nd", "e")]


def test_long_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "\n".join(f'line {i}, "" quoted' for i in range(200))
    (tmp_path / "a.csv").write_text(f'url,type\n"{long}",x\nb,y\n')
    (tmp_path / "b.csv").write_text("url,type\nc,z\n")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    assert _split(spark, str(tmp_path)) == [("a.csv", long.replace('""', '"'), "x"), ("a.csv", "b", "y"), ("b.csv", "c", "z")]


def test_very_long_lines_with_many_quotes(spark, tmp_path):
    cells = '""' * 200_000 + "," * 3
    (tmp_path / "a.csv").write_text(f'url,type\n"{cells}\nend",x\n' + ",".join(['"q"'] * 20_000) + "\n")
    rows = _split(spark, str(tmp_path))
    assert [(len(r[1]), r[2]) for r in rows] == [(200_000 + 3 + 4, "x"), (1, "q")]


def test_empty_files_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('url,type\n"x\ny",1\n')
    (tmp_path / "b.csv").write_text("url,type\n")
    (tmp_path / "c.csv").write_text("")
    assert _split(spark, str(tmp_path)) == [("a.csv", "x\ny", "1")]
    (tmp_path / "d.csv").write_text("type,url\n1,z\n")
    with pytest.raises(Exception, match="another header"):
        read_split_csv(spark, str(tmp_path)).collect()


def test_first_label_wins_across_blocks(spark, tmp_path, small_blocks):
    rows = "".join(f'"http://u{i % 20}.com/\n",{"first" if i < 20 else "later"}\n' for i in range(200))
    (tmp_path / "a.csv").write_text("url,type\n" + rows)
    cleaned = clean_urls(read_urls(spark, str(tmp_path))).collect()
    assert len(cleaned) == 20 and {r["type"] for r in cleaned} == {"first"}
    assert read_csv(spark, str(tmp_path)).columns == ["url", "type"] and read_csv(spark, str(tmp_path)).count() == 200
