"""Readers by header name, staging of streams, and the shared folder."""

import pytest
from pyspark.sql import functions as F

from quire.sources import readers
from quire.streaming import harness


def test_csv_columns_go_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,Key,Ticker,isPriceSensitive,url,announcementTypes\n"
                                    "2020-01-02,k1,ABC,true,http://x,Placement\n")
    row = readers.read_announcements(spark, str(tmp_path / "a.csv"), "csv").first()
    assert (row.ticker, row.key, str(row.date), row.is_price_sensitive) == ("ABC", "k1", "2020-01-02", True)


def test_company_file_without_sequence(spark, tmp_path):
    header = readers.COMPANIES_HEADER
    (tmp_path / "c.csv").write_text(f"{header[1]},{header[0]}\nAAA,First\nBBB,Second\n")
    rows = readers.read_companies(spark, str(tmp_path / "c.csv"), "csv").orderBy("load_seq").collect()
    assert [(r.company_name, r.ticker) for r in rows] == [("First", "AAA"), ("Second", "BBB")]


def test_missing_column_is_an_error(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Ticker,url\nA,b\n")
    with pytest.raises(ValueError):
        readers.read_announcements(spark, str(tmp_path / "b.csv"), "csv")


def test_staging_keeps_rows_without_order(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") != 4, F.col("id")).alias("o"))
    path = harness.stage_files(df, str(tmp_path / "in"), F.col("o"))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(10))


def test_only_the_wanted_folders_are_looked_at(spark, tmp_path):
    """Folders of other keys are not even listed; a key may have several files, or only unfinished ones."""
    rows = [("a/1.md", "one\ntwo"), ("b", ""), ("c", "x"), ("", "of the empty key")]
    path = readers.write_document_files(spark.createDataFrame(rows, "key string, text string"), str(tmp_path / "files"))
    (tmp_path / "files" / "key=b" / "more.txt").write_bytes("ü\n".encode())
    (tmp_path / "files" / "key=c" / "body.txt").rename(tmp_path / "files" / "key=c" / "_begun-1")
    wanted = spark.createDataFrame([("a/1.md",), ("a/1.md",), ("b",), ("c",), ("",), (None,), ("absent",)], "key string")
    got = readers.read_document_files(spark, path, wanted)
    assert sorted(map(tuple, got.collect())) == [("a/1.md", "one\ntwo"), ("b", ""), ("b", "ü")]
    assert "binaryFile" not in got._jdf.queryExecution().optimizedPlan().toString()
