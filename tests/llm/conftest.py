import pytest

LONG = "lorem ipsum dolor " * 20_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: nulls, empty and very long texts, repeats, clashing extra columns."""
    base = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, base, "en", "a", len(base), True, 7), (2, base, "en", "a", len(base), False, 8),
        (2, base, "en", "a", len(base), False, 8), (3, None, None, None, None, None, None),
        (4, "", "en", "a", 0, None, None), (5, " \n\t ", None, "b", 4, None, None),
        (6, LONG, "de", "b", len(LONG), None, None), (None, "no id here at all", "en", "b", 17, None, None),
        (7, "éa 中文 \U0001F600 <|endoftext|> x", "fr", "c", 9, None, None),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept boolean, id int")


@pytest.fixture(scope="session")
def odd_dir(spark, odd, tmp_path_factory):
    """The same as tables on disk, with labels and a benchmark of their own."""
    d = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (99, None, None), (6, 0, 0)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(10, 40))), (2, None), (3, ""), (None, "x y z"),
                           (4, "tiny item")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="session")
def empty_dir(spark, odd_dir, tmp_path_factory):
    """The tables without rows."""
    d = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d
