"""Golden rows for the scalar functions (S-*) and the taxonomy."""

import datetime as dt

from pyspark.sql import functions as F

from quire.functions import hashing, taxonomy, text as tx


def one(spark, expr, value, schema="x string"):
    return spark.createDataFrame([(value,)], schema).select(expr(F.col("x")).alias("y")).first()["y"]


def test_strip_markdown(spark):
    cases = {
        "# Head\nbody **b** x": "Head\nbody b x",
        "####### seven": "####### seven",
        "#\n\nnext": "next",
        "**a\nb** **c**": "**a\nb c**",
        "****": "",
        "a\r# no\n##  two": "a\r# no\ntwo",
    }
    for src, want in cases.items():
        assert one(spark, tx.strip_markdown, src) == want, src


def test_clean_chunk(spark):
    assert one(spark, tx.clean_chunk, "cost $5 **$x**") == "cost \\$5 `\\$x`"
    assert one(spark, tx.clean_chunk, "**a") == "**a"
    assert one(spark, tx.clean_chunk, "b**") == "b**"


def test_file_ids(spark):
    assert one(spark, tx.citation_file_id, "a_b_c_d.v1.pdf") == "c_d.v1"
    assert one(spark, tx.citation_file_id, "2924-0001-2A12_x.md") is None
    assert one(spark, tx.citation_file_id, "nounderscore.pdf") is None
    assert one(spark, tx.hit_file_id, "a_b_c_d.v1.pdf") == "a"
    assert one(spark, tx.hit_file_id, "2924-0001-2A12_x.md") == "2924-0001-2A12"
    assert one(spark, tx.hit_file_id, "nounderscore.pdf") == "nounderscore"


def test_preview(spark):
    assert one(spark, tx.preview, "a" * 300) == "a" * 300
    assert one(spark, tx.preview, "a" * 301) == "a" * 300 + "..."


def test_query_hash_goldens(spark):
    rows = [([],), (["Presentations"],), (["Shares 3B's, 2A's", "Placements"],), (None,)]
    df = spark.createDataFrame(rows, "types array<string>")
    h = hashing.query_hash(F.lit("BHP"), F.lit("2025-01-01").cast("date"), F.lit("2025-06-30").cast("date"),
                           F.col("types"), F.lit(False))
    got = [r[0] for r in df.select(h).collect()]
    assert got == ["440eac9f", "ec773da9", "3158fe44", "440eac9f"]


def test_company_label_parse(spark):
    df = spark.createDataFrame([("Acme (Holdings) (H03)",), ("Plain (T01)",), ("broken",)], "label string")
    name, ticker = tx.parse_company_label(F.col("label"))
    got = [tuple(r) for r in df.select(name, ticker).collect()]
    assert got == [("Acme (Holdings)", "H03"), ("Plain", "T01"), (None, None)]


def test_taxonomy(spark):
    df = spark.createDataFrame([("cashflow",), ("Trading Halt",), ("Appendix 3G",), (None,)], "t string")
    got = [r[0] for r in df.select(taxonomy.labels_array(F.col("t"))).collect()]
    assert got == [["Cashflow Reports"], ["Placements", "Shares 3B's, 2A's"], ["Shares 3B's, 2A's"], []]


def test_placements_subset_of_shares(spark):
    from quire.sources import fixtures as fx
    a = fx.announcements(spark, "/root/testdata/sf0.001")
    bad = a.where(taxonomy.label_matches(F.col("announcement_types"), "Placements")
                  & ~taxonomy.label_matches(F.col("announcement_types"), "Shares 3B's, 2A's")).count()
    assert bad == 0


def test_confidence(spark):
    ans = "x\nConfidence Score: 0.5\nmore\nConfidence Score: 0.92"
    assert one(spark, tx.parse_confidence, ans) == 0.92
    assert one(spark, tx.parse_confidence, "no score") is None
    df = spark.createDataFrame([(1.0,), (0.85,), (0.7,), (0.6,), (0.1,)], "s double")
    bands = [r[0] for r in df.select(tx.confidence_band(F.col("s"))).collect()]
    assert bands == ["direct quote", "reliable company document", "reputable web source", "indirect or older", "uncertain"]


def test_date_range_and_store(spark):
    df = spark.createDataFrame([(dt.date(2025, 1, 1), dt.date(2025, 6, 30), "BHP")], "a date, b date, t string")
    r = df.select(tx.date_range_days(F.col("a"), F.col("b")), tx.store_name(F.col("t"))).first()
    assert tuple(r) == (180, "BHP_vs")


def test_parse_sources(spark):
    ans = "Acme grew.\n- Source: Annual report, 2024-06-30\nSource: web page\nno Source here"
    df = spark.createDataFrame([(ans,)], "x string")
    assert df.select(tx.parse_sources(F.col("x"))).first()[0] == ["Annual report, 2024-06-30", "web page"]


def test_json_or_empty(spark):
    df = spark.createDataFrame([("T", ["a"]), (None, [])], "t string, types array<string>")
    got = [r[0] for r in df.select(tx.json_or_empty(F.when(F.col("t").isNotNull(), F.struct("t", "types")))).collect()]
    assert got == ['{"t":"T","types":["a"]}', "{}"]
