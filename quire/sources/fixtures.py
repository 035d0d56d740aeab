"""Derived views over the driver tables (the reference ships no data).

Each function returns the view as a DataFrame built from the driver tables, so
its size grows with the scale factor.  The same views are spelled in SQL for
the DuckDB oracle in ``quire.plans.oracle``; both spellings must stay equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.tables import read_table


def _code(prefix: str, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), 2, "0"))


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company reference rows; two duplicate names and one name holding `` (``."""
    n = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    base = n.select(F.col("n_name").alias("company_name"), _code("T", F.col("n_nationkey")).alias("ticker"),
                    F.col("n_nationkey").cast("bigint").alias("load_seq"))
    dup = n.where(F.col("n_nationkey") < 2).select(
        F.col("n_name").alias("company_name"), _code("X", F.col("n_nationkey")).alias("ticker"),
        (F.col("n_nationkey") + 100).cast("bigint").alias("load_seq"))
    paren = n.where(F.col("n_nationkey") == 3).select(
        F.concat(F.col("n_name"), F.lit(" (Holdings)")).alias("company_name"),
        _code("H", F.col("n_nationkey")).alias("ticker"),
        (F.col("n_nationkey") + 200).cast("bigint").alias("load_seq"))
    return base.unionByName(dup).unionByName(paren)


# announcement type string by o_orderkey % 12 (10 -> NULL)
_TYPE_BY_MOD = {
    0: "Quarterly Cashflow Report", 1: "Appendix 3B", 2: "Appendix 2A", 3: "Placement",
    4: "Trading Halt", 5: "Investor Presentation", 6: "Pre-Feasibility Study (PFS)",
    7: "JORC Resource Update", 8: "Renounceable Issue", 9: "Annual Report",
    11: "Appendix 3G, Security Purchase Plan",
}


def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, url, key, announcement_types, date, is_price_sensitive (one row per order).

    Every twentieth order has a second row under the same key: a later trading
    halt with the other price flag.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"])
    j = o.join(c, o.o_custkey == c.c_custkey)
    m = F.col("o_orderkey") % 12
    types = None
    for k, v in _TYPE_BY_MOD.items():
        types = (F.when(m == k, F.lit(v)) if types is None else types.when(m == k, F.lit(v)))
    ticker = _code("T", F.col("c_nationkey"))
    d = F.col("o_orderdate").cast("date")
    rows = j.select(
        F.col("o_orderkey"),
        ticker.alias("ticker"),
        F.concat(F.lit("https://example.invalid/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.concat(ticker, F.lit("_"), d.cast("string"), F.lit("_"), F.col("o_orderkey").cast("string"),
                 F.lit(".md")).alias("key"),
        types.alias("announcement_types"),
        d.alias("date"),
        (F.col("o_orderstatus") == "F").alias("is_price_sensitive"),
    )
    again = (rows.where(F.col("o_orderkey") % 20 == 3).withColumn("announcement_types", F.lit("Trading Halt"))
             .withColumn("date", F.date_add("date", 40)).withColumn("is_price_sensitive", ~F.col("is_price_sensitive")))
    return rows.unionByName(again).drop("o_orderkey")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One filter request per event: session, ts, ticker (NULL for some), window, flag, types."""
    e = read_table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type", "value"])
    eid = F.col("event_id")
    ticker = F.when(eid % 97 == 0, F.lit(None).cast("string")).otherwise(
        _code("T", (F.col("user_id") + eid % 3) % 25))
    types = (F.when(eid % 11 == 0, F.lit("Mining studies/resources"))
             .when(eid % 13 == 0, F.lit("Unknown label"))
             .when(F.col("event_type") == "view", F.lit("Placements"))
             .when(F.col("event_type") == "signup", F.lit("Placements|Shares 3B's, 2A's"))
             .when(F.col("event_type") == "error", F.lit("Presentations"))
             .when(F.col("event_type") == "purchase", F.lit("Cashflow Reports"))
             .otherwise(F.lit("")))
    return e.select(
        eid.alias("request_id"),
        F.col("user_id").alias("session_id"),
        F.col("ts"),
        ticker.alias("ticker"),
        F.when(eid % 4 == 0, F.lit("1996-01-01")).otherwise(F.lit("1998-01-01")).cast("date").alias("date_from"),
        F.when(eid % 5 == 0, F.lit("1998-12-31")).otherwise(F.lit("2001-12-31")).cast("date").alias("date_to"),
        (F.col("value") > 20).alias("price_sensitive"),
        F.filter(F.split(types, r"\|"), lambda x: x != "").alias("types"),
        F.col("event_type"),
    )


def _company(custkey: Column) -> Column:
    """A company for every ten customers, so tickers grow with the data; every twentieth customer belongs to one large one."""
    return F.when(custkey % 20 == 0, F.lit("C000000")).otherwise(
        F.concat(F.lit("C"), F.lpad((F.floor(custkey / 10) + 1).cast("string"), 6, "0")))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announcements of a whole market: one row per line item, companies that grow with the data.

    Some first lines have a second row under the same key, as in :func:`announcements`.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    i = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_returnflag"])
    j = i.join(o, i.l_orderkey == o.o_orderkey)
    types = F.element_at(F.create_map(*[F.lit(x) for kv in _TYPE_BY_MOD.items() for x in kv]), (F.col("l_partkey") % 12).cast("int"))
    name = F.concat(F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))
    rows = j.select(
        "l_orderkey", "l_linenumber", _company(F.col("o_custkey")).alias("ticker"),
        F.concat(F.lit("https://example.invalid/"), name).alias("url"), F.concat(name, F.lit(".md")).alias("key"),
        types.alias("announcement_types"), F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_returnflag") == "R").alias("is_price_sensitive"))
    again = (rows.where((F.col("l_orderkey") % 20 == 3) & (F.col("l_linenumber") == 1))
             .withColumn("announcement_types", F.lit("Trading Halt"))
             .withColumn("date", F.date_add("date", 40)).withColumn("is_price_sensitive", ~F.col("is_price_sensitive")))
    return rows.unionByName(again).drop("l_orderkey", "l_linenumber")


def market_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for every order, at its day: windows of all lengths up to and beyond a year, some without dates.

    ``as_of`` is the request's own day, for the defaults and limits of FLT-6.
    """
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    null_day = F.lit(None).cast("date")
    labels = (F.when(k % 11 == 0, F.array(F.lit("Mining studies/resources"))).when(k % 13 == 0, F.array(F.lit("Unknown label")))
              .when(k % 3 == 0, F.array(F.lit("Placements"), F.lit("Cashflow Reports")))
              .when(k % 3 == 1, F.array(F.lit("Shares 3B's, 2A's"))).otherwise(F.array().cast("array<string>")))
    return o.select(
        k.alias("request_id"), F.col("o_custkey").alias("session_id"),
        (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (k % 86400).cast("decimal(18,6)"))).alias("ts"),
        F.when(k % 97 != 0, _company(F.col("o_custkey") + F.when(k % 4 == 0, F.lit(10)).otherwise(F.lit(0)))).alias("ticker"),
        F.when(k % 7 == 0, null_day).otherwise(F.date_sub(day, (20 + (k * 7) % 500).cast("int"))).alias("date_from"),
        F.when(k % 5 == 0, null_day).otherwise(F.date_sub(day, ((k % 9) * 10).cast("int"))).alias("date_to"),
        (F.col("o_totalprice") > 150000).alias("price_sensitive"), labels.alias("types"),
        day.alias("as_of"), (k % 6 != 0).alias("ack"))


def _with_evidence(conv: Column, text: Column) -> Column:
    """Every third conversation's answers end in a source line and a confidence score."""
    score = F.when(conv % 10 == 0, F.lit("1.0")).otherwise(F.concat(F.lit("0."), (conv % 10).cast("string")))
    return F.when(conv % 3 == 0, F.concat(text, F.lit("\n- Source: T"), conv.cast("string"),
                                          F.lit(".md\nConfidence Score: "), score)).otherwise(text)


def response_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed answer events for every assistant turn (whole text, 16-char deltas).

    Terminal event by conv_id % 7: 0 failed, 1 cancelled (both at seq 25),
    2 incomplete (seq 25), else completed (last).
    """
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]).where(
        F.col("role") == "assistant").withColumn("text", _with_evidence(F.col("conv_id"), F.col("text")))
    obj = F.col("conv_id") % 3 == 1                  # annotations of these answers come in object form
    null_b = F.lit(None).cast("boolean").alias("is_object")
    rid = (F.col("conv_id") * 1000 + F.col("turn")).alias("response_id")
    null_s = F.lit(None).cast("string")
    n = F.length("text")
    deltas = (c.select(rid, F.col("text"), F.explode(F.when(n > 0, F.sequence(F.lit(0), ((n - 1) / 16).cast("int")))).alias("i"))
              .select("response_id", (F.col("i") * 10).cast("bigint").alias("seq"),
                      F.lit("response.output_text.delta").alias("type"),
                      F.substring(F.col("text"), F.col("i") * 16 + 1, 16).alias("delta"),
                      null_s.alias("ann_type"), null_s.alias("filename"), null_s.alias("url"), null_s.alias("title"), null_b))
    fc = c.where((F.col("turn") >= 1) & (F.col("conv_id") % 4 != 3))
    files = (fc.select(rid, F.col("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
             .select("response_id", (F.col("i") * 10 + 1).cast("bigint").alias("seq"),
                     F.lit("response.output_text.annotation.added").alias("type"), null_s.alias("delta"),
                     F.lit("file_citation").alias("ann_type"),
                     F.when((F.col("conv_id") + F.col("i")) % 5 == 0, F.lit("malformed.pdf")).otherwise(
                         F.concat(F.lit("T"), (F.col("conv_id") % 3).cast("string"), F.lit("_x_"),
                                  ((F.col("conv_id") + F.col("i")) % 2).cast("string"), F.lit(".v1.pdf"))).alias("filename"),
                     null_s.alias("url"), null_s.alias("title"), obj.alias("is_object")))
    wc = c.where((F.col("turn") >= 1) & (F.col("conv_id") % 2 == 0))
    webs = (wc.select(rid, F.col("conv_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("i"))
            .select("response_id", (F.col("i") * 10 + 2).cast("bigint").alias("seq"),
                    F.lit("response.output_text.annotation.added").alias("type"), null_s.alias("delta"),
                    F.when(obj, "url_citation").otherwise("web_citation").alias("ann_type"), null_s.alias("filename"),
                    F.concat(F.lit("https://example.invalid/w"), (F.col("conv_id") % 6).cast("string")).alias("url"),
                    F.when(F.col("i") == 0, F.lit("Some title")).alias("title"), obj.alias("is_object")))
    m = F.col("conv_id") % 7
    ends = c.select(rid, F.when(m < 3, F.lit(25)).otherwise(F.lit(1000000)).cast("bigint").alias("seq"),
                    F.when(m == 0, "response.failed").when(m == 1, "response.cancelled")
                    .when(m == 2, "response.incomplete").otherwise("response.completed").alias("type"),
                    null_s.alias("delta"), null_s.alias("ann_type"), null_s.alias("filename"),
                    null_s.alias("url"), null_s.alias("title"), null_b)
    return deltas.unionByName(files).unionByName(webs).unionByName(ends)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits standing in for the remote store's answers (20 query groups)."""
    d = read_table(spark, sf_dir, "documents", ["doc_id", "source", "text"])
    return d.select(
        (F.col("doc_id") % 20).alias("query_id"), F.col("doc_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit(".md")).alias("filename"),
        ((F.col("doc_id") * 37) % 101).cast("double") / 100,
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("## Report **"), F.col("doc_id").cast("string"), F.lit("**\n"),
                                                  F.col("text"))).otherwise(F.col("text")),
    ).toDF("query_id", "doc_id", "filename", "score", "text")


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per turn: the selected ticker (switches every three turns) and, for user
    turns only, a summary (other turns add none, like search prompts).  Every
    fourth conversation keeps its ticker and has a summary at every turn."""
    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    steady = F.col("conv_id") % 4 == 0
    t = (F.col("conv_id") + F.when(steady, F.lit(0)).otherwise(F.floor(F.col("turn") / 3)).cast("bigint")) % 25
    return c.select(F.col("conv_id").alias("session_id"), F.col("turn"), _code("T", t).alias("ticker"),
                    F.when((F.col("role") == "user") | steady, F.concat(F.lit("User asked about "), F.col("text"))).alias("summary"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item, whole text, as a search query."""
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def store_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store touches: one per event, the store named by user."""
    e = read_table(spark, sf_dir, "events", ["user_id", "ts"])
    return e.select(F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("ticker"), F.col("ts"))


def conversation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested conversation records (one per user question answered by the next turn).

    Shape: session_id; user{user_id,user_email}; vector_store{vs_id,num_of_docs,s3_keys[]};
    query{selected_ticker,announcement_types[],price_sensitive,date_from,date_to,date_range};
    message{message_text,message_timestamp,assistant_response};
    chat_settings{chat_model,chat_mode,tokens_used}.
    """
    from quire.operators.history import qa_pairs
    from quire.functions.text import store_name, date_range_days

    c = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    qa = qa_pairs(c)
    ticker = _code("T", (F.col("conv_id") + F.floor(F.col("turn") / 3).cast("bigint")) % 25)
    dfrom = F.lit("1998-01-01").cast("date")
    dto = F.lit("2001-12-31").cast("date")
    types = F.when(F.col("turn") % 2 == 0, F.array(F.lit("Placements"))).otherwise(
        F.array().cast("array<string>"))
    return qa.select(
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        F.struct(F.col("conv_id").alias("user_id"),
                 F.concat(F.lit("user"), F.col("conv_id").cast("string"), F.lit("@example.invalid")).alias("user_email")
                 ).alias("user"),
        F.struct(store_name(ticker).alias("vs_id"), F.col("turn").alias("num_of_docs"),
                 F.array(F.concat(ticker, F.lit("_"), F.col("conv_id").cast("string"), F.lit(".md"))).alias("s3_keys")
                 ).alias("vector_store"),
        F.struct(ticker.alias("selected_ticker"), types.alias("announcement_types"),
                 (F.col("turn") % 2 == 1).alias("price_sensitive"), dfrom.alias("date_from"), dto.alias("date_to"),
                 date_range_days(dfrom, dto).alias("date_range")).alias("query"),
        F.struct(F.col("question").alias("message_text"),
                 F.concat(F.lit("2024-01-01 00:00:"),
                          F.when(F.col("turn") < 100, F.lpad(F.col("turn").cast("string"), 2, "0"))
                          .otherwise(F.col("turn").cast("string"))).alias("message_timestamp"),
                 F.col("answer").alias("assistant_response")).alias("message"),
        F.struct(F.lit("model-a").alias("chat_model"), F.lit("Generate").alias("chat_mode"),
                 F.length("answer").cast("bigint").alias("tokens_used")).alias("chat_settings"),
    )
