"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or views Spark derives from them) whole.
Column names match the oracle SQL in ``quire.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources import fixtures as fx
from quire.operators import filters, ingest, stats
from quire.operators.filters import FilterSpec
from quire.plans import refresh

# The minimum slice: one request's filter set (ticker, closed window, flag, labels).
SLICE = FilterSpec("T07", "1996-01-01", "1998-12-31", True, ["Placements", "Presentations"])
MAX_KEYS = 100
AS_OF = "1999-06-30"


def flt_select_announcements(spark: SparkSession, sf: str) -> DataFrame:
    return filters.select_announcements(fx.announcements(spark, sf), SLICE)


def agg1_single_request(spark: SparkSession, sf: str) -> DataFrame:
    m = filters.select_announcements(fx.announcements(spark, sf), SLICE)
    return m.groupBy("announcement_types").agg(F.count(F.lit(1)).alias("n"))


def win4_detect_change(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.detect_change(fx.requests(spark, sf)).select(
        "request_id", "session_id", "ticker", "query_hash", "reason")


def jn2_match_requests(spark: SparkSession, sf: str) -> DataFrame:
    return filters.match_requests(fx.requests(spark, sf), fx.announcements(spark, sf), ["request_id", "key"])


def agg1_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return stats.type_counts(fx.requests(spark, sf), fx.announcements(spark, sf))


def agg2_doc_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.doc_counts(fx.requests(spark, sf), fx.announcements(spark, sf))


def win7_ledger_grow(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.load_ledger(fx.requests(spark, sf), fx.announcements(spark, sf), mode="grow").select(
        "session_id", "ticker", "key", "request_id")


def win7_ledger_ack(spark: SparkSession, sf: str) -> DataFrame:
    """Grow ledger where uploads of requests raised by error events are not acknowledged (Q5)."""
    r = fx.requests(spark, sf).withColumn("ack", F.col("event_type") != "error")
    return ingest.load_ledger(r, fx.announcements(spark, sf), mode="grow", ack_col="ack").select(
        "session_id", "ticker", "key", "request_id")


def win7_ledger_faithful(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.load_ledger(fx.requests(spark, sf), fx.announcements(spark, sf), mode="faithful").select(
        "session_id", "ticker", "key", "request_id")


def snk2_manifests(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.refresh_manifests(fx.requests(spark, sf), fx.announcements(spark, sf), max_keys=MAX_KEYS)


def r4_refresh_plan(spark: SparkSession, sf: str) -> DataFrame:
    return refresh.refresh_plan(fx.requests(spark, sf), fx.announcements(spark, sf), max_keys=MAX_KEYS)


def r4_refresh_types(spark: SparkSession, sf: str) -> DataFrame:
    """Type counts of the changed requests, whose windows have the defaults and limits of FLT-6."""
    return refresh.refresh_type_counts(fx.requests(spark, sf), fx.announcements(spark, sf), AS_OF)


# ---- a whole market: companies that grow with the data, windows of all lengths that end at each request's day ----
def _market(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return filters.normalise_window(fx.market_requests(spark, sf), F.col("as_of")), fx.filings(spark, sf)


def jn2_market_requests(spark: SparkSession, sf: str) -> DataFrame:
    return filters.match_requests(*_market(spark, sf), ["request_id", "key"])


def agg1_market_types(spark: SparkSession, sf: str) -> DataFrame:
    return stats.type_counts(*_market(spark, sf))


def agg2_market_new_docs(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.doc_counts(*_market(spark, sf))


def r4_market_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship plan with the default windows of FLT-6, each at its request's day."""
    return refresh.refresh_plan(fx.market_requests(spark, sf), fx.filings(spark, sf), max_keys=MAX_KEYS, as_of=F.col("as_of"))


def win7_market_ack(spark: SparkSession, sf: str) -> DataFrame:
    """Acknowledged ledger of the market, a store for every company: one ledger for all sessions."""
    r, a = _market(spark, sf)
    return ingest.load_ledger(r, a, mode="grow", scope="store", ack_col="ack").select("ticker", "key", "request_id")


QUERIES = {
    "jn2_market_requests": jn2_market_requests,
    "agg1_market_types": agg1_market_types,
    "agg2_market_new_docs": agg2_market_new_docs,
    "r4_market_refresh": r4_market_refresh,
    "win7_market_ack": win7_market_ack,
    "flt_select_announcements": flt_select_announcements,
    "agg1_single_request": agg1_single_request,
    "win4_detect_change": win4_detect_change,
    "jn2_match_requests": jn2_match_requests,
    "agg1_type_counts": agg1_type_counts,
    "agg2_doc_counts": agg2_doc_counts,
    "win7_ledger_grow": win7_ledger_grow,
    "win7_ledger_faithful": win7_ledger_faithful,
    "win7_ledger_ack": win7_ledger_ack,
    "snk2_manifests": snk2_manifests,
    "r4_refresh_plan": r4_refresh_plan,
    "r4_refresh_types": r4_refresh_types,
}


# ---- history (WIN-2/3/5/6, AGG-10, S-11) ---------------------------------------
from quire.functions import text as tx  # noqa: E402
from quire.operators import citations, history, responses  # noqa: E402
from quire.plans.answer_report import answer_report  # noqa: E402
from quire.sources.tables import read_table  # noqa: E402


def _epochs(spark, sf):
    return history.epochs(fx.summaries(spark, sf))


def win3_qa_pairs(spark, sf):
    return history.qa_pairs(read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]))


def s11_qa_line(spark, sf):
    qa = win3_qa_pairs(spark, sf)
    return qa.select("conv_id", "turn", tx.qa_line(F.col("question"), F.col("answer")).alias("qa_line"))


def win5_epochs(spark, sf):
    return _epochs(spark, sf).select("session_id", "turn", "ticker", "epoch")


def win2_last_n(spark, sf):
    return history.last_n(_epochs(spark, sf)).select("session_id", "epoch", "turn", "pos")


def win6_visible(spark, sf):
    return history.visible(_epochs(spark, sf)).select("session_id", "epoch", "turn", "idx", "summary")


def agg10_history_block(spark, sf):
    e = _epochs(spark, sf)
    return history.render_block(e, history.visible(e))


# ---- citations / responses (FLT-8, WIN-1, AGG-7, AGG-8, R-6) --------------------
def flt8_annotation_routing(spark, sf):
    return citations.classify(fx.response_events(spark, sf)).select("response_id", "seq", "kind")


def win1_dedupe_files(spark, sf):
    return citations.dedupe_files(citations.classify(fx.response_events(spark, sf)))


def agg8_reference_block(spark, sf):
    return citations.render_block(citations.classify(fx.response_events(spark, sf)))


def agg7_assemble(spark, sf):
    return responses.assemble(fx.response_events(spark, sf))


def r6_answer_report(spark, sf):
    return answer_report(fx.response_events(spark, sf))


QUERIES.update({
    "win3_qa_pairs": win3_qa_pairs,
    "s11_qa_line": s11_qa_line,
    "win5_epochs": win5_epochs,
    "win2_last_n": win2_last_n,
    "win6_visible": win6_visible,
    "agg10_history_block": agg10_history_block,
    "flt8_annotation_routing": flt8_annotation_routing,
    "win1_dedupe_files": win1_dedupe_files,
    "agg8_reference_block": agg8_reference_block,
    "agg7_assemble": agg7_assemble,
    "r6_answer_report": r6_answer_report,
})


# ---- index / search (R-1, R-2, TOP-1/2/4, ORD-2/3, AGG-9, JN-5, R-5) ---------------------
from quire.operators import index as ix, search, vectors  # noqa: E402
from quire.plans.search_report import search_hits, search_report  # noqa: E402

BASE_URL = "https://files.example.invalid/file/"


def _docs(spark, sf):
    return read_table(spark, sf, "documents", ["doc_id", "text", "source"])


def r1_chunks(spark, sf):
    return ix.chunk(_docs(spark, sf))


def r2_term_df(spark, sf):
    return ix.build(_docs(spark, sf)).df.select("term", "df")


def top2_text_topk(spark, sf):
    idx = ix.build(_docs(spark, sf))
    return search.text_topk(fx.text_queries(spark, sf), idx, 10).select("query_id", "rank", "doc_id", "chunk_no", "score")


def ord3_canned_queries(spark, sf):
    """The canned questions in every store; a document's source names its store."""
    docs = _docs(spark, sf)
    idx = ix.build(docs, partition_col="source")
    top = search.text_topk(search.canned_queries(spark, docs.select("source")), idx, 10, partition_col="source")
    return top.select(F.col("part").alias("source"), "query_id", "rank", "doc_id", "chunk_no", "score")


def top3_prompt_passages(spark, sf):
    """R-3 prompt records with the passages their questions retrieve."""
    records = r3_prompt_records(spark, sf)
    q = records.select(F.struct("session_id", "turn").alias("query_id"), F.col("input").alias("query"))
    hits = search.text_topk(q, ix.build(_docs(spark, sf)), 5).select("query_id.*", "rank", "doc_id", "chunk_no")
    return prompts.attach_passages(records, hits).select("session_id", "turn", "input", "n_passages", "passages")


def top1_vector_topk_by_store(spark, sf):
    """Exact top-k within the vectors of the same label: one store per label."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    return search.vector_topk(e.withColumnRenamed("vec_id", "query_id"), e, 10, exclude_self=True, partition_col="label")


def top1_vector_topk(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    return search.vector_topk(e.withColumnRenamed("vec_id", "query_id"), e, 10, exclude_self=True)


def top4_lsh_topk(spark, sf):
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    found = vectors.index_topk(e.withColumnRenamed("vec_id", "query_id"), vectors.build_index(e), 10, exclude_self=True)
    return found.select("query_id", "vec_id", "score", "rank")


def top4_recall(spark, sf):
    """What the index does on the whole table: recall of the exact answers, and pairs scored, against what is asked of it."""
    e = read_table(spark, sf, "embeddings", ["vec_id", "embedding"])
    q = e.withColumnRenamed("vec_id", "query_id")
    index = vectors.build_index(e)
    pair = ["query_id", "vec_id"]
    truth = search.vector_topk(q, e, 10, exclude_self=True).select(*pair, F.lit(1).alias("t"))
    found = vectors.index_topk(q, index, 10, exclude_self=True).select(*pair, F.lit(1).alias("f"))
    recall = truth.join(found, pair, "left").agg((F.count("f") / F.count("t")).alias("recall"),
                                                 F.countDistinct("query_id").alias("n_queries"))
    share = vectors.scored_share(q, index)
    return recall.select("n_queries", (F.col("recall") >= 0.9).alias("recall_reached"),
                         F.lit(share.first().scored < 0.3).alias("pruned"))


def ord2_rank_evidence(spark, sf):
    a = fx.announcements(spark, sf).withColumn("priority", F.when(F.col("is_price_sensitive"), 0).otherwise(1))
    return search.rank_evidence(a, ["ticker"]).select("ticker", "rank", "key")


def agg9_result_cards(spark, sf):
    return search.render_cards(fx.hits(spark, sf), BASE_URL, 10, order=[F.col("score").desc(), F.col("doc_id").asc()])


def jn5_attach_source(spark, sf):
    meta = read_table(spark, sf, "documents", ["doc_id", "lang", "source", "n_chars"])
    return citations.attach_source(fx.hits(spark, sf).select("query_id", "doc_id", "filename", "score"), meta)


def r5_search_report(spark, sf):
    return search_report(fx.text_queries(spark, sf), _docs(spark, sf), 10, BASE_URL)


QUERIES.update({
    "r1_chunks": r1_chunks,
    "r2_term_df": r2_term_df,
    "top2_text_topk": top2_text_topk,
    "ord3_canned_queries": ord3_canned_queries,
    "top3_prompt_passages": top3_prompt_passages,
    "top1_vector_topk_by_store": top1_vector_topk_by_store,
    "top1_vector_topk": top1_vector_topk,
    "top4_lsh_topk": top4_lsh_topk,
    "top4_recall": top4_recall,
    "ord2_rank_evidence": ord2_rank_evidence,
    "agg9_result_cards": agg9_result_cards,
    "jn5_attach_source": jn5_attach_source,
    "r5_search_report": r5_search_report,
})


# ---- companies, taxonomy, filters, scalars (AGG-3..6, JN-1, JN-3, JN-4, FLT-4/6/7, S-*) ----
from quire.functions import taxonomy as tax  # noqa: E402
from quire.operators import companies, evidence  # noqa: E402

CUTOFF = "2024-01-15 00:00:00"


def agg4_distinct_companies(spark, sf):
    return companies.distinct_pairs(fx.companies(spark, sf))


def agg5_company_lookup(spark, sf):
    return companies.build_lookup(fx.companies(spark, sf))


def jn1_resolve_company(spark, sf):
    c = fx.companies(spark, sf)
    labels = c.select(tx.company_label(F.col("company_name"), F.col("ticker")).alias("label"))
    return companies.resolve(labels, companies.build_lookup(c)).select("label", "company_name", "shown_ticker", "ticker")


def jn4_taxonomy_labels(spark, sf):
    a = fx.announcements(spark, sf)
    return a.select("key", F.array_join(tax.labels_array(F.col("announcement_types")), "|").alias("labels"))


def jn4_taxonomy_join(spark, sf):
    a = fx.announcements(spark, sf).select("key", "announcement_types")
    t = F.broadcast(tax.taxonomy_frame(spark))      # fixed 5-row table: bounded broadcast
    return a.join(t, F.expr("announcement_types rlike concat('(?iu)', pattern)")).select("key", "label")


def flt4_type_flags(spark, sf):
    a = fx.announcements(spark, sf)
    names = ["is_cashflow", "is_mining", "is_placement", "is_shares", "is_presentation"]
    return a.select("key", *[tax.label_matches(F.col("announcement_types"), lab).alias(n)
                             for lab, n in zip(tax.LABELS, names)])


def agg3_label_counts(spark, sf):
    return stats.label_counts(fx.announcements(spark, sf))


def flt6_normalise_window(spark, sf):
    r = fx.requests(spark, sf)
    click = F.col("event_type") == "click"           # clicks carry no dates: defaults apply
    r = (r.withColumn("date_from", F.when(click, F.lit(None).cast("date")).otherwise(F.col("date_from")))
          .withColumn("date_to", F.when(click, F.lit(None).cast("date")).otherwise(F.col("date_to"))))
    n = filters.normalise_window(r, AS_OF)
    return n.select("request_id", "date_from", "date_to",
                    tx.date_range_days(F.col("date_from"), F.col("date_to")).cast("bigint").alias("date_range"))


def flt7_classify(spark, sf):
    r = fx.requests(spark, sf)
    mode = (F.when(F.col("event_type").isin("view", "signup"), F.lit("Generate"))
            .when(F.col("event_type") == "click", F.lit("Search"))
            .when(F.col("event_type") == "purchase", F.lit("Summarise")))
    return filters.classify(r.withColumn("mode", mode)).select("request_id", "status")


def agg6_key_lists(spark, sf):
    """The slice's filter without its ticker, as one sorted key list per ticker."""
    a = fx.announcements(spark, sf)
    spec = SLICE
    cond = (F.col("date").between(F.lit(spec.date_from).cast("date"), F.lit(spec.date_to).cast("date"))
            & (F.col("is_price_sensitive") == F.lit(True)) & tax.type_predicate(F.col("announcement_types"), spec.types))
    m = a.where(cond)
    return filters.select_keys(m, by=("ticker",), as_list=True, max_keys=MAX_KEYS).select(
        "ticker", "batch_no", F.to_json("keys").alias("keys"))


def jn3_incremental_keys(spark, sf):
    """By key group until the end: what is loaded and what is new meet before keys become rows."""
    r = fx.requests(spark, sf)
    a = fx.announcements(spark, sf)
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    names = ["request_id", "session_id", "ticker", "key"]
    plan = filters.plan_matches(r, a)
    k = ingest.plan_keys(plan)
    loaded = ingest.load_ledger(r.where(F.col("ts") < cut), a, groups=k)
    new = filters.match_requests(r.where(F.col("ts") >= cut), a, names[:-1], groups=k)
    return k.expand(ingest.incremental_keys(new, loaded, on=("session_id", "ticker", "kg"))).select(*names)


def s_hit_functions(spark, sf):
    h = fx.hits(spark, sf)
    return h.select(
        "query_id", "doc_id",
        tx.hit_file_id(F.col("filename")).alias("hit_file_id"),
        tx.citation_file_id(F.col("filename")).alias("citation_file_id"),
        tx.document_url(BASE_URL, tx.hit_file_id(F.col("filename"))).alias("url"),
        tx.round_score(F.col("score")).alias("score2"),
        tx.preview(tx.strip_markdown(F.col("text"))).alias("preview"),
        tx.clean_chunk(F.col("text")).alias("cleaned"),
        tx.result_id(F.col("query_id"), F.col("doc_id")).alias("result_id"))


def s_request_functions(spark, sf):
    r = fx.requests(spark, sf)
    payload = tx.json_or_empty(F.when(F.col("ticker").isNotNull(), F.struct("ticker", "types")))
    return r.select(
        "request_id",
        tx.parse_json(payload, "ticker string, types array<string>")["ticker"].alias("payload_ticker"),
        tx.store_name(F.col("ticker")).alias("store_name"),
        tx.list_cell(tx.selected_types(F.col("types"))).alias("types_json"),
        payload.alias("payload"),
        tx.markdown_link(F.when(F.size("types") > 0, F.get(F.col("types"), 0)), F.concat(F.lit("https://example.invalid/"),
                         F.col("request_id").cast("string"))).alias("link"))


def s20_conflicts(spark, sf):
    e = read_table(spark, sf, "events", ["user_id", "event_type", "ts", "props"])
    v = e.select("user_id", "event_type", "ts", F.get_json_object("props", "$.k").cast("bigint").alias("v"))
    return evidence.conflicts(v, "user_id", "event_type", "v", "ts")


QUERIES.update({
    "agg4_distinct_companies": agg4_distinct_companies,
    "agg5_company_lookup": agg5_company_lookup,
    "jn1_resolve_company": jn1_resolve_company,
    "jn4_taxonomy_labels": jn4_taxonomy_labels,
    "jn4_taxonomy_join": jn4_taxonomy_join,
    "flt4_type_flags": flt4_type_flags,
    "agg3_label_counts": agg3_label_counts,
    "flt6_normalise_window": flt6_normalise_window,
    "flt7_classify": flt7_classify,
    "agg6_key_lists": agg6_key_lists,
    "jn3_incremental_keys": jn3_incremental_keys,
    "s_hit_functions": s_hit_functions,
    "s_request_functions": s_request_functions,
    "s20_conflicts": s20_conflicts,
})


# ---- sources, sinks, prompts (SRC-1..4, SNK-1, R-3) -----------------------------------------
from quire.operators import prompts  # noqa: E402
from quire.session import scratch_path  # noqa: E402
from quire.sources import readers, sinks  # noqa: E402


def src1_companies_csv(spark, sf):
    path = readers.write_companies_csv(fx.companies(spark, sf), scratch_path(spark, "companies-csv"))
    return readers.read_companies(spark, path, "csv")


def src2_announcements_layout(spark, sf):
    path = readers.write_announcements(fx.announcements(spark, sf), scratch_path(spark, "announcements"))
    ann = readers.prune_by_month(readers.read_announcements(spark, path), SLICE.date_from, SLICE.date_to)
    return filters.select_announcements(ann, SLICE)


def src2_announcements_csv(spark, sf):
    """The whole announcement table through its CSV layout, read back by header names."""
    ann = fx.announcements(spark, sf)
    path = readers.write_announcements_csv(ann, scratch_path(spark, "announcements-csv"))
    return readers.read_announcements(spark, path, "csv")


def src3_documents_by_key(spark, sf):
    d = read_table(spark, sf, "documents", ["doc_id", "source", "n_chars", "text"])
    docs = d.withColumn("key", F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit(".md")))
    wanted = fx.hits(spark, sf).where(F.col("score") >= 0.9).select(F.col("filename").alias("key"))
    return readers.read_documents(docs, wanted).select("doc_id", "key", "n_chars", "text")


def src3_document_files(spark, sf):
    """Document bodies kept as one file per key, and only the wanted files read."""
    d = read_table(spark, sf, "documents", ["doc_id", "source", "text"])
    path = readers.write_document_files(
        d.select(F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit(".md")).alias("key"), "text"),
        scratch_path(spark, "document-files"))
    wanted = fx.hits(spark, sf).where(F.col("score") >= 0.9).select(F.col("filename").alias("key"))
    return readers.read_document_files(spark, path, wanted).select("key", "text")


def src4_response_events(spark, sf):
    path = scratch_path(spark, "response-events")
    fx.response_events(spark, sf).write.mode("overwrite").json(path)
    return readers.read_response_events(spark, path, "json")


def snk1_conversation_log(spark, sf):
    path = scratch_path(spark, "conversation-log")
    sinks.append_conversation_log(fx.conversation_records(spark, sf), path, "parquet")
    return sinks.read_conversation_log(spark, path)


def r3_prompt_records(spark, sf):
    e = _epochs(spark, sf)
    hist = history.render_block(e, history.visible(e))
    conv = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"]).where(F.col("role") == "user")
    p = (conv.select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"))
         .join(e.select("session_id", "turn", "ticker"), ["session_id", "turn"]))
    names = prompts.company_names(companies.build_lookup(fx.companies(spark, sf)))
    return prompts.assemble(p, names, hist)


QUERIES.update({
    "src1_companies_csv": src1_companies_csv,
    "src2_announcements_layout": src2_announcements_layout,
    "src2_announcements_csv": src2_announcements_csv,
    "src3_documents_by_key": src3_documents_by_key,
    "src3_document_files": src3_document_files,
    "src4_response_events": src4_response_events,
    "snk1_conversation_log": snk1_conversation_log,
    "r3_prompt_records": r3_prompt_records,
})


# ---- streams (ST-1 .. ST-6), each checked against its batch twin ----------------------------
from quire.streaming import harness, stateful, windows  # noqa: E402


def _run_stream(spark, df, order, name, build):
    """Feed ``df`` range after range to a stream that appends to a Parquet table; the table."""
    base = scratch_path(spark, name)

    def run():
        out = build(harness.read_staged(spark, f"{base}/in", df.schema))
        harness.run_available_now(out.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck")
                                  .option("path", f"{base}/out"))

    harness.replay(df, f"{base}/in", order, run)
    return spark.read.parquet(f"{base}/out")


def st1_assemble_stream(spark, sf):
    """JSON event files through the streaming reader and the live log, assembled from the log."""
    base = scratch_path(spark, "st1")

    def run():
        live = stateful.live_responses(readers.read_response_events(spark, f"{base}/in", "json", streaming=True))
        harness.run_available_now(live.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck")
                                  .option("path", f"{base}/live"))

    harness.replay(fx.response_events(spark, sf), f"{base}/in", F.col("seq"), run, fmt="json")
    return responses.assemble(spark.read.parquet(f"{base}/live"))


def _shipments(spark, sf):
    r = ingest.detect_change(fx.requests(spark, sf)).where(F.col("needs_update"))
    names = ["session_id", "ticker", "key", "ts", "request_id"]
    return filters.match_requests(r, fx.announcements(spark, sf), names).select(*names)


def _by_time():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def st2_incremental_intake(spark, sf):
    pairs = _shipments(spark, sf)
    base = scratch_path(spark, "st2")
    body = windows.intake_batch(spark, f"{base}/ledger")

    def run():
        harness.run_available_now(harness.read_staged(spark, f"{base}/in", pairs.schema).writeStream
                                  .foreachBatch(body).option("checkpointLocation", f"{base}/ck"))

    harness.replay(pairs, f"{base}/in", _by_time(), run)
    return spark.read.parquet(f"{base}/ledger").select("session_id", "ticker", "key", "request_id")


def st2_watermark_intake(spark, sf):
    """Keys seen first within a horizon of 400 days, longer than the table's span: every key once."""
    pairs = _shipments(spark, sf)
    out = _run_stream(spark, pairs, _by_time(), "st2w", lambda s: windows.dedupe_within_watermark(s, "400 days"))
    return out.select("session_id", "ticker", "key")


def st3_rolling_history(spark, sf):
    return _run_stream(spark, fx.summaries(spark, sf), F.col("turn"), "st3", stateful.rolling_history)


def st4_detect_change(spark, sf):
    r = fx.requests(spark, sf).drop("event_type")
    return _run_stream(spark, r, _by_time(), "st4", stateful.detect_change)


def st5_store_lifetimes(spark, sf):
    """Lifetimes that the stream has closed (the watermark passed their end), and those still open."""
    act = fx.store_activity(spark, sf)
    closed = _run_stream(spark, act, _by_time(), "st5", windows.store_lifetimes)
    return closed.unionByName(windows.open_lifetimes(act, closed))


def st5_batch_lifetimes(spark, sf):
    return windows.store_lifetimes(fx.store_activity(spark, sf))


def st6_conversation_log(spark, sf):
    rec = fx.conversation_records(spark, sf)
    base = scratch_path(spark, "st6")

    def run():
        harness.run_available_now(harness.read_staged(spark, f"{base}/in", rec.schema).writeStream
                                  .foreachBatch(windows.log_batch(f"{base}/log")).option("checkpointLocation", f"{base}/ck"))

    harness.replay(rec, f"{base}/in", F.col("vector_store.num_of_docs"), run)
    return sinks.read_conversation_log(spark, f"{base}/log")


QUERIES.update({
    "st1_assemble_stream": st1_assemble_stream,
    "st2_incremental_intake": st2_incremental_intake,
    "st2_watermark_intake": st2_watermark_intake,
    "st3_rolling_history": st3_rolling_history,
    "st4_detect_change": st4_detect_change,
    "st5_store_lifetimes": st5_store_lifetimes,
    "st5_batch_lifetimes": st5_batch_lifetimes,
    "st6_conversation_log": st6_conversation_log,
})
