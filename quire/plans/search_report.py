"""R-5 search report: text queries -> BM25 top-k passages -> cards per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.citations import DEFAULT_BASE_URL, attach_source
from quire.operators.index import build, chunk_text
from quire.operators.search import K_DEFAULT, render_cards, text_topk
from quire.session import materialize


def search_hits(queries: DataFrame, docs: DataFrame, k: int = K_DEFAULT, size: int = 200, overlap: int = 50,
                partition_col: str | None = None) -> DataFrame:
    """Long-form hits: query_id, rank, doc_id, chunk_no, score, filename, text (original passage)."""
    idx = build(docs, size, overlap, partition_col=partition_col)
    # the top-k table (queries x k rows) feeds both the passage lookup and the
    # final join; writing it once into the shared checkpoint folder scores BM25
    # once and cuts the lineage (a lost executor re-reads it instead of
    # re-scoring).  A parquet write, not Dataset.checkpoint(): on an unpersisted
    # plan that runs the scoring twice (once to count, once to write).
    top = materialize(text_topk(queries, idx, k, partition_col=partition_col), "text-topk")
    texts = chunk_text(idx, top)
    meta = docs.select("doc_id", "source")
    return (attach_source(top.join(texts, ["part", "doc_id", "chunk_no"]), meta)
            .select("query_id", "rank", "doc_id", "chunk_no", "score",
                    F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("source"), F.lit(".md")).alias("filename"),
                    "text"))


def search_report(queries: DataFrame, docs: DataFrame, k: int = K_DEFAULT, base_url: str = DEFAULT_BASE_URL,
                  size: int = 200, overlap: int = 50) -> DataFrame:
    """One row per query with hits: query_id, n_hits, report (cards in rank order)."""
    return render_cards(search_hits(queries, docs, k, size, overlap), base_url, k)
