"""Citation operators (FLT-8, WIN-1, AGG-8, JN-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import citation_file_id, document_url, markdown_link

# --- fixed values: reference block layout --------------------------------------
FILES_HEADER = "🔗 Referenced Files:\n"
WEB_HEADER = "🌐 Web Sources:\n"
FILE_LINK_TITLE = "File Link"
# ------------------------------------------------------------------------------
DEFAULT_BASE_URL = "https://files.example.invalid/file/"
ANNOTATION = "response.output_text.annotation.added"


def classify(events: DataFrame) -> DataFrame:
    """FLT-8: ``kind`` = file / web / NULL (dropped later) for annotation events.

    The shape decides, as ``is_object`` says.  Dict form: file_citation with a
    filename -> file, web_citation with a url -> web.  Object form: filename ->
    file, else url -> web, whatever its type.  Rows that do not say are objects
    where they have no type.
    """
    t, fn, url = F.col("ann_type"), F.col("filename"), F.col("url")
    is_object = F.coalesce(F.col("is_object"), t.isNull())
    kind = (F.when(is_object, F.when(fn.isNotNull(), F.lit("file")).when(url.isNotNull(), F.lit("web")))
            .when((t == "file_citation") & fn.isNotNull(), F.lit("file"))
            .when((t == "web_citation") & url.isNotNull(), F.lit("web")))
    return events.where(F.col("type") == ANNOTATION).withColumn("kind", kind)


def dedupe_files(cites: DataFrame) -> DataFrame:
    """WIN-1: first appearance of each file citation per response (min seq, combines map-side)."""
    return (cites.where(F.col("kind") == "file")
            .groupBy("response_id", "filename").agg(F.min("seq").alias("first_seq")))


def _ordered_lines(df: DataFrame, seq_col: str, line, block_seq: int) -> DataFrame:
    """Per response: ``line`` values joined in ``seq`` order (``text``) and their count (``n``).

    Two levels, like answer assembly: lines are sorted and joined per
    (response, seq block), then the block texts per response, so one response
    with very many citations is not sorted line by line in one task.
    """
    blk = F.floor(F.col(seq_col) / F.lit(block_seq)).cast("bigint")
    b = (df.groupBy("response_id", blk.alias("_blk"))
         .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(seq_col), line.alias("line")))),
                                       lambda x: x["line"]), "").alias("_t"),
              F.count(F.lit(1)).alias("_n")))
    return (b.groupBy("response_id")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_blk", "_t"))), lambda x: x["_t"]), "")
                 .alias("text"),
                 F.sum("_n").alias("n")))


def render_block(cites: DataFrame, base_url: str = DEFAULT_BASE_URL, block_seq: int = 4096) -> DataFrame:
    """AGG-8: per response, the reference block text ('' when there is nothing to show).

    File links come from de-duplicated file citations in first-seen order;
    malformed names (< 3 ``_`` pieces) are skipped but still count as "a file
    citation existed", which puts a blank line before the web block.  Web
    citations are not de-duplicated.  Lines are joined in two levels
    (:func:`_ordered_lines`).
    """
    files = dedupe_files(cites).withColumn("fid", citation_file_id(F.col("filename")))
    file_line = F.concat(F.lit(f"- [{FILE_LINK_TITLE}]("), document_url(base_url, F.col("fid")), F.lit(")\n"))
    fl = (_ordered_lines(files.where(F.col("fid").isNotNull()), "first_seq", file_line, block_seq)
          .select("response_id", F.col("text").alias("ftext"), F.col("n").alias("nf")))
    wl = (_ordered_lines(cites.where(F.col("kind") == "web"), "seq", markdown_link(F.col("title"), F.col("url")), block_seq)
          .select("response_id", F.col("text").alias("wtext"), F.col("n").alias("nw")))
    flags = cites.groupBy("response_id").agg(F.max(F.col("kind") == "file").alias("has_file"))
    j = flags.join(fl, "response_id", "left").join(wl, "response_id", "left")
    fpart = F.when(F.col("ftext").isNotNull(), F.concat(F.lit(FILES_HEADER), F.col("ftext"))).otherwise(F.lit(""))
    wpart = F.when(F.col("wtext").isNotNull(), F.concat(
        F.when(F.col("has_file"), F.lit("\n")).otherwise(F.lit("")), F.lit(WEB_HEADER), F.col("wtext"))
    ).otherwise(F.lit(""))
    return j.select("response_id", F.concat(fpart, wpart).alias("citations"),
                    F.coalesce(F.col("nf"), F.lit(0)).cast("bigint").alias("n_file_links"),
                    F.coalesce(F.col("nw"), F.lit(0)).cast("bigint").alias("n_web_links"))


def attach_source(rows: DataFrame, meta: DataFrame, on: str = "doc_id") -> DataFrame:
    """JN-5: left join of document metadata onto hits or citations."""
    return rows.join(meta, on, "left")
