"""Response assembly (ST-1 batch twin, AGG-7).

Per response, in ``seq`` order: each delta is cleaned (S-2) and appended;
``failed``/``cancelled`` append their message and stop (later events are
ignored); ``incomplete`` appends its message and goes on; ``completed`` adds
nothing.  Pieces are collected per (response, seq block) and the block texts
per response, so no task sorts all pieces of one long response.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import clean_chunk

# --- fixed values: event types and status messages ---------------------------------
DELTA = "response.output_text.delta"
FAILED = "response.failed"
CANCELLED = "response.cancelled"
INCOMPLETE = "response.incomplete"
COMPLETED = "response.completed"
FAILED_MSG = "Response failed. Please try again."
CANCELLED_MSG = "Response was cancelled"
INCOMPLETE_MSG = "Response was incomplete. Please try again."
# -----------------------------------------------------------------------------------
RECOGNISED = [DELTA, "response.output_text.annotation.added", FAILED, INCOMPLETE, CANCELLED, COMPLETED]


def stops(events: DataFrame) -> DataFrame:
    """First stopping event (failed/cancelled) per response: stop_seq, stop_type."""
    return (events.where(F.col("type").isin(FAILED, CANCELLED))
            .groupBy("response_id")
            .agg(F.min(F.struct("seq", "type")).alias("_s"))
            .select("response_id", F.col("_s.seq").alias("stop_seq"), F.col("_s.type").alias("stop_type")))


def live_events(events: DataFrame) -> DataFrame:
    """Events at or before the stop (all events if the response never stopped)."""
    return (events.join(stops(events), "response_id", "left")
            .where(F.col("stop_seq").isNull() | (F.col("seq") <= F.col("stop_seq"))))


def piece_col() -> Column:
    """The text an event appends to the answer (NULL for events that append nothing)."""
    t = F.col("type")
    return (F.when(t == DELTA, clean_chunk(F.col("delta")))
            .when(t == INCOMPLETE, F.lit(INCOMPLETE_MSG))
            .when(t == FAILED, F.lit(FAILED_MSG))
            .when(t == CANCELLED, F.lit(CANCELLED_MSG)))


def assemble(events: DataFrame, block_seq: int = 4096) -> DataFrame:
    """AGG-7 + ST-1: answer text and status per response, in two aggregation levels.

    Level 1 groups by (response, seq block of ``block_seq`` sequence numbers),
    so a very long response is spread over many tasks: each block sorts only
    its own (seq, piece) pairs and keeps the block's first stop, first
    ``incomplete`` and first ``completed``; its text is cut at its own first
    stop.  Level 2 groups the block rows by response: the response's stop is
    the smallest block stop, and only blocks starting at or before it are
    joined, in block order.  (A block before the stop block holds no stop, so
    its text is whole; the stop block's own cut is the response's cut.)  The
    level-2 group holds one short row per block, not one per event.
    """
    if block_seq < 1:
        raise ValueError("block_seq must be positive")
    t = F.col("type")
    stop_ev = F.when(t.isin(FAILED, CANCELLED), F.struct(F.col("seq"), t.alias("type")))
    piece = piece_col()
    blk = F.floor(F.col("seq") / F.lit(block_seq)).cast("bigint")
    b = events.groupBy("response_id", blk.alias("blk")).agg(
        F.min(stop_ev).alias("stop"),
        F.min(F.when(t == INCOMPLETE, F.col("seq"))).alias("first_inc"),
        F.min(F.when(t == COMPLETED, F.col("seq"))).alias("first_done"),
        F.array_sort(F.collect_list(F.when(piece.isNotNull(), F.struct(F.col("seq"), piece.alias("p"))))).alias("parts"))
    bstop = F.col("stop.seq")
    btext = F.array_join(F.transform(F.filter("parts", lambda x: bstop.isNull() | (x["seq"] <= bstop)),
                                     lambda x: x["p"]), "")
    blocks = b.select("response_id", "blk", "stop", "first_inc", "first_done", btext.alias("text"))
    g = blocks.groupBy("response_id").agg(
        F.min("stop").alias("stop"),
        F.min("first_inc").alias("first_inc"),
        F.min("first_done").alias("first_done"),
        F.array_sort(F.collect_list(F.struct("blk", "text"))).alias("blocks"))
    stop_seq = F.col("stop.seq")

    def live(c):
        return stop_seq.isNull() | (c <= stop_seq)

    stop_blk = F.floor(stop_seq / F.lit(block_seq))
    answer = F.array_join(F.transform(F.filter("blocks", lambda x: stop_seq.isNull() | (x["blk"] <= stop_blk)),
                                      lambda x: x["text"]), "")
    status = (F.when(F.col("stop.type") == FAILED, F.lit("failed"))
              .when(F.col("stop.type") == CANCELLED, F.lit("cancelled"))
              .when(F.col("first_inc").isNotNull() & live(F.col("first_inc")), F.lit("incomplete"))
              .when(F.col("first_done").isNotNull() & live(F.col("first_done")), F.lit("completed"))
              .otherwise(F.lit("open")))
    return g.select("response_id", answer.alias("answer"), status.alias("status"))
