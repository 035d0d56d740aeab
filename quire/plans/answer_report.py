"""R-6 answer report: response events -> assembled answer -> citations -> confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import below_threshold, confidence_band, parse_confidence, parse_sources
from quire.operators.citations import DEFAULT_BASE_URL, classify, render_block
from quire.operators.responses import assemble


def answer_report(events: DataFrame, base_url: str = DEFAULT_BASE_URL, threshold: float = 0.7) -> DataFrame:
    """One row per response: status, answer text, reference block and confidence fields.

    A stopped (failed/cancelled) response shows no citations (NULL), rather
    than repeating the previous answer's (fixes Q6); a finished response
    without annotations shows ''.
    """
    answers = assemble(events)
    blocks = render_block(classify(events), base_url)
    stopped = F.col("status").isin("failed", "cancelled")
    conf = F.col("confidence")
    return (answers.join(blocks, "response_id", "left")
            .select("response_id", "status", "answer",
                    F.when(stopped, F.lit(None).cast("string")).otherwise(F.coalesce(F.col("citations"), F.lit("")))
                    .alias("citations"),
                    parse_confidence(F.col("answer")).alias("confidence"),
                    F.array_join(parse_sources(F.col("answer")), " | ").alias("sources"))
            .select("*", confidence_band(conf).alias("confidence_band"),
                    below_threshold(conf, threshold).alias("search_web")))
