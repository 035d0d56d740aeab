"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``docs`` as they came, extra ones
included, in any order of rows.  Between stages the documents are written as
Parquet and read again.  Defined results: a null text fails the quality rules;
a null id is never a duplicate; an empty table passes every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, minmax_dedup, quality, secret_scan
from quire.llm.common import bounded_batches, free_name
from quire.session import materialize, scratch_path
from quire.sources.tables import read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the base rules or the certified cutoffs reject go."""
    bounded_batches(spark)
    measured = materialize(quality.measure_documents(docs), "measures")
    thresholds = quality.fit(measured, read_table(spark, sf_dir, "labels", ["doc_id", "quality"]))
    m = free_name(docs, "quality_measures")
    return (docs.withColumn(m, quality.measures("text"))
            .where(~quality.base_failed(m) & ~thresholds.rejects(F.coalesce("lang", F.lit(quality.POOLED)), m))
            .drop(m))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: the document of least id of each group stays."""
    found = minmax_dedup.near_duplicates(docs).where("doc_id is not null")
    name = free_name(docs, "dropped_id")
    dropped = found.groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("kept")).where("not kept")
    return docs.join(dropped.select(name).hint("merge"), docs["doc_id"] == F.col(name), "left_anti")


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination: documents that hold a benchmark item go."""
    return decontam.without_contaminated(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every span is replaced by a mark, and n_chars follows the text."""
    formats = secret_scan.fit(docs)
    name = free_name(docs, "secrets")
    out = secret_scan.scan(docs, formats, redacted=True, out_col=name).withColumn("text", F.col(f"{name}.redacted"))
    if "n_chars" in docs.columns:
        changed = F.col(f"{name}.spans") != ""
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text (packed 32-bit integers), their number, and digests of ids and decoded text."""
    both = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return both.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", keep_good),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", remove_benchmarks),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode),
]

#: SQL cannot express the certified cutoffs, the inferred formats or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = scratch_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
