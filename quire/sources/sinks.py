"""Sinks: the conversation log (SNK-1).

The log is append-only.  Records are nested; the sink flattens them to the 18
log columns in their fixed order.  Arrays are written as JSON text (Spark CSV
rejects arrays; parquet keeps the same representation so both formats agree).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import list_cell

# --- fixed values: log column order ------------------------------------------------------
LOG_COLUMNS = [
    "session_id", "user_id", "user_email", "vector_store_id",
    "num_of_docs", "s3_keys", "ticker", "announcement_types",
    "price_sensitive", "date_from", "date_to", "date_range",
    "message_text", "assistant_response", "message_timestamp",
    "chat_model", "chat_mode", "tokens_used",
]
# -------------------------------------------------------------------------------------------


def flatten_records(records: DataFrame) -> DataFrame:
    """S-15: nested record -> 18 flat columns, in log order."""
    c = F.col
    return records.select(
        c("session_id"), c("user.user_id").alias("user_id"), c("user.user_email").alias("user_email"),
        c("vector_store.vs_id").alias("vector_store_id"), c("vector_store.num_of_docs").alias("num_of_docs"),
        list_cell(c("vector_store.s3_keys")).alias("s3_keys"), c("query.selected_ticker").alias("ticker"),
        list_cell(c("query.announcement_types")).alias("announcement_types"),
        c("query.price_sensitive").alias("price_sensitive"), c("query.date_from").alias("date_from"),
        c("query.date_to").alias("date_to"), c("query.date_range").cast("bigint").alias("date_range"),
        c("message.message_text").alias("message_text"), c("message.assistant_response").alias("assistant_response"),
        c("message.message_timestamp").alias("message_timestamp"),
        c("chat_settings.chat_model").alias("chat_model"), c("chat_settings.chat_mode").alias("chat_mode"),
        c("chat_settings.tokens_used").alias("tokens_used"),
    )


def append_conversation_log(records: DataFrame, path: str, fmt: str = "parquet") -> str:
    """SNK-1: append flattened records; parquet partitioned by ``log_date``, or CSV with a header per part file."""
    write_log(with_log_date(flatten_records(records)), path, fmt)
    return path


def with_log_date(flat: DataFrame) -> DataFrame:
    return flat.withColumn("log_date", F.substring("message_timestamp", 1, 10))


def write_log(flat: DataFrame, path: str, fmt: str) -> None:
    """Append flattened records with their ``log_date``."""
    w = flat.write.mode("append").partitionBy("log_date")
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        raise ValueError(f"unsupported format {fmt}")


def read_conversation_log(spark, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*LOG_COLUMNS)
