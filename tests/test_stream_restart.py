"""Streams started again on a new checkpoint: nothing is lost and nothing is loaded twice."""

import pytest
from pyspark.sql import functions as F

from quire.sources import fixtures as fx
from quire.sources import sinks
from quire.streaming import windows

SF = "/root/testdata/sf0.001"


def test_ledger_survives_a_new_checkpoint(spark, tmp_path):
    schema = "session_id long, ticker string, key string, ts string, request_id long"
    a, b, c = (spark.createDataFrame([(1, "T", k, "2024", n)], schema) for n, k in enumerate("abc"))
    path = str(tmp_path / "ledger")
    first = windows.intake_batch(spark, path)
    first(a, 0)
    first(b, 1)
    first(b, 1)                                   # a replay
    second = windows.intake_batch(spark, path)    # a new query, batch ids from 0
    second(b.unionByName(c), 0)
    assert sorted(r.key for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]


def test_log_is_idempotent_and_has_one_layout(spark, tmp_path):
    records = fx.conversation_records(spark, SF)
    n = records.select("session_id", F.col("message.message_timestamp")).distinct().count()
    path = str(tmp_path / "log")
    sinks.append_conversation_log(records.limit(5), path)
    for _ in range(2):
        windows.log_batch(path)(records, 0)
    assert sinks.read_conversation_log(spark, path).count() == n


def test_csv_log_round_trip(spark, tmp_path):
    records = fx.conversation_records(spark, SF)
    path = sinks.append_conversation_log(records, str(tmp_path / "csv"), "csv")
    assert sinks.read_conversation_log(spark, path, "csv").columns == sinks.LOG_COLUMNS


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_log_keeps_different_records_of_one_timestamp(spark, tmp_path, fmt):
    one = fx.conversation_records(spark, SF).limit(1).checkpoint()

    def record(text, ts):
        return one.withColumn("message", F.struct(F.lit(text).alias("message_text"),
                                                  F.lit(ts).cast("string").alias("message_timestamp"),
                                                  F.lit(" an answer").alias("assistant_response")))

    def batch(*rows):
        out = record(*rows[0])
        for r in rows[1:]:
            out = out.unionByName(record(*r))
        return out

    first = batch(("a", "2024-01-01 00:00:01"), ("b", "2024-01-01 00:00:01"), ("c", None), ("d", None), ("d", None))
    path = str(tmp_path / "log")
    body = windows.log_batch(path, fmt)
    body(first, 0)
    body(first, 0)                                                     # a replay
    windows.log_batch(path, fmt)(first.unionByName(record("e", "2024-01-01 00:00:01")), 0)
    got = [r.message_text for r in sinks.read_conversation_log(spark, path, fmt).collect()]
    assert sorted(got) == ["a", "b", "c", "d", "d", "e"]


def test_long_conversations_repeat_no_timestamp(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t}") for t in range(1, 261)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = fx.conversation_records(spark, str(tmp_path)).select("message.message_timestamp").collect()
    assert len(got) == len({r.message_timestamp for r in got}) > 100
