"""Streams over batches laid out by hand: late rows, repeats, buckets, open lifetimes, event files."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import ingest, responses
from quire.sources import readers
from quire.streaming import harness, stateful, windows

PAIRS = "session_id long, ticker string, key string, ts timestamp, request_id long"
DAY = dt.datetime(2024, 1, 1)


def _feed(spark, base, schema, batches, build, fmt="parquet"):
    """Write the batches one after another; the query drains each from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(f"{base}/in")
        out = build(harness.read_staged(spark, f"{base}/in", spark.createDataFrame([], schema).schema))
        harness.run_available_now(out.writeStream.format("parquet").option("checkpointLocation", f"{base}/ck")
                                  .option("path", f"{base}/out"))
    return spark.read.parquet(f"{base}/out")


def _pair(key, days, request):
    return 1, "T", key, DAY + dt.timedelta(days=days), request


def test_watermark_intake_repeats_and_late_rows(spark, tmp_path):
    """A horizon of two days: a repeat inside is dropped, one outside is loaded again, a row behind the watermark is lost."""
    batches = [[_pair("a", 0, 1), _pair("b", 0, 2)],
               [_pair("a", 1, 3), _pair("c", 1, 4)],                 # a again after one day
               [_pair("x", 20, 5)],                                  # the watermark goes to day 18
               [_pair("a", 21, 6), _pair("late", 3, 7)]]
    got = _feed(spark, str(tmp_path), PAIRS, batches, lambda s: windows.dedupe_within_watermark(s, "2 days")).collect()
    assert sorted((r.key, r.request_id) for r in got) == [("a", 1), ("a", 6), ("b", 2), ("c", 4), ("x", 5)]


def test_ledger_batches_read_their_own_buckets(spark, tmp_path):
    path = str(tmp_path / "ledger")
    body = windows.intake_batch(spark, path)
    rows = [(s, "T", f"k{i}", DAY, s) for s in range(40) for i in range(3)]
    body(spark.createDataFrame(rows, PAIRS), 0)
    again = spark.createDataFrame([(7, "T", "k1", DAY, 1), (7, "T", "new", DAY, 2)], PAIRS)
    body(again, 1)
    ledger = spark.read.parquet(path)
    assert ledger.count() == 121 and ledger.where("key = 'new'").count() == 1
    bucket = F.pmod(F.xxhash64("session_id", "ticker"), F.lit(windows.LEDGER_BUCKETS)).cast("int").alias("bucket")
    own = [r.bucket for r in again.select(bucket).distinct().collect()]
    seen = windows.seen_in_buckets(spark, path, ledger.drop("run", "batch"), own)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in filters
    assert len(seen.inputFiles()) >= len(own) and len({f for f in seen.inputFiles()}) <= len(ledger.inputFiles())
    assert seen.count() < 20


def test_change_stream_equals_batch_with_empty_tickers(spark, tmp_path):
    schema = ("request_id long, session_id long, ts timestamp, ticker string, date_from date, date_to date, "
              "price_sensitive boolean, types array<string>")
    d = dt.date(2024, 1, 1)
    rows = [(i, i % 2, DAY + dt.timedelta(seconds=i), ["", None, "A", "B"][i // 2 % 4], d, d + dt.timedelta(i // 8 % 2), False, [])
            for i in range(64)]
    cols = ["request_id", "session_id", "ticker", "query_hash", "reason"]
    got = _feed(spark, str(tmp_path), schema, [rows[:20], rows[20:21], rows[21:]], stateful.detect_change).select(*cols).collect()
    want = ingest.detect_change(spark.createDataFrame(rows, schema)).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.reason for r in got if not r.ticker} == {ingest.NO_TICKER} and all(r.query_hash is None for r in got if not r.ticker)


def test_change_stream_keeps_a_session_s_tickers_apart(spark, tmp_path):
    """One state for a session: a ticker's change is told from its own last fingerprint, also over null ids."""
    schema = ("request_id long, session_id long, ts timestamp, ticker string, date_from date, date_to date, "
              "price_sensitive boolean, types array<string>")
    d = dt.date(2024, 1, 1)
    rows = [(None if i == 9 else i, None if i % 3 == 2 else 1, DAY + dt.timedelta(seconds=i), "ABC"[i * 7 % 5 % 3], d,
             d + dt.timedelta(i // 6 % 2), False, []) for i in range(40)]
    cols = ["request_id", "session_id", "ticker", "query_hash", "reason"]
    got = _feed(spark, str(tmp_path), schema, [rows[:13], rows[13:14], rows[14:]], stateful.detect_change).select(*cols).collect()
    want = ingest.detect_change(spark.createDataFrame(rows, schema)).select(*cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_change_state_forgets_silent_tickers_alone():
    """With a timeout each ticker of a session has its own: what is silent so long begins anew, the others go on."""
    class State:
        exists, hasTimedOut, get, timer, now = False, False, None, None, 0

        def getCurrentProcessingTimeMs(self):
            return self.now

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutDuration(self, ms):
            self.timer = self.now + ms

    state, calls = State(), []
    step = stateful._change_fn(100)

    def rows(now, *pairs):
        state.now, state.hasTimedOut = now, not pairs
        pdf = pd.DataFrame([(i, 1, t, pd.Timestamp(now + i, unit="ms"), h) for i, (t, h) in enumerate(pairs)],
                           columns=["request_id", "session_id", "ticker", "ts", "query_hash"])
        calls.append([r for out in step((1,), iter([pdf] if pairs else []), state) for r in out["reason"]])

    rows(0, ("A", "x"), ("B", "x"))
    rows(60, ("B", "y"))
    assert state.timer == 100
    rows(110)                                   # A is forgotten, B is not
    assert state.get[0] == ["B"] and state.timer == 160
    rows(120, ("A", "x"), ("B", "y"))
    rows(300)
    assert not state.exists
    assert calls == [[ingest.INITIAL] * 2, [ingest.CHANGED], [], [ingest.INITIAL, ingest.SAME], []]


def test_open_lifetimes_complete_the_closed_ones(spark, tmp_path):
    schema = "ticker string, ts timestamp"
    hours = {"S1": [0, 5, 29, 60, 200, 201], "S2": [3], "S3": [0, 24, 48, 73, 300], "S4": [299]}
    rows = sorted(((t, DAY + dt.timedelta(hours=h)) for t, hs in hours.items() for h in hs), key=lambda r: r[1])
    cut = [[r for r in rows if lo <= (r[1] - DAY).total_seconds() / 3600 < hi] for lo, hi in ((0, 30), (30, 202), (202, 999))]
    closed = _feed(spark, str(tmp_path), schema, cut, windows.store_lifetimes)
    act = spark.createDataFrame(rows, schema)
    both = closed.unionByName(windows.open_lifetimes(act, closed))
    assert 0 < closed.count() < both.count()
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, windows.store_lifetimes(act).collect()))


def test_event_files_through_the_streaming_reader(spark, tmp_path):
    """JSON files in three triggers, events of a finished response coming late."""
    def event(r, seq, kind, delta=None):
        return {"response_id": r, "seq": seq, "type": kind, "delta": delta}

    batches = [[event(1, 2, responses.DELTA, "b"), event(1, 1, responses.DELTA, "a"), event(2, 1, responses.DELTA, "x")],
               [event(1, 3, responses.COMPLETED), event(2, 2, responses.FAILED), event(3, 1, responses.DELTA, "**o**")],
               [event(1, 4, responses.DELTA, "late"), event(2, 0, responses.DELTA, "late"), event(3, 2, responses.DELTA, "$")]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        live = stateful.live_responses(readers.read_response_events(spark, str(tmp_path / "in"), "json", streaming=True))
        harness.run_available_now(live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck"))
                                  .option("path", str(tmp_path / "live")))
    log = spark.read.parquet(str(tmp_path / "live"))
    assert log.columns == readers.RESPONSE_EVENTS_SCHEMA.fieldNames() and log.count() == 7
    got = {r.response_id: (r.answer, r.status) for r in responses.assemble(log).collect()}
    assert got == {1: ("ab", "completed"), 2: ("x" + responses.FAILED_MSG, "failed"), 3: ("`o`\\$", "open")}


def test_staging_spreads_over_files(spark, tmp_path):
    df = spark.range(3000, numPartitions=8).withColumn("o", F.when(F.col("id") != 4, F.col("id")))
    parts = harness.ranges(df, F.col("o"), 3)
    assert [p.count() > 800 for p in parts] == [True] * 3
    tops = [p.agg(F.min("o"), F.max("o")).first() for p in parts]
    assert tops[0][1] < tops[1][0] and tops[1][1] < tops[2][0]
    assert all(p.rdd.getNumPartitions() > 1 for p in parts)


def test_document_files_are_written_by_the_tasks(spark, tmp_path):
    import os
    keys = ["a/b=c%d", "x:\"[1]^{2}\\ ?#*'", "é 1.md", "e\tf", "_g", ".h", "i,j&k~!@$+;<>|()}`"]
    rows = [(k, f"text of {k}\n") for k in keys] + [("r", "s"), ("r", "t"), ("", "no key"), ("n", None)]
    docs = spark.createDataFrame(rows, "key string, text string")
    docs.where("key is not null").write.partitionBy("key").text(str(tmp_path / "spark"))
    path = readers.write_document_files(docs, str(tmp_path / "files"))
    assert sorted(d for d in os.listdir(path)) == sorted(d for d in os.listdir(tmp_path / "spark") if d.startswith("key="))
    assert {n for d in os.listdir(path) for n in os.listdir(os.path.join(path, d))} == {"body.txt"}     # no staged copies, no checksums
    got = {r.key: r.text for r in readers.read_document_files(spark, path, docs).collect()}
    assert got.pop("r") in ("s\nt", "t\ns") and got == {**{k: f"text of {k}\n" for k in keys}, "n": ""}


def test_document_files_by_key(spark, tmp_path):
    rows = [("1_a.md", "one\ntwo\n"), ("2_b/ü %.md", "  "), ("3", None), (None, "lost"), ("4", "")]
    path = readers.write_document_files(spark.createDataFrame(rows, "key string, text string"), str(tmp_path / "files"))
    wanted = spark.createDataFrame([("1_a.md",), ("2_b/ü %.md",), ("3",), ("3",), ("none",), (None,)], "key string")
    got = readers.read_document_files(spark, path, wanted)
    assert sorted(map(tuple, got.collect())) == [("1_a.md", "one\ntwo\n"), ("2_b/ü %.md", "  "), ("3", "")]
