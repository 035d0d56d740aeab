"""Change detection, load ledger (grow / faithful), increments and manifests."""

import datetime as dt

from pyspark.sql import functions as F

from quire.operators import filters, ingest

ANN_SCHEMA = "ticker string, url string, key string, announcement_types string, date date, is_price_sensitive boolean"
REQ_SCHEMA = ("request_id bigint, session_id bigint, ts timestamp, ticker string, date_from date, date_to date, "
              "price_sensitive boolean, types array<string>")


def _ann(spark):
    rows = [("T", "u1", "1", "Placement", dt.date(2020, 1, 1), True),
            ("T", "u2", "2", "Placement", dt.date(2020, 2, 1), False),
            ("T", "u3", "3", "Annual Report", dt.date(2020, 3, 1), False)]
    return spark.createDataFrame(rows, ANN_SCHEMA)


def _req(spark, windows, ticker="T"):
    rows = []
    for i, (a, b) in enumerate(windows):
        rows.append((i + 1, 1, dt.datetime(2024, 1, 1, 0, 0, i), ticker, a, b, False, []))
    return spark.createDataFrame(rows, REQ_SCHEMA)


def test_change_reasons(spark):
    d = dt.date
    w = [(d(2020, 1, 1), d(2020, 12, 31)), (d(2020, 1, 1), d(2020, 12, 31)),
         (d(2020, 1, 1), d(2020, 6, 30)), (d(2020, 1, 1), d(2020, 12, 31))]
    got = [r.reason for r in ingest.detect_change(_req(spark, w)).orderBy("request_id").collect()]
    assert got == ["Initial setup", "No changes", "Query changed", "Query changed"]


def test_no_ticker(spark):
    d = dt.date
    r = _req(spark, [(d(2020, 1, 1), d(2020, 12, 31))], ticker=None)
    assert ingest.detect_change(r).first().reason == "No ticker selected"


def _ledger_golden(spark, mode):
    d = dt.date
    # N1 = {1,2,3}, N2 = {1}, N3 = {1,2}
    w = [(d(2020, 1, 1), d(2020, 12, 31)), (d(2020, 1, 1), d(2020, 1, 15)), (d(2020, 1, 1), d(2020, 2, 15))]
    led = ingest.load_ledger(_req(spark, w), _ann(spark), mode=mode)
    out = {}
    for r in led.collect():
        out.setdefault(r.request_id, set()).add(r.key)
    return out


def test_ledger_grow_golden(spark):
    assert _ledger_golden(spark, "grow") == {1: {"1", "2", "3"}}


def test_ledger_faithful_golden(spark):
    assert _ledger_golden(spark, "faithful") == {1: {"1", "2", "3"}, 2: {"1"}, 3: {"2"}}


def test_faithful_matches_python_fold(spark):
    """Faithful ledger on the sf0.001 fixture vs a plain sequential fold over brute-force matches."""
    from quire.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    req = ingest.detect_change(fx.requests(spark, sf))
    ann = fx.announcements(spark, sf)
    got = {(r.request_id, r.key) for r in ingest.load_ledger(req, ann, mode="faithful").collect()}
    changed = req.where("needs_update").orderBy("session_id", "ticker", "ts", "request_id").collect()
    pairs = filters.match_requests(req.where("needs_update"), ann).select("request_id", "key").collect()
    matched = {}
    for p in pairs:
        matched.setdefault(p.request_id, set()).add(p.key)
    want, state = set(), {}
    for r in changed:
        g = (r.session_id, r.ticker)
        loaded = state.get(g, set())
        n = matched.get(r.request_id, set())
        inc = n - loaded
        if inc:
            ship, loaded = inc, loaded | inc
        elif n:
            ship, loaded = n, set(n)
        else:
            ship = set()
        state[g] = loaded
        want |= {(r.request_id, k) for k in ship}
    assert got == want


def test_ledger_invariants(spark):
    from quire.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    led = ingest.load_ledger(fx.requests(spark, sf), fx.announcements(spark, sf))
    assert led.groupBy("session_id", "ticker", "key").count().where("count > 1").count() == 0


def test_incremental_keys_disjoint(spark):
    new = spark.createDataFrame([(1, "T", "a"), (1, "T", "b"), (1, "T", "b")], "session_id long, ticker string, key string")
    loaded = spark.createDataFrame([(1, "T", "a")], "session_id long, ticker string, key string")
    out = ingest.incremental_keys(new, loaded)
    assert sorted(r.key for r in out.collect()) == ["b", "b"]        # bag semantics kept
    assert out.join(loaded, ["session_id", "ticker", "key"]).count() == 0


def test_manifests_number_keys_in_order(spark):
    """One numbering at every size: ceil(n / max_keys) manifests, key-ordered, also for a large group."""
    rows = spark.range(25_000).selectExpr("cast(1 as long) session_id", "'T' ticker",
                                          "concat('k', lpad(cast(id as string), 6, '0')) key", "cast(7 as long) request_id")
    m = sorted(ingest.build_manifests(rows, max_keys=1000).collect(), key=lambda r: r.batch_no)
    assert [r.batch_no for r in m] == list(range(25)) and all(r.n_keys == 1000 for r in m)
    import json
    keys = [k for r in m for k in json.loads(r.payload)["Records"][0]["s3"]["object"]["keys"]]
    assert keys == [f"k{i:06d}" for i in range(25_000)]


def test_a_key_in_several_rows_is_one_key(spark):
    """k1 stands in two rows of different date: it is shipped once, and counted once."""
    d = dt.date
    ann = _ann(spark)
    again = ann.where("key = '1'").withColumn("date", F.lit(d(2020, 2, 10)))
    ann = ann.unionByName(again)
    req = _req(spark, [(d(2020, 1, 1), d(2020, 1, 15)), (d(2020, 1, 1), d(2020, 12, 31))])
    for mode in ("grow", "faithful"):
        got = sorted((r.key, r.request_id) for r in ingest.load_ledger(req, ann, mode=mode).collect())
        assert len(got) == len({k for k, _ in got}) and ("1", 1) in got
    counts = {r.request_id: r.n_new for r in ingest.doc_counts(req, ann).collect()}
    assert sum(counts.values()) == ann.select("key").distinct().count()


def test_empty_ticker_is_no_ticker(spark):
    d = dt.date
    req = _req(spark, [(d(2020, 1, 1), d(2020, 1, 15))]).withColumn("ticker", F.lit(""))
    row = ingest.detect_change(req).first()
    assert row.reason == ingest.NO_TICKER and not row.needs_update and row.query_hash is None


def test_ledger_ack_golden(spark):
    """Unacknowledged shipments stay unloaded: N1={1,2,3} (not acked), N2={1} (acked), N3={1,2}."""
    d = dt.date
    w = [(d(2020, 1, 1), d(2020, 12, 31)), (d(2020, 1, 1), d(2020, 1, 15)), (d(2020, 1, 1), d(2020, 2, 15))]
    req = _req(spark, w).withColumn("ack", F.col("request_id") != 1)
    out = {}
    for r in ingest.load_ledger(req, _ann(spark), mode="grow", ack_col="ack").collect():
        out.setdefault(r.request_id, set()).add(r.key)
    assert out == {1: {"1", "2", "3"}, 2: {"1"}, 3: {"2"}}
