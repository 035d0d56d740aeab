"""Ledgers in cells: no rows for pairs on the way, however a ticker is spread."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import cells, filters, ingest, stats
from quire.plans import refresh

ANN = "ticker string, url string, key string, announcement_types string, date date, is_price_sensitive boolean"
REQ = ("request_id bigint, session_id bigint, ts timestamp, ticker string, date_from date, date_to date, "
       "price_sensitive boolean, types array<string>, ack boolean, needs_update boolean")
TYPES = ["Placement", "Appendix 2A", "Annual Report", None, "Investor Presentation", "Quarterly Cashflow"]
LABELS = [[], ["Placements"], ["Presentations"], ["Unknown label"], None]
DAY = dt.date(2020, 1, 1)


def _tables(spark, seed):
    """Keys of up to eleven rows, a null key, sessions without a name, and rows that come twice."""
    r = random.Random(seed)
    ann = [(r.choice(["A", "A", "B"]), f"u{i}", r.choice([f"k{r.randrange(120)}", f"s{i}", "long", None]), r.choice(TYPES),
            DAY + dt.timedelta(r.randrange(60)), r.choice([True, False, None])) for i in range(260)]
    req = []
    for i in range(150):
        a = DAY + dt.timedelta(r.randrange(-5, 60))
        req.append((i, r.choice([0, 1, 2, None]), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(60)), r.choice(["A", "A", "B", "C"]),
                    a if r.random() > .05 else None, a + dt.timedelta(r.randrange(-3, 30)), r.choice([True, False, None]),
                    r.choice(LABELS), r.choice([True, False, None]), True))
    return spark.createDataFrame(req + req[:20], REQ), spark.createDataFrame(ann + ann[:40], ANN)


def _folds(req, ann):
    """(grow, acked, faithful) as sets of (session, request, key), by going through the requests."""
    keys, order = {}, {}
    for q in filters.match_requests(req, ann).select("request_id", "key").collect():
        keys.setdefault(q.request_id, set()).add(q.key)
    for q in req.collect():
        order[q.session_id, q.ts, q.request_id] = q
    grow, acked, faithful, loaded, sure, state = set(), set(), set(), {}, {}, {}
    for q in sorted(order.values(), key=lambda q: (q.ts, q.request_id)):
        g, n = (q.session_id, q.ticker), keys.get(q.request_id, set())
        had, found = loaded.setdefault(g, set()), sure.setdefault(g, set())
        grow |= {(q.session_id, q.request_id, k) for k in n - had}
        had |= n
        # a session without a name: its acknowledged loads are not found again for the others
        acked |= {(q.session_id, q.request_id, k) for k in (n if q.session_id is None and not q.ack else n - found)}
        if q.ack:
            found |= n
        before = state.setdefault(g, set())
        ship = n - before or n
        state[g] = before | n if n - before else (set(n) or before)
        faithful |= {(q.session_id, q.request_id, k) for k in ship}
    return grow, acked, faithful


@pytest.mark.parametrize("rows, many", [(500_000, 1), (40, 4)])
def test_ledgers_are_the_folds_however_a_ticker_is_spread(spark, monkeypatch, rows, many):
    monkeypatch.setattr(cells, "CELL_ROWS", rows)
    req, ann = _tables(spark, 7)
    for want, how in zip(_folds(req, ann), ({}, {"ack_col": "ack"}, {"mode": "faithful"}), strict=True):
        got = [(r.session_id, r.request_id, r.key) for r in ingest.load_ledger(req, ann, **how).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    grow = _folds(req, ann)[0]
    per = {}
    for _, i, _ in grow:
        per[i] = per.get(i, 0) + 1
    counts = ingest.doc_counts(req, ann).collect()
    assert len(counts) == req.count() and {(r.request_id, r.n_new) for r in counts} == {(i, per.get(i, 0)) for i in range(150)}
    lists = ingest.load_ledger(req, ann, max_keys=3).collect()
    assert {(r.session_id, r.request_id, k) for r in lists for k in r["keys"]} == grow
    by_request = {}
    for r in sorted(lists, key=lambda r: r.batch_no):
        assert r.batch_no == len(by_request.setdefault(r.request_id, [])) and 0 < len(r["keys"]) <= 3
        by_request[r.request_id].append(r["keys"])
    for found in by_request.values():
        flat = [k or "" for x in found for k in x]
        assert flat == sorted(flat) and all(len(x) == 3 for x in found[:-1])


def test_counts_of_a_plan_are_those_of_the_pairs(spark):
    req, ann = _tables(spark, 9)
    once = req.dropDuplicates(["request_id"])
    pairs = filters.match_requests(once, ann).groupBy("request_id").count().collect()
    got = {r.request_id: r.n_matched for r in ingest.new_counts(once, ann).collect()}
    assert len(got) == 150 and {i: n for i, n in got.items() if n} == {r.request_id: r["count"] for r in pairs}


def test_pairs_are_no_rows_of_a_ledger(spark):
    """Requests and announcements are dealt once; nothing that grows with their pairs is joined, shuffled or written."""
    req, ann = _tables(spark, 3)
    found = (ingest.load_ledger(req, ann), ingest.load_ledger(req, ann, ack_col="ack"), ingest.load_ledger(req, ann, mode="faithful"),
             ingest.new_counts(req, ann), ingest.load_ledger(req, ann, max_keys=5))
    found += (stats.type_counts(req, ann), filters.match_requests(req, ann))
    for df in found:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("RepartitionByExpression") == 1 and "MapInArrow" in text
        assert all("shares" in line or "ticker" in line for line in text.splitlines() if "Join" in line)


def test_batches_cut_anywhere(spark):
    """Cells, members and steps of a stream may begin and end inside a batch."""
    req, ann = _tables(spark, 11)
    whole = sorted(map(str, ingest.load_ledger(req, ann).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(str, ingest.load_ledger(req, ann).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_manifests_of_a_plan_are_those_of_its_ledger(spark):
    """Also where a request's number stands in two sessions."""
    req, ann = _tables(spark, 5)
    req, ann = req.drop("needs_update"), ann.where("key is not null")
    for r in (req, req.withColumn("request_id", F.col("request_id") % 70)):
        want = ingest.build_manifests(ingest.load_ledger(r, ann), max_keys=4).collect()
        got = refresh.refresh_manifests(r, ann, max_keys=4).collect()
        assert {(m.request_id, m.batch_no, m.n_keys) for m in got} == {(m.request_id, m.batch_no, m.n_keys) for m in want}
        assert sum(m.n_keys for m in got) == sum(m.n_keys for m in want)


def test_new_and_loaded_keys_meet_as_groups(spark):
    """JN-3 by key group: the same rows as by key, as often as they stand; a key that is null is never loaded."""
    req, ann = _tables(spark, 13)
    old, late = req.where("request_id < 70"), req.where("request_id >= 70")
    names = ["request_id", "session_id", "ticker", "key"]
    want = ingest.incremental_keys(filters.match_requests(late, ann), ingest.load_ledger(old, ann)).select(*names)
    k = ingest.plan_keys(filters.plan_matches(req, ann))
    new = filters.match_requests(late, ann, names[:-1], groups=k)
    left = ingest.incremental_keys(new, ingest.load_ledger(old, ann, groups=k), on=("session_id", "ticker", "kg"))
    got = k.expand(left).select(*names)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("key is null").count()
