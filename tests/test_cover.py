"""Windows as pieces: covers, bounded matching, and the ledgers built on them."""

import datetime as dt
import random

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import filters, ingest, stats
from quire.operators.cover import FANOUT, LEVELS, cover, holders, levels_for

ANN = "ticker string, url string, key string, announcement_types string, date date, is_price_sensitive boolean"
REQ = ("request_id bigint, session_id bigint, ts timestamp, ticker string, date_from date, date_to date, "
       "price_sensitive boolean, types array<string>, ack boolean")
TYPES = ["Placement", "Appendix 2A", "Annual Report", None, "Investor Presentation", "Quarterly Cashflow"]
LABELS = [[], ["Placements"], ["Presentations", "Unknown label"], ["Unknown label"], ["Cashflow Reports"], None]


def test_every_segment_of_a_window_lies_in_exactly_one_piece(spark):
    top = FANOUT ** (LEVELS - 1)
    windows = [(a, b) for a in range(0, 40) for b in range(a - 1, 40)] + [
        (0, 3 * top), (5, 3 * top + 7), (top - 1, top + 1), (top, 2 * top), (12345, 54321)]
    rows = (spark.createDataFrame(windows, "a int, b int")
            .select("a", "b", cover(F.col("a"), F.col("b")).alias("p")).collect())
    for r in rows:
        spans = sorted((x.ix * FANOUT ** x.lv, (x.ix + 1) * FANOUT ** x.lv) for x in r.p)
        at = r.a
        for low, high in spans:
            assert low == at
            at = high
        assert at == max(r.a, r.b)
        assert len(spans) <= 6 * LEVELS + max(0, r.b - r.a) // top


def test_fewer_levels_cover_as_well(spark):
    assert [levels_for(n) for n in (1, 3, 4, 15, 16, 10**9)] == [1, 1, 2, 2, 3, LEVELS]
    rows = spark.createDataFrame([(a, b) for a in range(20) for b in range(20)], "a int, b int")
    for r in rows.select("a", "b", cover(F.col("a"), F.col("b"), 2).alias("p")).collect():
        assert sorted(q for x in r.p for q in range(x.ix * FANOUT ** x.lv, (x.ix + 1) * FANOUT ** x.lv)) == list(range(r.a, r.b))


def test_holders_are_the_pieces_above_a_segment(spark):
    for r in spark.range(0, 70000, 997).select("id", holders(F.col("id")).alias("h")).collect():
        assert [(x.lv, x.ix) for x in r.h] == [(lv, r.id // FANOUT ** lv) for lv in range(LEVELS)]


def _tables(spark, seed, n_req=160, n_ann=220, days=400, tickers=("A", "B")):
    r = random.Random(seed)
    day = dt.date(2020, 1, 1)
    ann = [(r.choice(tickers), f"u{i}", f"k{r.randrange(n_ann)}", r.choice(TYPES),
            day + dt.timedelta(r.randrange(days)) if r.random() > .02 else None, r.choice([True, False, None])) for i in range(n_ann)]
    req = []
    for i in range(n_req):
        a = day + dt.timedelta(r.randrange(-20, days))
        req.append((i, r.randrange(3), dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randrange(n_req)), r.choice([*tickers, "C", None, ""]),
                    a if r.random() > .03 else None, a + dt.timedelta(r.randrange(-5, 365)), r.choice([True, False, None]),
                    r.choice(LABELS), r.choice([True, False, None])))
    return spark.createDataFrame(req, REQ), spark.createDataFrame(ann, ANN)


def _matched(requests, announcements):
    import re
    from quire.functions.taxonomy import TAXONOMY
    patterns = dict(TAXONOMY)
    out = []
    for q in requests:
        known = [patterns[t] for t in q.types or [] if t in patterns]
        for a in announcements:
            if (q.ticker == a.ticker and a.date and q.date_from and q.date_to and q.date_from <= a.date <= q.date_to
                    and (not q.price_sensitive or a.is_price_sensitive)
                    and (not known or any(a.announcement_types and re.search(p, a.announcement_types, re.I) for p in known))):
                out.append((q, a))
    return out


def test_matching_against_all_pairs(spark):
    for seed in (1, 2):
        req, ann = _tables(spark, seed)
        want = _matched(req.collect(), ann.collect())
        got = filters.match_requests(req, ann).select("request_id", "url").collect()
        assert sorted(map(tuple, got)) == sorted((q.request_id, a.url) for q, a in want)
        counts = {}
        for q, a in want:
            counts[q.request_id, a.announcement_types] = counts.get((q.request_id, a.announcement_types), 0) + 1
        got = {(r.request_id, r.announcement_types): r.n for r in stats.type_counts(req, ann).collect()}
        assert got == counts


def test_ledgers_against_a_fold(spark):
    req, ann = _tables(spark, 3)
    changed = ingest.detect_change(req).where("needs_update")
    keys = {}
    for q, a in _matched(changed.collect(), ann.collect()):
        keys.setdefault(q.request_id, set()).add(a.key)
    ordered = sorted(changed.collect(), key=lambda r: (r.ts, r.request_id))
    for scope in ("session", "store"):
        first, attempts, faithful, loaded, acked, state = set(), set(), set(), {}, {}, {}
        for q in ordered:
            g = (q.session_id, q.ticker) if scope == "session" else q.ticker
            n = keys.get(q.request_id, set())
            first |= {(q.request_id, k) for k in n - loaded.setdefault(g, set())}
            loaded[g] |= n
            attempts |= {(q.request_id, k) for k in n - acked.setdefault(g, set())}
            if q.ack:
                acked[g] |= n
            had = state.setdefault(g, set())
            ship = n - had or n
            state[g] = had | n if n - had else (set(n) or had)
            faithful |= {(q.request_id, k) for k in ship}
        for want, how in ((first, {}), (attempts, {"ack_col": "ack"}), (faithful, {"mode": "faithful"})):
            got = [(r.request_id, r.key) for r in ingest.load_ledger(req, ann, scope=scope, **how).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_matching_is_bounded_by_specs_not_by_pairs(spark):
    """1,500 different windows of one ticker over 1,500 days with three announcements each: about 1.7 million pairs."""
    day = dt.date(2020, 1, 1)
    r = random.Random(4)
    req = spark.createDataFrame([(i, i % 7, dt.datetime(2024, 1, 1), "T", day + dt.timedelta(a := r.randrange(1400)),
                                  day + dt.timedelta(a + r.randrange(30, 900)), False, [], True) for i in range(1500)], REQ)
    ann = spark.createDataFrame([("T", "u", f"k{i}", "Placement", day + dt.timedelta(i % 1500), False) for i in range(4500)], ANN)
    plan = filters.plan_matches(req, ann)
    n_specs = plan.specs.count()
    pieces = plan.spec_pieces().count()
    assert n_specs > 1400 and pieces <= 30 * n_specs
    met = plan.spec_pieces().join(filters.with_pieces(plan.classes()).groupBy(*filters.MEET, "aps", "amask").agg(F.sum("n").alias("n")),
                                  filters.MEET).count()
    pairs = plan.spec_class.agg(F.sum("n")).first()[0]
    assert met <= pieces and pairs > 50 * met       # one kind of announcement: a row for every piece at most
    # the ledger meets key groups once per level and session, not once per request
    keys = ingest.plan_keys(plan)
    covered = keys.in_pieces(filters.with_spec(req)).select("session_id", *filters.MEET).distinct()
    assert covered.join(keys.pieces, filters.MEET).count() <= 7 * LEVELS * keys.groups.count()


def test_no_join_on_the_ticker_alone(spark):
    req, ann = _tables(spark, 5, 20, 30)
    p = filters.plan_matches(req, ann)
    for df in (p.spec_class, p.counts("announcement_types")):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        joins = [line for line in text.splitlines() if "Join Inner" in line]
        assert joins and all("lv#" in line and "ix#" in line for line in joins)


def test_the_faithful_fold_is_a_stream(monkeypatch):
    """One session with half of all requests: rows leave while later batches have not been asked for."""
    monkeypatch.setattr(ingest, "_OUT_ROWS", 400)
    schema = pa.schema([("session_id", pa.int64()), ("ts", pa.int64()), ("request_id", pa.int64()), ("kg", pa.string())])
    asked = 0

    def batches():
        nonlocal asked
        for i in range(400):
            asked += 1
            rows = [(1 if i < 200 else i, i, i, f"g{(i * 7 + k) % 1000}") for k in range(500)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    seen, first = [], None
    for out in ingest.fold_faithful(batches(), 1, schema):
        first = asked if first is None else first
        seen += [tuple(r.values()) for r in out.to_pylist()]
        assert out.num_rows < ingest._OUT_ROWS + 501
    assert first <= 3
    loaded, group, want = set(), None, set()
    for i in range(400):
        g = 1 if i < 200 else i
        if g != group:
            group, loaded = g, set()
        n = {f"g{(i * 7 + k) % 1000}" for k in range(500)}
        ship = n - loaded or n
        loaded = loaded | n if n - loaded else set(n)
        want |= {(g, i, i, k) for k in ship}
    assert len(seen) == len(set(seen)) and set(seen) == want
