"""Citation shapes, searches within a store, and state that ends."""


import pandas as pd
from pyspark.sql import functions as F

from quire.operators import citations, index, search
from quire.sources.readers import RESPONSE_EVENTS_SCHEMA
from quire.streaming import stateful


def test_annotation_shape_decides(spark):
    ann = citations.ANNOTATION
    rows = [(1, 1, ann, None, "url_citation", None, "u", None, True), (1, 2, ann, None, "url_citation", None, "u", None, False),
            (1, 3, ann, None, "anything", "f", "u", None, True), (1, 4, ann, None, "file_citation", "f", None, None, False),
            (1, 5, ann, None, None, None, "u", None, None)]
    got = citations.classify(spark.createDataFrame(rows, RESPONSE_EVENTS_SCHEMA)).orderBy("seq").collect()
    assert [r.kind for r in got] == ["web", None, "file", "file", "web"]


def test_vectors_within_their_store(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0]), (4, "b", [1.0, 0.1]), (5, "c", [1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, store string, embedding array<float>")
    got = search.vector_topk(v.withColumnRenamed("vec_id", "query_id"), v, 2, exclude_self=True, partition_col="store").collect()
    assert sorted((r.store, r.query_id, r.vec_id) for r in got) == [("a", 1, 2), ("a", 2, 1), ("b", 3, 4), ("b", 4, 3)]


def test_canned_questions_per_store(spark):
    docs = spark.createDataFrame([(1, "main asset", "007"), (2, "main asset", "7"), (3, "nothing", "7")],
                                 "doc_id long, text string, ticker string")
    asked = search.canned_queries(spark, docs.select("ticker"))
    assert asked.count() == 2 * len(search.CANNED_QUESTIONS)
    top = search.text_topk(asked, index.build(docs, partition_col="ticker"), 5, partition_col="ticker")
    assert {(r.part, r.doc_id) for r in top.where(F.col("query_id") == 0).collect()} == {("007", 1), ("7", 2)}


class _State:
    def __init__(self):
        self.value, self.hasTimedOut, self.duration = None, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.duration = ms


def _events(*rows):
    return iter([pd.DataFrame(rows, columns=["seq", "type", "delta"])])


def test_response_state_ends_with_the_response():
    fn, _ = stateful._with_timeout(stateful._live_fn, None)
    st = _State()
    out = list(fn((1,), _events((1, "d", "a"), (2, stateful.COMPLETED, None)), st))
    assert [len(x) for x in out] == [2] and st.value == (True,)
    assert list(fn((1,), _events((3, "d", "late")), st)) == []


def test_open_response_has_no_state():
    """100,000 events in 50 batches: each is passed on once, and nothing is kept of them."""
    fn, _ = stateful._with_timeout(stateful._live_fn, None)
    st, passed = _State(), 0
    for b in range(50):
        passed += sum(len(x) for x in fn((1,), _events(*((2000 * b + i, "d", "a") for i in range(2000))), st))
        assert not st.exists
    assert passed == 100_000


def test_silent_state_times_out():
    fn, kind = stateful._with_timeout(stateful._live_fn, "1 hour")
    st = _State()
    list(fn((1,), _events((1, stateful.FAILED, None)), st))
    assert st.duration == 3_600_000 and st.exists and "ProcessingTime" in kind
    st.hasTimedOut = True
    assert list(fn((1,), iter([]), st)) == [] and not st.exists
