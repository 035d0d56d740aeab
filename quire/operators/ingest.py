"""Document ingest planning: change detection, load ledger, increments, manifests.

WIN-4  detect_change     per (session, ticker) fingerprint vs the previous one
WIN-7  load_ledger       which request first ships each document
JN-3   incremental_keys  new keys minus already loaded keys (bag semantics)
AGG-2  doc_counts        new documents per changed request
SNK-2  build_manifests   bounded JSON manifests of keys per shipping request
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.hashing import query_hash
from quire.functions.text import store_name
from quire.operators import cells
from quire.operators.cover import cover
from quire.operators.filters import (
    CLASS, MEET, SPEC, MatchPlan, expand_classes, matching, with_pieces, with_spec,
)
from quire.operators.scan import ordered_scan
from quire.session import materialize

INITIAL, CHANGED, SAME, NO_TICKER = "Initial setup", "Query changed", "No changes", "No ticker selected"
_ORDER = ["ts", "request_id"]
KEYS = ["ticker", "kg"]
NO_KEY = "null"         # the key group of announcements without a key
_OUT_ROWS = 16384       # shipped rows in an Arrow batch that leaves the fold


def detect_change(requests: DataFrame, split: bool = True) -> DataFrame:
    """WIN-4: add ``query_hash``, ``reason`` and ``needs_update``.

    The previous fingerprint is the one of the previous request of the same
    (session, ticker), ordered by (ts, request_id); A -> B -> A is two changes.
    A null or empty ticker has no fingerprint and never needs an update.
    Scale: an ordered scan per (session, ticker), split into range pieces (:func:`quire.operators.scan.ordered_scan`).
    """
    h = query_hash(F.col("ticker"), F.col("date_from"), F.col("date_to"), F.col("types"),
                   F.col("price_sensitive"))
    has_ticker = F.coalesce(F.col("ticker"), F.lit("")) != ""       # an empty ticker is no ticker
    out = requests.withColumn("query_hash", F.when(has_ticker, h))
    out = ordered_scan(out, ["session_id", "ticker"], _ORDER, prev={"_prev_hash": "query_hash"}, split=split)
    prev = F.col("_prev_hash")
    reason = (F.when(~has_ticker, F.lit(NO_TICKER))
              .when(prev.isNull(), F.lit(INITIAL))
              .when(F.col("query_hash") != prev, F.lit(CHANGED))
              .otherwise(F.lit(SAME)))
    return (out.withColumn("reason", reason)
            .withColumn("needs_update", F.col("reason").isin(INITIAL, CHANGED))
            .drop("_prev_hash"))


def incremental_keys(new: DataFrame, loaded: DataFrame, on=("session_id", "ticker", "key")) -> DataFrame:
    """JN-3: rows of ``new`` whose key is not in ``loaded``; duplicates in ``new`` are kept.

    ``left_anti`` (not ``exceptAll``) gives the list-comprehension semantics.
    """
    return new.join(loaded.select(*on).distinct(), list(on), "left_anti")


def _group_cols(scope: str) -> list:
    if scope == "session":
        return ["session_id", "ticker"]
    if scope == "store":
        return ["ticker"]
    raise ValueError("scope must be 'session' or 'store'")


def _changed(requests: DataFrame) -> DataFrame:
    cols = requests.columns
    src = requests if "needs_update" in cols else detect_change(requests)
    return src.where(F.col("needs_update"))


@dataclass
class KeyPlan:
    """What a request ships is keys, and a key may stand in several announcement rows.

    Keys whose rows fall into the same classes form a *key group*; a spec
    matches all keys of a group or none.  ``keys``: (ticker, kg, key), one row
    per key; ``groups``: (ticker, kg, n), the keys of each group; ``pieces``: a row
    for every piece that holds a class of the group, (ticker, piece, aps, amask, kg).
    """

    keys: DataFrame
    groups: DataFrame
    pieces: DataFrame
    plan: MatchPlan
    rows: DataFrame         # (ticker, kg, seg, aps, amask, key): one row per announcement

    def matches(self, requests: DataFrame) -> DataFrame:
        """JN-2 by key group: the columns of requests, and each (kg, class) they match once; :meth:`expand` gives its rows."""
        held = self.rows.select("ticker", "kg", *CLASS[1:]).distinct()
        return with_spec(requests).join(self.plan.spec_class.drop("n"), SPEC).join(held, CLASS).select(*requests.columns, "kg", *CLASS[1:])

    def expand(self, matched: DataFrame) -> DataFrame:
        """A row for every announcement of each (kg, class), with its ``key``."""
        sizes = self.rows.groupBy("ticker", "kg", *CLASS[1:]).agg(F.count(F.lit(1)).alias("n"))
        return expand_classes(matched, self.rows, sizes, on=["ticker", "kg", *CLASS[1:]])

    def spec_groups(self) -> DataFrame:
        """SPEC + kg: the key groups each spec matches, each once."""
        return (self.plan.spec_pieces().join(self.pieces, MEET).where(matching())
                .select(*SPEC, "kg").distinct())

    def in_pieces(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with SPEC) copied to the pieces of their windows."""
        return rows.join(self.plan.specs, SPEC).select(*rows.columns, F.inline(cover(F.col("seg_from"), F.col("seg_end"), self.plan.levels)))


def plan_keys(p: MatchPlan) -> KeyPlan:
    """Key groups of a match plan; the class set of a key is bounded by its own rows."""
    cls = F.struct("seg", "aps", "amask")
    sets = (p.ann.select("ticker", "key", cls.alias("cls")).groupBy("ticker", "key")
            .agg(F.sort_array(F.collect_set("cls")).alias("classes"), F.collect_list("cls").alias("rows")))
    name = F.when(F.col("key").isNotNull(), F.md5(F.to_json("classes"))).otherwise(F.lit(NO_KEY))
    keys = materialize(sets.withColumn("kg", name), "keys")
    groups = keys.groupBy("ticker", "kg").agg(F.count(F.lit(1)).alias("n"), F.first("classes").alias("classes"))
    pieces = with_pieces(groups.select("ticker", "kg", F.inline("classes")), p.levels).select(*MEET, "aps", "amask", "kg")
    return KeyPlan(keys.select("ticker", "kg", "key"), groups.select("ticker", "kg", "n"), pieces, p,
                   keys.select("ticker", "kg", "key", F.inline("rows")))


def _first_of(rows: DataFrame, k: KeyPlan, g: list, column: str) -> DataFrame:
    """The least (ts, request_id) of each (group, key group) among the requests whose windows hold it.

    Requests are reduced to their earliest per (group, spec) and per (group,
    piece, flag, labels) before they meet the key groups in the pieces.
    """
    kind = [c for c in [*MEET, "ps", "kmask"] if c not in g]
    first = rows.groupBy(*g, *[c for c in SPEC if c not in g]).agg(F.min(F.struct(*_ORDER)).alias(column))
    covered = k.in_pieces(first).groupBy(*g, *kind).agg(F.min(column).alias(column))
    sizes = k.pieces.groupBy(*MEET).agg(F.count(F.lit(1)).alias("n"))
    met = expand_classes(covered, k.pieces, sizes, on=MEET, salt_by="kg").where(matching())
    return met.groupBy(*g, *[c for c in KEYS if c not in g]).agg(F.min(column).alias(column))


def first_loads(requests: DataFrame, keys: KeyPlan, scope: str = "session") -> DataFrame:
    """Grow-mode ledger per key group: first (ts, request_id) per (group, key group), and the group's keys ``n``."""
    return _first_of(with_spec(_changed(requests)), keys, _group_cols(scope), "first").join(keys.groups, KEYS)


def _steps(requests: DataFrame, g: list, *more: str) -> DataFrame:
    """What a ledger needs of the changed requests: group, order, window and further columns."""
    return with_spec(_changed(requests)).select(*g, *_ORDER, *cells.WINDOW, *more, *[c for c in ["ticker"] if c not in g])


def load_ledger(requests: DataFrame, ann: DataFrame, mode: str = "grow", scope: str = "session",
                ack_col: str | None = None, max_keys: int | None = None, groups: KeyPlan | None = None) -> DataFrame:
    """WIN-7: which request ships each document.

    ``grow`` (default, relational): a key is shipped once, by the first changed
    request of its group whose filter matches it.  ``faithful``: the reference's
    order-dependent fold (an empty increment re-ships the whole matched set and
    *replaces* the loaded set).
    A key that stands in several announcement rows is one key.

    ``ack_col`` (grow mode, fixes Q5): a boolean column saying whether the
    request's upload was acknowledged.  Unacknowledged shipments do not count
    as loaded, so a key is shipped by every matching request up to and
    including the first *acknowledged* one (all of them if none is).

    ``max_keys`` (grow mode): the keys of a request in key order, as lists of at
    most so many, numbered ``batch_no`` (SNK-2 without a row for every key).

    ``groups`` (grow mode): the ledger by key group, ``kg`` of that plan instead of keys; announcements without a key have none.

    Output: group columns, ``key`` (or ``batch_no`` and ``keys``), ``request_id``, ``ts``.
    Scale: requests meet keys in cells (:mod:`quire.operators.cells`); no row of
    the ledger is shuffled or written before it is returned.  A group of the faithful fold is folded
    by one task, as each step depends on the one before.
    """
    if mode not in ("grow", "faithful"):
        raise ValueError("mode must be 'grow' or 'faithful'")
    g = _group_cols(scope)
    if groups and mode == "grow":
        return (first_loads(requests, groups, scope).where(F.col("kg") != NO_KEY)
                .select(*g, "kg", F.col("first.request_id").alias("request_id"), F.col("first.ts").alias("ts")))
    order, names = [*g, *_ORDER], [*g, "request_id", "ts"]
    steps = _steps(requests, g, *([ack_col] if ack_col and mode == "grow" else []))
    found = materialize(cells.members(ann), "cell-members")
    kinds, text = [steps.schema[c] for c in names], T.StringType()
    if max_keys and mode == "grow":
        schema = T.StructType([*kinds, T.StructField("batch_no", T.LongType()), T.StructField("keys", T.ArrayType(text))])
        return _meet(steps, found, g, cells.ledger_lists(g, order, names, max_keys, to_arrow_schema(schema)), schema, whole=True)
    schema = T.StructType([*kinds[:len(g)], T.StructField("key", text), *kinds[len(g):]])
    kind, told = ("acked" if ack_col else "grow"), ack_col
    if mode == "faithful":
        # whether a request re-ships all depends on all keys of its ticker; once that is known, keys are independent
        kind, told = "faithful", "again"
        flagged = T.StructType([*steps.schema, T.StructField(told, T.BooleanType())])
        steps = materialize(_meet(steps, found, g, cells.faithful_steps(g, order, to_arrow_schema(flagged)), flagged, whole=True),
                            "faithful-shipped")
    return _meet(steps, found, g, cells.ledger_rows(g, order, kind, names, to_arrow_schema(schema), told), schema)


def _meet(steps: DataFrame, found: DataFrame, g: list, make, schema: T.StructType, whole: bool = False) -> DataFrame:
    """Ledgers of a session are independent, so a ticker's sessions may be shared out; a store's ledger is one."""
    return cells.meet(steps, found, [*g, *_ORDER], make, schema, [c for c in g if c != "ticker"], whole)


def new_counts(requests: DataFrame, ann: DataFrame, scope: str = "session") -> DataFrame:
    """A row for every changed request: announcements matched, and documents new under the grow ledger.

    Rows that are one request (equal in group, ``ts`` and ``request_id``) have its new documents once between them.
    """
    g = _group_cols(scope)
    steps = _steps(requests, g)
    schema = T.StructType([steps.schema["request_id"], T.StructField("n_matched", T.LongType()), T.StructField("n_new", T.LongType())])
    make = cells.ledger_counts(g, [*g, *_ORDER], to_arrow_schema(schema))
    return _meet(steps, materialize(cells.members(ann), "cell-members"), g, make, schema)


def fold_faithful(batches: Iterator[pa.RecordBatch], n_group: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sequential faithful fold over rows (group columns, ts, request_id, kg) in that order, where matches are rows.

    Rows of a request are adjacent and so are requests of a group.  What is
    held is the loaded set of one group and the matched key groups of one
    request; shipped rows leave in batches.  An increment is shipped and added;
    without one, the whole matched set is shipped and *replaces* the loaded set.
    """
    group = request = None
    loaded: set = set()
    matched: dict = {}
    shipped: list[tuple] = []

    def step() -> None:
        nonlocal loaded
        ship = [c for c in matched if c not in loaded] or list(matched)
        if all(c in loaded for c in ship):
            loaded = set(ship) if ship else loaded
        else:
            loaded.update(ship)
        shipped.extend((*group, *request, c) for c in ship)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_group] != group or row[n_group:-1] != request:
                if request is not None:
                    step()
                if row[:n_group] != group:
                    group, loaded = row[:n_group], set()
                request, matched = row[n_group:-1], {}
            if row[-1] is not None:
                matched[row[-1]] = None
            if len(shipped) >= _OUT_ROWS:
                yield _batch(shipped, out)
                shipped = []
    if request is not None:
        step()
    if shipped:
        yield _batch(shipped, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def doc_counts(requests: DataFrame, ann: DataFrame, scope: str = "session") -> DataFrame:
    """AGG-2: new documents per changed request (grow mode); 0 shows via a left join."""
    changed = _changed(requests)
    per_req = new_counts(changed, ann, scope).groupBy("request_id").agg(F.sum("n_new").alias("n_new"))
    return (changed.select("request_id").join(per_req, "request_id", "left")
            .select("request_id", F.coalesce(F.col("n_new"), F.lit(0)).cast("bigint").alias("n_new")))


def bounded_batches(df: DataFrame, by: list, order_col: str = "key", max_items: int = 1000,
                    ) -> DataFrame:
    """Number the rows of each ``by`` group in ``order_col`` order and cut them into
    batches of at most ``max_items``: adds ``batch_no``.

    Numbers come from an ordered scan over range pieces (local numbers plus
    the piece's offset), the same way at every size, so no task holds a group.
    """
    numbered = ordered_scan(df.withColumn("_one", F.lit(1)), list(by), [order_col], running={"_no": F.col("_one")})
    return (numbered.withColumn("batch_no", F.floor((F.col("_no") - 1) / F.lit(max_items)).cast("bigint"))
            .drop("_one", "_no"))


def build_manifests(ledger: DataFrame, bucket: str = "documents", max_keys: int = 1000) -> DataFrame:
    """SNK-2: JSON ingest manifests, one per (request, batch), at most ``max_keys`` keys.

    Keys of a request are numbered in key order and cut into batches of
    ``max_keys`` (:func:`bounded_batches`), so a request of n keys has
    ``ceil(n / max_keys)`` manifests.  A ledger whose keys are numbered lists
    already (``load_ledger(max_keys=...)``) is rendered as it is.
    """
    if "keys" not in ledger.columns:
        batched = bounded_batches(ledger, ["request_id"], "key", max_keys)
        return _rendered(batched.groupBy("session_id", "ticker", "request_id", "batch_no")
                         .agg(F.sort_array(F.collect_list("key")).alias("keys")), bucket)
    return _rendered(ledger.withColumn("keys", F.filter("keys", lambda k: k.isNotNull())), bucket)


def _rendered(lists: DataFrame, bucket: str) -> DataFrame:
    vs_id = store_name(F.col("ticker"))
    payload = F.struct(F.array(F.struct(F.struct(
        F.struct(F.lit(bucket).alias("name")).alias("bucket"),
        F.struct(F.col("keys").alias("keys"), vs_id.alias("vs_id")).alias("object"),
    ).alias("s3"))).alias("Records"))
    return lists.select("session_id", "ticker", "request_id", "batch_no",
                        F.size("keys").cast("bigint").alias("n_keys"), F.to_json(payload).alias("payload"))
