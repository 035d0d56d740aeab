"""Requests meet the announcements of their ticker in cells, without rows for pairs on the way.

A **cell** holds the announcements of a ticker (:class:`Members`) and a share
of its requests.  Its announcements come first and stay; its requests then pass
by in the order asked for.  Keys whose rows fall into the same classes (day,
price flag, labels) form a **key group**, which a request matches as a whole,
and the groups that pass a flag and a label mask lie sorted by day, so a window
is a slice of them.  What a group of requests has loaded is one number for each
key group.  Only what a query returns leaves a cell: counts, or the shipped keys.

A ticker with more than its part of all requests is spread over several cells by
the columns that name a ledger (``share_by``), and its announcements go to each.
Announcements of a ticker beyond ``CELL_ROWS`` are cut into blocks by key and
its requests go to each, wherever a key does not depend on other keys.  What is
shuffled is thus requests and announcements, and a task holds one cell's
announcements and a batch of requests.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quire.functions.taxonomy import label_mask
from quire.session import materialize

CELL_ROWS = 500_000     # announcements of a cell, where they can be cut by key
OUT_ROWS = 1 << 16      # rows of an Arrow batch that leaves a cell, about
_SETS = 1 << 21         # key groups kept for windows that come again
_LONG = 8               # keys of more classes are groups of their own
MEMBER = ["key", "date", "aps", "amask"]
WINDOW = ["date_from", "date_to", "ps", "kmask"]


def members(ann: DataFrame, *more: str) -> DataFrame:
    """ticker, MEMBER and further columns of the announcements that a request can match."""
    return (ann.where(F.col("ticker").isNotNull() & F.col("date").isNotNull())
            .select("ticker", "key", "date", F.coalesce(F.col("is_price_sensitive"), F.lit(False)).alias("aps"),
                    label_mask(F.col("announcement_types")).alias("amask"), *more))


def meet(requests: DataFrame, found: DataFrame, order: list, make: Callable, schema: StructType,
         share_by: list | None = None, whole: bool = False) -> DataFrame:
    """What ``make(members)`` gives for the requests of each cell.

    ``found``: :func:`members`, materialised.  ``make`` takes a cell's members (an Arrow
    table) and returns a function from (requests as an Arrow table, whether they are the cell's
    last) to batches of ``schema``; requests come in ``order``, and those equal in it together
    (without it, in any order).
    ``share_by``: requests equal in these columns must share a cell (without them all
    requests of a ticker).  ``whole``: all keys of a ticker must share a cell.
    """
    spark = requests.sparkSession
    requests = materialize(requests, "cell-requests")
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked, had = requests.columns, [c for c in found.columns if c != "ticker"]

    # the tickers above one cell are few: a part of all requests or CELL_ROWS announcements each
    part = F.ceil(F.col("q") * nparts / F.lit(max(1, requests.count()))).cast("int")
    rows = F.ceil(F.col("m") / F.lit(CELL_ROWS)).cast("int")
    shares, blocks = (part, F.lit(1) if whole else rows) if share_by else (F.lit(1), F.lit(1) if whole else F.greatest(part, rows))
    large = (requests.groupBy("ticker").agg(F.count(F.lit(1)).alias("q"))
             .join(found.groupBy("ticker").agg(F.count(F.lit(1)).alias("m")), "ticker")
             .select("ticker", shares.alias("shares"), blocks.alias("blocks"))
             .where("shares > 1 or blocks > 1").toArrow())
    if large.num_rows:
        sizes = F.broadcast(spark.createDataFrame(large))
        requests, found = requests.join(sizes, "ticker", "left"), found.join(sizes, "ticker", "left")
    else:
        one = F.lit(1)
        requests, found = (x.withColumns({"shares": one, "blocks": one}) for x in (requests, found))
    n_shares, n_blocks = F.coalesce("shares", F.lit(1)), F.coalesce("blocks", F.lit(1))
    share = F.pmod(F.xxhash64(*share_by), n_shares).cast("int") if share_by else F.lit(0)
    block = F.lit(0) if whole else F.pmod(F.xxhash64("key"), n_blocks).cast("int")
    q = requests.select(*[F.col(c).alias(f"q_{c}") for c in asked], F.col("ticker"), share.alias("share"),
                        F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.lit(1).alias("side"))
    m = found.select(*[F.col(c).alias(f"m_{c}") for c in had], F.col("ticker"), block.alias("block"),
                     F.explode(F.sequence(F.lit(0), n_shares - 1)).alias("share"), F.lit(0).alias("side"))
    cell = ["ticker", "share", "block"]
    both = (m.unionByName(q, allowMissingColumns=True).repartition(nparts, *cell)
            .sortWithinPartitions(*cell, "side", *[f"q_{c}" for c in order]))
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return in_cells(batches, cell, had, asked, order, make, out)

    return both.mapInArrow(run, schema)


def changes(t: pa.Table | pa.RecordBatch, columns: list) -> np.ndarray:
    """Whether a row differs from the one before it (null equals null); the first does."""
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for name in columns:
        column = t.column(name)
        code = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = np.asarray(code.dictionary_encode(null_encoding="encode").indices)
        change[1:] |= code[1:] != code[:-1]
    return change


def in_cells(batches: Iterator[pa.RecordBatch], cell: list, had: list, asked: list, order: list, make: Callable,
             out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The stream of one partition: cells one after another, of each its members and then its requests in order."""
    current, own, step, held = None, [], None, None
    kinds = None

    def requests(last: bool) -> Iterator[pa.RecordBatch]:
        """Passes on the requests that are complete: of the latest step more may come."""
        nonlocal step, held
        if step is None:
            if not own:
                step = make(kinds.empty_table())
            else:
                step = make(pa.Table.from_batches(own).combine_chunks())
            own.clear()
        end = held.num_rows if last or not order else int(np.flatnonzero(changes(held, order))[-1])
        done, held = held.slice(0, end), held.slice(end) if end < held.num_rows else None
        if done.num_rows:
            yield from step(done.combine_chunks(), last)

    for batch in batches:
        if not batch.num_rows:
            continue
        if kinds is None:
            kinds = batch.select([f"m_{c}" for c in had]).rename_columns(had).schema
        starts = np.flatnonzero(changes(batch, [*cell, "side"]))
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            rows = batch.slice(start, end - start)
            at = tuple(rows.column(c)[0].as_py() for c in cell)
            if at != current:
                if held is not None:
                    yield from requests(True)
                current, step = at, None
                own.clear()
            if rows.column("side")[0].as_py() == 0:
                own.append(rows.select([f"m_{c}" for c in had]).rename_columns(had))
                continue
            more = pa.Table.from_batches([rows.select([f"q_{c}" for c in asked]).rename_columns(asked)])
            held = more if held is None else pa.concat_tables([held, more])
            yield from requests(False)
    if held is not None:
        yield from requests(True)


def _days(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Days since 1970; a null is the day before all others."""
    return np.asarray(pc.fill_null(pc.cast(column, pa.int32()), -(1 << 31)))


def _numbers(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def _passing(aps: np.ndarray, mask: np.ndarray, ps: bool, kmask: int) -> np.ndarray:
    """Numbers of the announcements that pass a flag and a label mask."""
    return np.flatnonzero((aps | (not ps)) & ((mask & kmask != 0) | (kmask == 0)))


def _kinds(q: pa.Table) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Flag and label mask, and of the requests with it that have a window: their numbers, first and last day."""
    from_, to = _days(q.column("date_from")), _days(q.column("date_to"))
    absent = np.asarray(pc.or_(pc.is_null(q.column("date_from")), pc.is_null(q.column("date_to"))))
    kinds, of = np.unique(np.asarray(q.column("kmask")).astype(np.int64) << 1 | np.asarray(q.column("ps")), return_inverse=True)
    for i, kind in enumerate(kinds.tolist()):
        mine = np.flatnonzero((of == i) & ~absent)
        yield bool(kind & 1), kind >> 1, mine, from_[mine], to[mine]


def _slices(day: np.ndarray, from_: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.searchsorted(day, from_)
    return low, np.maximum(low, np.searchsorted(day, to, side="right"))


def match_rows(names: list, had: list, out: pa.Schema) -> Callable:
    """For :func:`meet`: a row for every request and announcement it matches, with the columns ``names`` and ``had`` of them."""

    def make(t: pa.Table) -> Callable:
        t = t.take(pc.sort_indices(pc.cast(t.column("date").combine_chunks(), pa.int32())))
        day, aps, mask = _days(t.column("date")), np.asarray(t.column("aps").combine_chunks().cast(pa.uint8())).astype(bool), np.asarray(t.column("amask"))
        columns, passing = {c: t.column(c).combine_chunks() for c in had}, {}

        def step(q: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            asked = {c: q.column(c).combine_chunks() for c in names}
            for ps, kmask, mine, from_, to in _kinds(q):
                if (ps, kmask) not in passing:
                    passing[ps, kmask] = _passing(aps, mask, ps, kmask)
                some = passing[ps, kmask]
                low, high = _slices(day[some], from_, to)
                n = high - low
                upto = np.cumsum(n)
                cuts = np.searchsorted(upto, np.arange(OUT_ROWS, upto[-1] if len(upto) else 0, OUT_ROWS)) + 1
                for own in np.split(np.arange(len(mine)), np.unique(cuts)):
                    ends = np.cumsum(n[own])
                    if not len(ends) or not ends[-1]:
                        continue
                    row = np.repeat(mine[own], n[own])
                    found = some[np.repeat(low[own] - ends + n[own], n[own]) + np.arange(ends[-1])]
                    for s in range(0, len(row), OUT_ROWS):
                        a, b = pa.array(row[s:s + OUT_ROWS]), pa.array(found[s:s + OUT_ROWS])
                        yield pa.RecordBatch.from_arrays([(asked[f.name].take(a) if f.name in asked else columns[f.name].take(b)).cast(f.type)
                                                          for f in out], schema=out)

        return step

    return make


def kind_counts(column: str, out: pa.Schema) -> Callable:
    """For :func:`meet`: request_id, a value of ``column`` and the announcements with it that the request matches, if any.

    Members are counts ``n`` per day, flag, labels and value; sums up to each day give those of any window.
    """

    def make(t: pa.Table) -> Callable:
        coded = t.column(column).combine_chunks().dictionary_encode(null_encoding="encode")
        day, aps, mask = _days(t.column("date")), np.asarray(t.column("aps").combine_chunks().cast(pa.uint8())).astype(bool), np.asarray(t.column("amask"))
        order = np.lexsort((day, np.asarray(coded.indices)))
        value, day, aps, mask = np.asarray(coded.indices)[order], day[order], aps[order], mask[order]
        n, passing = np.asarray(t.column("n"))[order], {}

        def upto(ps: bool, kmask: int) -> list:
            """Of each value: its number, days, and sums before each."""
            some = _passing(aps, mask, ps, kmask)
            starts = np.flatnonzero(np.diff(value[some], prepend=-1))
            return [(int(value[x[0]]), day[x], np.append(0, np.cumsum(n[x]))) for x in np.split(some, starts[1:]) if len(x)]

        def step(q: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            ids = q.column("request_id").combine_chunks()
            for ps, kmask, mine, from_, to in _kinds(q):
                if (ps, kmask) not in passing:
                    passing[ps, kmask] = upto(ps, kmask)
                rows, values, counts = [], [], []
                for code, days, before in passing[ps, kmask]:
                    low, high = _slices(days, from_, to)
                    count = before[high] - before[low]
                    some = np.flatnonzero(count)
                    rows.append(mine[some])
                    values.append(np.full(len(some), code))
                    counts.append(count[some])
                if rows and sum(map(len, rows)):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(rows))).cast(out.field(0).type),
                                                      coded.dictionary.take(pa.array(np.concatenate(values))).cast(out.field(1).type),
                                                      pa.array(np.concatenate(counts).astype(np.int64))], schema=out)

        return step

    return make


class Members:
    """The announcements of a cell by key group.

    ``keys``: the distinct keys; the keys of group x are ``of_group[first[x]:first[x + 1]]``, and ``n`` has their number.
    """

    def __init__(self, t: pa.Table) -> None:
        coded = t.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
        self.keys, key = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
        day, aps = _days(t.column("date")).astype(np.int64), np.asarray(t.column("aps").combine_chunks().cast(pa.uint8()))
        kind = _numbers(day << 32 | np.asarray(t.column("amask")).astype(np.int64) << 1 | aps)     # class
        n_kinds = int(kind.max()) + 1 if len(kind) else 1
        pair, at, rows = np.unique(key * n_kinds + kind, return_index=True, return_counts=True)    # sorted by key, then class
        key, kind = key[at], kind[at]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        held = np.diff(np.append(starts, len(key)))
        group, more = kind[starts].copy(), held > 1
        for i in range(1, min(_LONG, int(held.max()) if len(held) else 0)):
            some = held > i
            # pairs of (what it was so far, next class) as numbers beyond those of the shorter sets
            group[some] = _numbers(group[some] * n_kinds + kind[starts[some] + i]) + group[~some].max(initial=-1) + 1
        long = held > _LONG
        group[long] = np.arange(long.sum()) + group[~long].max(initial=-1) + 1
        group = _numbers(group)
        self.n = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        self.of_group = np.argsort(group, kind="stable")
        self.first = np.append(0, np.cumsum(self.n))
        entry = np.repeat(group, held)
        both, where, back = np.unique(entry * n_kinds + kind, return_index=True, return_inverse=True)
        self._rows = np.bincount(back, weights=rows, minlength=len(both)).astype(np.int64) if len(both) else np.zeros(0, np.int64)
        self._group, source = entry[where], at[where]
        self._day, self._aps = day[source], aps[source].astype(bool)
        self._mask = np.asarray(t.column("amask"))[source]
        by_day = np.argsort(self._day, kind="stable")
        self._rows, self._group, self._day, self._aps, self._mask = (
            x[by_day] for x in (self._rows, self._group, self._day, self._aps, self._mask))
        self.several = bool(more.any())
        self._passing: dict = {}
        self._stamp = np.zeros(len(self.n), np.int64)
        self._sets: dict = {}
        self._kept = 0

    def passing(self, ps: bool, kmask: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Day and group of what passes the flag and the labels, by day, and announcements before each."""
        if (ps, kmask) not in self._passing:
            ok = _passing(self._aps, self._mask, ps, kmask)
            self._passing[ps, kmask] = self._day[ok], self._group[ok], np.append(0, np.cumsum(self._rows[ok]))
        return self._passing[ps, kmask]

    def windows(self, q: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Flag and labels of each request, its slice of what passes them, and the announcements it matches."""
        kind = [(False, 0)] * q.num_rows
        low, high, n = (np.zeros(q.num_rows, np.int64) for _ in range(3))
        for ps, kmask, mine, from_, to in _kinds(q):
            day, _, before = self.passing(ps, kmask)
            low[mine], high[mine] = _slices(day, from_, to)
            n[mine] = before[high[mine]] - before[low[mine]]
            for i in mine.tolist():
                kind[i] = ps, kmask
        return kind, low, high, n

    def distinct(self, groups: np.ndarray) -> np.ndarray:
        number = np.arange(len(groups))
        self._stamp[groups] = number
        return groups[self._stamp[groups] == number]

    def matched(self, kind: tuple, low: int, high: int) -> np.ndarray:
        """The groups a request matches, each once."""
        groups = self.passing(*kind)[1][low:high]
        if not self.several or high - low < 2:
            return groups
        at = (kind, low, high)
        if at not in self._sets:
            if self._kept > _SETS:
                self._sets.clear()
                self._kept = 0
            self._sets[at] = self.distinct(groups)
            self._kept += high - low + 16
        return self._sets[at]

    def keys_of(self, groups: np.ndarray) -> np.ndarray:
        """Numbers of the keys of all groups, group by group."""
        n = self.n[groups]
        ends = np.cumsum(n)
        return self.of_group[np.repeat(self.first[groups] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


class Ledger:
    """Which request ships each key group, for requests that come ledger by ledger in their order.

    ``grow``: the first that matches it.  ``acked``: every one up to the first
    acknowledged one (column ``told``).  ``faithful``: an empty increment ships the whole
    matched set, which *replaces* the loaded set; with ``told`` a column says
    which requests do so.  Rows of one request (equal in ``order``) are one step.
    """

    def __init__(self, t: pa.Table, ledger: list, order: list, mode: str, told: str | None = None) -> None:
        self.m, self.ledger, self.order, self.mode, self.told = Members(t), ledger, order, mode, told
        self.loaded = np.zeros(len(self.m.n), np.int64)       # the ledger (its number) that has the group
        self.number, self.last = 0, None

    def steps(self, q: pa.Table) -> tuple[np.ndarray, np.ndarray, list, np.ndarray]:
        """Announcements matched by each row; the rows that ship, and the key groups of each; rows that re-ship all."""
        m, loaded = self.m, self.loaded
        kind, low, high, n = m.windows(q)
        new = changes(q, self.ledger)
        first = tuple(q.column(c)[0].as_py() for c in self.ledger)
        new[0] = first != self.last
        self.last = tuple(q.column(c)[-1].as_py() for c in self.ledger)
        starts = np.flatnonzero(changes(q, self.order))
        told = np.asarray(pc.fill_null(q.column(self.told), False)).tolist() if self.told else None
        # a ledger under a null name is not found again, so nothing in it counts as acknowledged for later rows
        nameless = np.any([np.asarray(pc.is_null(q.column(c))) for c in self.ledger], axis=0).tolist()
        low_, high_ = low.tolist(), high.tolist()
        rows, ships, again = [], [], np.zeros(q.num_rows, bool)

        def of(some: list) -> list:
            return [m.matched(kind[i], low_[i], high_[i]) for i in some if high_[i] > low_[i]]

        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), q.num_rows], strict=True):
            if new[s]:
                self.number += 1
            replaces = self.mode == "faithful" and told and told[s]
            if replaces:
                self.number += 1
            own = of(range(s, e))
            if not own:
                continue
            groups = own[0] if len(own) == 1 else m.distinct(np.concatenate(own))
            fresh = groups[loaded[groups] != self.number]
            if self.mode == "acked":
                sure = of([i for i in range(s, e) if told[i]])
                if nameless[s]:
                    rest = of([i for i in range(s, e) if not told[i]])
                    fresh = m.distinct(np.concatenate([*[x[loaded[x] != self.number] for x in sure], *rest]))
                for x in sure:
                    loaded[x] = self.number
            elif len(fresh):
                loaded[fresh] = self.number
            elif self.mode == "faithful" and not told:
                self.number += 1
                again[s:e] = True
                fresh = groups
                loaded[groups] = self.number
            if len(fresh):
                rows.append(s)
                ships.append(fresh)
        return n, np.array(rows, np.int64), ships, again


def ledger_rows(ledger: list, order: list, mode: str, names: list, out: pa.Schema, told: str | None = None) -> Callable:
    """For :func:`meet`: a row for every key that a request ships, with the request's columns ``names``."""

    def make(t: pa.Table) -> Callable:
        fold = Ledger(t, ledger, order, mode, told)

        def step(q: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            _, rows, ships, _ = fold.steps(q)
            sizes = np.array([fold.m.n[g].sum() for g in ships], np.int64)
            upto = np.cumsum(sizes)
            cuts = np.searchsorted(upto, np.arange(OUT_ROWS, upto[-1] if len(upto) else 0, OUT_ROWS)) + 1
            for some in np.split(np.arange(len(rows)), np.unique(cuts)):
                if not len(some):
                    continue
                key = fold.m.keys_of(np.concatenate([ships[i] for i in some]))
                row = np.repeat(rows[some], sizes[some])
                for s in range(0, len(key), OUT_ROWS):
                    at = pa.array(row[s:s + OUT_ROWS])
                    values = {c: q.column(c).combine_chunks().take(at) for c in names}
                    values["key"] = fold.m.keys.take(pa.array(key[s:s + OUT_ROWS]))
                    yield pa.RecordBatch.from_arrays([values[f.name].cast(f.type) for f in out], schema=out)

        return step

    return make


def ledger_counts(ledger: list, order: list, out: pa.Schema) -> Callable:
    """For :func:`meet`: a row for every request: request_id, the announcements it matches, the keys it ships first."""

    def make(t: pa.Table) -> Callable:
        fold = Ledger(t, ledger, order, "grow")

        def step(q: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            matched, rows, ships, _ = fold.steps(q)
            new = np.zeros(q.num_rows, np.int64)
            new[rows] = [fold.m.n[g].sum() for g in ships]
            yield pa.RecordBatch.from_arrays([q.column("request_id").combine_chunks().cast(out.field(0).type), pa.array(matched), pa.array(new)],
                                             schema=out)

        return step

    return make


def ledger_lists(ledger: list, order: list, names: list, max_keys: int, out: pa.Schema) -> Callable:
    """For :func:`meet`: the keys that a request ships in key order, in numbered lists of at most ``max_keys``."""

    def make(t: pa.Table) -> Callable:
        fold = Ledger(t, ledger, order, "grow")
        ordered = np.asarray(pc.sort_indices(fold.m.keys, null_placement="at_start")).astype(np.int64)
        place = np.empty(len(ordered), np.int64)
        place[ordered] = np.arange(len(ordered))
        keys = fold.m.keys.take(pa.array(ordered))

        def emit(q: pa.Table, rows: list, lists: list) -> pa.RecordBatch:
            numbers = [np.arange((len(x) + max_keys - 1) // max_keys) for x in lists]
            ends = [np.minimum((b + 1) * max_keys, len(x)) for x, b in zip(lists, numbers, strict=True)]
            before = np.cumsum([0, *map(len, lists)])[:-1]
            offsets = np.concatenate([[0], *[e + o for e, o in zip(ends, before, strict=True)]]).astype(np.int32)
            at = pa.array(np.repeat(rows, [len(b) for b in numbers]))
            values = {c: q.column(c).combine_chunks().take(at) for c in names}
            values["batch_no"] = pa.array(np.concatenate(numbers).astype(np.int64))
            values["keys"] = pa.ListArray.from_arrays(pa.array(offsets), keys.take(pa.array(np.concatenate(lists))))
            return pa.RecordBatch.from_arrays([values[f.name].cast(f.type) for f in out], schema=out)

        def step(q: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            _, rows, ships, _ = fold.steps(q)
            some, lists, n = [], [], 0
            for row, groups in zip(rows.tolist(), ships, strict=True):
                some.append(row)
                lists.append(np.sort(place[fold.m.keys_of(groups)]))
                n += len(lists[-1])
                if n >= OUT_ROWS:
                    yield emit(q, some, lists)
                    some, lists, n = [], [], 0
            if some:
                yield emit(q, some, lists)

        return step

    return make


def faithful_steps(ledger: list, order: list, out: pa.Schema) -> Callable:
    """For :func:`meet`: the requests as they came, and whether each re-ships all it matches."""

    def make(t: pa.Table) -> Callable:
        fold = Ledger(t, ledger, order, "faithful")

        def step(q: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
            again = pa.array(fold.steps(q)[-1])
            asked = [q.column(name).combine_chunks().cast(out.field(name).type) for name in out.names[:-1]]
            yield pa.RecordBatch.from_arrays([*asked, again], schema=out)

        return step

    return make
