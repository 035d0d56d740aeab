"""Announcement filters (FLT-1..7, PRJ-1/2) and request matching (JN-2).

Matching many requests against announcements
---------------------------------------------
A request matches an announcement when tickers are equal, the date lies in the
closed window, the price flag (if set) holds, and the type string matches one
of the request's *known* taxonomy labels (no known label -> no type filter).

Joining requests to announcements on the ticker evaluates every request of a
ticker against every announcement of it: quadratic, and a hot ticker lands in
one task.  Instead

* a request **spec** is (ticker, date_from, date_to, ps, kmask) where kmask is
  the bit mask of known labels; many requests may share one spec;
* the window boundaries of all specs of a ticker cut the calendar into numbered
  **segments**; announcements of one **class** (ticker, seg, aps, amask) match a
  spec all or none;
* windows become a few **pieces** of segments each (:mod:`quire.operators.cover`),
  so specs and classes meet in an equi-join on (ticker, piece), and counts and
  first requests are summed per piece before it.  A spec has at most 6 pieces
  for every fourfold of its segments, however many windows there are.

Nothing is joined on the ticker alone.  Only the final output joins classes
back to announcements, producing genuine matches.  Segments are numbered by a
window over *distinct (ticker, day)* rows, which the calendar bounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.taxonomy import label_mask, known_mask, type_predicate
from quire.functions.text import selected_types
from quire.operators.cover import LEVELS, PIECE, cover, holders, levels_for
from quire.session import materialize

ANN_COLUMNS = ["ticker", "url", "key", "announcement_types"]
SPEC = ["ticker", "date_from", "date_to", "ps", "kmask"]
CLASS = ["ticker", "seg", "aps", "amask"]
MEET = ["ticker", *PIECE]       # where specs and classes meet


@dataclass(frozen=True)
class FilterSpec:
    """One request's filter set (FLT-1..4)."""
    ticker: str
    date_from: str
    date_to: str
    price_sensitive: bool = False
    types: list = field(default_factory=list)


def select_announcements(ann: DataFrame, spec: FilterSpec, project: bool = True) -> DataFrame:
    """FLT-5: ticker equality, closed date window, optional flag, optional taxonomy.

    Predicates are built as Columns with bound values; the ticker and date
    conditions reach the parquet scan as pushed filters.  PRJ-1 keeps the four
    output columns.
    """
    conds = [
        F.col("ticker") == F.lit(spec.ticker),
        F.col("date").between(F.lit(spec.date_from).cast("date"), F.lit(spec.date_to).cast("date")),
    ]
    if spec.price_sensitive:
        conds.append(F.col("is_price_sensitive") == F.lit(True))
    tp = type_predicate(F.col("announcement_types"), spec.types)
    if tp is not None:
        conds.append(tp)
    out = ann.where(reduce(lambda a, b: a & b, conds))
    return out.select(*ANN_COLUMNS) if project else out


def select_keys(matched: DataFrame, by=("request_id",), as_list: bool = False, max_keys: int = 1000) -> DataFrame:
    """PRJ-2 / AGG-6: the key column (long form, primary), or sorted key lists per group.

    Lists are bounded: each holds at most ``max_keys`` keys (``batch_no``
    numbers them), so a hot group never becomes one huge array.
    """
    if not as_list:
        return matched.select(*by, "key")
    from quire.operators.ingest import bounded_batches
    b = bounded_batches(matched.select(*by, "key"), list(by), "key", max_keys)
    return b.groupBy(*by, "batch_no").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def normalise_window(requests: DataFrame, as_of: str | Column, default_days: int = 180,
                     max_days: int = 365) -> DataFrame:
    """FLT-6: default from = as_of - 180 d, to = as_of; both clamped to [as_of - 365 d, as_of].

    ``as_of`` is a parameter (never the wall clock) so results repeat: a date for
    all requests, or a column with each request's own day.
    """
    a = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    lo = F.date_sub(a, max_days)

    def clamp(c: Column) -> Column:
        return F.least(F.greatest(c, lo), a)

    return (requests
            .withColumn("date_from", clamp(F.coalesce(F.col("date_from"), F.date_sub(a, default_days))))
            .withColumn("date_to", clamp(F.coalesce(F.col("date_to"), a))))


def classify(requests: DataFrame, mode_col: str = "mode") -> DataFrame:
    """FLT-7: status per request; rows are labelled, never dropped.

    ``disabled`` without ticker or mode (input is blocked), else by mode:
    ``generate``, ``search``, anything else ``invalid`` (the warning path).
    """
    t, m = F.col("ticker"), F.col(mode_col)
    status = (F.when(t.isNull() | (t == "") | m.isNull() | (m == ""), F.lit("disabled"))
              .when(m == "Generate", F.lit("generate"))
              .when(m == "Search", F.lit("search"))
              .otherwise(F.lit("invalid")))
    return requests.withColumn("status", status)


# --------------------------------------------------------------------------
# class machinery for JN-2 and everything built on it
# --------------------------------------------------------------------------

def with_spec(requests: DataFrame) -> DataFrame:
    """Add the spec columns ``ps`` (flag, NULL -> false) and ``kmask`` (known labels)."""
    return (requests
            .withColumn("ps", F.coalesce(F.col("price_sensitive"), F.lit(False)))
            .withColumn("kmask", known_mask(selected_types(F.col("types")))))


def _spec_table(spec_rows: DataFrame) -> DataFrame:
    return spec_rows.where(F.col("ticker").isNotNull() & F.col("date_from").isNotNull()
                           & F.col("date_to").isNotNull()).select(*SPEC).distinct()


def _calendar(specs: DataFrame, ann: DataFrame) -> DataFrame:
    """(ticker, d, edge, seg): windows' edges with their number, days of announcements with their segment.

    Segment q is the days from edge q up to the day before edge q + 1.
    """
    edges = (specs.select("ticker", F.explode(F.array(F.col("date_from"), F.date_add(F.col("date_to"), 1))).alias("d"))
             .distinct().withColumn("edge", F.lit(1)))
    days = ann.select("ticker", F.col("date").alias("d")).distinct().withColumn("edge", F.lit(0))
    upto = Window.partitionBy("ticker").orderBy("d", F.desc("edge")).rowsBetween(Window.unboundedPreceding, 0)
    return edges.unionByName(days).withColumn("seg", F.sum("edge").over(upto).cast("int"))


def matching(flag: str = "ps", mask: str = "kmask") -> Column:
    """Price flag and labels of a spec against those of a class."""
    return ((~F.col(flag) | F.col("aps"))
            & ((F.col(mask) == 0) | (F.col("amask").bitwiseAND(F.col(mask)) != 0)))


def with_pieces(classes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """A row for every piece that holds the class's segment."""
    return classes.select("*", F.inline(holders(F.col("seg"), levels)))


@dataclass
class MatchPlan:
    """Intermediate tables of what is matched by classes (JN-3, :class:`quire.operators.ingest.KeyPlan`)."""
    requests: DataFrame      # requests with spec columns
    ann: DataFrame           # announcements with class columns
    specs: DataFrame         # SPEC + seg_from, seg_end: the segments of the window are seg_from .. seg_end - 1
    levels: int = LEVELS     # of pieces

    def classes(self, *more: str) -> DataFrame:
        """CLASS and further columns with ``n``, the announcements of each."""
        return self.ann.groupBy(*CLASS, *more).agg(F.count(F.lit(1)).alias("n"))

    def spec_pieces(self) -> DataFrame:
        """SPEC + PIECE: the pieces of each spec's window."""
        return self.specs.select(*SPEC, F.inline(cover(F.col("seg_from"), F.col("seg_end"), self.levels)))

    def counts(self, *more: str) -> DataFrame:
        """SPEC (and ``more`` columns of announcements) with ``n``, the matching announcements.

        Announcements are counted per piece first, so the join has a row for
        every piece of a spec and kind of announcement in it, whatever their number.
        """
        kind = [*MEET, "aps", "amask", *more]
        pieces = with_pieces(self.classes(*more), self.levels).groupBy(*kind).agg(F.sum("n").alias("n"))
        return (self.spec_pieces().join(pieces, MEET).where(matching())
                .groupBy(*SPEC, *more).agg(F.sum("n").alias("n")))

    @cached_property
    def spec_class(self) -> DataFrame:
        """SPEC + CLASS + n: the classes that each spec matches, each once."""
        return (self.spec_pieces().join(with_pieces(self.classes(), self.levels), MEET).where(matching())
                .select(*SPEC, *CLASS[1:], "n"))


def plan_matches(requests: DataFrame, ann: DataFrame, write: bool = True) -> MatchPlan:
    """Build the shared tables.

    The classified announcements and the specs feed several consumers, so with
    ``write`` they are written once under the shared checkpoint folder and read
    back: consumers stop recomputing the announcement joins and windows, plans
    stay small, and a lost executor re-reads files instead of recomputing
    upstream stages.
    """
    req = with_spec(requests)
    specs = _spec_table(req)
    a = ann.join(specs.select("ticker").distinct(), "ticker", "left_semi").where(F.col("date").isNotNull())
    calendar = _calendar(specs, a)
    if write:
        calendar = materialize(calendar, "calendar")
    edges = calendar.where("edge = 1")
    numbered = (specs
                .join(edges.select("ticker", F.col("d").alias("date_from"), F.col("seg").alias("seg_from")), ["ticker", "date_from"])
                .withColumn("_after", F.date_add("date_to", 1))
                .join(edges.select("ticker", F.col("d").alias("_after"), F.col("seg").alias("seg_end")), ["ticker", "_after"])
                .select(*SPEC, "seg_from", "seg_end"))
    ann_c = (a.join(calendar.where("edge = 0").select("ticker", F.col("d").alias("date"), "seg"), ["ticker", "date"])
             .withColumn("aps", F.coalesce(F.col("is_price_sensitive"), F.lit(False)))
             .withColumn("amask", label_mask(F.col("announcement_types"))))
    if write:
        ann_c, numbered = materialize(ann_c, "ann-classes"), materialize(numbered, "specs")
    segments = numbered.agg(F.max("seg_end")).first()[0] or 1
    return MatchPlan(req, ann_c, numbered, levels_for(segments))


def expand_classes(rows: DataFrame, members: DataFrame, sizes: DataFrame,
                   target_rows: int = 1_000_000, on: list = CLASS, salt_by: str = "key") -> DataFrame:
    """Join class-level ``rows`` to the announcements (``members``) of their class.

    This is the one join whose output (rows of a class x members of the
    class) is far larger than its inputs.  Left alone, adaptive execution
    sizes it by its small inputs and coalesces it into very few tasks, and a
    hot class lands in one task.  So each class is cut into ``_s`` salt
    buckets from its expected output (``rows x n / target_rows``, ``n`` from
    ``sizes``, at most the shuffle-partition count): a member goes to one
    bucket by the hash of ``salt_by``, a class row is copied to each bucket.  Both sides are
    repartitioned explicitly to the configured shuffle partitions, which
    adaptive execution keeps, so the expansion runs on every core.  ``on``
    names the class columns (default :data:`CLASS`).
    """
    on = list(on)
    nparts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_r"))
    salts = (per.join(sizes.select(*on, "n").dropDuplicates(on), on)
             .select(*on, F.least(F.lit(nparts), F.greatest(F.lit(1), F.ceil(
                 F.col("_r") * F.col("n") / F.lit(target_rows)))).cast("int").alias("_s")))
    keys = [*on, "_salt"]
    r = (rows.join(salts, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
         .drop("_s"))
    m = (members.join(salts, on).withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.col("_s")).cast("int"))
         .drop("_s"))
    return r.repartition(nparts, *keys).join(m.repartition(nparts, *keys), keys).drop("_salt")


def match_requests(requests: DataFrame, ann: DataFrame, columns: list | None = None, groups=None) -> DataFrame:
    """JN-2: one row per (request, matched announcement), all requests at once.

    Output: ``columns`` of requests (default: all), then ``key``, ``url``, ``announcement_types``, ``date``,
    or of those the ones in ``columns``.  Scale: requests meet announcements in cells
    (:mod:`quire.operators.cells`), so no pair is shuffled or written before it is returned.

    ``groups`` (a key plan): matches by key group instead, with ``kg`` and its class in place of the
    announcement's columns; the plan's ``expand`` gives the rows.
    """
    from quire.operators import cells

    if groups is not None:
        return groups.matches(requests.select(*[c for c in requests.columns if columns is None or c in [*columns, *SPEC, "price_sensitive", "types"]]))
    r = with_spec(requests).where(F.col("ticker").isNotNull() & F.col("date_from").isNotNull() & F.col("date_to").isNotNull())
    ours = ["key", "url", "announcement_types", "date"]
    names = [c for c in requests.columns if columns is None or c in columns]
    had = [c for c in ours if columns is None or c in columns]
    more = [c for c in ("url", "announcement_types") if c in had]
    found = materialize(cells.members(ann, *more), "cell-members")
    asked = r.select(*dict.fromkeys([*names, "request_id", "ticker", *cells.WINDOW]))
    schema = T.StructType([*[asked.schema[c] for c in names], *[found.schema[c] for c in had]])
    return cells.meet(asked, found, [], cells.match_rows(names, had, to_arrow_schema(schema)), schema, ["request_id"])
