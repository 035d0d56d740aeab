"""Ordered scans within groups that survive a hot group (previous value, running sum).

A window ``partitionBy(group).orderBy(order)`` sorts each whole group in one
task.  When one group (a session, a conversation) holds a large share of all
rows, that task does a large share of all the work.  :func:`ordered_scan`
gives the same columns as ``lag`` / running ``sum`` windows but splits every
group into *pieces*, at every input size:

1. the rows are range-partitioned on the whole sort key ``(group, order)``;
   the range bounds come from a sample, so a hot group spans several
   partitions.  The partition number becomes the ``_piece`` column and the
   result is written once to the shared checkpoint folder, so pieces stay
   stable when a lost executor forces recomputation;
2. the windows run per ``(group, _piece)``: each sort holds at most one
   range partition;
3. a piece table (one row per ``(group, _piece)``: the piece's last values and
   its totals) is scanned per group in piece order.  A group has at most as
   many pieces as there are range partitions, so this window is bounded;
4. only pieces that are not the first of their group need a correction, and
   there is at most one such piece per range partition, so the correction
   table is bounded by the partition count and is broadcast.

``split=False`` is the plain window, for callers that know their groups to be
small; nothing measures the input to choose between the two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

def _plain(df: DataFrame, group: list, order: list, prev: dict, running: dict) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    out = df
    for name, col in prev.items():
        out = out.withColumn(name, F.lag(col).over(w))
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, expr in running.items():
        out = out.withColumn(name, F.sum(expr).over(wr))
    return out


def ordered_scan(df: DataFrame, group: list, order: list, prev: dict | None = None,
                 running: dict | None = None, split: bool = True, pieces: int | None = None) -> DataFrame:
    """Add ``prev`` and ``running`` columns to ``df``.

    ``prev``: ``{out_name: column_name}`` -> value of the column in the previous
    row of the group (NULL for the first row), like ``lag``.
    ``running``: ``{out_name: Column}`` -> inclusive running sum of the
    expression in group order, like ``sum(...) over (rows unbounded preceding)``.
    ``order`` may hold Columns with a direction (``F.col("turn").desc()`` gives
    ``lead`` semantics); it must be a total order within each group.  On the
    piece path a running sum is re-associated (piece offset + local sum), so
    floating-point sums may differ in the last bits; integral sums are exact.
    """
    prev, running = dict(prev or {}), dict(running or {})
    if not split:
        return _plain(df, group, order, prev, running)

    spark = df.sparkSession
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = {name: f"_v_{i}" for i, name in enumerate(running)}
    base = df
    for name, expr in running.items():
        base = base.withColumn(sums[name], expr)
    cut = materialize(base.repartitionByRange(n, *group, *order)
                      .withColumn("_piece", F.spark_partition_id().cast("int")), "scan-pieces")

    w = Window.partitionBy(*group, "_piece").orderBy(*order)
    x = cut.withColumn("_rn", F.row_number().over(w))
    for name, col in prev.items():
        x = x.withColumn(name, F.lag(col).over(w))
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for name, v in sums.items():
        x = x.withColumn(name, F.sum(v).over(wr))

    aggs = [F.max_by(F.struct(*[F.col(c).alias(c) for c in prev.values()]), "_rn").alias("_last")] if prev else []
    aggs += [F.sum(v).alias(f"_t{v}") for v in sums.values()]
    pt = x.groupBy(*group, "_piece").agg(*aggs)
    pw = Window.partitionBy(*group).orderBy("_piece")
    fix = pt.withColumn("_k", F.row_number().over(pw))
    if prev:
        fix = fix.withColumn("_prev_last", F.lag("_last").over(pw))
    for v in sums.values():
        fix = fix.withColumn(f"_o{v}", F.sum(f"_t{v}").over(pw.rowsBetween(Window.unboundedPreceding, -1)))
    # at most one non-first piece per range partition: bounded by n, broadcast
    fix = fix.where(F.col("_k") > 1).drop("_k", "_last", *[f"_t{v}" for v in sums.values()])

    # null-safe on the group columns: a NULL group key is a group like any other
    keys = [*group, "_piece"]
    fix = fix.select(*[F.col(c).alias(f"_f{c}") for c in keys],
                     *[c for c in fix.columns if c not in keys])
    cond = [x[c].eqNullSafe(F.col(f"_f{c}")) for c in keys]
    out = x.join(F.broadcast(fix), cond, "left").drop(*[f"_f{c}" for c in keys])
    for name, col in prev.items():
        out = out.withColumn(name, F.when(F.col("_rn") == 1, F.col("_prev_last")[col]).otherwise(F.col(name)))
    for name, v in sums.items():
        local, off = F.col(name), F.col(f"_o{v}")
        out = out.withColumn(name, F.coalesce(local + off, local, off))
    drop = ["_piece", "_rn", *sums.values(), *[f"_o{v}" for v in sums.values()]]
    if prev:
        drop.append("_prev_last")
    return out.drop(*drop)
