"""Counting operators (AGG-1, AGG-2, AGG-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quire.functions.taxonomy import labels_array
from quire.operators import cells
from quire.operators.filters import with_spec
from quire.session import materialize


def type_counts_matched(matched: DataFrame, by=("request_id",)) -> DataFrame:
    """AGG-1 on an already matched long-form set: raw type string -> count (NULL is its own key)."""
    return matched.groupBy(*by, "announcement_types").agg(F.count(F.lit(1)).alias("n"))


def type_counts(requests: DataFrame, ann: DataFrame) -> DataFrame:
    """AGG-1 for many requests without materialising request x announcement pairs.

    Announcements are counted per (ticker, day, flag, labels, type string); in
    cells (:mod:`quire.operators.cells`) sums up to each day give the counts of any window.
    """
    asked = (with_spec(requests).where(F.col("ticker").isNotNull() & F.col("date_from").isNotNull() & F.col("date_to").isNotNull())
             .select("request_id", "ticker", *cells.WINDOW))
    found = materialize(cells.members(ann, "announcement_types").groupBy("ticker", "date", "aps", "amask", "announcement_types")
                        .agg(F.count(F.lit(1)).alias("n")), "type-days")
    schema = T.StructType([asked.schema["request_id"], T.StructField("announcement_types", T.StringType()),
                           T.StructField("n", T.LongType())])
    make = cells.kind_counts("announcement_types", to_arrow_schema(schema))
    return cells.meet(asked, found, [], make, schema, ["request_id"], whole=True)


def label_counts(ann: DataFrame, by=("ticker",)) -> DataFrame:
    """AGG-3: frequency per taxonomy label (multi-label: one announcement can count twice)."""
    return (ann.select(*by, F.explode(labels_array(F.col("announcement_types"))).alias("label"))
            .groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n")))
