"""Evidence checks stated by the answer rules (S-20): conflicting values per fact.

Per (entity, fact): ``conflicting`` when more than one distinct value is
reported, and the most recent value (recency breaks conflicts).  Both are
plain aggregates, so they combine map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def conflicts(df: DataFrame, entity: str, fact: str, value: str, date: str) -> DataFrame:
    return df.groupBy(entity, fact).agg(
        (F.countDistinct(value) > 1).alias("conflicting"),
        F.max_by(value, date).alias("latest_value"),
        F.count(F.lit(1)).alias("n_reports"))
