"""Connected components of a graph given as rows of edges.

Each round points every node to the least of its neighbours and itself, and
from there one step further (pointer jumping), so chains halve.  Then the edges
are contracted: both ends are replaced by what they point to, and loops and
repeated edges go, so a round has fewer edges than the one before it.  A node
that others point to stays joined to what it points to itself, as the edges
that led there are contracted too.  Rounds are written to the shared folder: the
plan stays short and a lost executor costs only its own tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, label): every node of an edge with the least node reachable.

    Null ends and loops link nothing; repeated and reversed edges count once.
    """
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    both = materialize(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other")))
                       .distinct(), "edges")
    labels = None
    while True:
        low = materialize(both.groupBy("node").agg(F.min("other").alias("low"))
                          .select("node", F.least("node", "low").alias("label")), "labels-low")
        far = low.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = materialize(low.join(far, "label").select("node", F.col("far").alias("label")), "labels-step")
        if labels is None:
            labels = step
        else:
            next_ = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = materialize(labels.join(next_, "label", "left")
                                 .select("node", F.coalesce("next", "label").alias("label")), "labels")
        both = materialize(both.join(step, "node").select("other", F.col("label").alias("from"))
                           .join(step.withColumnRenamed("node", "other"), "other")
                           .select(F.col("from").alias("node"), F.col("label").alias("other"))
                           .where("node <> other").distinct(), "edges")
        if both.isEmpty():
            return labels
