"""Connected components by least labels, with pointer jumping; every round is staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(id, label) of every vertex of ``edges`` (a, b): the least id reachable.

    A round sends each vertex the least label of its neighbours (partial aggregation keeps a hub's
    messages to one a task), then follows the label's own label, so long chains take logarithmic rounds.
    ``labels`` are those of an earlier call whose edges are among those given.
    """
    both = staged(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "graph-edges")
    now = both.select(F.col("a").alias("id")).distinct().withColumn("label", F.col("id"))
    if labels is not None:
        old = labels.select("id", F.col("label").alias("old"))
        now = now.join(old, "id", "left").select("id", F.least("label", F.coalesce("old", "label")).alias("label"))
    now = staged(now, "graph-labels")
    while True:
        offers = both.join(now.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("offer"))
        hooked = now.join(offers.withColumnRenamed("a", "id"), "id", "left").select("id", F.col("label").alias("was"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        hooked = staged(hooked, "graph-hooked")
        target = hooked.select(F.col("id").alias("label"), F.col("label").alias("beyond"))
        # The label may itself have got a smaller label in this round.
        jumped = staged(hooked.join(target, "label", "left").select("id", "was", F.least("label", F.coalesce("beyond", "label")).alias("label")), "graph-labels")
        changed = jumped.where("was <> label").limit(1).count()
        now = jumped.select("id", "label")
        if not changed:
            return now
