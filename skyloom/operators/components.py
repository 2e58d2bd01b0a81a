"""Connected components by least labels with pointer jumping; every round is staged in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.sources.staging import stage


def label_components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, label) for every vertex ``v``, isolated ones too; ``links`` is (a, b) in both directions."""
    links = stage(links.select("a", "b").where("a <> b"), "links")
    now = stage(vertices.select("v", F.col("v").alias("label")), "labels")
    while True:
        least = links.join(now, links["b"] == now["v"]).groupBy("a").agg(F.min("label").alias("seen"))
        told = stage(now.join(least, now["v"] == least["a"], "left").select("v", F.col("label").alias("old"), F.least("label", F.coalesce("seen", "label")).alias("label")), "told")
        far = told.select(F.col("v").alias("label"), F.col("label").alias("further"))
        told2 = stage(told.join(far, "label").select("v", "old", F.least("label", "further").alias("label")), "labels")
        now = told2.select("v", "label")
        if told2.where("old <> label").isEmpty():
            return now
